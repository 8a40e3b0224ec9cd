"""Approximate nearest neighbours by largest inner product, with a vantage-point tree for each shard.

One more coordinate, the root of what a vector's square falls short of the largest one, turns the largest inner product
into the smallest distance (queries have 0 there). Each shard builds a tree: a node splits its vectors at the median
distance to a vantage point, a query visits the near side first, and skips a side that the triangle inequality puts
beyond `factor` times its distance to the k-th neighbour so far. Factor 1 gives the exact neighbours; below, sides that
could hold a neighbour are skipped. Shards and query blocks have a bounded number of vectors, whatever the cluster, so
answers depend on the table alone. Trees are built once, written, and then meet each block of queries in a group of their own.

Of equal vectors only the k + 1 with the smallest ids can be among any query's k, so only these go on. Vectors that are
null or zero or have null or non-finite components take no part, nor do rows with a null id; repeated rows count once;
vectors of another length than the query have no product with it and do not meet it. Fewer than k candidates give
fewer rows, and an empty table none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARD, BLOCK, LEAF = 1 << 14, 1 << 13, 512
#: Queries that go down a tree together.
TOGETHER = 2048
FACTOR = 0.25


class Tree:
    """Vectors split by vantage points, those of a leaf side by side; nodes are rows of (vantage or -1, inner, outer, begin, end)."""

    def __init__(self, top: float, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, cuts: np.ndarray) -> None:
        self.top, self.ids, self.vectors, self.nodes, self.cuts = top, ids, vectors, nodes, cuts

    @classmethod
    def built(cls, ids: np.ndarray, vectors: np.ndarray, top: float, seed: int = 1) -> Tree:
        extra = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", vectors, vectors), 0))
        rng, nodes, cuts, order = np.random.default_rng(seed), [], [], []

        def apart(at: np.ndarray, v: int) -> np.ndarray:
            return np.sqrt(np.maximum(2 * (top**2 - vectors[at] @ vectors[v] - extra[at] * extra[v]), 0))

        def split(at: np.ndarray) -> int:
            own = len(nodes)
            nodes.append([-1, -1, -1, sum(map(len, order)), 0])
            cuts.append(0.0)
            if len(at) <= LEAF:
                order.append(at)
            else:
                few = rng.choice(at, min(len(at), 128), replace=False)
                v = max(few[:4], key=lambda c: apart(few, c).std())
                d = apart(at, v)
                cut = float(np.median(d))
                near = d < cut
                if near.all() or not near.any():  # all at one distance: nothing to tell them apart by
                    near = np.arange(len(at)) < len(at) // 2
                else:
                    nodes[own][0], cuts[own] = v, cut
                nodes[own][1:3] = split(at[near]), split(at[~near])
            nodes[own][4] = sum(map(len, order))
            return own

        split(np.arange(len(ids)))
        order, table = np.concatenate(order), np.array(nodes)
        place = np.empty(len(ids) + 1, np.int64)
        place[order], place[-1] = np.arange(len(ids)), -1
        table[:, 0] = place[table[:, 0]]
        return cls(top, ids[order], vectors[order], table, np.array(cuts))

    def packed(self) -> bytes:
        return pickle.dumps((self.top, self.ids, self.vectors, self.nodes, self.cuts), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        return cls(*pickle.loads(data))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of each query's k nearest, -inf and -1 where there are fewer."""
        best, found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1)
        for start in range(0, len(ids), TOGETHER):
            part = slice(start, start + TOGETHER)
            self.own, self.q, self.square, self.k, self.factor = ids[part], queries[part], np.einsum("ij,ij->i", queries[part], queries[part]), k, factor
            self.best, self.found = best[part], found[part]
            self.visit(0, np.arange(len(self.own)))
        return best, found

    def visit(self, node: int, asks: np.ndarray) -> None:
        if not len(asks):
            return
        v, inner, outer, begin, end = self.nodes[node]
        if inner < 0:
            self.compare(asks, begin, end)
            return
        if v < 0:
            self.visit(inner, asks)
            self.visit(outer, asks)
            return
        cut = self.cuts[node]
        d = np.sqrt(np.maximum(self.square[asks] + self.top**2 - 2 * (self.q[asks] @ self.vectors[v]), 0))
        near = d < cut
        self.visit(inner, asks[near])
        self.visit(outer, asks[~near])
        reach = self.factor * np.sqrt(np.maximum(self.square[asks] + self.top**2 - 2 * self.best[asks, -1], 0)) + 1e-9
        self.visit(outer, asks[near & (d + reach >= cut)])
        self.visit(inner, asks[~near & (d - reach < cut)])

    def compare(self, asks: np.ndarray, begin: int, end: int) -> None:
        """Take the vectors of a leaf into the k best; the products pick those that can be among them, ranks go by each pair's own sum."""
        scores = self.q[asks] @ self.vectors[begin:end].T
        scores[self.own[asks][:, None] == self.ids[None, begin:end]] = -np.inf
        some = np.broadcast_to(np.arange(end - begin), scores.shape)
        if scores.shape[1] > 2 * self.k:
            cut = np.maximum(np.partition(scores, -self.k, axis=1)[:, -self.k], self.best[asks, -1])
            # the two ways to add up differ by rounding only: what comes as near as that stays
            slack = 1e-12 * (1 + self.top * np.sqrt(self.square[asks]))
            width = max(1, int((scores >= (cut - slack)[:, None]).sum(axis=1).max()))
            some = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            scores = np.take_along_axis(scores, some, 1)
        r, c = np.nonzero(np.isfinite(scores))
        exact = np.full(scores.shape, -np.inf)
        exact[r, c] = np.einsum("ij,ij->i", self.q[asks[r]], self.vectors[begin + some[r, c]])
        both, places = np.hstack([self.best[asks], exact]), np.hstack([self.found[asks], begin + some])
        label = np.where(np.isfinite(both), self.ids[places], np.iinfo(np.int64).max)
        order = np.lexsort((label, -both), axis=1)[:, : self.k]
        self.best[asks], self.found[asks] = np.take_along_axis(both, order, 1), np.take_along_axis(places, order, 1)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec (components as 64-bit floats, joined), n (their number), square: rows that take part, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, sizes, squares = [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                square = float(v @ v)
                if len(v) and np.isfinite(v).all() and v.any():
                    ids.append(i)
                    packed.append(v.tobytes())
                    sizes.append(len(v))
                    squares.append(square)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32()), pa.array(squares, pa.float64())], ["id", "vec", "n", "square"])

    return df.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(run, "id long, vec binary, n int, square double").distinct()


def search(df: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank int, vec_id, score double: for the rows where `asks` (over the key) holds, their k nearest of all other rows."""
    rows = saved(usable(df, key, vector), "vectors")
    queries = rows.where(asks)
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("n", "vec").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    size, squares = rows.agg(F.count("*"), F.max("square")).collect()[0]
    wide, deep = max(1, -(-size // shard)), max(1, -(-queries.count() // block))
    top = float(np.sqrt(squares or 1.0))

    def dealt(of: DataFrame, own: str, n: int) -> DataFrame:
        return of.withColumn(own, F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n)).cast("int"))

    def with_each(of: DataFrame, other: str, m: int) -> DataFrame:
        return of.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def build(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("id")
        tree = Tree.built(held["id"].to_numpy(), np.frombuffer(b"".join(held["vec"]), np.float64).reshape(len(held), -1), top)
        return pd.DataFrame({"shard": [key[0]], "n": [key[1]], "tree": [tree.packed()]})

    def run(key: tuple, trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        for data in trees["tree"] if len(asked) else ():
            own, q, tree = asked["id"].to_numpy(), np.frombuffer(b"".join(asked["vec"]), np.float64).reshape(len(asked), -1), Tree.unpacked(data)
            best, found = tree.search(own, q, k, factor)
            r, c = np.nonzero(np.isfinite(best))
            out.append(pd.DataFrame({"query_id": own[r], "vec_id": tree.ids[found[r, c]], "score": best[r, c]}))
        return pd.concat(out)

    trees = saved(dealt(few, "shard", wide).select("shard", "n", "id", "vec").groupBy("shard", "n").applyInPandas(build, "shard int, n int, tree binary"), "trees")
    trees, queries = with_each(trees, "block", deep), with_each(dealt(queries, "block", deep).select("block", "n", "id", "vec"), "shard", wide)
    near = trees.groupBy("shard", "block", "n").cogroup(queries.groupBy("shard", "block", "n")).applyInPandas(run, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
