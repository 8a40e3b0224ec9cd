"""N-gram Jaccard join with count vectors in R-trees: which texts share four fifths or more of their 5-word shingles.

A text's set is its distinct shingles of SIZE words (with fewer words the whole sequence), each a 48-bit number. Equal
sets are one node. Shingles are hashed into groups; the counts by group are a point, and the sum of the coordinates'
minima bounds what two sets have in common. Points are indexed in R-trees, one for each bucket; pairs that the bound
leaves are verified on the whole sets.

Buckets keep unlike texts apart without losing a pair: two sets of the join's similarity share one of the first numbers
of each (its prefix) in any order that all sets agree on. The order here puts the FREQUENT most frequent numbers of all
texts last, so that passages which many texts share make no buckets. Numbers that only one set has are gone at once, and
of buckets with the same members one is kept.

First each node is compared with the least and the largest node of its buckets, which unites groups of copies without
their pairs. Then the R-trees of the buckets that still hold several components find the pairs of different components
that the bound leaves, first as many as connect what all of them would; if all these prove to be links, nothing else can
be one. Otherwise the trees give every such pair among the nodes that were connected through a pair which failed. No pair
is left unseen, so none is lost: what comes out are the components, not all pairs. A
bucket of more than BLOCK nodes is cut by size and then by hash, and its blocks meet in pairs, where sizes allow it, so
that no task holds a whole one.

Null and empty texts have no shingles and stay alone; repeated rows and equal texts are linked; a null key is in its
component but names it only if it has no other. Other columns are ignored. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, mix, saved, slices, small_batches, words

SIZE = 5
#: Groups of the R-trees' points, of the widest vectors, and how many times GROUPS these are folded to at most.
GROUPS, WIDE, FINEST = 64, 1 << 16, 128
#: So many of the most frequent shingles are put last in prefixes, those in LEAST texts or more; it only matters for speed.
FREQUENT, LEAST = 1 << 20, 4
#: Nodes of one bucket that are looked at together, rows that one group has on average, and counts that are unpacked together.
BLOCK, ROWS, CELLS = 4096, 10_000, 1 << 22
LEAF, FAN = 16, 8
#: Pairs of tree nodes that are opened together.
TOGETHER = 1 << 12
#: Shingles that one vectorised step holds.
STEP = 1 << 18
_WEIGHTS = mix(np.arange(1, SIZE + 1, dtype=np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) sorted, without repeats."""
    rows, hashes = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    out_rows, out = [], []
    full = np.flatnonzero(rows[: len(rows) - SIZE + 1] == rows[SIZE - 1 :]) if len(rows) >= SIZE else np.zeros(0, np.int64)
    if len(full):
        total = np.zeros(len(full), np.uint64)
        for j in range(SIZE):
            total += hashes[full + j] * _WEIGHTS[j]
        out_rows.append(rows[full])
        out.append(mix(total))
    short = np.flatnonzero((count > 0) & (count < SIZE))
    if len(short):
        total = mix(count[short].astype(np.uint64) + np.uint64(1 << 32))
        for j in range(SIZE - 1):
            has = count[short] > j
            total[has] += hashes[first[short[has]] + j] * _WEIGHTS[j]
        out_rows.append(short)
        out.append(mix(total))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, h = np.concatenate(out_rows), (np.concatenate(out) >> np.uint64(16)).astype(np.int64)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def packed(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for each row, six bytes for each of its numbers."""
    data = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((6 * cuts).astype(np.int32)), pa.py_buffer(data)])


def unpacked(data: bytes | np.ndarray) -> np.ndarray:
    few = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, :6] = few
    return out.view("<u8").ravel().astype(np.int64)


def sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, m (shingles), node (the set's signature), shingles (in order) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                r, h = shingles(data, offsets)
                cuts = np.searchsorted(r, np.arange(part.num_rows + 1))
                m = np.diff(cuts)
                total = np.zeros(len(r) + 1, np.uint64)
                np.cumsum(mix(h.astype(np.uint64) + np.uint64(1)), out=total[1:])
                node = mix(total[cuts[1:]] - total[cuts[:-1]] + m.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(m), pa.array(node), packed(h, cuts)], ["key", "m", "node", "shingles"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"key {kind}, m bigint, node bigint, shingles binary")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, their shingles one after the other, offsets) of sets that aren't empty, each node once in a task."""
    seen: set[int] = set()
    for batch in batches:
        node, size = batch.column("node").to_numpy(), batch.column("m").to_numpy()
        new = []
        for i, x in enumerate(node.tolist()):
            if size[i] and x not in seen:
                seen.add(x)
                new.append(i)
        start, sizes = 0, np.cumsum(size[new])
        while start < len(new):
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + STEP, side="right")))
            column = batch.column("shingles").take(pa.array(new[start:end]))
            at = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1].astype(np.int64)
            yield node[new[start:end]], unpacked(np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]), (at - at[0]) // 6
            start = end


def counted(every: DataFrame) -> DataFrame:
    """k, n: in how many sets a shingle is among the first three tenths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, at in chunks(batches):
            m = np.diff(at)
            place = np.arange(len(h)) - np.repeat(at[:-1], m)
            yield pa.RecordBatch.from_arrays([pa.array(h[place < np.repeat(3 * m // 10 + 4, m)])], ["k"])

    return every.select("node", "m", "shingles").mapInArrow(run, "k bigint").groupBy("k").agg(F.count("*").alias("n"))


def frequent(every: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, up to `most`, in order, and the logarithm of how often each is there."""
    n = saved(counted(every).where(F.col("n") >= LEAST), "shingle-counts")
    size = F.floor(8 * F.log2("n"))
    limit, left = LEAST, most
    for r in n.groupBy(size.alias("size")).agg(F.count("*").alias("here"), F.max("n").alias("top")).orderBy(F.desc("size")).collect():
        left -= r["here"]
        if left < 0:
            limit = r["top"] + 1
            break
    rows = n.where(F.col("n") >= limit).select("k", F.floor(F.log2("n")).cast("byte").alias("size")).toArrow()
    k, size = rows["k"].to_numpy(), rows["size"].to_numpy()
    discarded(every.sparkSession, n)
    order = np.argsort(k)
    return k[order], size[order]


def first(h: np.ndarray, at: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which numbers are the row's n first by (size, number); numbers are in order."""
    row = np.repeat(np.arange(len(n)), np.diff(at))
    seen = np.zeros(len(h) + 1, np.int64)
    np.cumsum(size == 0, out=seen[1:])
    out = (size == 0) & (seen[:-1] - seen[at[:-1]][row] < n[row])
    left = n - (seen[at[1:]] - seen[at[:-1]])
    i = np.flatnonzero((size > 0) & (left[row] > 0))
    i = i[np.lexsort((h[i], size[i], row[i]))]
    begins = np.flatnonzero(np.concatenate([[True], row[i[1:]] != row[i[:-1]]])) if len(i) else i
    place = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
    out[i[place < left[row[i]]]] = True
    return out


def prefixes(every: DataFrame, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """k, node: of each set the first shingles, as many as make sure that sets of the similarity share one; those in `last` come last."""
    sent = every.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = sent.value
        for node, h, at in chunks(batches):
            m = np.diff(at)
            n = m - -(-4 * m // 5) + 1
            size = np.zeros(len(h), np.int8)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                size = np.where(keys[place] == h, sizes[place], 0)
            yield pa.RecordBatch.from_arrays([pa.array(h[first(h, at, size, n)]), pa.array(np.repeat(node, n))], ["k", "node"])

    return every.select("node", "m", "shingles").mapInArrow(run, "k bigint, node bigint")


def bucketed(keys: DataFrame) -> DataFrame:
    """k, node, n (the bucket's nodes) of buckets with two nodes or more, one for each set of members."""
    shared = keys.groupBy("k").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("k")
    rows = saved(keys.join(shared.hint("shuffle_hash"), "k").distinct(), "shared-keys")
    halves = F.col("node").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("node", 32)
    members = [F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y"), *(F.sum(h).alias(f"s{i}") for i, h in enumerate(halves))]
    one = rows.groupBy("k").agg(*members).groupBy("n", "x", "y", "s0", "s1").agg(F.min("k").alias("k")).select("k", "n")
    out = saved(rows.join(one, "k"), "buckets")
    discarded(keys.sparkSession, rows)
    return out


def vectors(of: DataFrame) -> DataFrame:
    """node, m, fine: counts by WIDE groups, as the groups of the node's shingles in order, two bytes for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("m"), pa.array([np.sort(unpacked(x.as_buffer()) & (WIDE - 1)).astype("<u2").tobytes() for x in batch.column("shingles")], pa.binary())], ["node", "m", "fine"])

    return of.mapInArrow(run, "node bigint, m bigint, fine binary")


class Fine:
    """Such vectors of many nodes; folded to the next power of two groups above twice their size, and to GROUPS."""

    def __init__(self, vectors: list[bytes]) -> None:
        self.groups = [np.frombuffer(v, "<u2") for v in vectors]
        self.size = folds(np.array([len(g) for g in self.groups], np.int64))
        self.coarse = np.array([np.bincount(g & (GROUPS - 1), minlength=GROUPS) for g in self.groups], np.uint32).reshape(-1, GROUPS)
        self.codes: dict[int, np.ndarray] = {}
        self.levels = {}
        for n in np.unique(self.size).tolist():
            members = np.flatnonzero((self.size == n) | (self.size == 2 * n))
            place = np.full(len(vectors), -1)
            place[members] = np.arange(len(members))
            # what goes beyond 16 bits would bound too much
            self.levels[n] = place, np.array([np.bincount(self.groups[i] & (n - 1), minlength=n) for i in members], np.uint32 if max(len(self.groups[i]) for i in members) > 0xFFFF else np.uint16)

    def possible(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether the summed minima of the folded counts reach what the pairs need in common; folds of more than two to one don't."""
        out = np.zeros(len(a), bool)
        least = np.minimum(self.size[a], self.size[b])
        for n in np.unique(least).tolist():
            place, table = self.levels[n]
            at = np.flatnonzero((least == n) & (place[a] >= 0) & (place[b] >= 0))
            for k in range(0, len(at), step := max(1, STEP // n)):
                part = at[k : k + step]
                out[part] = 9 * np.minimum(table[place[a[part]]], table[place[b[part]]]).sum(axis=1, dtype=np.int64) >= need[part]
        return out

    def code(self, i: int) -> np.ndarray:
        """Each group with how often it has been there before: two codes in common are one of the summed minima."""
        if i not in self.codes:
            g = self.groups[i].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else g
            self.codes[i] = g << 32 | (np.arange(len(g)) - np.repeat(new, np.diff(np.append(new, len(g)))))
        return self.codes[i]

    def common(self, a: int, b: int) -> int:
        """Summed minima of all WIDE groups."""
        both = np.concatenate([self.code(a), self.code(b)])
        both.sort()
        return int(np.count_nonzero(both[1:] == both[:-1]))


def folds(m: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(2.0 * np.maximum(m, 1))).astype(np.int64), GROUPS, GROUPS * FINEST)


def possible(m1: np.ndarray, m2: np.ndarray, v1: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """Whether the summed coordinate minima reach what sets of these sizes need in common: 180 * common >= 80 * both."""
    return 9 * np.minimum(v1, v2).sum(axis=1, dtype=np.int64) >= 4 * (m1 + m2)


class CountTree:
    """R-tree over count vectors: points by size in leaves, above them nodes of FAN with the largest counts and the sizes' range."""

    def __init__(self, m: np.ndarray, v: np.ndarray) -> None:
        self.order = np.lexsort((v.argmax(axis=1), m))
        m, v = m[self.order], v[self.order]
        self.m, self.v, self.levels = m, v, []
        low, high, most, width = m, m, v, LEAF
        while len(low) > 1 or not self.levels:
            at = np.arange(0, len(low), width)
            low, high, most = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at, axis=0)
            self.levels.append((low, high, most))
            width = FAN

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (into what was given) of pairs that the bound leaves, each once."""
        yield from self.below(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))

    def below(self, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        low, high, most = self.levels[level] if level >= 0 else (self.m, self.m, self.v)
        for k in range(0, len(i), TOGETHER):
            a, b = i[k : k + TOGETHER], j[k : k + TOGETHER]
            good = (5 * high[a] >= 4 * low[b]) & (5 * high[b] >= 4 * low[a])
            good[good] = possible(low[a[good]], low[b[good]], most[a[good]], most[b[good]])
            a, b = a[good], b[good]
            if level < 0:
                yield self.order[a], self.order[b]
                continue
            width, size = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, len(self.m))
            grid = np.arange(width)
            x = (a[:, None, None] * width + grid[None, :, None]) + 0 * grid[None, None, :]
            y = (b[:, None, None] * width + grid[None, None, :]) + 0 * grid[None, :, None]
            x, y = x.ravel(), y.ravel()
            keep = (x < size) & (y < size) & ((x <= y) if level else (x < y))
            yield from self.below(level - 1, x[keep], y[keep])


def tree_pairs(rows: pd.DataFrame, forest: bool) -> pd.DataFrame:
    """Pairs a < b of nodes in one bucket, of different components and sides, that the bound leaves; with forest, as many as connect what all of them would."""
    rows = rows.sort_values(["bucket", "node"], kind="stable")
    bucket = rows["bucket"].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    cells = np.concatenate([[0], np.cumsum(folds(rows["m"].to_numpy()))])[cuts]
    found, start = [np.zeros((0, 2), np.int64)], 0
    while start < len(cuts) - 1:  # as many buckets as unpack into CELLS counts, one at least
        end = max(start + 1, int(np.searchsorted(cells, cells[start] + CELLS, side="right")) - 1)
        found.append(some_pairs(rows.iloc[cuts[start] : cuts[end]], cuts[start : end + 1] - cuts[start], forest))
        start = end
    out = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def some_pairs(rows: pd.DataFrame, cuts: np.ndarray, forest: bool) -> np.ndarray:
    """The pairs of some whole buckets, each tried on the widest vectors once."""
    m, node, comp, side = (rows[c].to_numpy() for c in ("m", "node", "comp", "side"))
    names, once, own = np.unique(node, return_index=True, return_inverse=True)
    vectors = Fine([rows["fine"].iloc[i] for i in once])
    v = vectors.coarse[own]

    def take(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # blocks of one bucket meet in a group of their own: there, only nodes of different blocks are new
        good = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side[a] < 0))
        a, b = a[good], b[good]
        good = vectors.possible(own[a], own[b], 4 * (m[a] + m[b]))
        a, b = own[a[good]], own[b[good]]
        return np.minimum(a, b) * len(names) + np.maximum(a, b)

    sizes = np.diff(cuts)
    once_each, held = np.zeros(0, np.int64), []
    for pairs in within(m, comp, v, cuts, sizes):
        held.append(take(*pairs))
        if sum(map(len, held)) > 4 * STEP:
            once_each, held = np.unique(np.concatenate([once_each, *held])), []
    once_each = np.unique(np.concatenate([once_each, *held]))
    a, b = once_each // len(names), once_each % len(names)
    _, begin, of = np.unique(comp[once], return_index=True, return_inverse=True)
    up, out = begin[of].tolist(), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j, n in zip(a.tolist(), b.tolist(), (4 * (m[once[a]] + m[once[b]])).tolist(), strict=True):
        x, y = top(i), top(j)
        if (x != y or not forest) and 9 * vectors.common(i, j) >= n:
            out.append((i, j))
            up[x] = y
    return names[np.array(out, np.int64).reshape(-1, 2)]


def within(m: np.ndarray, comp: np.ndarray, v: np.ndarray, cuts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs in each bucket that the points leave."""
    for n in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]):  # one leaf each: all of a size at once
        starts, (x, y) = cuts[:-1][sizes == n], np.triu_indices(n, 1)
        for k in range(0, len(starts), TOGETHER):
            at = starts[k : k + TOGETHER, None]
            a, b = (at + x).ravel(), (at + y).ravel()
            good = (5 * m[a] >= 4 * m[b]) & (5 * m[b] >= 4 * m[a]) & (comp[a] != comp[b])
            a, b = a[good], b[good]
            good = possible(m[a], m[b], v[a], v[b])
            yield a[good], b[good]
    for start, n in zip(cuts[:-1][sizes > LEAF], sizes[sizes > LEAF], strict=True):
        for a, b in CountTree(m[start : start + n], v[start : start + n]).pairs():
            yield start + a, start + b


def from_trees(rows: DataFrame, of: DataFrame, forest: bool) -> DataFrame:
    """a, b: pairs of the open buckets (k, n, node, m, comp) by R-trees over their points, all or a forest of each group's."""
    # in a bucket of more than one block nodes are cut by size; sets of classes that are farther apart have too different sizes
    size = F.when(F.col("n") > BLOCK, F.floor(F.log("m") / F.log(F.lit(1.1)))).otherwise(0).cast("int").alias("c")
    rows = rows.select("k", "n", "node", "m", "comp", size)
    apart = int(np.ceil(np.log(1.25) / np.log(1.1)))
    large = rows.where(F.col("n") > BLOCK).groupBy("k", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    large = large.groupBy("k").agg(F.collect_list(F.struct("c", "blocks")).alias("classes"))
    x = rows.join(large, "k", "left")
    own = F.filter("classes", lambda c: c["c"] == F.col("c"))[0]["blocks"]
    x = x.withColumn("block", F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("node"), own).cast("int")).otherwise(0))
    here = F.struct(F.col("c").alias("c"), F.col("block").alias("block"))
    others = F.flatten(F.transform(F.filter("classes", lambda c: F.abs(c["c"] - F.col("c")) <= apart), lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: F.struct(c["c"].alias("c"), b.alias("block")))))

    def meeting(o: Column) -> Column:
        return F.struct(F.least(here, o).alias("i"), F.greatest(here, o).alias("j"), F.when(here == o, -1).when(here < o, 0).otherwise(1).alias("side"))

    alone = F.array(meeting(here))
    x = x.withColumn("p", F.explode(F.when(F.col("n") > BLOCK, F.transform(others, meeting)).otherwise(alone)))
    x = x.select(F.xxhash64("k", "p.i", "p.j").alias("bucket"), "p.side", "node", "comp")
    groups = max(1, -(-x.count() // ROWS))  # of what meets, copies of nodes for several meetings included
    x = x.join(vectors(of), "node")
    found = x.withColumn("g", F.pmod("bucket", F.lit(groups))).groupBy("g").applyInPandas(lambda held: tree_pairs(held, forest), "a bigint, b bigint")
    return found.distinct()


def verified(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs a, b whose sets have the similarity: first by the bound, then on the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = unpacked(p.as_buffer()), unpacked(q.as_buffer())
                need = 4 * (len(p) + len(q))
                v, w = (np.bincount(h & (GROUPS - 1), minlength=GROUPS) for h in (p, q))
                if 9 * int(np.minimum(v, w).sum()) < need:
                    good.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort()
                good.append(9 * int((both[1:] == both[:-1]).sum()) >= need)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    own = of.select("node", "shingles")
    both = pairs.join(own.withColumnsRenamed({"node": "b", "shingles": "y"}), "b").join(own.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in edges (a, b), by alternating large and small stars."""
    edges, last = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, edges = edges, saved(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0])
        if now == last or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if last:
            discarded(edges.sparkSession, before)
        last = now


def reached(failed: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of all components of edges in which some pair failed: only among these can a pair have been passed over."""
    at = components(edges)
    bad = failed.select(F.explode(F.array("a", "b")).alias("node")).join(at, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
    return saved(at.join(bad, "root", "left_semi").select("node").union(bad), "reached")


def opened(buckets: DataFrame, sizes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold several components, with m, comp, and the least and the largest (comp, node, m) of the bucket as lo and hi."""
    state = sizes if labels is None else sizes.join(labels, "node", "left")
    state = state.select("node", "m", (F.col("node") if labels is None else F.coalesce("root", "node")).alias("comp"))
    rows = buckets.join(state, "node")
    lead = F.struct("comp", "node", "m")
    ends = rows.groupBy("k").agg(F.min(lead).alias("lo"), F.max(lead).alias("hi")).where("lo.comp <> hi.comp")
    return rows.join(ends, "k")


def linked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles long, component_id (the smallest key of the row's component) of every row."""
    with small_batches(df.sparkSession):  # sets are wide rows, and all work on them is done in here
        rows, labels = _labelled(df, key, text)
    # the name of a component is the smallest key of all rows in it, copies included
    full = rows.where("m > 0").join(labels, "node", "left").withColumn("node", F.coalesce("root", "node"))
    names = full.groupBy("node").agg(F.min("key").alias("name"))
    full = full.join(names, "node").select(F.col("key").alias(key), F.col("m").alias("n_shingles"), F.col("name").alias("component_id"))
    return full.unionByName(rows.where("m = 0").select(F.col("key").alias(key), F.col("m").alias("n_shingles"), F.col("key").alias("component_id")))


def _labelled(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: key, m, node of every row, and node, root of every node with links."""
    spark = df.sparkSession
    # sets lie by node, so that they need not move again when the nodes of buckets are known
    every = saved(sets(df, key, text), "shingle-sets", by="node")
    rows = saved(every.select("key", "m", "node"), "shingle-rows")
    buckets = bucketed(prefixes(every, frequent(every, FREQUENT)))
    discarded(spark)  # the shuffles so far
    of = saved(every.where("m > 0").join(buckets.select("node").distinct(), "node", "left_semi").select("node", "m", "shingles").dropDuplicates(["node"]), "nodes", by="node")
    discarded(spark, every)
    sizes, links, labels = of.select("node", "m"), None, None
    for kind in ("ends", "forest", "all"):
        open_rows = saved(opened(buckets, sizes, labels), "open")
        if kind == "ends":
            with_end = [open_rows.where(f"comp <> {e}.comp AND 5 * m >= 4 * {e}.m AND 5 * {e}.m >= 4 * m").select(F.col("node").alias("a"), F.col(f"{e}.node").alias("b")) for e in ("lo", "hi")]
            pairs = with_end[0].union(with_end[1]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            pairs = from_trees(open_rows, of, kind == "forest")
        pairs = saved(pairs, "pairs")
        new = saved(verified(pairs, of), "links")
        links = new if links is None else links.union(new)
        # for now it is enough to know nodes that are linked to one and the same other
        labels = saved(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "labels") if kind == "ends" else components(links)
        if kind == "forest":
            failed = pairs.join(new, ["a", "b"], "left_anti")
            if not failed.take(1):  # what a forest of links connects needs no other pair
                break
            buckets = buckets.join(reached(failed, links.union(pairs)), "node", "left_semi")
        discarded(spark, open_rows, pairs)
    discarded(spark, of)
    return rows, labels
