"""Whitening of embeddings through a covariance weighted by multiplicity.

Components c become whole numbers x = floor(SCALE * c) + SHIFT. Equal x-vectors are one row with a count, and the fit takes
each with that count as its weight (weights="count", as if all rows were there) or with one (weights="one"). Sums are exact;
the covariance is a product of centred, weighted matrices, summed over tasks, of which only d x d numbers reach the driver
(d: components of a vector, a few thousand at most). Each distinct vector is whitened once, and rows are joined to that.

Rows whose vector is null, holds null or non-finite components, or components of an x beyond 2^52 (where doubles no longer
hold whole numbers), take no part; nor do vectors shorter than the longest, as they lack components. Repeated rows and ids,
and null ids, stay rows of their own. A component whose variance is no more than rounding has no whitened value (null);
the deviation is null where it is beyond a long. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: Vectors in one matrix product.
STEP = 4096
#: Variances below this share of the largest are rounding.
LEAST = 1e-13
_LIMIT = float(1 << 52)


def packed(x: np.ndarray) -> bytes:
    """x - SHIFT in the smallest width that holds it, so that equal vectors have equal bytes."""
    high = int(np.abs(x).max(initial=0))
    return next(x.astype(t).tobytes() + bytes([w]) for t, w in (("<i1", 1), ("<i2", 2), ("<i4", 4), ("<i8", 8)) if high < 1 << (8 * w - 1))


def unpacked(held: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(b, f"<i{b[-1]}", count=(len(b) - 1) // b[-1]).astype(np.int64) for b in held.to_pylist()])


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, d, x of the rows that take part, whatever their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x, sizes = [], [], []
            for i, v in enumerate(batch.column(1)):
                if not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                v = v.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE
                if np.isfinite(v).all() and np.abs(v).max() < _LIMIT:
                    good.append(i)
                    x.append(packed(np.floor(v).astype(np.int64)))
                    sizes.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), pa.array(sizes, pa.int32()), pa.array(x, pa.binary())], ["key", "d", "x"])

    return df.select(F.col(key), F.col(vector)).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, d int, x binary")


def added(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], rows: int) -> np.ndarray:
    """The sum over all batches of a matrix with so many rows: each task adds up its own, and each row is added up by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                one = part(batch.slice(k, STEP))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(held: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<f8") for b in held["row"].to_pylist())
        return pa.table({"i": held["i"].slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})

    kind = "i int, row binary"
    got = dict(df.mapInArrow(run, kind).groupBy("i").applyInArrow(add, kind).collect())
    return np.array([np.frombuffer(got[i], "<f8") for i in range(rows)]) if got else np.zeros((rows, 0))


@dataclass
class Model:
    """n fitted vectors, the sums S of x - SHIFT by component of the vector, unit eigenvectors as columns by falling variance, and the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole numbers first, so that nothing but the last division is rounded."""
        return _centred(x, self.n, self.sums)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over components of (n * x - S) squared; null beyond a long."""
        out = self.n * x.astype(object) - np.array(self.sums, object) if self._wide(x) else self.n * x - np.array(self.sums, np.int64)
        return [s if s < 1 << 63 else None for s in (out * out).sum(axis=1).tolist()]

    def _wide(self, x: np.ndarray) -> bool:
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        return most * most * x.shape[1] >= 1 << 63

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Coordinates on the axes in units of their deviation; not a number where there is none."""
        good = self.variances > LEAST * max(self.variances[0], 1e-300) if len(self.variances) else np.zeros(0, bool)
        scale = np.where(good, 1 / np.sqrt(np.where(good, self.variances, 1)), np.nan)
        return (self.centred(x) @ self.axes) * scale


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    near = [round(s / n) for s in sums]
    rest = np.array([(s - n * c) / n for s, c in zip(sums, near, strict=True)])
    return (x - np.array(near, np.int64)).astype(np.float64) - rest


def distinct(rows: DataFrame) -> DataFrame:
    """x, m (how many rows have it)."""
    return rows.groupBy("x").agg(F.count("*").alias("m"))


def fit(vectors: DataFrame, d: int, weights: str = "count", most: int = MOST) -> Model:
    """From distinct vectors (x, m) of d components."""
    if weights not in ("count", "one"):
        raise ValueError("weights are count or one")
    held = vectors.select("x", "m" if weights == "count" else F.lit(1).cast("bigint").alias("m"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = unpacked(batch.column("x")), batch.column("m").to_numpy()
            wide = int(np.abs(x).max()) * int(m.sum()) >= 1 << 62
            total = (x.astype(object) * m.astype(object)[:, None]).sum(axis=0) if wide else m @ x
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total.tolist()])], ["i", "s"])

    totals = held.mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    s = [int(t) for _, t in sorted(totals)]
    n = int(held.agg(F.sum("m")).collect()[0][0])

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        z = _centred(unpacked(batch.column("x")), n, s)
        return (z * batch.column("m").to_numpy()[:, None]).T @ z

    cov = added(held, gram, d) / n
    e, u = np.linalg.eigh((cov + cov.T) / 2)
    e, u = np.maximum(e[::-1], 0), u[:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return Model(n, s, np.ascontiguousarray(u[:, :most]), e[:most], float(np.trace(cov)))


def applied(vectors: DataFrame, model: Model) -> DataFrame:
    """x, m, deviation, whitened (array) of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                x = unpacked(part.column("x"))
                w = model.whiten(x)
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("m"), pa.array(model.deviation(x), pa.int64()), lists], ["x", "m", "deviation", "whitened"])

    return vectors.select("x", "m").mapInArrow(run, "x binary, m bigint, deviation bigint, whitened array<double>")


def identity_error(done: DataFrame, model: Model, weights: str = "count") -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity, over the components that have values."""
    k = int((model.variances > LEAST * max(model.variances[0], 1e-300)).sum())
    if not k:
        return None

    def values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w = batch.column("whitened").flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :k]
        return w, batch.column("m").to_numpy() if weights == "count" else np.ones(batch.num_rows)

    def total(batch: pa.RecordBatch) -> np.ndarray:
        w, m = values(batch)
        return (m @ w)[None]

    mean = added(done, total, 1)[0] / model.n

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        w, m = values(batch)
        return ((w - mean) * m[:, None]).T @ (w - mean)

    return float(np.abs(added(done, gram, k) / model.n - np.eye(k)).max())


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", weights: str = "count", most: int = MOST) -> DataFrame:
    """key, component int (from 1), n, deviation long, whitened, explained, identity_error double of every row that takes part and every component."""
    spark = df.sparkSession
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = saved(whole(df, key, vector), "whole-vectors")
    d = rows.agg(F.max("d")).collect()[0][0]
    if not d:
        return spark.createDataFrame([], kind)
    rows = rows.where(F.col("d") == d).select("key", "x")
    vectors = saved(distinct(rows), "distinct-vectors")
    model = fit(vectors, d, weights, most)
    done = saved(applied(vectors, model), "whitened-vectors")
    error = identity_error(done, model, weights)
    share = F.array(*(F.lit(float(e / model.trace) if model.trace else None).cast("double") for e in model.variances))
    all_ = rows.join(done.select("x", "deviation", "whitened"), "x").select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return all_.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
