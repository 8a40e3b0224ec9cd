"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at most, unless a single text is longer.
CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where Spark runs in one process, a folder of this machine will do."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def saved(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors. With `by`, rows are in buckets by that column, and joins on it do not move them."""
    spark, name = df.sparkSession, f"{label}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if by:
        n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), name.replace("-", "_")
        df.repartition(n, by).write.bucketBy(n, by).option("path", path).saveAsTable(table)
        out = spark.table(table)
        out.saved_table = table
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While it lasts, Arrow batches hold so many bytes at most (Spark's own limit is 64 MB, for each side of each task)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discarded(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete saved tables that no later plan reads, and let Spark's cleaner find the shuffle files of what has ended."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        if hasattr(t, "saved_table"):
            spark.sql(f"DROP TABLE IF EXISTS {t.saved_table}")
        path = jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def sampled(df: DataFrame, by: list[str], most: int, each: str | None = None) -> DataFrame:
    """About `most` of the rows, those with the smallest hash of the columns `by` (added as __hash), each hash once; with `each`, of every value of that column.

    The limit is that share of all hashes which holds `most` of the distinct ones, by their estimated number; where there
    are fewer, all stay. So the sample depends on the rows alone, and no sort is needed.
    """
    rows = df.withColumn("__hash", F.xxhash64(*by))
    own = F.col(each) if each else F.lit(0)
    share = {r[0]: most / max(1, r[1]) for r in rows.groupBy(own.alias("of")).agg(F.approx_count_distinct("__hash", 0.02)).collect()}
    limits = [x for k, s in sorted(share.items()) if s < 1 for x in (F.lit(k), F.lit(min(int((s - 0.5) * 2**64), 2**63 - 1)).cast("long"))]
    if limits:
        rows = rows.where(F.coalesce(F.col("__hash") <= F.element_at(F.create_map(*limits), own), F.lit(True)))
    return rows.dropDuplicates(["__hash"])


def remainder(doc_id: str, divisor: int) -> F.Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch by bytes of text: (rows, the texts' UTF-8 bytes, len + 1 offsets); a null text is empty."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    texts = pc.fill_null(texts, "")
    start, sizes = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        part = texts.slice(start, end - start)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        yield batch.slice(start, end - start), data, offsets - offsets[0]
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, 2 * CHUNK_BYTES)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of bytes outside 09-0D and 20, after lower-casing A-Z: (the row of each, a 64-bit hash of each)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins = begins[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    return np.searchsorted(offsets, start, side="right") - 1, hashes


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte after the last) of each word, words being runs of bytes outside 09-0D and 20 within a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:-1]
    last[:-1] &= ~inside[1:] | begins[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def joined(data: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's words, joined by one space: (bytes, rows + 1 offsets, first byte and byte after the last of each word)."""
    size = end - start
    space = np.zeros(len(row), np.int64)
    space[:-1] = row[1:] == row[:-1]
    after = np.cumsum(size + space)
    begin = after - size - space
    out = np.full(after[-1] if len(after) else 0, 32, np.uint8)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + at] = data[np.repeat(start, size) + at]
    offsets = np.concatenate([[0], after])[np.searchsorted(row, np.arange(rows + 1))]
    return out, offsets, begin, begin + size
