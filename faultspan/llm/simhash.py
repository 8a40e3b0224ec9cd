"""SimHash near-duplicates by counting set bits in segments: which texts' 64-bit fingerprints differ in REACH bits or fewer.

A fingerprint is cut into 32 segments of two bits; the numbers of set bits by segment (0, 1 or 2) are a point. Points
are never farther apart by Manhattan distance than the fingerprints are by differing bits, so a range join of the points
on a grid whose cells are single points leaves no link out: two points at a distance of 2 have a point between them, at
most 1 from each, and so every fingerprint goes to the cells of its own point and of those next to it (49 on average), and
links meet in a cell. Each cell is verified on the fingerprints themselves: one of up to PAIRWISE fingerprints pair by
pair; in a fuller one fingerprints are put by every fingerprint of that cell that is one bit away or none, as two that
share one of these differ in 2 bits at most, and two that differ in 2 share one. So rows grow with the
fingerprints, not with the square of a cell's, and no link is lost. Of random fingerprints about 2 pairs in 10^11 meet.

Null and empty texts and texts without words have fingerprint zero and are linked like others. Equal fingerprints are one
node, so repeated rows and ties cost nothing; a null key is in its component but names it only if it has no other. Other
columns are ignored. An empty table gives none. A text is worked on in steps of STEP shingles, so a very long one takes
memory for its own bytes and words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discarded, joined, saved, slices, spans
from .ngram_join import components

SIZE, SEED, REACH = 3, 42, 2
#: Shingles hashed in one step, and fingerprints of a cell that are compared pair by pair.
STEP, PAIRWISE = 1 << 16, 8
EVEN = 0x5555555555555555


def set_bits(text: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with each bit set, hashes) of the rows' pieces text[first:last]."""
    counts, data = np.zeros((rows, 64), np.int64), text.tobytes()
    for k in range(0, len(row), STEP):
        part = slice(k, k + STEP)
        hashes = np.array([xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(first[part].tolist(), last[part].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[part]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return counts, np.bincount(row, minlength=rows)


def of_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit numbers."""
    rows = len(offsets) - 1
    row, start, end = spans(data, offsets)
    text, _, first, last = joined(LOWER[data], row, start, end, rows)
    words = np.bincount(row, minlength=rows)
    begin = np.cumsum(words) - words
    # a shingle for each word that has SIZE - 1 after it, and one of all words of a shorter text
    place = np.arange(len(row)) - begin[row]
    starts = np.flatnonzero((place + SIZE <= words[row]) | ((place == 0) & (words[row] < SIZE)))
    ends = np.minimum(starts + SIZE, (begin + words)[row[starts]]) - 1
    counts, n = set_bits(text, first[starts], last[ends], row[starts], rows)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, print (long) of every row: a bit is set where over half of the text's shingle hashes have it set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(of_texts(data, offsets))], ["key", "print"])

    return df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, print bigint")


def number(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("bigint")


def point(prints: Column) -> Column:
    """The set bits of each segment, two bits for each."""
    high = F.shiftrightunsigned(prints, 1)
    both, one = prints.bitwiseAND(high).bitwiseAND(number(EVEN)), prints.bitwiseXOR(high).bitwiseAND(number(EVEN))
    return F.shiftleft(both, 1).bitwiseOR(one)


def cells(at: Column) -> Column:
    """The point itself and those at a distance of 1."""
    near = [at]
    for j in range(0, 64, 2):
        near.append(F.when(at.bitwiseAND(number(2 << j)) == 0, at.bitwiseXOR(number(1 << j))))  # none and one
        near.append(F.when(at.bitwiseAND(number(3 << j)) != 0, at.bitwiseXOR(number(3 << j))))  # one and two
    return F.array_compact(F.array(*near))


def links(prints: DataFrame) -> DataFrame:
    """a > b: links between the distinct fingerprints, as many as connect all that differ in REACH bits or fewer."""
    # few bytes become many rows here, so they are dealt to as many tasks as later shuffles
    dealt = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print")
    placed = dealt.select("print", F.explode(cells(point(F.col("print")))).alias("cell"))
    shared = saved(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-cells")
    held = saved(placed.join(shared, "cell"), "simhash-held")
    pairs = held.where(F.col("n") <= PAIRWISE).groupBy("cell").agg(F.array_sort(F.collect_list("print")).alias("p"))
    differ = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= REACH
    few = pairs.select(F.explode(F.flatten(F.transform("p", lambda b: F.transform(F.filter("p", lambda a: (a > b) & differ(a, b)), lambda a: F.struct(a.alias("a"), b.alias("b")))))).alias("e")).select("e.a", "e.b")
    # of a fuller cell: those of its fingerprints that are one bit away or none
    flips = F.array(F.col("print"), *(F.col("print").bitwiseXOR(number(1 << i)) for i in range(64)))
    middle = held.where(F.col("n") > PAIRWISE).select("print", "cell", F.explode(flips).alias("middle")).where(point(F.col("middle")) == F.col("cell"))
    least = middle.groupBy("middle").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1").select("middle", "b")
    many = middle.join(least, "middle").where("print > b").select(F.col("print").alias("a"), "b")
    out = saved(few.union(many).distinct(), "simhash-links")
    discarded(prints.sparkSession, shared, held)
    return out


def linked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id (the smallest key of the row's component) of every row."""
    rows = saved(fingerprints(df, key, text), "simhash-prints")
    nodes = rows.groupBy("print").agg(F.min("key").alias("least"))
    labels = components(links(nodes.select("print"))).withColumnRenamed("node", "print")
    named = nodes.join(labels, "print", "left").withColumn("root", F.coalesce("root", "print"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("print", "component_id")
    return rows.join(named, "print").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
