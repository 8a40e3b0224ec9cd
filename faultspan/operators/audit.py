"""A hash chain over events: build, verify in parallel, report tombstones.

Building is serial along a chain, and one task walks each chain, so a chain's key should bound it: `block_key` cuts any key
into blocks of ids, 1,024 rows at most, and `anchors` chain the blocks' heads, level by level, so that what a long chain tells
is kept: an edited, lost or added row breaks a link, and a block whose end is cut off breaks its anchor. Verifying is parallel:
each row's predecessor is the row or else the tombstone before it, in one chain of ids one after another found by two joins,
in chains with a key by a window over each. As stored and expected hashes agree before the first break, the smallest broken
id is what a walk along the chain would stop at. `streaming.stateful.chained_stream` builds the same blocks in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from faultspan.functions.lineage import checkpointed

GENESIS = "genesis"
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Rows of a block, and blocks whose heads are chained together, as a power of two.
BITS = 10


def block_key(key: Column | None = None, bits: int = BITS) -> Column:
    """A chain for each key and block of ids; without a key for each block."""
    number = F.shiftright("id", bits).cast("string")
    return F.concat_ws("#", F.coalesce(key.cast("string"), F.lit("")), number) if key is not None else number


def anchors(df: DataFrame, tombstones: DataFrame | None = None, key: Column | None = None, bits: int = BITS, flat: bool = False) -> DataFrame:
    """key, level, block, head of every block: on level 0 the last hash of its rows and tombstones (row_id, audit_hash, key); above, of the chain of the heads of 2 ** bits blocks, until one is left.

    Each level is a group by block of 2 ** bits rows at most, however long the chain is. A flat anchor has one level above
    the blocks, block 0, of the chain of all heads of a key, which streams through a task in order.
    """
    name = key.cast("string") if key is not None else F.lit("")
    rows = df.select(F.coalesce(name, F.lit("")).alias("key"), "id", F.col("audit_hash").alias("h"))
    if tombstones is not None:
        rows = rows.unionByName(tombstones.select(F.coalesce("key", F.lit("")).alias("key") if "key" in tombstones.columns else F.lit("").alias("key"), F.col("row_id").alias("id"), F.col("audit_hash").alias("h")))
    level = 0
    now = checkpointed(rows.groupBy("key", F.shiftright("id", bits).alias("block")).agg(F.max_by("h", "id").alias("head")))
    out = now.select("key", F.lit(0).alias("level"), "block", "head")
    if flat:
        several = now.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").take(1)
        return out.unionByName(_flat(now)) if several else out
    while now.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").take(1):
        level += 1
        heads = F.transform(F.array_sort(F.collect_list(F.struct("block", "head"))), lambda x: x["head"])
        up = now.groupBy("key", F.shiftright("block", bits).alias("up")).agg(heads.alias("heads"))
        now = checkpointed(up.select("key", F.col("up").alias("block"), F.aggregate("heads", F.lit(GENESIS), lambda a, h: F.sha2(F.concat(a, F.lit("|"), h), 256)).alias("head")))
        out = out.unionByName(now.select("key", F.lit(level).alias("level"), "block", "head"))
    return out


def _flat(heads: DataFrame) -> DataFrame:
    """key, level 1, block 0, head of the chain of all heads of each key: rows come sorted, and only the key and hash at hand are kept."""

    def walk(batches):
        key, at = None, GENESIS
        for rows in batches:
            done = []
            for own, head in zip(rows["key"], rows["head"], strict=True):
                if own != key:
                    done += [(key, at)] if key is not None else []
                    key, at = own, GENESIS
                at = hashlib.sha256(f"{at}|{head}".encode()).hexdigest()
            yield pd.DataFrame(done, columns=["key", "head"])
        if key is not None:
            yield pd.DataFrame([(key, at)], columns=["key", "head"])

    ends = heads.repartition("key").sortWithinPartitions("key", "block").select("key", "head").mapInPandas(walk, "key string, head string")
    return ends.select("key", F.lit(1).alias("level"), F.lit(0).cast(heads.schema["block"].dataType).alias("block"), "head")


def broken_anchors(df: DataFrame, stored: DataFrame, tombstones: DataFrame | None = None, key: Column | None = None, bits: int = BITS) -> DataFrame:
    """key, level, block, expected (stored), actual (of the rows that are there) of the blocks that differ or are missing on either side."""
    own = anchors(df, tombstones, key, bits).withColumnRenamed("head", "actual")
    both = stored.withColumnRenamed("head", "expected").join(own, ["key", "level", "block"], "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("key", "level", "block", "expected", "actual")


def link(previous: Column) -> Column:
    """SHA-256 over the previous hash, id, time, message and fingerprint."""
    return F.sha2(F.concat(previous, *(F.concat(F.lit("|"), c) for c in (F.col("event_id"), F.date_format("ts", STAMP), F.col("message"), F.col("fingerprint")))), 256)


def build(df: DataFrame, chain: Column, last: DataFrame | None = None) -> DataFrame:
    """Fill the audit_hash of rows that have none, in id order within each chain, on from the chain's last hash (of its rows, else of `last`: chain, hash). One task walks a chain: see block_key."""
    given = df if "audit_hash" in df.columns else df.withColumn("audit_hash", F.lit(None).cast("string"))
    rest = F.concat(*(F.concat(F.lit("|"), c) for c in (F.col("event_id"), F.date_format("ts", STAMP), F.col("message"), F.col("fingerprint"))))
    x = given.withColumns({"__chain": chain, "__rest": rest})
    x = x.join(last.select(F.col("chain").alias("__chain"), F.col("hash").alias("__from")), "__chain", "left") if last is not None else x.withColumn("__from", F.lit(None).cast("string"))
    x = x.repartition("__chain").sortWithinPartitions("__chain", "id")
    return x.withColumn("audit_hash", _walk("__chain", "audit_hash", "__rest", "__from")).select(*given.columns)


@F.pandas_udf(StringType())
def _walk(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Hashes of rows that come sorted by chain and id: only the chain and hash at hand are kept, and the rows' other columns stay where they are."""
    key, at = (), GENESIS
    for rows in parts:
        out = []
        for chain, own, rest, begun in zip(*rows, strict=True):
            if chain != key:
                key, at = chain, begun or GENESIS
            at = own if own else hashlib.sha256((at + rest).encode()).hexdigest()
            out.append(at)
        yield pd.Series(out, dtype=object)


def checked(df: DataFrame, tombstones: DataFrame, chain: Column | None = None) -> DataFrame:
    """id, event_id, expected, actual, bridged, ok of every row: of one chain with ids one after another, or of chains with a key, which tombstones have as `chain`."""
    if chain is not None:
        parts = ("id", "event_id", "ts", "message", "fingerprint")
        rows = df.select(chain.alias("chain"), *parts, F.col("audit_hash").alias("actual"), F.lit(False).alias("stone"))
        stones = tombstones.select("chain", F.col("row_id").alias("id"), F.col("audit_hash").alias("actual"), F.lit(True).alias("stone")).dropDuplicates(["id"])
        w = Window.partitionBy("chain").orderBy("id")
        x = rows.unionByName(stones, allowMissingColumns=True).withColumns({"__from": F.coalesce(F.lag("actual").over(w), F.lit(GENESIS)), "bridged": F.coalesce(F.lag("stone").over(w), F.lit(False))})
        x = x.where("NOT stone").withColumn("expected", F.coalesce(link(F.col("__from")), F.lit("")))
        return x.select("id", "event_id", "expected", "actual", "bridged", F.col("expected").eqNullSafe(F.col("actual")).alias("ok"))
    before = df.select((F.col("id") + 1).alias("id"), F.col("audit_hash").alias("__row"))
    stone = tombstones.select((F.col("row_id") + 1).alias("id"), F.col("audit_hash").alias("__stone")).dropDuplicates(["id"])
    x = df.join(before, "id", "left").join(stone, "id", "left")
    x = x.withColumn("__from", F.coalesce("__row", "__stone", F.when(F.col("id") == 1, GENESIS)))
    x = x.withColumn("expected", F.coalesce(link(F.col("__from")), F.lit("")))
    bridged = F.col("__row").isNull() & F.col("__stone").isNotNull()
    return x.select("id", "event_id", "expected", F.col("audit_hash").alias("actual"), bridged.alias("bridged"), F.col("expected").eqNullSafe(F.col("audit_hash")).alias("ok"))


def breaks(df: DataFrame, tombstones: DataFrame, chain: Column | None = None) -> DataFrame:
    return checked(df, tombstones, chain).where("NOT ok").select("id", "event_id", "expected", "actual")


def verify(df: DataFrame, tombstones: DataFrame, chain: Column | None = None) -> DataFrame:
    """ok, rows_checked and tombstones_bridged up to the first break, and its id."""
    rows = checked(df, tombstones, chain)
    first = rows.agg(F.min(F.when(~F.col("ok"), F.col("id"))).alias("first_break"))
    before = F.col("first_break").isNull() | (F.col("id") < F.col("first_break"))
    x = rows.crossJoin(F.broadcast(first)).agg(F.count(F.when(before, 1)).alias("rows_checked"), F.count(F.when(before & F.col("bridged"), 1)).alias("tombstones_bridged"), F.max("first_break").alias("first_break"))
    return x.select(F.col("first_break").isNull().alias("ok"), "rows_checked", "tombstones_bridged", "first_break")


def tombstone_report(tombstones: DataFrame) -> DataFrame:
    return tombstones.agg(F.count("*").alias("tombstones"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
