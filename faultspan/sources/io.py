"""Stores as folders of Parquet, JSON lines in and out, backups, schema upgrade, many stores at once."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultspan.functions.lineage import checkpointed
from faultspan.operators.audit import BITS, block_key, build
from faultspan.operators.filters import age_ms
from faultspan.schema import EVENT_COLUMNS, EVENT_SCHEMA, SCHEMA_VERSION
from faultspan.schema import categories as builtin

from . import commits


def scan(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None, table: str = "events") -> DataFrame:
    """Events of a store in the order of the model's columns; of a store with commits what they list, and only the days asked for are read."""
    if not commits.is_committed(spark, path):
        rows = spark.read.parquet(f"{path}/{table}")
        for limit, ok in ((first_day, lambda d: F.col("day") >= d), (last_day, lambda d: F.col("day") <= d)):
            rows = rows.where(ok(F.lit(limit).cast("date"))) if limit else rows
        return rows.select(*EVENT_COLUMNS)
    listed = [f for f in commits.state(spark, path).of(table) if (not first_day or f.notes["day"] >= first_day) and (not last_day or f.notes["day"] <= last_day)]
    return commits.read(spark, path, listed, EVENT_SCHEMA)


def _dealt(df: DataFrame) -> DataFrame:
    """A day's rows go to as many tasks as there are applications and ranges of ids."""
    return df.withColumn("day", F.to_date("ts")).repartition("day", "application", F.shiftright("id", 20)).sortWithinPartitions("application", "ts")


def save(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write events to a plain store, in one job; for batches that may be repeated or break off see append_batch."""
    _dealt(df).write.mode(mode).partitionBy("day").parquet(f"{path}/events")
    df.sparkSession.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def _staged(df: DataFrame, path: str, table: str) -> list[tuple[str, str, dict]]:
    """Stage events by day, and what a commit has to list; events without a time have the day of none."""
    spark = df.sparkSession
    staged = commits.stage(_dealt(upgraded(df, 0)), path, ["day"])
    return [(table, f"{staged}/{d}", {"day": d.removeprefix("day="), "version": SCHEMA_VERSION}) for d in commits.subfolders(spark, path, staged)]


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Add a batch of events to a store with commits: readers see all of it or nothing, and a batch id that was there before adds nothing (false)."""
    spark = df.sparkSession
    if batch in commits.state(spark, path).batches:
        return False
    return commits.commit(spark, path, batch, _staged(df, path, "events"))


#: Folders of heads after which a commit puts them together.
HEADS = 32
_HEADS = "chain string, last bigint, head string"


def heads(spark: SparkSession, path: str) -> DataFrame:
    """chain, last (id), head: where each chain of a store with commits stands."""
    rows = commits.read(spark, path, commits.state(spark, path).of("heads"), _HEADS)
    return rows.groupBy("chain").agg(F.max("last").alias("last"), F.max_by("head", "last").alias("head"))


def append_chained(df: DataFrame, path: str, batch: str, key: Column | None = None, bits: int = BITS) -> bool:
    """Add a batch whose rows are linked, block by block of their key's ids (see audit.block_key), on from where the store's chains stand.

    Events, the heads of the chains that grew and rows that came too late are one commit, so a batch that breaks off or is
    repeated changes no chain. Rows with an id up to their chain's last one can't be linked any more: they go to the table
    "late". As blocks are small and batches go on from heads, a stream of such batches gives the hashes of one build.
    """
    spark = df.sparkSession
    state = commits.state(spark, path)
    if batch in state.batches:
        return False
    chain = block_key(key, bits)
    rows = upgraded(df, 0).withColumn("audit_hash", F.lit(None).cast("string"))
    at = checkpointed(heads(spark, path).join(rows.select(chain.alias("chain")).distinct(), "chain", "left_semi"))
    named = rows.withColumn("__chain", chain).join(at.select(F.col("chain").alias("__chain"), "last"), "__chain", "left")
    late = F.coalesce(F.col("id") <= F.col("last"), F.lit(False))
    built = checkpointed(build(named.where(~late).drop("last"), F.col("__chain"), at.select("chain", F.col("head").alias("hash"))))
    new = built.groupBy(F.col("__chain").alias("chain")).agg(F.max("id").alias("last"), F.max_by("audit_hash", "id").alias("head"))
    old = state.of("heads")
    if together := len(old) >= HEADS:
        both = heads(spark, path).unionByName(new)
        new = both.groupBy("chain").agg(F.max("last").alias("last"), F.max_by("head", "last").alias("head"))
    add = _staged(built.drop("__chain"), path, "events") + [("heads", commits.stage(new, path), {})]
    if at.take(1) and named.where(late).select("id").take(1):  # without heads nothing is late
        add += _staged(named.where(late).drop("last", "__chain"), path, "late")
    return commits.commit(spark, path, batch, add, [f.path for f in old] if together else [], upon=state.version)


def archive_store(spark: SparkSession, path: str, age: str, now_ms: int, batch: str) -> bool:
    """Move events older than an age to the store's archive, in one commit.

    Days that are wholly older are listed as archive without being written anew; only the day that the age cuts is split.
    """
    cut = now_ms - age_ms(age)
    day = spark.range(1).select(F.to_date(F.timestamp_millis(F.lit(cut))).cast("string")).collect()[0][0]
    state = commits.state(spark, path)
    if batch in state.batches:
        return False
    listed = [f for f in state.of("events") if f.notes["day"][:1].isdigit() and f.notes["day"] <= day]
    split = [f for f in listed if f.notes["day"] == day]
    add = [("archive", f.path, f.notes) for f in listed if f.notes["day"] < day]
    if split:
        rows = commits.read(spark, path, split, EVENT_SCHEMA)
        old = F.unix_millis("ts") < cut
        add += _staged(rows.where(old), path, "archive") + _staged(rows.where(~old), path, "events")
    return commits.commit(spark, path, batch, add, [f.path for f in listed], upon=state.version)


def archived(spark: SparkSession, path: str) -> DataFrame:
    """The archive's events with their year and quarter."""
    return scan(spark, path, table="archive").withColumns({"arch_year": F.year("ts"), "arch_quarter": F.quarter("ts")})


def store_version(spark: SparkSession, path: str) -> int:
    """The oldest schema version that a store's events were written with; a plain store has one, and an empty store this library's."""
    if commits.is_committed(spark, path):
        return min((f.notes["version"] for f in commits.state(spark, path).folders if "version" in f.notes), default=SCHEMA_VERSION)
    return spark.read.parquet(f"{path}/meta").agg(F.min("version")).collect()[0][0]


def backup(spark: SparkSession, path: str, target: str, force: bool = False) -> None:
    """Copy a store; an existing target is an error unless forced."""
    mode = "overwrite" if force else "errorifexists"
    spark.read.parquet(f"{path}/events").write.mode(mode).partitionBy("day").parquet(f"{target}/events")
    spark.read.parquet(f"{path}/meta").write.mode("overwrite").parquet(f"{target}/meta")


def upgraded(df: DataFrame, version: int) -> DataFrame:
    """Older snapshots get the columns that they lack; newer ones are refused. Doing it again changes nothing."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"the snapshot has version {version}; this library knows up to {SCHEMA_VERSION}")
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA))


def upgraded_store(df: DataFrame, version: int, chain: Column, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events with all columns and their missing links (one group walks each chain, see audit.block_key), and the categories with the builtin ones that were missing."""
    known = builtin(df.sparkSession)
    if categories is not None:
        known = categories.unionByName(known.join(categories.select("canonical"), "canonical", "left_anti").select(*categories.columns))
    return build(upgraded(df, version), chain), known


def export_lines(df: DataFrame, path: str, where: Column | None = None) -> None:
    """One event a line, by time and id."""
    df.where(where if where is not None else F.lit(True)).orderBy("ts", "id").write.json(path)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """line, and the event's columns of JSON lines (line, value); blank lines are left out, of broken ones only the line is known."""
    event = F.from_json("value", EVENT_SCHEMA)
    x = lines.where(F.trim("value") != "").select("line", F.when(F.try_parse_json("value").isNotNull(), event).alias("e"))
    good = F.col("e.event_id").isNotNull() & F.col("e.message").isNotNull()
    return x.select("line", *(F.when(good, F.col(f"e.{c}")).alias(c) for c in EVENT_COLUMNS))


def import_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files, numbered as they lie in them."""
    return parsed_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"))


def federated(spark: SparkSession, stores: dict[str, str | DataFrame], run: Callable[[DataFrame], DataFrame], limit: int | None = None, order: list[Column] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Run one query on every store (a path or its events) by itself, with its own statistics and limit; rows carry source_db.

    Each store's answer is made in a job of its own, here, so that a store that can't be opened, or breaks off while it is
    read, gives a row of the status table (source_db, ok, n, error), and the others go on. The order says which rows a limit
    keeps (the latest, if none is given).
    """
    out, status = None, []
    for name, store in stores.items():
        try:
            rows = run(scan(spark, store) if isinstance(store, str) else store)
            if limit is not None:
                rows = rows.orderBy(*(order or [F.desc("ts"), F.desc("id")])).limit(limit)
            rows = checkpointed(rows).withColumn("source_db", F.lit(name))
            status.append((name, True, rows.count(), None))
            out = rows if out is None else out.unionByName(rows)
        except (PySparkException, Py4JJavaError) as e:
            status.append((name, False, 0, str(e).splitlines()[0][:300]))
    return out, spark.createDataFrame(status, "source_db string, ok boolean, n bigint, error string")


def top_of_each(df: DataFrame, k: int, by: str = "source_db") -> DataFrame:
    """The latest k rows of each source."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id")))).where(F.col("__n") <= k).drop("__n")


def with_archive(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Live and archived events of a store, of the days asked for."""
    return scan(spark, path, first_day, last_day).unionByName(scan(spark, path, first_day, last_day, "archive"))
