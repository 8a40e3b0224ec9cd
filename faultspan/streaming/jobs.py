"""Streams: the ingest pipeline, live rollups and counts, dedupe, and sinks that don't stop each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from faultspan.functions import columns as C
from faultspan.operators.analytics import rollup
from faultspan.schema import Rule
from faultspan.sources import commits, io

Sink = Callable[[DataFrame, int], None]


def pipeline(df: DataFrame, aliases: DataFrame | None = None, custom: list[Rule] | None = None, patterns: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """Redact, classify, encrypt metadata if there is a key, fingerprint, and resolve the category's alias: one projection for tables and streams."""
    out = C.redacted_event(df.withColumn("severity", C.parsed_severity("severity")), patterns)
    out = C.classified_event(out, custom)
    if key is not None and "metadata" in out.columns:
        out = out.withColumn("metadata", C.encrypted("metadata", key))
    out = out.withColumns({"stack_norm": C.stack_norm("stacktrace"), "fingerprint": C.fingerprint()})
    return C.canonical_category(out, aliases) if aliases is not None else out


def deduplicated(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each event_id once among those that come within this time of each other."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


def live_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Events in each window; those later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), *([by] if by else [])).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *([by] if by else []), "n")


def live_rollup(stream: DataFrame) -> DataFrame:
    """What `rollup` tells of each fingerprint, so far (complete or update mode)."""
    return rollup(stream)


def to_table(path: str, mode: str = "append") -> Sink:
    return lambda df, batch: df.write.mode(mode).parquet(path)


def to_lines(path: str) -> Sink:
    """One line of JSON for each event."""
    return lambda df, batch: df.write.mode("append").json(path)


def to_store(path: str, name: str = "stream") -> Sink:
    """Batches into a store with commits; a repeated batch adds nothing."""
    return lambda df, batch: io.append_batch(df, path, f"{name}-{batch}")


def to_chained_store(path: str, key: Column | None = None, name: str = "stream") -> Sink:
    """The same with the hash chain going on from batch to batch."""
    return lambda df, batch: io.append_chained(df, path, f"{name}-{batch}", key)


_PART = "fingerprint string, count bigint, first_seen timestamp, last_seen timestamp, f struct<ts:timestamp,id:bigint,event_id:string,message:string,category:string>"
_DAYS = "day date, n bigint, prints binary"


def merged_rollup(path: str, name: str = "stream") -> Sink:
    """A batch's part of a rollup that can be merged: of each fingerprint the count, times and first event, and of each day the count and a sketch of its fingerprints. Commits make a repeated batch count once."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if f"{name}-{batch}" in commits.state(spark, path).batches:
            return
        known = df.where(F.col("fingerprint").isNotNull())
        first = F.min(F.struct("ts", F.col("id").cast("bigint").alias("id"), "event_id", "message", "category")).alias("f")
        part = known.groupBy("fingerprint").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), first)
        days = known.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg("fingerprint").alias("prints"))
        commits.commit(spark, path, f"{name}-{batch}", [("rollup", commits.stage(part, path), {}), ("days", commits.stage(days, path), {})])

    return write


def read_rollup(spark, path: str) -> DataFrame:
    """The view over all batches: the columns of `rollup`."""
    parts = commits.read(spark, path, commits.state(spark, path).of("rollup"), _PART)
    x = parts.groupBy("fingerprint").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("f").alias("f"))
    return x.select("fingerprint", "count", "first_seen", "last_seen", F.col("f.event_id").alias("sample_event_id"), F.col("f.message").alias("title"), F.col("f.category").alias("category"))


def read_days(spark, path: str) -> DataFrame:
    """day, n, distinct (fingerprints, estimated with an error of about 2 %) over all batches."""
    parts = commits.read(spark, path, commits.state(spark, path).of("days"), _DAYS)
    return parts.groupBy("day").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("prints")).alias("distinct"))


def compacted_rollup(spark, path: str, batch: str) -> bool:
    """Put the parts of all batches together, in one commit."""
    state = commits.state(spark, path)
    if batch in state.batches:
        return False
    parts, days = commits.read(spark, path, state.of("rollup"), _PART), commits.read(spark, path, state.of("days"), _DAYS)
    part = parts.groupBy("fingerprint").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("f").alias("f"))
    day = days.groupBy("day").agg(F.sum("n").alias("n"), F.hll_union_agg("prints").alias("prints"))
    return commits.commit(spark, path, batch, [("rollup", commits.stage(part, path), {}), ("days", commits.stage(day, path), {})], [f.path for f in state.folders], upon=state.version)


def _said(e: Exception) -> str:
    return (str(e).splitlines() or [type(e).__name__])[0][:300]


def to_failures(path: str, name: str = "stream") -> Callable[[DataFrame, str, int, str], None]:
    """A table of failures for fan_out: sink, batch, error, rows."""

    def write(df: DataFrame, sink: str, batch: int, error: str) -> None:
        row = df.agg(F.count("*").alias("rows")).select(F.lit(sink).alias("sink"), F.lit(batch).cast("bigint").alias("batch"), F.lit(error).alias("error"), "rows")
        commits.commit(df.sparkSession, path, f"{name}-{sink}-{batch}", [("failures", commits.stage(row, path), {})])

    return write


def read_failures(spark, path: str) -> DataFrame:
    return commits.read(spark, path, commits.state(spark, path).of("failures"), "sink string, batch bigint, error string, rows bigint")


def fan_out(sinks: dict[str, Sink], errors: list | None = None, failures: Callable[[DataFrame, str, int, str], None] | None = None) -> Sink:
    """Every sink gets every batch; one that fails is noted (sink, batch, error), in a list or as a row of a table, and the others go on."""

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(df, batch)
                except Exception as e:
                    if errors is not None:
                        errors.append((name, batch, _said(e)))
                    if failures is not None:
                        failures(df, name, batch, _said(e))
        finally:
            df.unpersist()

    return write


def with_retry(sink: Sink, lost: str, name: str = "stream") -> Sink:
    """Try a batch a second time; if that fails too, its rows go to the table of lost rows, with the error, and the stream goes on."""

    def write(df: DataFrame, batch: int) -> None:
        own = not df.is_cached
        if own:
            df.persist()
        try:
            error = None
            for _ in range(2):
                try:
                    return sink(df, batch)
                except Exception as e:
                    error = _said(e)
            rows = df.select(F.lit(batch).cast("bigint").alias("batch"), F.lit(error).alias("error"), F.to_json(F.struct(*df.columns)).alias("row"))
            commits.commit(df.sparkSession, lost, f"{name}-{batch}", [("lost", commits.stage(rows, lost), {})])
        finally:
            if own:
                df.unpersist()

    return write


def lost_rows(spark, lost: str) -> DataFrame:
    """batch, error, row (JSON) of all rows that were lost."""
    return commits.read(spark, lost, commits.state(spark, lost).of("lost"), "batch bigint, error string, row string")


def observed(stream: DataFrame, name: str = "ingest") -> DataFrame:
    """Let Metrics count what a stream takes in: rows, and of these errors and worse."""
    return stream.observe(name, F.count("*").alias("rows"), F.count(F.when(C.severity_rank("severity") >= 50, 1)).alias("severe"))


class Metrics(StreamingQueryListener):
    """Sums of the observed counts of all batches, by name and count; add it by spark.streams.addListener."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            own = self.totals.setdefault(name, {})
            for k, v in row.asDict().items():
                own[k] = own.get(k, 0) + v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start(stream: DataFrame, sink: Sink, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run batches at an interval, or once over all there is."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
