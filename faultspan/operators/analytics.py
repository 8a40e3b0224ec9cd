"""Counts, rates, timelines, fingerprint rollups, top failures, time to resolution, category roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspan.functions.columns import severity_rank, week_label
from faultspan.functions.lineage import checkpointed

from .filters import Filters, clamp

ALL = Filters()


def total(df: DataFrame, filters: Filters = ALL) -> DataFrame:
    return df.where(filters.column()).agg(F.count("*").alias("total"))


def counts_by(df: DataFrame, column: str, filters: Filters = ALL) -> DataFrame:
    """Rows by value; a missing category or host doesn't count."""
    return df.where(filters.column()).where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_hosts(df: DataFrame, filters: Filters = ALL, n: int = 5) -> DataFrame:
    return counts_by(df, "hostname", filters).orderBy(F.desc("n"), "hostname").limit(n)


def overview(df: DataFrame, filters: Filters = ALL) -> DataFrame:
    """total, days with events, error_rate_per_day, unique_fingerprints: one row in one pass."""
    x = df.where(filters.column()).agg(F.count("*").alias("total"), F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct("fingerprint").alias("unique_fingerprints"))
    return x.withColumn("error_rate_per_day", F.coalesce(F.col("total") / F.nullif(F.col("days"), F.lit(0)), F.lit(0.0)))


def statistics(df: DataFrame, filters: Filters = ALL) -> DataFrame:
    """All statistics in long form: metric, key, value; one scan counts every value of every part, and the rest is made of these counts."""
    parts = {"severity": F.col("severity"), "category": F.col("category"), "host": F.col("hostname"), "day": F.to_date("ts").cast("string"), "unique_fingerprints": F.col("fingerprint")}
    each = df.where(filters.column()).select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.alias("key")) for n, c in parts.items()))).alias("m")).select("m.*")
    counts = checkpointed(each.groupBy("metric", "key").agg(F.count("*").alias("n")))
    of = lambda m: F.col("metric") == m
    x = counts.agg(F.coalesce(F.sum(F.when(of("severity"), F.col("n"))), F.lit(0)).alias("total"), F.count(F.when(of("day"), F.col("key"))).alias("days"), F.count(F.when(of("unique_fingerprints"), F.col("key"))).alias("unique_fingerprints"))
    x = x.withColumn("error_rate_per_day", F.coalesce(F.col("total") / F.nullif(F.col("days"), F.lit(0)), F.lit(0.0)))
    long = x.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("double").alias("value")) for c in ("total", "error_rate_per_day", "unique_fingerprints")))).alias("m")).select("m.*")
    known = counts.where("key IS NOT NULL")
    hosts = known.where(of("host")).orderBy(F.desc("n"), "key").limit(5)
    return long.unionByName(known.where(F.col("metric").isin("severity", "category")).unionByName(hosts).select("metric", "key", F.col("n").cast("double").alias("value")))


def bucket(name: str, ts: str = "ts") -> Column:
    """hour, day or week as text; other names mean day."""
    if name == "hour":
        return F.date_format(ts, "yyyy-MM-dd'T'HH:00:00'Z'")
    return week_label(ts) if name == "week" else F.date_format(ts, "yyyy-MM-dd")


def timeline(df: DataFrame, filters: Filters = ALL, by: str = "day", series: str | None = None) -> DataFrame:
    """Events in each bucket that has any, by time, for each value of the series column if there is one."""
    keys = [bucket(by).alias("bucket")] + ([F.col(series)] if series else [])
    return df.where(filters.column()).groupBy(*keys).agg(F.count("*").alias("n")).orderBy("bucket", *([series] if series else []))


def rollup(df: DataFrame) -> DataFrame:
    """Of each fingerprint: count, first and last time, and id, message and category of its first event."""
    first = F.min_by(F.struct("event_id", "message", "category"), F.struct("ts", "id"))
    x = df.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), first.alias("f"))
    return x.select("fingerprint", "count", "first_seen", "last_seen", F.col("f.event_id").alias("sample_event_id"), F.col("f.message").alias("title"), F.col("f.category").alias("category"))


def top_failures(df: DataFrame, filters: Filters = ALL, by: str = "count", limit: int | None = None, rolled: DataFrame | None = None) -> DataFrame:
    """Fingerprints by count, recency or severity of their events inside the filter, with what is known of them from all events."""
    inside = df.where(filters.column()).groupBy("fingerprint").agg(F.count("*").alias("n"), F.max("ts").alias("latest"), F.max(severity_rank("severity")).alias("worst"))
    metric = {"recency": "latest", "severity": "worst"}.get(by, "n")
    top = inside.orderBy(F.desc(metric), "fingerprint").limit(clamp(limit, 10, 100))
    known = (rolled if rolled is not None else rollup(df)).select("fingerprint", "last_seen", "category", "title", "sample_event_id")
    return top.join(known, "fingerprint").orderBy(F.desc(metric), "fingerprint")


def mttr(df: DataFrame, filters: Filters = ALL) -> DataFrame:
    """Fingerprints resolved and not, and the mean seconds from the first event to the first resolution (null if none is)."""
    each = df.where(filters.column()).groupBy("fingerprint").agg(F.min("ts").alias("first"), F.min("resolved_at").alias("done"))
    seconds = (F.unix_millis("done") - F.unix_millis("first")) / 1000.0
    return each.agg(F.count("done").alias("resolved"), (F.count("*") - F.count("done")).alias("unresolved"), F.avg(seconds).alias("mean_seconds"))


def summary_by(df: DataFrame, dims: list[str], filters: Filters = ALL) -> DataFrame:
    return df.where(filters.column()).groupBy(*dims).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))


def summarize(df: DataFrame, filters: Filters = ALL) -> dict[str, DataFrame]:
    return {"total": total(df, filters), "by_category": counts_by(df, "category", filters), "by_severity": counts_by(df, "severity", filters), "top": top_failures(df, filters)}


def category_rollup(df: DataFrame, categories: DataFrame, filters: Filters = ALL) -> DataFrame:
    """Every known category with its own events and those of all below it."""
    own = counts_by(df, "category", filters)
    parts = F.split("category", r"\.")
    up = own.select("n", "category", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("canonical"))
    sums = up.groupBy("canonical").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("canonical") == F.col("category"), F.col("n")).otherwise(0)).alias("own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return categories.join(sums, "canonical", "left").select("canonical", "parent", "label", "builtin", zero("own"), zero("total"))


def dropped(*rejects: DataFrame) -> DataFrame:
    """dropped: the rows of all tables of rejects."""
    parts = [r.agg(F.count("*").alias("n")) for r in rejects]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.sum("n").alias("dropped"))


def outcome_counts(df: DataFrame, column: str = "outcome") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
