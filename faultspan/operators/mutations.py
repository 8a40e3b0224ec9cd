"""Resolve, delete with tombstones, prune, retention, taxonomy changes: each takes tables and returns new ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import older_than


def resolve(df: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set resolved_at by updates (event_id, resolved_at, force): the first resolution stays unless one is forced; of several, the latest forced, else the earliest.

    Also a report: event_id, outcome (resolved, forced, already_resolved, unmatched).
    """
    forced = F.max(F.when(F.col("force"), F.col("resolved_at"))).alias("__forced")
    u = updates.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min("resolved_at").alias("__at"), forced)
    x = df.join(u, "event_id", "left")
    out = x.withColumn("resolved_at", F.coalesce("__forced", "resolved_at", "__at")).select(*df.columns)
    was = u.join(df.select("event_id", F.col("resolved_at").alias("__was"), F.lit(True).alias("__has")), "event_id", "left")
    told = F.when(F.col("__has").isNull(), "unmatched").when(F.col("__was").isNull(), "resolved").when(F.col("__forced").isNotNull(), "forced").otherwise("already_resolved")
    return out, was.select("event_id", told.alias("outcome"))


@dataclass(frozen=True)
class Selector:
    """What to delete; only resolved events unless forced. At least one of the first three must be given."""

    event_id: str | None = None
    fingerprint: str | None = None
    resolved_before_ms: int | None = None
    force: bool = False

    def column(self) -> Column:
        if self.event_id is None and self.fingerprint is None and self.resolved_before_ms is None:
            raise ValueError("a deletion needs an event id, a fingerprint or a time")
        out = F.lit(True) if self.force else F.col("resolved_at").isNotNull()
        if self.event_id is not None:
            out &= F.col("event_id") == self.event_id
        if self.fingerprint is not None:
            out &= F.col("fingerprint") == self.fingerprint
        if self.resolved_before_ms is not None:
            before = F.col("resolved_at") < F.timestamp_millis(F.lit(self.resolved_before_ms))
            out &= before | F.col("resolved_at").isNull() if self.force else before
        return out


def preview(df: DataFrame, what: Selector) -> DataFrame:
    """The ids that a deletion would take, by the rule that it goes by."""
    return df.where(what.column()).select("event_id")


def delete(df: DataFrame, edges: DataFrame, which: Column, deleted_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Survivors, tombstones (row_id, event_id, audit_hash, deleted_at) and the edges that touch no deleted event."""
    gone = df.where(which)
    stones = gone.select(F.col("id").alias("row_id"), "event_id", F.coalesce("audit_hash", F.lit("")).alias("audit_hash") if "audit_hash" in df.columns else F.lit("").alias("audit_hash"), deleted_at.alias("deleted_at"))
    ids = gone.select("event_id")
    left = edges.join(ids.withColumnRenamed("event_id", "src_event_id"), "src_event_id", "left_anti").join(ids.withColumnRenamed("event_id", "dst_event_id"), "dst_event_id", "left_anti")
    return df.where(~F.coalesce(which, F.lit(False))), stones, left.select(*edges.columns)


def prune(df: DataFrame, edges: DataFrame, age: str, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    return delete(df, edges, older_than(age, now_ms), F.timestamp_millis(F.lit(now_ms)))


def retained(df: DataFrame, now_ms: int, max_age: str = "90d", max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Events young enough, of these the latest whose texts have max_bytes together, and of these the latest max_rows."""
    out = df.where(~older_than(max_age, now_ms))
    if max_bytes is not None:
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        out = _newest(out, sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("bigint"), max_bytes)
    return out if max_rows is None else _newest(out, F.lit(1).cast("bigint"), max_rows)


def _newest(df: DataFrame, size: Column, most: int) -> DataFrame:
    """The latest rows whose sizes have `most` together: sizes are summed up by hours, and by rows only in the hour of the cut, so no task ranks all rows."""
    x = df.withColumns({"__size": size, "__hour": F.date_trunc("hour", "ts")})
    hours = x.groupBy("__hour").agg(F.sum("__size").alias("own")).withColumn("__upto", F.sum("own").over(Window.orderBy(F.desc("__hour"))))
    x = x.join(hours.withColumn("__before", F.col("__upto") - F.col("own")).where(F.col("__before") <= most).select("__hour", "__before", "__upto"), "__hour")
    part = Window.partitionBy("__hour").orderBy(F.desc("ts"), F.desc("id"))
    cut = x.where(F.col("__upto") > most).withColumn("__sum", F.col("__before") + F.sum("__size").over(part)).where(F.col("__sum") <= most)
    return x.where(F.col("__upto") <= most).select(*df.columns).unionByName(cut.select(*df.columns))


def archive(df: DataFrame, age: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Old events with their year and quarter, and those that stay."""
    old = older_than(age, now_ms)
    return df.where(old).withColumns({"arch_year": F.year("ts"), "arch_quarter": F.quarter("ts")}), df.where(~F.coalesce(old, F.lit(False)))


def merge_import(df: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of incoming whose event_id is new, the first of each id by line; and counts by outcome: imported, duplicate, malformed.

    incoming has a line number (line) and, where a line can't be read, a null event_id.
    """
    w = Window.partitionBy("event_id").orderBy("line")
    x = incoming.withColumn("__n", F.when(F.col("event_id").isNotNull(), F.row_number().over(w))).join(df.select("event_id", F.lit(True).alias("__has")).distinct(), "event_id", "left")
    outcome = F.when(F.col("event_id").isNull(), "malformed").when(F.col("__has") | (F.col("__n") > 1), "duplicate").otherwise("imported")
    x = x.withColumn("outcome", outcome)
    return x.where("outcome = 'imported'").drop("__n", "__has", "outcome", "line"), x.groupBy("outcome").agg(F.count("*").alias("n"))


def upsert_categories(categories: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add or change custom categories; rejects: those that a builtin one has the name of, or whose parent isn't there."""
    builtin = categories.where("builtin").select("canonical", F.lit(True).alias("__builtin"))
    known = categories.select("canonical").unionByName(new.select("canonical")).distinct().select(F.col("canonical").alias("parent"), F.lit(True).alias("__parent"))
    x = new.dropDuplicates(["canonical"]).join(builtin, "canonical", "left").join(known, "parent", "left")
    reason = F.when(F.col("__builtin"), "builtin").when(F.col("parent").isNotNull() & F.col("__parent").isNull(), "no such parent")
    x = x.withColumn("reason", reason)
    good = x.where("reason IS NULL").select("canonical", "parent", "label", F.lit(False).alias("builtin"))
    return categories.join(good, "canonical", "left_anti").select(*good.columns).unionByName(good), x.where("reason IS NOT NULL").select("canonical", "reason")


def upsert_aliases(aliases: DataFrame, new: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add or change aliases; rejects: those whose target is no known category."""
    known = categories.select("canonical")
    good = new.dropDuplicates(["alias"]).join(known, "canonical", "left_semi").select("alias", "canonical")
    return aliases.join(good, "alias", "left_anti").select("alias", "canonical").unionByName(good), new.join(known, "canonical", "left_anti").select("alias", F.lit("no such category").alias("reason"))


def broken_parents(categories: DataFrame) -> DataFrame:
    """canonical, reason of categories whose chain of parents ends in a missing one or goes round."""
    from .traces import roots

    named = categories.select(F.col("canonical").alias("event_id"), F.col("parent").alias("parent_event_id"))
    missing = named.where("parent_event_id IS NOT NULL").join(named.select(F.col("event_id").alias("parent_event_id")), "parent_event_id", "left_anti").select(F.col("event_id").alias("canonical"), F.lit("no such parent").alias("reason"))
    return missing.unionByName(roots(named).where("cycle").select(F.col("event_id").alias("canonical"), F.lit("cycle").alias("reason")))
