"""What users call: named tools over a store's tables, exporters by name, and composite pipelines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspan import schema
from faultspan.functions import columns, hooks
from faultspan.operators import analytics, audit, filters, mutations, search, traces
from faultspan.sources.ingest import browser_batches, sdk_payloads
from faultspan.sources.io import federated, scan, store_version
from faultspan.streaming.jobs import pipeline

SUMMARY = ["id", "event_id", "ts", "application", "severity", "category", "error_code", "message", "fingerprint", "resolved_at"]


@dataclass
class Tables:
    """A store's tables; those that are missing stay None. chain is the key of the audit chains that the events were linked by, None for one chain."""

    events: DataFrame
    edges: DataFrame | None = None
    tombstones: DataFrame | None = None
    categories: DataFrame | None = None
    aliases: DataFrame | None = None
    index: search.Index | None = None
    rejects: DataFrame | None = None
    chain: Column | None = None
    version: int = schema.SCHEMA_VERSION


def opened(spark: SparkSession, path: str, **more) -> Tables:
    """The tables of a store, with the schema version that it was written with."""
    return Tables(scan(spark, path), version=store_version(spark, path), **more)


def event_summary(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in SUMMARY if c in df.columns))


def event_detail(df: DataFrame, key=None) -> DataFrame:
    """All columns, metadata decrypted where the key fits."""
    from faultspan.functions.columns import decrypted

    return df.withColumn("metadata", decrypted("metadata", key))


def ingest(raw: DataFrame, tables: Tables, hostname: Column | None = None, defaults: dict[str, Column] | None = None, last: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """JSON payloads (body) to events and rejects.

    With a hostname or defaults missing ones are filled; where the tables have a chain, rows that come with id, event_id and ts are linked, on from its last hashes.
    """
    good, bad = sdk_payloads(raw)
    return _finished(good, tables, hostname, defaults, last, **how), bad


def ingest_browser(guarded: DataFrame, tables: Tables, application: str, hostname: Column | None = None, defaults: dict[str, Column] | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Requests with their status to events of the accepted ones, with repeatable ids, and the refused requests."""
    rows = browser_batches(guarded, application)
    rows = rows.withColumn("event_id", columns.new_event_id("request_id", "place")).withColumns({c: F.lit(None).cast("string") for c in ("category", "metadata") if c not in rows.columns})
    return _finished(rows, tables, hostname, defaults, None, **how), guarded.where("status <> 202")


def _finished(rows: DataFrame, tables: Tables, hostname: Column | None, defaults: dict[str, Column] | None, last: DataFrame | None, **how) -> DataFrame:
    if hostname is not None or defaults:
        rows = rows if "hostname" in rows.columns else rows.withColumn("hostname", F.lit(None).cast("string"))
        rows = columns.with_defaults(rows, hostname if hostname is not None else F.lit(None).cast("string"), defaults or {})
    out = pipeline(rows, tables.aliases, **how)
    return audit.build(out, tables.chain, last) if tables.chain is not None and {"id", "event_id", "ts"} <= set(out.columns) else out


def _index(t: Tables) -> search.Index:
    return t.index or search.index(t.events)


def _search(t: Tables, query: str | search.Query | None = None, limit: int | None = None, cursor: str | None = None, order: str = "recency", **f) -> DataFrame:
    q = search.parse_free(query) if query is None or isinstance(query, str) else query
    rank = order == "rank" and q is not None
    return filters.page(search.found(t.events, _index(t) if q else None, q, filters.Filters(**f), rank), limit, cursor, rank)


def _latest(t: Tables, limit: int | None = None, **f) -> DataFrame:
    return event_summary(filters.page(t.events.where(filters.Filters(**f).checked().column()), limit))


def _stones(t: Tables) -> DataFrame:
    """Tombstones with the chains that they lie in; none, if there is no such table."""
    kind = "row_id bigint, event_id string, audit_hash string, chain string"
    return t.tombstones if t.tombstones is not None else t.events.sparkSession.createDataFrame([], kind)


def _verify(t: Tables) -> DataFrame:
    return audit.verify(t.events, _stones(t), t.chain)


def _doctor(t: Tables) -> DataFrame:
    """rows, open, schema version of the store and the newest one known, dropped rows if rejects are kept, whether the chains hold."""
    rows = t.events.agg(F.count("*").alias("rows"), F.count(F.when(F.col("resolved_at").isNull(), 1)).alias("open")).withColumns({"schema_version": F.lit(t.version), "max_version": F.lit(schema.SCHEMA_VERSION)})
    if t.rejects is not None:
        rows = rows.crossJoin(F.broadcast(analytics.dropped(t.rejects)))
    if "audit_hash" not in t.events.columns:
        return rows
    return rows.crossJoin(F.broadcast(_verify(t))).crossJoin(F.broadcast(audit.tombstone_report(_stones(t))))


def _ids(t: Tables, ids: list[str]) -> DataFrame:
    given = t.events.sparkSession.createDataFrame([(i,) for i in ids], "given string")
    return traces.resolve_ids(t.events, given).where("event_id IS NOT NULL").select("event_id")


def _similar(t: Tables, ids: list[str], by: str = "fingerprint", limit: int | None = None) -> DataFrame:
    """Other events like each given one: the latest with its fingerprint, or the best that hold its message."""
    n = filters.clamp(limit)
    return search.similar_by_fingerprint(t.events, _ids(t, ids), n) if by == "fingerprint" else search.similar_by_text(t.events, _index(t), _ids(t, ids), n)


def _search_all(t: Tables, stores: dict[str, str], query: str | None = None, limit: int | None = None) -> DataFrame:
    """The first rows by rank of these tables ("primary") and of every store that can be read, each by its own statistics (part item), and a row for each store with its number of rows or its error (part store)."""
    rank = search.parse_free(query) is not None

    def first(df: DataFrame) -> DataFrame:
        found = _search(Tables(df, index=t.index if df is t.events else None), query, limit, order="rank")
        return found.select(*SUMMARY, "score" if rank else F.lit(None).cast("double").alias("score"))

    order = [F.asc_nulls_last("score"), F.desc("ts"), F.desc("id")]
    rows, status = federated(t.events.sparkSession, {"primary": t.events} | stores, first, filters.clamp(limit), order)
    told = status.select(F.lit("store").alias("part"), "source_db", "n", "error")
    return told if rows is None else rows.withColumn("part", F.lit("item")).unionByName(told, allowMissingColumns=True)


def _delete(t: Tables, now_ms: int, confirm: bool = False, **what) -> DataFrame:
    """The tombstones of a deletion; without confirm nothing but what it would take."""
    if not confirm:
        return mutations.preview(t.events, mutations.Selector(**what))
    chains = t.events.select("event_id", t.chain.alias("chain")) if t.chain is not None else None
    t.events, stones, t.edges = mutations.delete(t.events, t.edges, mutations.Selector(**what).column(), F.timestamp_millis(F.lit(now_ms)))
    stones = stones.join(chains, "event_id") if chains is not None else stones
    t.tombstones = stones if t.tombstones is None else t.tombstones.unionByName(stones, allowMissingColumns=True)
    return stones


def _long(parts: dict[str, DataFrame]) -> DataFrame:
    """part, key, n of each part of a summary."""
    total = parts["total"].select(F.lit("total").alias("part"), F.lit("").alias("key"), F.col("total").alias("n"))
    return total.unionByName(parts["by_category"].select(F.lit("category").alias("part"), F.col("category").alias("key"), "n")).unionByName(parts["by_severity"].select(F.lit("severity").alias("part"), F.col("severity").alias("key"), "n")).unionByName(parts["top"].select(F.lit("failure").alias("part"), F.col("fingerprint").alias("key"), "n"))


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "search_errors": _search,
    "latest_errors": _latest,
    "statistics": lambda t, **f: analytics.statistics(t.events, filters.Filters(**f)),
    "timeline": lambda t, by="day", series=None, **f: analytics.timeline(t.events, filters.Filters(**f), by, series),
    "top_failures": lambda t, by="count", limit=None, **f: analytics.top_failures(t.events, filters.Filters(**f), by, limit),
    "mttr": lambda t, **f: analytics.mttr(t.events, filters.Filters(**f)),
    "summarize": lambda t, group_by=("category",), **f: analytics.summary_by(t.events, list(group_by), filters.Filters(**f)),
    "list_categories": lambda t, **f: analytics.category_rollup(t.events, t.categories, filters.Filters(**f)),
    "fingerprint_stats": lambda t, fingerprint: analytics.rollup(t.events.where(F.col("fingerprint") == fingerprint)),
    "get_error": lambda t, ids, key=None: event_detail(t.events.join(_ids(t, ids), "event_id", "left_semi"), key),
    "get_trace": lambda t, correlation_id: traces.timeline(t.events.where(F.col("correlation_id") == correlation_id)),
    "explain_error": lambda t, ids: traces.explain(t.events, t.edges, _ids(t, ids)),
    "similar_errors": _similar,
    "list_traces": lambda t, limit=None, **f: traces.summary(t.events.where(filters.Filters(**f).checked().column())).orderBy(F.desc("end"), "correlation_id").limit(filters.clamp(limit)),
    "search_all": _search_all,
    "classify_error": lambda t, ids, rules=(): t.events.join(_ids(t, ids), "event_id", "left_semi").select("event_id", columns.classified(list(rules)).alias("c")).select("event_id", "c.*"),
    "delete_errors": _delete,
    "summary": lambda t, **f: _long(analytics.summarize(t.events, filters.Filters(**f))),
    "preview_delete": lambda t, **what: mutations.preview(t.events, mutations.Selector(**what)),
    "verify_audit": _verify,
    "doctor": _doctor,
}


@dataclass
class Registry:
    """Hooks of one's own: enrichers (of tables and of rows), rules, tools and exporters, by name and in order of registration."""

    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=lambda: dict(TOOLS))
    enrichers: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    row_enrichers: dict[str, hooks.Enricher] = field(default_factory=dict)
    rules: dict[str, hooks.Rule] = field(default_factory=dict)
    exporters: dict[str, Callable[[DataFrame], None]] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def call(self, name: str, tables: Tables, **params) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"no tool {name}; there are {', '.join(sorted(self.tools))}")
        return self.tools[name](tables, **params)

    def enrich(self, df: DataFrame) -> DataFrame:
        """Each in turn; one that fails to make a plan is noted and left out."""
        for f in self.enrichers:
            try:
                df = f(df)
            except Exception as e:
                self.errors.append((getattr(f, "__name__", "enricher"), str(e).splitlines()[0][:300]))
        return df

    def hooked(self, df: DataFrame, adds: str = "") -> tuple[DataFrame, DataFrame]:
        """Rows through the row enrichers and the rules, and the table of their failures (event_id, hook, error)."""
        out, first = hooks.enriched_by(df, self.row_enrichers, adds)
        out, second = hooks.classified_by(out, self.rules)
        return out, first.unionByName(second)

    def export(self, name: str, df: DataFrame) -> None:
        if name not in self.exporters:
            raise KeyError(f"no exporter {name}")
        self.exporters[name](df)
