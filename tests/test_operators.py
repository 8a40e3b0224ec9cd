import datetime
import random

import pytest
from pyspark.sql import functions as F

from faultspan.operators import analytics, audit, filters, mutations, search, traces
from faultspan.plans.registry import Registry, Tables
from faultspan.sources import io
from faultspan.streaming import jobs, stateful

T0 = datetime.datetime(2024, 1, 1)


def events(spark, rows):
    """rows: dicts over defaults."""
    base = {"id": 0, "event_id": "", "ts": T0, "application": "a", "severity": "error", "message": "m", "fingerprint": "f", "correlation_id": None, "parent_event_id": None, "resolved_at": None, "category": None, "tags": [], "hostname": None, "exception": None, "error_code": None, "stacktrace": None, "root_cause": None, "context": None, "metadata": None, "version": None, "environment": None, "command": None, "subsystem": None, "audit_hash": None}
    out = [base | {"id": i, "event_id": f"e{i}", "ts": T0 + datetime.timedelta(seconds=i)} | r for i, r in enumerate(rows, 1)]
    kinds = {"id": "bigint", "ts": "timestamp", "resolved_at": "timestamp", "tags": "array<string>"}
    return spark.createDataFrame([tuple(r[c] for c in base) for r in out], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in base))


def test_mttr(spark):
    hour = datetime.timedelta(hours=1)
    df = events(spark, [{"fingerprint": "1", "ts": T0, "resolved_at": T0 + hour}, {"fingerprint": "1", "ts": T0 + hour}, {"fingerprint": "1", "ts": T0 + hour}, {"fingerprint": "2"}])
    assert analytics.mttr(df).collect()[0].asDict() == {"resolved": 1, "unresolved": 1, "mean_seconds": 3600.0}
    assert analytics.mttr(df.where("fingerprint = '2'")).collect()[0].mean_seconds is None


def test_empty_overview(spark):
    assert analytics.overview(events(spark, [{}]).limit(0)).collect()[0].error_rate_per_day == 0.0


def test_pages_join_to_the_whole(spark):
    df = events(spark, [{"ts": T0 + datetime.timedelta(seconds=i // 3)} for i in range(30)])
    seen, cursor = [], None
    while True:
        p = filters.fetch(df, 7, cursor)
        seen += [r.id for r in p.items]
        assert p.total == 30
        cursor = p.next_cursor
        if not cursor:
            break
    assert seen == [r.id for r in df.orderBy(F.desc("ts"), F.desc("id")).collect()]
    assert filters.fetch(df, 5, "!!").warning and len(filters.fetch(df, 5, "!!").items) == 5


def test_filter_arguments():
    with pytest.raises(ValueError, match="ends before"):
        filters.Filters(start_ms=2, end_ms=1).checked()
    assert filters.age_ms("24h") == 86_400_000 and filters.clamp(500) == 200 and filters.clamp(0) == 1
    with pytest.raises(ValueError, match="age"):
        filters.age_ms("x")
    assert filters.time_ms("2024-01-01T00:00:00Z") == 1704067200000 and filters.time_ms("soon") is None


def test_bm25_like_sqlite(spark):
    import sqlite3

    rng = random.Random(3)
    words = "alpha beta gamma delta eps zeta".split()
    rows = [{"message": " ".join(rng.choices(words, k=rng.randint(1, 12))), "exception": rng.choice([None, "alpha", "beta gamma"]), "tags": rng.sample(words, 2)} for _ in range(80)]
    df = events(spark, rows)
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(message, exception, stack_norm, root_cause, tags_text, category, tokenize=\"unicode61 remove_diacritics 2 tokenchars '._:/-'\")")
    for i, r in enumerate(rows, 1):
        c.execute("INSERT INTO t(rowid, message, exception, tags_text) VALUES (?,?,?,?)", (i, r["message"], r["exception"], " ".join(r["tags"])))
    ix = search.index(df)
    a, b = search.term("alpha"), search.term("beta")
    for q, text in (
        (a, "alpha"), (search.prefix("ga*"), "ga*"), (search.phrase("alpha beta"), '"alpha beta"'), (a & b, "alpha AND beta"), (a | b, "alpha OR beta"), (a - b, "alpha NOT beta"),
        (a.in_field("exception"), "exception:alpha"), (search.near(a, b, within=2), "NEAR(alpha beta, 2)"), (search.near(a, b, within=0), "NEAR(alpha beta, 0)"),
    ):
        want = dict(c.execute("SELECT rowid, bm25(t, 3, 2, 1, 2, 2, 1) FROM t WHERE t MATCH ?", (text,)).fetchall())
        got = {r.id: r.score for r in search.scores(ix, q).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), text


def test_search_arguments(spark):
    assert search.parse_free("*") is None and search.parse_free("  ") is None
    for bad in (lambda: search.term("  "), lambda: search.near(search.term("a")), lambda: search.term("a").in_field("nope")):
        with pytest.raises(ValueError):
            bad()


def test_cycles_are_told(spark):
    df = events(spark, [{"parent_event_id": "e2"}, {"parent_event_id": "e1"}, {"parent_event_id": "gone"}, {"parent_event_id": "e3"}])
    got = {r.event_id: (r.root_id, r.depth, r.cycle) for r in traces.roots(df, 4).collect()}
    assert got == {"e1": (None, None, True), "e2": (None, None, True), "e3": ("e3", 0, False), "e4": ("e3", 1, False)}
    walked = traces.ancestors(df, df.where("id = 1")).collect()
    assert [(r.event_id, r.cycle) for r in sorted(walked, key=lambda r: r.depth)] == [("e2", False), ("e1", True)]


def test_audit_chain(spark):
    df = audit.build(events(spark, [{} for _ in range(12)]), F.lit("")).persist()
    none = df.limit(0).select(F.col("id").alias("row_id"), "audit_hash")
    assert audit.verify(df, none).collect()[0].asDict() == {"ok": True, "rows_checked": 12, "tombstones_bridged": 0, "first_break": None}
    assert audit.build(df, F.lit("")).exceptAll(df).count() == 0
    edges = spark.createDataFrame([], "src_event_id string, dst_event_id string, rel string")
    left, stones, _ = mutations.delete(df, edges, F.col("id") == 5, F.current_timestamp())
    assert audit.verify(left, stones).collect()[0].asDict() == {"ok": True, "rows_checked": 11, "tombstones_bridged": 1, "first_break": None}
    assert audit.verify(left, none).collect()[0].first_break == 6
    edited = df.withColumn("message", F.when(F.col("id") == 4, "x").otherwise(F.col("message")))
    assert audit.verify(edited, none).collect()[0].asDict() == {"ok": False, "rows_checked": 3, "tombstones_bridged": 0, "first_break": 4}
    assert left.count() + stones.count() == df.count()


def test_delete_selection(spark):
    df = events(spark, [{"resolved_at": T0}, {}])
    late = 2 * 1704067200000
    assert mutations.preview(df, mutations.Selector(resolved_before_ms=late)).count() == 1
    assert mutations.preview(df, mutations.Selector(resolved_before_ms=late, force=True)).count() == 2
    with pytest.raises(ValueError, match="needs"):
        mutations.Selector().column()


def test_resolution(spark):
    df = events(spark, [{}, {"resolved_at": T0}, {"resolved_at": T0}])
    up = spark.createDataFrame([("e1", T0, False), ("e2", T0 + datetime.timedelta(1), False), ("e3", T0 + datetime.timedelta(1), True), ("no", T0, False)], "event_id string, resolved_at timestamp, force boolean")
    out, told = mutations.resolve(df, up)
    assert [r.resolved_at for r in out.orderBy("id").collect()] == [T0, T0, T0 + datetime.timedelta(1)]
    assert {r.event_id: r.outcome for r in told.collect()} == {"e1": "resolved", "e2": "already_resolved", "e3": "forced", "no": "unmatched"}


def test_taxonomy(spark):
    from faultspan import schema

    cats = schema.categories(spark)
    new = spark.createDataFrame([("external", None, "x"), ("own", None, "Own"), ("own.part", "own", "Part"), ("lost.part", "lost", "L")], "canonical string, parent string, label string")
    out, bad = mutations.upsert_categories(cats, new)
    assert out.count() == 26 and {r.canonical: r.reason for r in bad.collect()} == {"external": "builtin", "lost.part": "no such parent"}
    again, _ = mutations.upsert_categories(out, new)
    assert again.exceptAll(out).count() == 0
    assert mutations.broken_parents(out).count() == 0
    als, bad = mutations.upsert_aliases(schema.aliases(spark), spark.createDataFrame([("z", "own"), ("y", "nope")], "alias string, canonical string"), out)
    assert als.count() == 3 and bad.count() == 1


def test_throttle_and_limits_like_a_loop(spark):
    rng = random.Random(1)
    rows = [{"fingerprint": rng.choice("xyz"), "ts": T0 + datetime.timedelta(seconds=rng.randint(0, 4000))} for _ in range(300)]
    df = events(spark, rows)
    want, last = [], {}
    for r in df.orderBy("ts", "id").collect():
        if r.fingerprint not in last or r.ts - last[r.fingerprint] >= datetime.timedelta(minutes=5):
            last[r.fingerprint] = r.ts
            want.append(r.id)
    assert sorted(r.id for r in stateful.throttled(df, 300_000).collect()) == sorted(want)
    assert stateful.throttled(df, None).count() == 300
    req = df.select(F.col("id").alias("request_id"), F.col("ts").alias("received_at"), F.col("fingerprint").alias("client"))
    state, over = {}, {}
    for r in req.orderBy("received_at", "request_id").collect():
        s = state.get(r.client)
        if s is None or r.received_at >= s[0] + datetime.timedelta(minutes=1):
            s = state[r.client] = [r.received_at, 0]
        s[1] += 1
        over[r.request_id] = s[1] > 2
    assert {r.request_id: r.limited for r in stateful.rate_limited(req, 2, 60_000).collect()} == over


def test_streams_like_tables(spark, tmp_path):
    df = events(spark, [{"fingerprint": "ab"[i % 2], "ts": T0 + datetime.timedelta(seconds=40 * i)} for i in range(60)])
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.start(stateful.throttled_stream(stream, 300_000), jobs.to_table(str(tmp_path / "out")), str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.event_id for r in stateful.throttled(df, 300_000).collect())
    errors = []

    def broken(df, batch):
        raise RuntimeError("down")

    sinks = jobs.fan_out({"broken": broken, "lines": jobs.to_lines(str(tmp_path / "lines")), "roll": jobs.merged_rollup(str(tmp_path / "roll"))}, errors)
    jobs.start(jobs.deduplicated(stream), sinks, str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "lines")).count() == 60 and errors[0][0] == "broken"
    assert {r.fingerprint: r["count"] for r in jobs.read_rollup(spark, str(tmp_path / "roll")).collect()} == {"a": 30, "b": 30}


def test_stores(spark, tmp_path):
    df = events(spark, [{} for _ in range(5)])
    io.save(df, str(tmp_path / "s"))
    assert io.scan(spark, str(tmp_path / "s")).exceptAll(df.select(*io.EVENT_COLUMNS)).count() == 0
    io.backup(spark, str(tmp_path / "s"), str(tmp_path / "b"))
    with pytest.raises(Exception, match="exist"):
        io.backup(spark, str(tmp_path / "s"), str(tmp_path / "b"))
    rows, status = io.federated(spark, {"s": str(tmp_path / "s"), "none": str(tmp_path / "none")}, lambda d: d, 2)
    assert rows.count() == 2 and {r.source_db: r.ok for r in status.collect()} == {"s": True, "none": False}
    io.export_lines(df, str(tmp_path / "l"))
    back = io.import_lines(spark, str(tmp_path / "l"))
    new, counts = mutations.merge_import(df.where("id < 3"), back)
    assert new.count() == 3 and {r.outcome: r.n for r in counts.collect()} == {"imported": 3, "duplicate": 2}
    assert io.upgraded(df.drop("audit_hash", "resolved_at"), 1).columns == io.EVENT_COLUMNS
    with pytest.raises(ValueError, match="version"):
        io.upgraded(df, 99)


def test_registry(spark):
    df = events(spark, [{"message": "payment gateway timeout"}, {"message": "other", "correlation_id": "r"}])
    edges = spark.createDataFrame([("e1", "e2", "retry_of")], "src_event_id string, dst_event_id string, rel string")
    r, t = Registry(), Tables(df, edges)
    assert [x.id for x in r.call("search_errors", t, query="gateway", order="rank").collect()] == [1]
    assert r.call("latest_errors", t, limit=1).collect()[0].id == 2
    assert r.call("get_trace", t, correlation_id="r").count() == 1
    assert r.call("explain_error", t, ids=["e1"]).collect()[0].edges[0].rel == "retry_of"
    assert r.call("doctor", t).collect()[0].rows == 2
    with pytest.raises(KeyError):
        r.call("nope", t)
    r.enrichers += [lambda d: d.withColumn("x", F.lit(1)), lambda d: d.select("missing")]
    assert "x" in r.enrich(df).columns and len(r.errors) == 1


def test_audit_chains_with_a_key(spark):
    df = events(spark, [{"application": "ab"[i % 2]} for i in range(12)])
    built = audit.build(df, F.col("application")).persist()
    none = df.limit(0).select(F.col("id").alias("row_id"), F.lit("").alias("audit_hash"), F.col("application").alias("chain"))
    assert audit.verify(built, none, F.col("application")).collect()[0].asDict() == {"ok": True, "rows_checked": 12, "tombstones_bridged": 0, "first_break": None}
    gone = built.where("id IN (5, 6)")
    stones = gone.select(F.col("id").alias("row_id"), "audit_hash", F.col("application").alias("chain"))
    left = built.where("id NOT IN (5, 6)")
    assert audit.verify(left, stones, F.col("application")).collect()[0].asDict() == {"ok": True, "rows_checked": 10, "tombstones_bridged": 2, "first_break": None}
    assert [r.id for r in audit.breaks(left, none, F.col("application")).orderBy("id").collect()] == [7, 8]


def test_more_tools(spark, tmp_path):
    from faultspan.plans import registry

    df = events(spark, [{"message": f"Disk Full {i % 2}", "fingerprint": f"f{i % 2}", "correlation_id": f"c{i % 3}", "category": None, "exception": None} for i in range(9)])
    t = registry.Tables(df, edges=spark.createDataFrame([], "src_event_id string, dst_event_id string, rel string"))
    tools = registry.Registry()
    one = df.orderBy("id").first().event_id
    assert tools.call("similar_errors", t, ids=[one], limit=2).count() == 2
    assert [r.n for r in tools.call("list_traces", t).collect()] == [3, 3, 3] and tools.call("list_traces", t, limit=1).count() == 1
    assert tools.call("classify_error", t, ids=[one]).count() == 1
    assert {r.part for r in tools.call("summary", t).collect()} == {"total", "severity", "failure"}
    assert tools.call("delete_errors", t, now_ms=0, fingerprint="f0", force=True).count() == 5 and t.tombstones is None
    assert tools.call("delete_errors", t, now_ms=0, confirm=True, fingerprint="f0", force=True).count() == 5 and t.events.count() == 4


def test_upgraded_stores(spark):
    from faultspan import schema
    from faultspan.sources import io

    old = events(spark, [{} for _ in range(4)])
    old = old.drop(*(c for c in ("audit_hash", "resolved_at") if c in old.columns))
    some = schema.categories(spark).limit(3)
    new, known = io.upgraded_store(old, 1, audit.block_key(), some)
    assert new.where("audit_hash IS NULL").count() == 0 and known.count() == schema.categories(spark).count()
    again, same = io.upgraded_store(new, schema.SCHEMA_VERSION, audit.block_key(), known)
    assert again.exceptAll(new).count() == 0 and same.count() == known.count()


def test_tools_know_the_chain(spark):
    from faultspan.plans import registry

    rows = events(spark, [{"application": "ab"[i % 2], "fingerprint": f"f{i % 4}"} for i in range(12)])
    edges = spark.createDataFrame([], "src_event_id string, dst_event_id string, rel string")
    built = audit.build(rows, F.col("application")).persist()
    tools, t = registry.Registry(), registry.Tables(built, edges, chain=F.col("application"), version=6)
    assert tools.call("verify_audit", t).collect()[0].ok and tools.call("doctor", t).collect()[0].schema_version == 6
    assert not tools.call("verify_audit", registry.Tables(built, edges)).collect()[0].ok
    assert tools.call("delete_errors", t, now_ms=0, confirm=True, fingerprint="f1", force=True).count() == 3
    told = tools.call("doctor", t).collect()[0]
    assert told.ok and told.rows == 9 and told.tombstones == 3 and told.tombstones_bridged > 0 and told.max_version == 7


def test_full_last_page(spark):
    df = spark.range(1, 201).select(F.col("id"), F.timestamp_seconds("id").alias("ts"))
    p = filters.fetch(df, 200)
    assert len(p.items) == 200 and p.next_cursor is None
    assert filters.fetch(df.unionByName(df.limit(1)), 200).next_cursor


def test_search_all_tells_of_each_store(spark, tmp_path):
    from faultspan.plans import registry

    df = events(spark, [{"message": f"disk full {i}"} for i in range(5)])
    for n in ("good", "broken"):
        io.save(df, f"{tmp_path}/{n}")
    next((tmp_path / "broken" / "events").rglob("*.parquet")).write_bytes(b"PAR1 no table")
    rows = registry.Registry().call("search_all", registry.Tables(df), stores={n: f"{tmp_path}/{n}" for n in ("good", "broken", "none")}, query="disk full", limit=3).collect()
    assert sorted((r.source_db, r.n, r.error is None) for r in rows if r.part == "store") == [("broken", 0, False), ("good", 3, True), ("none", 0, False), ("primary", 3, True)]
    assert sorted((r.source_db, r.id) for r in rows if r.part == "item") == [(n, i) for n in ("good", "primary") for i in (3, 4, 5)]


def test_ingest_from_end_to_end(spark):
    from faultspan.plans import registry
    from faultspan.sources import ingest

    body = '{"application":"a","message":"token=abc123 disk full","context":"{\\"pid\\":1}"}'
    raw = spark.createDataFrame([(i, f"e{i}", T0, body) for i in range(1, 4)] + [(4, "e4", T0, "{broken")], "id bigint, event_id string, ts timestamp, body string")
    t = registry.Tables(raw, chain=F.col("application"))
    good, bad = registry.ingest(raw, t, F.lit("h1"), {"pid": F.lit(9), "cwd": F.lit("/x")})
    rows = good.orderBy("id").collect()
    assert bad.count() == 1 and [r.hostname for r in rows] == ["h1"] * 3 and all('"pid":1' in r.context and '"cwd":"/x"' in r.context for r in rows)
    assert rows[0].audit_hash and len({r.audit_hash for r in rows}) == 3
    req = spark.createDataFrame([(1, T0, "127.0.0.1", "o", "ua", '{"events":[{"message":"m","tags":["a",5]}]}'), (2, T0, "1.2.3.4", "o", "ua", "{}")], "request_id bigint, received_at timestamp, remote_addr string, origin string, user_agent string, body string")
    seen, refused = registry.ingest_browser(ingest.guard(req, ["o"]), registry.Tables(req), "shop", F.lit("h2"))
    row = seen.collect()[0]
    assert (row.application, row.message, row.tags[:2], row.context, row.hostname) == ("shop", "m", ["browser", "a"], '{"ua":"ua"}', "h2") and refused.count() == 1


def test_walks_like_plain_python(spark):
    """Trees of many shapes, deep chains, missing parents, wide events and cycles, from all events."""
    rng = random.Random(9)
    parent = {}
    for i in range(1, 260):
        parent[f"e{i}"] = rng.choice([None, "gone", f"e{rng.randint(1, i)}", f"e{rng.randint(1, i)}"]) if i % 9 else None
    parent = {e: (p if p != e else None) for e, p in parent.items()}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(70)} | {f"w{i}": "c69" for i in range(40)}
    parent |= {"x1": "x2", "x2": "x3", "x3": "x1", "x4": "x1", "x5": "x4", "s": "s"}
    df = spark.createDataFrame(list(parent.items()), "event_id string, parent_event_id string")
    want, cycles = set(), set()
    for e in parent:
        at, seen, depth = e, {e}, 0
        while (at := parent.get(at)) is not None:
            depth += 1
            want.add((e, at, depth, at in seen))
            if at in seen:
                cycles.add(e)
                break
            seen.add(at)
    got = traces.ancestors(df, df)
    assert {(r.of_id, r.event_id, r.depth, r.cycle) for r in got.collect()} == want and got.count() == len(want)
    down = {(r.of_id, r.event_id, r.depth) for r in traces.descendants(df, df).where("NOT cycle").collect()}
    assert {x for x in down if x[0] in parent and x[0] not in cycles} == {(up, e, d) for e, up, d, c in want if up in parent and up not in cycles and e not in cycles}
    some = df.where("event_id IN ('c69', 'e200', 'x5')")
    assert {(r.of_id, r.event_id, r.depth, r.cycle) for r in traces.ancestors(df, some).collect()} == {w for w in want if w[0] in ("c69", "e200", "x5")}
    labels = {r.event_id: r for r in traces.labelled(df).collect()}
    assert set(labels) == (set(parent) | {p for p in parent.values() if p}) - cycles
    assert len({(r.root_id, r.pre) for r in labels.values()}) == len(labels)
    roots = {r.event_id: r for r in traces.roots(df).collect()}
    assert {e for e, r in roots.items() if r.cycle} == cycles


def test_pairs_and_dossiers_by_jumps(spark, monkeypatch):
    """No numbered trees are needed for all events; an event id with two parents has its edges among the members only."""
    monkeypatch.setattr(traces, "labelled", None)
    parent = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "gone"), ("x", "y"), ("y", "x"), ("d", "e")]
    rows = [(i, e, T0, p, "error", "m", "{}", "k.l", "f", "app", None) for i, (e, p) in enumerate(parent, 1)]
    df = spark.createDataFrame(rows, "id bigint, event_id string, ts timestamp, parent_event_id string, severity string, message string, context string, category string, fingerprint string, application string, resolved_at timestamp")
    edges = spark.createDataFrame([("a", "e", "retry_of")], "src_event_id string, dst_event_id string, rel string")
    down = {(r.of_id, r.event_id, r.depth) for r in traces.descendants(df, df).where("NOT cycle").collect()}
    assert down == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1), ("x", "y", 1), ("y", "x", 1)}
    some = traces.descendants(df, spark.createDataFrame([("gone",), ("b",)], "event_id string"))
    assert {(r.of_id, r.event_id, r.depth) for r in some.collect()} == {("gone", "e", 1), ("b", "c", 1), ("b", "d", 2)}
    own = df.where("id < 8")
    for given in (df, own):
        members, ties = traces.trace_of(given, edges, given)
        told = {(r.event_id, tuple(e)) for r in traces.explain(given, edges, given).collect() for e in r.edges or []}
        assert told == {(r.of_id, (r.src_event_id, r.dst_event_id, r.rel)) for r in ties.collect()}
    lone = {r.event_id: r for r in traces.explain(own, edges, own).collect()}
    assert lone["c"].chain == ["a", "b", "c"] and lone["c"].root_cause_id == "a" and set(lone["x"].chain) == {"x", "y"}
    assert [tuple(e) for e in lone["c"].edges] == [("a", "b", "caused_by"), ("b", "c", "caused_by"), ("c", "d", "caused_by")]
