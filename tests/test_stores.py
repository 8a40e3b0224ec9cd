"""Stores by commits, chains in streams, retries, failures as rows, rollups that merge: against tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from faultspan.operators import analytics, audit, mutations
from faultspan.sources import commits, io
from faultspan.streaming import jobs
from test_operators import T0, events

DAY = datetime.timedelta(days=1)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_batches_are_all_or_nothing(spark, tmp_path):
    path, df = f"file://{tmp_path}/s", events(spark, [{"ts": T0 + i * DAY / 2} for i in range(10)])
    assert io.append_batch(df, path, "1") and not io.append_batch(df, path, "1")
    fails = df.withColumns({"id": F.col("id") + 100, "message": F.udf(lambda x: 1 / 0, "string")("message")})
    with pytest.raises(Exception, match="division|UDF"):
        io.append_batch(fails, path, "2")
    assert ids(io.scan(spark, path)) == list(range(1, 11)) and io.scan(spark, path).columns == io.EVENT_COLUMNS
    assert ids(io.scan(spark, path, "2024-01-02", "2024-01-03")) == [3, 4, 5, 6]
    assert io.append_batch(df.withColumn("id", F.col("id") + 100), path, "2") and io.scan(spark, path).count() == 20
    assert io.store_version(spark, path) == 7
    sink = jobs.to_store(path, "s")
    sink(df.withColumn("id", F.col("id") + 200), 0)
    sink(df.withColumn("id", F.col("id") + 200), 0)
    assert io.scan(spark, path).count() == 30


def test_archive_is_one_commit(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    io.append_batch(events(spark, [{"ts": T0 + i * DAY / 4} for i in range(20)]), path, "1")
    now = int((T0 + 5 * DAY).timestamp() * 1000 + 6 * 3_600_000)
    whole, kept = commits.commit, commits.state(spark, path)

    def breaks(*_, **__):
        raise RuntimeError("gone")

    monkeypatch.setattr(commits, "commit", breaks)
    with pytest.raises(RuntimeError):
        io.archive_store(spark, path, "3d", now, "a")
    monkeypatch.setattr(commits, "commit", whole)
    assert commits.state(spark, path) == kept and io.archived(spark, path).count() == 0
    assert io.archive_store(spark, path, "3d", now, "a") and not io.archive_store(spark, path, "3d", now, "a")
    old, rest = mutations.archive(events(spark, [{"ts": T0 + i * DAY / 4} for i in range(20)]), "3d", now)
    assert ids(io.archived(spark, path)) == ids(old) and ids(io.scan(spark, path)) == ids(rest) and old.count() and rest.count()
    assert ids(io.with_archive(spark, path)) == list(range(1, 21)) and ids(io.with_archive(spark, path, "2024-01-02", "2024-01-03")) == list(range(5, 13))
    assert {(r.arch_year, r.arch_quarter) for r in io.archived(spark, path).collect()} == {(2024, 1)}
    # days that are wholly old were not written anew
    assert {f.path for f in kept.folders} & {f.path for f in commits.state(spark, path).of("archive")}


def test_chain_of_a_stream_like_one_build(spark, tmp_path):
    rows = [{"application": "ab"[i % 2], "message": f"m{i}"} for i in range(90)]
    df = events(spark, rows)
    df.repartition(1).sortWithinPartitions("id").write.option("maxRecordsPerFile", 20).parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    path, key = f"file://{tmp_path}/s", F.col("application")

    def by_id(batch_df, batch):  # files come in any order; batches have to come by id
        lo = batch * 20
        io.append_chained(df.where(f"id > {lo} AND id <= {lo + 20}"), path, f"b-{batch}", key, 4)
        io.append_chained(df.where(f"id > {lo} AND id <= {lo + 20}"), path, f"b-{batch}", key, 4)

    jobs.start(stream, by_id, f"{tmp_path}/c").awaitTermination(180)
    want = audit.build(df, audit.block_key(key, 4))
    got = io.scan(spark, path)
    assert {r.id: r.audit_hash for r in got.collect()} == {r.id: r.audit_hash for r in want.collect()}
    assert {(r.chain, r["last"]) for r in io.heads(spark, path).collect()} == {(f"{'ab'[(i - 1) % 2]}#{i >> 4}", i) for i in range(1, 91) if i + 2 > 90 or (i + 2) >> 4 != i >> 4}
    io.append_chained(df.where("id IN (3, 4)"), path, "late", key, 4)
    assert ids(io.scan(spark, path, table="late")) == [3, 4] and io.scan(spark, path).count() == 90
    none = df.limit(0).select(F.col("id").alias("row_id"), "audit_hash", F.lit("").alias("chain"))
    assert audit.verify(got, none, audit.block_key(key, 4)).collect()[0].ok


def test_anchors_tell_what_links_cannot(spark):
    df = audit.build(events(spark, [{"application": "ab"[i % 2], "message": f"m{i}"} for i in range(200)]), audit.block_key(F.col("application"), 3)).persist()
    key = F.col("application")
    stored = audit.anchors(df, None, key, 3).persist()
    assert {(r.key, r.level, r.n) for r in stored.groupBy("key", "level").agg(F.count("*").alias("n")).collect()} == {("a", 0, 25), ("b", 0, 26), ("a", 1, 4), ("b", 1, 4), ("a", 2, 1), ("b", 2, 1)}
    assert audit.broken_anchors(df, stored, None, key, 3).count() == 0
    last = df.where("application = 'a'").agg(F.max("id")).collect()[0][0]
    cut = df.where(F.col("id") != last)
    none = df.limit(0).select(F.col("id").alias("row_id"), "audit_hash", F.lit("").alias("chain"))
    assert audit.verify(cut, none, audit.block_key(key, 3)).collect()[0].ok
    broken = audit.broken_anchors(cut, stored, None, key, 3).collect()
    assert {(r.key, r.level) for r in broken} == {("a", 0), ("a", 1), ("a", 2)}
    stone = df.where(F.col("id") == last).select(F.col("id").alias("row_id"), "audit_hash", F.col("application").alias("key"))
    assert audit.broken_anchors(cut, stored, stone, key, 3).count() == 0


def test_retries_and_lost_rows(spark, tmp_path):
    df = events(spark, [{"severity": "fatal" if i % 3 == 0 else "info"} for i in range(30)])
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    calls = {"once": 0, "twice": 0}

    def failing(name, times, path):
        def sink(rows, batch):
            calls[name] += 1
            if calls[name] <= times:
                raise RuntimeError(f"{name} down")
            io.append_batch(rows, path, f"{name}-{batch}")

        return sink

    metrics = jobs.Metrics()
    spark.streams.addListener(metrics)
    lost, failures = f"file://{tmp_path}/lost", f"file://{tmp_path}/failures"
    once = jobs.with_retry(failing("once", 1, f"file://{tmp_path}/once"), lost, "once")
    twice = jobs.with_retry(failing("twice", 2, f"file://{tmp_path}/twice"), lost, "twice")
    never = failing("never", 10**9, "")
    calls["never"] = 0
    jobs.start(jobs.observed(stream), jobs.fan_out({"once": once, "twice": twice, "never": never}, failures=jobs.to_failures(failures)), f"{tmp_path}/c").awaitTermination(180)
    assert io.scan(spark, f"file://{tmp_path}/once").count() == 30
    rows = jobs.lost_rows(spark, lost).collect()
    assert len(rows) == 30 and {r.error for r in rows} == {"twice down"} and calls == {"once": 2, "twice": 2, "never": 1}
    assert [(r.sink, r.batch, r.error, r.rows) for r in jobs.read_failures(spark, failures).collect()] == [("never", 0, "never down", 30)]
    for _ in range(50):
        if metrics.totals:
            break
        __import__("time").sleep(0.2)
    spark.streams.removeListener(metrics)
    assert metrics.totals["ingest"] == {"rows": 30, "severe": 10}


def test_rollup_of_a_stream_in_every_column(spark, tmp_path):
    df = events(spark, [{"fingerprint": "abc"[i % 3], "message": f"m{i}", "category": f"c{i % 2}", "ts": T0 + datetime.timedelta(hours=(i * 7) % 50)} for i in range(60)])
    df.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/roll"
    roll = jobs.merged_rollup(path)

    def twice(rows, batch):
        roll(rows, batch)
        roll(rows, batch)

    jobs.start(stream, twice, f"{tmp_path}/c").awaitTermination(180)
    want = sorted(map(tuple, analytics.rollup(df).collect()))
    assert len(commits.state(spark, path).of("rollup")) > 1
    assert sorted(map(tuple, jobs.read_rollup(spark, path).collect())) == want
    jobs.compacted_rollup(spark, path, "compact")
    assert len(commits.state(spark, path).of("rollup")) == 1 and sorted(map(tuple, jobs.read_rollup(spark, path).collect())) == want
    assert {(r.day, r.n, r.distinct) for r in jobs.read_days(spark, path).collect()} == {(r.day, r.n, r.d) for r in df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("d")).collect()}
    jobs.live_rollup(stream).writeStream.format("memory").queryName("live_rollup").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(180)
    assert sorted(map(tuple, spark.table("live_rollup").collect())) == want


def test_stores_that_break_are_rows(spark, tmp_path):
    df = events(spark, [{"message": "disk full"} for _ in range(5)])
    io.save(df, f"{tmp_path}/good")
    io.save(df, f"{tmp_path}/broken")
    files = [p for p in (tmp_path / "broken" / "events").rglob("*.parquet")]
    files[0].write_bytes(b"PAR1 no table")
    rows, status = io.federated(spark, {"good": f"{tmp_path}/good", "broken": f"{tmp_path}/broken", "none": f"{tmp_path}/none"}, lambda d: d, 3)
    assert rows.count() == 3 and {(r.source_db, r.ok, r.n, r.error is None) for r in status.collect()} == {("good", True, 3, True), ("broken", False, 0, False), ("none", False, 0, False)}


def test_live_counts_and_rate_limits_of_streams(spark, tmp_path):
    df = events(spark, [{"ts": T0 + datetime.timedelta(minutes=17 * i), "application": "ab"[i % 2]} for i in range(40)])
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    jobs.live_counts(stream, by="application").writeStream.format("memory").queryName("live_counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination(180)
    want = df.groupBy(F.date_trunc("hour", "ts").alias("start"), "application").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("live_counts").collect())) == sorted(map(tuple, want.collect()))

    from faultspan.streaming import stateful

    req = df.select(F.col("id").alias("request_id"), F.col("ts").alias("received_at"), F.col("application").alias("remote_addr"), F.lit("o").alias("origin"))
    req.repartition(1).write.parquet(f"{tmp_path}/req")
    calls = spark.readStream.schema(req.schema).parquet(f"{tmp_path}/req")
    jobs.start(stateful.rate_limited_stream(calls, 2, 3 * 3_600_000), jobs.to_table(f"{tmp_path}/out"), f"{tmp_path}/c2").awaitTermination(180)
    got = {(r.request_id, r.client, r.limited) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = stateful.rate_limited(stateful.client_key(req), 2, 3 * 3_600_000)
    assert got == {(r.request_id, r.client, r.limited) for r in table.collect()} and any(r[2] for r in got)
