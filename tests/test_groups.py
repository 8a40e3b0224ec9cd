"""What no group may hold: the whole of a key."""

import datetime
import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from faultspan import queries
from faultspan.operators import audit
from faultspan.streaming import stateful

DIR = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("window_ms", [7, 60_000])
def test_limits_and_throttling_with_gaps_like_a_loop(spark, window_ms):
    rng = random.Random(window_ms)
    rows = []
    for i in range(400):
        t = T0 + datetime.timedelta(days=rng.choice([0, 0, 0, 1, 90, 4000]), milliseconds=rng.randint(0, 9 * window_ms))
        rows.append((i, rng.choice(["a", "a", "a", "b", "", None]), None if i % 50 == 7 else t))
    rows.append((400, "without times", None))
    df = spark.createDataFrame(rows, "request_id bigint, client string, received_at timestamp")
    limited, told = {}, []
    by_key = defaultdict(list)
    for i, k, t in rows:
        by_key[k].append((t is None, t or T0, i))
    for x in by_key.values():
        start, n = None, 0
        for none, t, i in sorted(x):
            if not none and (start is None or t >= start + datetime.timedelta(milliseconds=window_ms)):
                start, n = t, 0
                told.append(i)
            n += 1
            limited[i] = n > 2
        if all(none for none, _, _ in x):
            told.append(min(i for _, _, i in x))
    out = stateful.rate_limited(df, 2, window_ms)
    assert {r.request_id: r.limited for r in out.collect()} == limited
    assert "InPandas" not in plan(out)
    events = df.selectExpr("request_id AS id", "client AS fingerprint", "received_at AS ts", "'error' AS severity")
    out = stateful.throttled(events, window_ms)
    assert sorted(r.id for r in out.collect()) == sorted(told)
    assert "InPandas" not in plan(out)


def test_chains_end_with_the_day(spark):
    rows = queries.events(spark, DIR).selectExpr("id", "application", "CAST(CAST(ts AS DATE) AS STRING) AS day", "concat('|', event_id, '|', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), '|', message, '|', fingerprint) AS rest").collect()
    last, want = {}, {}
    for r in sorted(rows):
        chain = r.application, r.day
        want[r.id] = last[chain] = hashlib.sha256((last.get(chain, "genesis") + r.rest).encode()).hexdigest()
    assert {r.id: r.audit_hash for r in queries.audit_build(spark, DIR).collect()} == want


def test_tombstones_are_told_without_a_chain(spark, monkeypatch):
    monkeypatch.setattr(queries.U, "build", None)
    ids = [r.id for r in queries.events(spark, DIR).select("id").collect() if r.id % 10 == 4]
    assert tuple(queries.tombstone_report(spark, DIR).collect()[0]) == (len(ids), min(ids), max(ids))


def test_anchors_of_more_blocks_than_a_level_has(spark, tmp_path):
    """With more than 1,024 blocks of an application the heads are still one chain, as the SQL has it."""
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE TABLE events AS SELECT * REPLACE (event_id * 20000 AS event_id) FROM '{DIR}/events.parquet'")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = sorted(c.execute(f"SELECT key, level, block, head FROM ({queries.ORACLE_SQL['audit_anchors']})").fetchall())
    assert max(block for _, _, block, _ in want) > 1024
    assert sorted(tuple(r) for r in queries.audit_anchors(spark, str(tmp_path)).select("key", "level", "block", "head").collect()) == want


def test_chains_are_walked_where_their_rows_lie(spark):
    """One shuffle by chain: no groups, and no join to bring hashes back to rows; two rows of one id stay two."""
    df = spark.createDataFrame([(i, f"e{i}", T0, "m", "f", "ab"[i % 2]) for i in (3, 1, 2, 2, 5)], "id bigint, event_id string, ts timestamp, message string, fingerprint string, application string")
    out = audit.build(df, audit.block_key(df["application"], 2))
    assert "InPandas" not in plan(out) and "Join" not in plan(out) and plan(out).count("Exchange hashpartitioning") == 1
    assert sorted(r.id for r in out.collect()) == [1, 2, 2, 3, 5]


def test_jumps_shrink_as_chains_run_together(spark, monkeypatch):
    rng, sizes, written = random.Random(4), [], stateful.checkpointed

    def seen(df):
        out = written(df)
        if out.columns == ["k", "ms", "to"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(stateful, "checkpointed", seen)
    times = sorted(rng.sample(range(40_000), 4000))
    told, _ = stateful.fires(times, 100, None)
    out = stateful.starts(spark.createDataFrame([("a", t) for t in times], "k string, ms bigint"), 100)
    assert sorted(r.ms for r in out.collect()) == [t for t, x in zip(times, told, strict=True) if x]
    assert min(s for s in sizes[:8] if s) * 4 < sizes[0]
