"""Rules and enrichers that fail on some rows, and what is registered by name."""

import pytest
from pyspark.sql import functions as F
from test_operators import events

from faultspan.functions import columns, hooks
from faultspan.plans import registry


def test_failures_stay_with_their_rows(spark):
    df = events(spark, [{"message": f"m{i}", "tags": ["t"], "category": "given" if i == 7 else None} for i in range(12)])

    def odd(row):
        if row["id"] == 3:
            raise ValueError("three")
        return "odd" if row["id"] % 2 else None

    out, errors = hooks.classified_by(df, {"odd": odd, "rest": lambda r: "rest" if r["id"] > 2 else None})
    got = {r.id: (r.category, r.matched_rule) for r in out.collect()}
    assert got == {i: ("given", None) if i == 8 else ("rest", "rest") if i == 3 or (i % 2 == 0 and i > 2) else (None, None) if i == 2 else ("odd", "odd") for i in range(1, 13)}
    assert [tuple(r) for r in errors.collect()] == [("e3", "odd", "ValueError: three")]
    assert out.drop("matched_rule", "category").exceptAll(df.drop("category")).count() == 0


def test_enrichers_of_rows(spark):
    df = events(spark, [{"message": f"m{i}"} for i in range(6)])
    steps = {
        "upper": lambda r: {"message": r["message"].upper()} if r["id"] != 2 else 1 / 0,
        "wrong": lambda r: {"shard": "no number"} if r["id"] == 4 else {"shard": r["id"] % 2},
        "unknown": lambda r: {"nope": 1} if r["id"] == 5 else None,
    }
    out, errors = hooks.enriched_by(df, steps, "shard int")
    assert {r.id: (r.message, r.shard) for r in out.collect()} == {i: ("m1" if i == 2 else f"M{i - 1}", None if i == 4 else i % 2) for i in range(1, 7)}
    assert sorted((r.event_id, r.hook) for r in errors.collect()) == [("e2", "upper"), ("e4", "wrong"), ("e5", "unknown")]
    assert hooks.enriched_by(df.limit(0), steps, "shard int")[0].count() == 0


def test_registered_hooks_and_exporters(spark, tmp_path):
    r, df = registry.Registry(), events(spark, [{}, {}])
    r.row_enrichers["host"] = lambda row: {"hostname": f"h{row['id']}"}
    r.rules["all"] = lambda row: row["missing"]
    out, errors = r.hooked(df)
    assert [x.hostname for x in out.orderBy("id").collect()] == ["h1", "h2"] and {x.error for x in errors.collect()} == {"KeyError: 'missing'"}
    r.exporters["lines"] = lambda d: d.select("event_id").write.json(f"{tmp_path}/out")
    r.export("lines", df)
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    with pytest.raises(KeyError, match="nope"):
        r.export("nope", df)


def test_sampling_and_ids(spark):
    df = events(spark, [{"message": f"m{i}"} for i in range(2000)])
    some = columns.sampled(df, 0.3)
    assert 500 < some.count() < 700 and some.exceptAll(columns.sampled(df, 0.3)).count() == 0
    assert columns.sampled(df, 0).count() == 0 and columns.sampled(df, 1).count() == 2000
    ids = df.select(columns.new_event_id("message", "id").alias("a"), columns.new_event_id().alias("b"))
    again = df.select(columns.new_event_id("message", "id").alias("a"))
    assert ids.select("a").distinct().count() == 2000 == ids.select("b").distinct().count()
    assert again.exceptAll(ids.select("a")).count() == 0 and all(r.a.startswith("evt-") for r in again.limit(3).collect())


def test_first_rule_wins(spark):
    df = events(spark, [{"message": "a b"}, {"message": "b"}, {"message": "c"}])
    has = lambda w: lambda d: F.when(d["message"].contains(w), w)
    rule = columns.first_match(has("a"), has("b"))
    assert [r.x for r in df.select("id", rule(df).alias("x")).orderBy("id").collect()] == ["a", "b", None]
