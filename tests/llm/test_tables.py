"""URL filter, WARC packages, preference pairs, vantage trees and the pipeline."""

import base64
import hashlib
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultspan.llm import byte_bpe, preference, queries, url_filter, vantage, warc_zip

DIR = "/root/testdata/sf0.001"


def split(url):
    _, sep, rest = (url or "").partition("://")
    rest = rest if sep else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest.split("?")[0].split("#")[0]


def test_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?q#x", "https://a.example.com/en/x", "https://notexample.com/en/x", "http://xnet/es/", "http://b.NET/es/1", "http://b.net/de/", "ftp://x.com?x=/a", "a://b://c/d", "http://É.com/é", "http://x.com#/y", "http://x.com\n/fr/z", "http://b.net:80/fr/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, host string")
    rows = url_filter.judge(df, queries.RULES, [0.0] * (url_filter.BUCKETS + 1)).orderBy("page_id").collect()
    for u, r in zip(urls, rows, strict=True):
        host, path = split(u)
        fits = [x for x in queries.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None)
        assert r.verdict == (best.verdict if best else "allow")


def test_url_classifier(spark):
    rng = random.Random(2)
    rows = [(f"http://{rng.choice(['casino', 'winbig'] if y else ['news', 'garden'])}{rng.randrange(999)}.org/{rng.choice('abc')}/{rng.randrange(999)}", y) for y in [0, 1] * 150]
    weights = url_filter.fit(spark.createDataFrame([*rows[:200], (None, 1), ("x", None), ("y", 7)], "url string, label int"))
    got = url_filter.judge(spark.createDataFrame(rows[200:], "url string, y int"), [], weights).where("(verdict = 'block') <> (y = 1)").count()
    assert got <= 3
    assert set(url_filter.fit(spark.createDataFrame([], "url string, label int"))) == {0.0}


def test_first_of_equal_rules(spark):
    rules = [url_filter.Rule("a.com", "/", "allow"), url_filter.Rule("com", "/xy", "block"), url_filter.Rule("m", "/", "block")]
    assert len(rules[0].name) == len(rules[1].name)
    df = spark.createDataFrame([("http://a.com/xyz",), ("http://b.com/xyz",)], "url string")
    zero = [0.0] * (url_filter.BUCKETS + 1)
    assert [r.rule for r in url_filter.judge(df, rules, zero).collect()] == ["a.com/", "com/xy"]
    assert [r.rule for r in url_filter.judge(df, rules[1::-1], zero).collect()] == ["com/xy", "com/xy"]


def test_url_slopes_like_brute_force(spark):
    rows = [(f"http://{'bad' if i % 3 else 'good'}{i}.org/p{i % 5}", int(i % 3 > 0)) for i in range(40)]
    df = spark.createDataFrame([*rows, (rows[0][0], 1), ("http://" + "x" * 5000 + ".com/", 0)], "url string, label int")
    got = np.array(url_filter.fit(df, turns=4))
    of = df.select(F.col("label").alias("y"), url_filter.grams(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("b")).collect()
    w = np.zeros(url_filter.BUCKETS + 1)
    for turn in range(4):
        g = np.zeros_like(w)
        for r in of:
            root = np.sqrt(len(r.b))
            d = r.y - 1 / (1 + np.exp(-(w[r.b].sum() / root + w[-1])))
            np.add.at(g, r.b, d / root)
            g[-1] += d
        hit = np.zeros(len(w), bool)
        hit[[-1, *(b for r in of for b in r.b)]] = True
        w[hit] += 4.0 / np.sqrt(1 + turn / 5) * (g / len(of) - 1e-4 * w)[hit]
    assert np.allclose(got, w)
    empty = df.limit(0).withColumn("page_id", F.lit(1))
    assert url_filter.judge(empty, queries.RULES, got.tolist()).count() == 0


def test_op2(spark):
    rows = queries.op2_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 250 and {r.verdict for r in rows} == {"allow", "block"}


@pytest.mark.parametrize("wide", [False, True])
def test_packages(spark, tmp_path, wide):
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate(["<p>é</p>", "", None, "<p>é</p>", "same", "same", "same", "x" * 300_000, "a\r\n\r\nb WARC/1.1"])] + [(4, "http://again", "same"), (None, None, "same"), (20, "u\r\nv", "last")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("path", F.lit("clash")).withColumn("record_type", F.lit(1)).repartition(2)
    folder = f"file://{tmp_path}/p"
    listed = warc_zip.write(df, folder, wide=wide, package=100).collect()
    assert sum(r.records for r in listed) == len(rows)
    for r in listed:
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]
    packages = spark.createDataFrame(listed)
    back = warc_zip.read(warc_zip.ranges(packages)).collect()
    pay = {(p, (h or "").encode()) for p, _, h in rows}
    assert {(None if r.record_id == "None" else int(r.record_id), bytes(r.payload)) for r in back if r.record_type == "response"} <= pay and len(back) == len(rows)


@pytest.mark.parametrize("least", [0, 5])
def test_revisits_like_brute_force(spark, tmp_path, least):
    rng = random.Random(3)
    rows = [(i, "u", rng.choice([None, "", "aaaa", "bbbbbbb", f"own {i}"])) for i in range(60)]
    got = warc_zip.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"file://{tmp_path}/q", least=least).collect()
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(p, best.get(h or "", -1))
    want = []
    for p, _, h in rows:
        h = (h or "").encode()
        first = best[h.decode()] if len(h) >= least else p
        want.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first == p else "revisit", None if first == p else first))
    assert sorted(map(tuple, got)) == sorted(want)
    assert warc_zip.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string"), f"file://{tmp_path}/e").count() == 0


def test_foreign_packages(tmp_path):
    import pyarrow.fs as fs

    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", b"stored bytes")
        z.writestr(zipfile.ZipInfo("b"), b"x" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside"
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        r = warc_zip.ZipReader(f)
        assert r.read(r.start("a"), r.members["a"].size) == b"stored bytes"
        with pytest.raises(ValueError, match="compressed"):
            r.start("b")
    path.write_bytes(b"nothing")
    with fs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.ZipReader(f)


def record(kind, block, **fields):
    head = "".join(f"{k.replace('_', '-')}:{v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nwarc-type:  {kind}\r\nCONTENT-LENGTH: {len(block)}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("indexed", [False, True])
def test_archives_of_others(spark, tmp_path, indexed):
    import gzip
    import json

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    sha = base64.b32encode(hashlib.sha1(b"<p>hi</p>").digest()).decode()
    all_of = [record("warcinfo", b"software: x"), record("response", http, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{sha.lower()}", WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="http://x/"), record("resource", b"a" * 3_000_000, WARC_Payload_Digest="md5:00"), record("revisit", b"", WARC_Refers_To="<urn:uuid:1>")]
    packed = [gzip.compress(r) for r in all_of]
    lines, at = "", 0
    for i, r in enumerate(packed):
        lines += f"com,x)/ 2024 {json.dumps({'offset': str(at), 'length': str(len(r)), 'filename': 'some.warc.gz'})}\n" if i else "!meta no json\n"
        at += len(r)
    with zipfile.ZipFile(tmp_path / "p.wacz", "w") as z:
        z.writestr("archive/some.warc.gz", b"".join(packed))
        z.writestr("archive/plain.warc", all_of[0] + all_of[1])
        if indexed:
            z.writestr("indexes/index.cdxj", lines)
    rows = warc_zip.read(warc_zip.ranges(spark.createDataFrame([(f"file://{tmp_path}/p.wacz",)], "path string"))).collect()
    kinds = sorted(r.record_type for r in rows)
    assert kinds == sorted(["warcinfo", "response", "response", "resource", "revisit"] + ["warcinfo"] * (not indexed))
    assert all(bytes(r.payload) == b"<p>hi</p>" and r.payload_digest == sha and r.record_id == "urn:uuid:1" for r in rows if r.record_type == "response")
    assert [(r.refers_to, r.payload_bytes) for r in rows if r.record_type == "revisit"] == [("urn:uuid:1", None)]


def test_as_many_members_as_fit(tmp_path):
    import pyarrow.fs as fs

    with zipfile.ZipFile(tmp_path / "z.zip", "w", allowZip64=True) as z:
        for i in range(0xFFFF):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
    data = (tmp_path / "z.zip").read_bytes()
    end64 = data.rfind(warc_zip.END64)
    (tmp_path / "z.zip").write_bytes(data[:end64] + data[data.rfind(warc_zip.END) :] if end64 >= 0 else data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "z.zip")) as f:
        assert len(warc_zip.ZipReader(f).members) == 0xFFFF


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_preference_like_brute_force(spark):
    rng = random.Random(4)
    talks = {}
    for c in range(30):
        talks[c] = [("user", "hi" if c < 20 else f"q{c}")] + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", None, ""])) for _ in range(rng.randint(0, 5))]
    rows = [(c, i, r, t, "x") for c, ts in talks.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame([*rows, rows[0], (None, 0, "user", "lost", "x"), (70, None, None, None, "x")], "conv_id bigint, turn bigint, role string, text string, place string")
    pairs = [(a, b) for a in range(0, 30, 3) for b in range(1, 30, 4)] + [(0, 0), (70, 70)]
    got = preference.format_pairs(preference.turns_of(df), spark.createDataFrame([*pairs, (0, 999), (None, 1), (0, 1), (0, 1)], "chosen_id bigint, rejected_id bigint")).collect()
    talks[70] = [(None, None)]
    clean = {c: [(r or "", t or "") for r, t in ts] for c, ts in talks.items()}
    assert sorted({(r.chosen_id, r.rejected_id) for r in got}) == sorted({*pairs, (0, 1)}) and len(got) == len({*pairs, (0, 1)})
    for r in got:
        a, b = clean[r.chosen_id], clean[r.rejected_id]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
        for text, spans, turns in ((r.chosen, r.chosen_spans, a[n:]), (r.rejected, r.rejected_spans, b[n:])):
            assert [text[s.start : s.end] for s in spans] == [f"{t}<|end|>" for role, t in turns if role == "assistant"]


def test_op7(spark):
    rows = queries.op7_preference(spark, DIR).collect()
    assert rows and all(r.prompt for r in rows if r.rejected_id == -1 - r.chosen_id) and all(r.chosen_spans for r in rows if r.rejected_id == -1 - r.chosen_id)


def test_preference_pairs_like_brute_force(spark):
    talks = {-3: [("user", "hi"), ("assistant", "yes"), ("user", "q"), ("assistant", "no")], 4: [("user", "hi"), ("assistant", "x" * 100_000)], 7: [("assistant", "first")], 9: [("user", "hi")], 12: [("user", "other"), ("assistant", "")]}
    df = spark.createDataFrame([(c, i, r, t, 1) for c, ts in talks.items() for i, (r, t) in enumerate(ts)], "conv_id bigint, turn int, role string, text string, chosen_id int")
    turns, pairs = queries.preference_pairs(preference.turns_of(df))
    echoes = {-7 - c: ts for c, ts in talks.items() if any(r == "assistant" for r, _ in ts[1:])}
    assert sorted(map(tuple, pairs.collect())) == sorted([(-3, 4), (-3, 9)] + [(-7 - e, e) for e in echoes])
    last = {-4: ("assistant", "q"), -11: ("assistant", "hi"), -19: ("assistant", "other")}
    got = {}
    for r in turns.orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == talks | {e: [*ts[:-1], last[e]] for e, ts in echoes.items()}
    none = queries.preference_pairs(preference.turns_of(df.limit(0)))
    assert preference.format_pairs(*none).count() == 0 and none[1].count() == 0


def nearest(ids, x, asks, k):
    out = {}
    for i in asks:
        s = x @ x[ids.index(i)]
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
        out[i] = [(ids[j], s[j]) for j in order]
    return out


def test_vantage_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 16)
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (300, 4)).astype(float)
    x[100:160] = [1, 2, 0, 1]  # more copies of one vector than there are neighbours to find
    x[~x.any(axis=1)] = 1
    ids = list(range(300))
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)] + [(5, x[5].tolist(), 1), (1000, None, 1), (1020, [0.0] * 4, 1), (1040, [1.0, None, 0.0, 0.0], 1), (1060, [1.0, float("nan"), 0.0, 0.0], 1), (1080, [float("inf"), 0.0, 0.0, 0.0], 1), (1100, [], 1), (None, [9.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int").repartition(3)
    want = nearest(ids, x, [i for i in ids if i % 20 == 0], 7)
    for shard, block in ((vantage.SHARD, vantage.BLOCK), (40, 4)):
        got = {}
        for r in vantage.search(df, F.expr("id % 20 = 0"), k=7, factor=1.0, shard=shard, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want


def test_vantage_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [2.0, 0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in vantage.search(df, F.expr("id % 20 = 0")).collect()] == [(0, 1, 1, 0.0)]
    assert vantage.search(df.limit(0), F.expr("id % 20 = 0")).count() == 0


def test_vantage_recall(spark):
    d = "/root/testdata/sf0.1"
    table = queries.table(spark, d, "embeddings").toArrow()
    ids, x = table["vec_id"].to_pylist(), np.stack(table["embedding"].to_pylist()).astype(float)
    want = nearest(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in queries.op10_vantage(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9


def test_pipeline(spark):
    """Each stage over what the one before it kept; near copies, leaks and junk go, all else stays."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 400")
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(9001, None, None, None, 0), (9002, "12 34", "en", "s", 5)], docs.schema))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.saved(stage(spark, docs, "/root/testdata/sf0.01"), name)
        sizes.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
    assert sizes[1] == sizes[0] - 2 and sizes[1] > sizes[2] > sizes[3] > sizes[4] == sizes[5] > 250
    assert docs.where("doc_id = 3").count() <= 1 and byte_bpe.digests(before, corpus_pipeline.public_tokenizers.path(queries.RANKS), corpus_pipeline.public_tokenizers.PATTERN).count() == sizes[5]


def test_one_of_each_by_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = b.replace("b39", "other")
    rows = [(3, b), (5, a), (5, near), (None, near), (None, c), (8, c), (8, c), (9, ""), (9, ""), (10, None), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.one_of_each(spark, docs, DIR)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, b), (5, a), (8, c), (9, ""), (10, None), (None, "alone")], key=str)
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), DIR).count() == 0


def test_run_like_brute_force(spark, tmp_path):
    """What the two classifiers decide is taken as given; the other stages are held against plain Python."""
    from test_matching import linked_by_force

    from faultspan.llm import decontaminate, language_id, toxicity
    from faultspan.llm.common import saved

    d = "/root/testdata/sf0.01"
    docs = queries.table(spark, d, "documents").orderBy("doc_id").limit(260)
    docs = docs.unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 100_000)).unionByName(spark.createDataFrame([(9001, None, None, None, 0), (9002, "12 34", "en", "s", 5)], docs.schema))
    docs = docs.withColumn("rejected", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        queries.table(spark, d, t).write.parquet(f"{tmp_path}/{t}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = queries.table(spark, str(tmp_path), "documents")
    left = saved(language_id.fit(docs.drop("rejected")).predict(docs.drop("rejected")).where("NOT rejected").drop("lang_pred", "score", "rejected"), "left")
    left = toxicity.fit(left, queries.table(spark, d, "labels")).predict(left).where("predicted = 0").collect()
    texts = {r.doc_id: r.text for r in left}
    assert 9001 not in texts and 9002 not in texts and len(texts) > 200
    first = {i for i, n, name in linked_by_force(sorted(texts.items())) if i == name}
    items = decontaminate.Matcher([(r.item_id, decontaminate.normal(r.text)) for r in queries.table(spark, d, "benchmark").collect()])
    want = {i for i in first if not items.find(decontaminate.normal(texts[i]))}
    assert set(got) == want and len(want) < len(first) < len(texts)
    for i, r in got.items():
        assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_conversations_in_many_pairs(spark, monkeypatch):
    """Either side of many pairs is split, and every pair is there once."""
    monkeypatch.setattr(preference, "PAIRS", 3)
    turns = spark.createDataFrame([(i, 1, "user", "hi") for i in range(20)] + [(i, 2, "assistant", f"a{i}") for i in range(20)], "conv_id int, turn int, role string, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 20)] + [(i, 19) for i in range(1, 19)], "chosen_id int, rejected_id int")
    got = preference.format_pairs(preference.turns_of(turns), pairs).collect()
    assert sorted((r.chosen_id, r.rejected_id) for r in got) == sorted(map(tuple, pairs.distinct().collect()))
    assert all((r.prompt_turns, r.chosen, r.rejected) == (1, f"<|assistant|>\na{r.chosen_id}<|end|>\n", f"<|assistant|>\na{r.rejected_id}<|end|>\n") for r in got)


def test_hot_digests_meet_narrow(spark):
    """Copies of a payload are told by narrow rows; ids that are there twice or null have an answer each."""
    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, "b"), (2, "b"), (4, None), (5, "")]
    got = warc_zip.decided(spark.createDataFrame(rows, "page_id int, html string")).collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id or 0, r.html, r["__revisit"], r["__refers"] or 0) for r in got) == sorted([(1, "a", True, 2), (2, "a", False, 0), (2, "a", False, 0), (0, "a", True, 2), (3, "b", False, 0), (2, "b", True, 3), (4, "", True, 5), (5, "", False, 0)])


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, and texts that are null, empty, very long or repeated, with nulls in every column and columns named like results."""
    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    for name, rows in (("empty", docs.limit(0)), ("odd", docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None), (9001, "word " * 200_000, None, "s", None), (9002, "word " * 200_000, "en", None, 1), (9002, "word " * 200_000, "en", None, 1)], docs.schema)).withColumns({"score": F.lit("x"), "node": F.lit(1), "rejected": F.lit(None).cast("int")}))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            own = queries.table(spark, d, t)
            (own.limit(0) if name == "empty" else own).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert {"score", "node", "rejected", "n_tokens"} <= set(got.columns)
    kept = {r.doc_id for r in got.select("doc_id").collect()}
    assert None not in kept and kept <= {r.doc_id for r in docs.select("doc_id").collect()} | {9001, 9002} and len(kept) > 100


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_like_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    found = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(found.fetchall()) == sorted(tuple(r[n] for n in names) for r in df.collect())
