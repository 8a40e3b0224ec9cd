"""Byte BPE, decontamination and the n-gram join against brute force."""

import base64
import random
import re

import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

from faultspan.llm import byte_bpe, decontaminate, ngram_join, queries

DIR = "/root/testdata/sf0.001"
PATH = P.path(queries.RANKS)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    out = ["", " ", "a\n\n b", "'s I'LL don't", "日本語 🙂👍🏽 é", "\u0085\x1c x", "ﬁ①²½ ٣ <|endoftext|>", "a" * 5000, "ա\u058bb \U00018d80\U00018d81 1\U00012475"]
    return out + ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2FFF), rng.randint(0x1F300, 0x1FAFF), rng.randint(0xE000, 0x3FFFF)])) for _ in range(rng.randint(1, 40))) for _ in range(500)]


def test_bpe_like_tiktoken(tik):
    codec = byte_bpe.codec(PATH, P.PATTERN)
    texts = odd_texts()
    ids = codec.encode(texts)
    assert ids == [tik.encode_ordinary(t) for t in texts]
    assert [codec.decode(i) for i in ids] == texts
    for t, (i, spans) in zip(texts, codec.encode_offsets(texts), strict=True):
        assert i == tik.encode_ordinary(t)
        for (a, b), token in zip(spans, i, strict=True):
            assert codec.bytes_of[token] in t[a:b].encode()


def test_split_characters():
    codec = byte_bpe.codec(PATH, P.PATTERN)
    single = {codec.bytes_of[i]: i for i in range(len(codec.bytes_of)) if len(codec.bytes_of[i]) == 1}
    ids = [single[bytes([b])] for b in "é🙂".encode()]
    assert codec.decode(ids) == "é🙂" and codec.pieces(ids) == ["", "é", "", "", "", "🙂"]
    assert codec.decode(ids[:3]) == "é\ufffd"


def test_bpe_frames(spark, tik):
    df = spark.createDataFrame([(1, None, "x"), (2, "héllo wörld", "x"), (2, "héllo wörld", "x"), (3, "word " * 40_000, "x")], "doc_id bigint, text string, ids string")
    rows = byte_bpe.encode(df, PATH, P.PATTERN, offsets=True).orderBy("doc_id").collect()
    assert rows[0].ids == [] and rows[1] == rows[2] and rows[1].ids == tik.encode_ordinary("héllo wörld") and len(rows[3].ids) == 40_001
    back = byte_bpe.decode(byte_bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).orderBy("doc_id").collect()
    assert [r.decoded_text for r in back] == ["", "héllo wörld", "héllo wörld", "word " * 40_000]
    assert byte_bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_op3(spark, tik):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in queries.table(spark, DIR, "documents").collect()}
    for r in queries.op3_byte_bpe(spark, DIR).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def edits(pattern, text):
    """Smallest edit distance to a substring, and where the first such one ends."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row), row.index(min(row))


def test_distance():
    rng = random.Random(0)
    for _ in range(300):
        p, t = ("".join(rng.choices("ab ", k=rng.randint(a, 30))) for a in (1, 0))
        best, at = decontaminate.nearest(decontaminate.masks(p), len(p), t)
        assert (best, at if best < len(p) else 0) == (edits(p, t)[0], edits(p, t)[1] if best < len(p) else 0)


def test_pieces():
    for n, k in ((1, 0), (30, 3), (57, 5), (200, 20)):
        paths = decontaminate.pieces(0, n, k)
        assert len(paths) == k + 1 and [p[0][0] for p in paths[1:]] == [p[0][1] for p in paths[:-1]] and paths[-1][0][1] == n


def test_decontamination_like_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 16)))) for i in range(12)] + [(50, None), (51, "  "), (3, "a repeated id with other text"), (52, "tiny")]
    docs = [(None, None, 1), (0, "", 1), (1, "x tiny y", 1), (1, "x tiny y", 1)]
    for d in range(2, 60):
        text = [word() for _ in range(30)]
        if d % 2:
            s = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(s) // 8)):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice([[], ["z"], [s[k], "q"]])
            text.insert(rng.randrange(30), "".join(s).upper())
        docs.append((d, "  ".join(text), 1))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, edits int"), spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for d, t, _ in docs:
        for i, s in items:
            p, t2 = decontaminate.normal(s), decontaminate.normal(t)
            if p and t2:
                n, end = edits(p, t2)
                if n <= int(len(p) * 0.1):
                    want.append((d, i, n, end))
    found = sorted(((r.doc_id, r.item_id, r.edits, r.end) for r in decontaminate.find(df, it).collect()), key=str)
    assert found == sorted(want, key=str) and len(want) > 10
    assert sorted(((r.doc_id, r.item_id, r.edits, r.end) for r in decontaminate.find(df, it, block=100).collect()), key=str) == found
    hit = {(d, t) for d, t, _ in docs for x in want if x[0] == d}
    assert sorted((str(r.doc_id), r.text) for r in decontaminate.clean(df, it, block=100).collect()) == sorted((str(d), t) for d, t, _ in docs if (d, t) not in hit)
    assert decontaminate.find(df, it.limit(0)).count() == 0 and decontaminate.find(df.limit(0), it).count() == 0 and decontaminate.clean(df, it.limit(0)).count() == len(docs)


def test_long_items_and_texts():
    rng = random.Random(1)
    item = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(1300))
    text = "x " * 50 + item[:4000] + "zz" + item[4000:] + " y" * 50_000
    assert decontaminate.Matcher([(1, item)]).find(text) == [(1, 2, 100, 100 + len(item) + 2)]


def linked_by_force(rows):
    sets, up = [], str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    at = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and at[i] != at[j]:
                old = at[i]
                at = [at[j] if x == old else x for x in at]
    name = {}
    for (i, _), c in zip(rows, at, strict=True):
        name[c] = i if name.get(c) is None else name[c] if i is None else min(name[c], i)
    return sorted(((i, len(s), name[c] if s else i) for (i, _), s, c in zip(rows, sets, at, strict=True)), key=str)


def near_copies(rng, groups, copies, words):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, words // 30))):
                own[rng.randrange(words)] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_like_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(rng, 8, 5, 60) + near_copies(rng, 1, 120, 90) + near_copies(rng, 6, 4, 7) + [f"{passage} {t}" for t in near_copies(rng, 60, 1, 50)]
    texts += [None, "", " \n", "one two", "ONE two", "one two three", "a b c d e", "A b c d e", "a\u00a0b c d e f", "same words again", "same words again", " ".join(f"l{i}" for i in range(20_000))]
    rows = [(i * 7 % len(texts), t) for i, t in enumerate(texts)] + [(5, "an id that comes twice"), (None, "one two"), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, node int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(df).collect()), key=str)
    assert got == linked_by_force(rows)


def test_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.linked(df).count() == 0
    one = spark.createDataFrame([(3, "a b c d e f")], "doc_id bigint, text string")
    assert [tuple(r) for r in ngram_join.linked(one).collect()] == [(3, 2, 3)]


def test_tree_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 6, (40, ngram_join.GROUPS))
    v = np.repeat(base, 12, axis=0)
    v = np.maximum(v + rng.integers(-1, 2, v.shape) * (rng.random(v.shape) < 0.1), 0).astype("<u4")
    m = v.sum(axis=1).astype(np.int64)
    i, j = np.triu_indices(len(m), 1)
    good = (5 * m[i] >= 4 * m[j]) & (5 * m[j] >= 4 * m[i]) & ngram_join.possible(m[i], m[j], v[i], v[j])
    want = set(zip(i[good].tolist(), j[good].tolist(), strict=True))
    got = [tuple(sorted(p)) for a, b in ngram_join.CountTree(m, v).pairs() for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_groups_are_counted_with_their_copies(spark, monkeypatch):
    """A bucket of many blocks meets in many pairs of blocks; no group of rows grows with the bucket."""
    import pyspark.sql.group as group

    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "ROWS", 200)
    n = 600
    rows = spark.range(n).selectExpr("1L AS k", f"{n}L AS n", "id AS node", "50L AS m", "id AS comp")
    of = spark.createDataFrame([(i, 50, b"\0" * 300) for i in range(n)], "node bigint, m bigint, shingles binary")

    def counting(self, f, schema, own=group.GroupedData.applyInPandas):
        return own(self, lambda held: pd.DataFrame({"a": [len(held)], "b": [int(held["bucket"].iloc[0])]}), schema)

    monkeypatch.setattr(group.GroupedData, "applyInPandas", counting)
    sizes = [r.a for r in ngram_join.from_trees(rows, of, True).collect()]
    assert sum(sizes) > 20 * n and max(sizes) < 1000


def test_blocks_of_items_are_taken_back(spark, monkeypatch):
    """Of several blocks one at a time is out; a single one stays a plan that nothing has run."""
    from pyspark import Broadcast

    out, most, own_init, own_destroy = set(), [], Broadcast.__init__, Broadcast.destroy

    def init(self, *a, **k):
        own_init(self, *a, **k)
        out.add(id(self))
        most.append(len(out))

    def destroy(self, *a, **k):
        out.discard(id(self))
        own_destroy(self, *a, **k)

    monkeypatch.setattr(Broadcast, "__init__", init)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    df = spark.createDataFrame([(i, f"text {i} holds item number {'abcdefgh'[i % 8] * 9} here") for i in range(16)], "doc_id int, text string")
    items = spark.createDataFrame([(i, f"holds item number {'abcdefgh'[i] * 9}") for i in range(4)], "item_id int, text string")
    found = decontaminate.find(df, items, block=30)
    assert len(most) == 4 and max(most) == 1 and sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted((i, i % 8) for i in range(16) if i % 8 < 4)
    most.clear()
    assert sorted(r.doc_id for r in decontaminate.clean(df, items, block=30).collect()) == [i for i in range(16) if i % 8 >= 4] and max(most) == 1
    assert not hasattr(decontaminate.clean(df, items), "saved_at") and decontaminate.find(df, items.limit(0)).count() == 0 and decontaminate.clean(df, items.limit(0)).count() == 16
    given = decontaminate.saved(df, "given")
    for block in (30, 1 << 20):
        assert decontaminate.clean(given, items, block=block).count() == 8 and given.count() == 16
