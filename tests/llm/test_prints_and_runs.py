"""SimHash groups, whitening and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultspan.llm import periodic, queries, simhash, whitening

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- SimHash ------------------------------------------------------------------------------------------------------


def print_of(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    pieces = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """The smallest id of each id's component, by all pairs."""
    up = {i: i for i, _ in prints}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, p in prints:
        for j, q in prints:
            if i < j and (p ^ q).bit_count() <= 2:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i, _ in prints}


def test_simhash_like_brute_force(spark):
    rng = random.Random(3)
    words = "A b C d e f g H i j".split()
    texts = [None, "", " \t\n", "One", "one", "one two", "É x y\x0bz", "a " * 70_000, "x" * 200_000, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(150))]
    texts += [" ".join(rng.choice(words) for _ in range(500))] * 3
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, fingerprint string, cell int")
    got = {r.doc_id: r for r in simhash.linked(df).collect()}
    prints = [(i, print_of(t)) for i, t in enumerate(texts)]
    want = groups(prints)
    assert len(got) == len(texts)
    for i, p in prints:
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", want[i])


def test_dense_groups_keep_all_links(spark):
    """Many prints around a few, so that cells are fuller than are compared pair by pair."""
    rng = random.Random(4)
    prints = set()
    for middle in [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(3))]:
        for _ in range(150):
            x = middle
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                x ^= 1 << b
            prints.add(x)
        base = rng.getrandbits(64) & ~0xFF
        prints |= {base | i for i in range(256) if rng.random() < 0.5}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "print bigint")
    links = [(r.a, r.b) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 if (a ^ b) >= 0 else ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in links)
    up = {p: p for p in signed}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    want = groups([(p, p & ((1 << 64) - 1)) for p in signed])
    assert {p: top(p) for p in signed} == want
    assert len(links) < len(signed) * 64


def test_points_bound_distances(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(200)], "print bigint")
    for r in df.select("print", simhash.point(F.col("print")).alias("p"), simhash.cells(simhash.point(F.col("print"))).alias("cells")).collect():
        bits = [(r.print >> i) & 3 for i in range(0, 64, 2)]
        digits = [(r.p >> i) & 3 for i in range(0, 64, 2)]
        assert digits == [b.bit_count() for b in bits]
        near = {tuple((c >> i) & 3 for i in range(0, 64, 2)) for c in r.cells}
        want = {tuple(digits)} | {(*digits[:j], d, *digits[j + 1 :]) for j in range(32) for d in (digits[j] - 1, digits[j] + 1) if 0 <= d <= 2}
        assert near == want and len(r.cells) == len(want)


def test_simhash_odd_tables(spark):
    kind = "doc_id bigint, text string"
    assert simhash.linked(spark.createDataFrame([], kind)).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.linked(spark.createDataFrame([], kind)).count() == 0
    rows = simhash.linked(spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "quite another text"), (9, None)], kind)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 7), (7, 7), (7, 7), (9, 9)]


def test_op11(spark):
    got = {r.doc_id: r for r in queries.op11_simhash(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, print_of(r.text)) for r in docs]
    want = groups(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints}


# --- whitening ----------------------------------------------------------------------------------------------------


def whole(v):
    return np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) + 1_000_000


def hold(rows, vectors, weights="count", most=32):
    """Rows of an answer against numpy and whole numbers of Python."""
    x = np.array([whole(v) for v in vectors])
    fitted = x if weights == "count" else np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(axis=0)
    z = fitted - s / n
    e, _ = np.linalg.eigh(z.T @ z / n)
    e = e[::-1]
    k = min(most, x.shape[1])
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert all(sorted(c) == list(range(1, k + 1)) for c in by.values())
    table = np.array([[by[i][c][0].whitened for c in range(1, k + 1)] for i in range(len(x))])
    for i in range(len(x)):
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))
        assert {(r.n, r.deviation) for c in by[i].values() for r in c} == {(n, dev)}
    if weights == "count":
        cov = np.cov(table.T, bias=True).reshape(k, k)
        assert np.abs(cov - np.eye(k)).max() < 1e-8
    share = np.array([by[0][c][0].explained for c in range(1, k + 1)])
    assert np.allclose(share, e[:k] / e.sum(), rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and 0 <= rows[0].identity_error < 1e-8
    # what whitening does to distances doesn't depend on signs: it is that of the covariance's inverse on the leading axes
    z = x - s / n
    w, u = np.linalg.eigh((fitted - s / n).T @ (fitted - s / n) / n)
    want = np.abs((z @ u[:, ::-1][:, :k]) / np.sqrt(w[::-1][:k]))
    assert np.allclose(np.abs(table), want, atol=1e-6)


def test_op12(spark):
    rows = queries.op12_whitening(spark, DIR).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    names = sorted(vectors)
    again = {v: i for i, v in enumerate(names)}
    assert {r.vec_id for r in rows} == set(names)
    hold([r.__class__(**(r.asDict() | {"vec_id": again[r.vec_id]})) for r in rows], [vectors[v] for v in names])


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_with_multiplicities(spark, weights):
    rng = np.random.default_rng(6)
    vectors = [v.tolist() for v in np.repeat(rng.normal(size=(40, 5)) * [900, 30, 3, 1, 0.5], rng.integers(1, 9, 40), axis=0)]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>, x string, m int")
    hold(whitening.whitened(df, weights=weights).collect(), vectors, weights)


def test_whitening_odd_rows(spark):
    kind = "vec_id int, embedding array<double>"
    good = [[1.0, 2.0], [3.5, -1.0], [0.0, 0.25], [3.5, -1.0]]
    rows = [*enumerate(good), (9, None), (10, [1.0, None]), (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, [1.0]), (14, []), (15, [1e300, 0.0])]
    got = whitening.whitened(spark.createDataFrame(rows, kind)).collect()
    hold(got, good)
    assert len(whitening.whitened(spark.createDataFrame([(None, good[0]), (1, good[1]), (1, good[1]), (2, good[2])], kind)).collect()) == 8
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], kind)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert {(r.whitened, r.deviation, r.n, r.identity_error) for r in same} == {(None, 0, 2, None)}
    flat = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    wide = whitening.whitened(spark.createDataFrame([(1, [7e13]), (2, [-7e13]), (3, [0.0])], kind)).orderBy("vec_id", "component").collect()
    x = [int(whole([v])[0]) for v in (7e13, -7e13, 0.0)]
    assert [r.deviation for r in wide] == [None, None, (3 * x[2] - sum(x)) ** 2]


# --- periodic runs ------------------------------------------------------------------------------------------------


def brute(s):
    """(start, length, period) by definition: stretches in which elements q apart are equal, of which q is the smallest period."""
    out, n = [], len(s)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(s[i + k] == s[i + k + r] for k in range(size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(n):
    rng = random.Random(7)
    for _ in range(n):
        k = rng.choice([1, 2, 2, 3, 6])
        s = [rng.randint(1, k) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.6 and s:
            w, a = s[: rng.randint(1, 6)], rng.randint(0, len(s))
            s = s[:a] + w * rng.randint(2, 9) + s[a:]
        yield s


def test_runs_of_sequences():
    for s in sequences(3000):
        assert periodic.runs_of(s) == brute(s)


def test_stretches_lose_no_run():
    """All sequences together as rows of one table."""
    all_ = list(sequences(1500))
    row, word = np.repeat(np.arange(len(all_)), [len(s) for s in all_]), periodic.mix(np.array([x for s in all_ for x in s], np.uint64))
    begin = np.searchsorted(row, np.arange(len(all_)))
    got = {i: [] for i in range(len(all_))}
    for a, b in periodic.stretches(row, word):
        i = row[a]
        got[i] += [(a + x - begin[i], n, q) for x, n, q in periodic.runs_of(all_[i][a - begin[i] : b - begin[i]])]
    for i, s in enumerate(all_):
        assert sorted(got[i], key=lambda r: (r[0], r[2])) == brute(s)


def test_common_extensions():
    for s in list(sequences(60)):
        if len(s) < 2:
            continue
        both = periodic.Extensions(periodic.SuffixTree(s))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(s)), np.arange(len(s))))
        i, j = i[i != j], j[i != j]
        for a, b, n in zip(i, j, both.common(i, j), strict=True):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert n == k


def digests(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    names = {}
    runs = brute([names.setdefault(x, len(names)) for x in w])
    drop = {i for a, n_, q in runs for i in range(a + q, a + n_)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_op13(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic(spark, DIR).collect()}
    assert len(got) == len(docs) and sum(g[0] > 0 for g in got.values()) > 5
    for r in docs:
        if len(r.text or "") < 4000:
            assert got[r.doc_id] == digests(r.doc_id, r.text)


def test_periodic_tables(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n", "na " * 9, "Na na NA na na na na na", "é ü " * 6 + "end", "tic tac toc\x0b" * 5, ("lo ng " * 30_000).strip(), " ".join(rng.choice("abc") for _ in range(400))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, texts[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            assert tuple(r)[1:] == digests(r.doc_id, texts[r.doc_id])
    plain = {r.doc_id: r for r in periodic.runs(df).collect()}
    assert [tuple(x) for x in plain[7].runs] == [(0, 60_000, 2)] and plain[7].collapsed == "lo ng" and plain[7].n_words == 60_000
    assert plain[0].runs == [] and plain[0].collapsed == "" and plain[3].collapsed == "na"
    assert periodic.runs(df.limit(0)).count() == 0
