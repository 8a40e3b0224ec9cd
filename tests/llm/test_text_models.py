"""Byte PPM, language ID and toxicity against brute force and held-out rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultspan.llm import byte_ppm, language_id, queries, toxicity
from faultspan.llm.common import remainder

DIR = "/root/testdata/sf0.01"
TEXTS = [None, "", " \t\n", "the cat", "The  cat\nsat", "the cat sat on the mat " * 3, "été où ça", "x", "x\u00a0y", "the cat"]


def stream(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return b"".join(w + b" " for w in words) + b"\n"


def brute(learn, texts, order):
    """PPM with exclusion by dictionaries, one byte after the other."""
    counts = defaultdict(Counter)
    for t in learn:
        s = b"\n" + stream(t)
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                counts[s[i - k : i]][s[i]] += 1
    out = []
    for t in texts:
        s, total = b"\n" + stream(t), 0.0
        for i in range(1, len(s)):
            gone, p = set(), 1.0
            for k in range(min(order, i), -1, -1):
                left = {b: n for b, n in counts.get(s[i - k : i], {}).items() if b not in gone}
                if not counts.get(s[i - k : i]):
                    continue
                if s[i] in left:
                    p *= (left[s[i]] - 0.5) / sum(left.values())
                    break
                if left:
                    p *= len(left) / (2 * sum(left.values()))
                gone |= set(left)
            else:
                p /= 256 - len(gone)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("order", [1, 3, 5])
def test_ppm_like_brute_force(spark, order):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    learn = [t for i, t in enumerate(TEXTS) if i % 2]
    model = byte_ppm.fit(df.where("doc_id % 2 = 1"), order=order, least=1, head=3)
    rows = {r.doc_id: r for r in byte_ppm.score(df, model).collect()}
    for i, want in enumerate(brute(learn, TEXTS, order)):
        assert rows[i].score == pytest.approx(want, abs=1e-9)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    count = Counter(w for t in learn for w in tokens(t))
    n = sum(count.values())
    for i, t in enumerate(TEXTS):
        assert rows[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + len(count) + 1)) for w in tokens(t)))
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n)


def test_ppm_is_a_distribution(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    trie = byte_ppm.fit(df, order=3, least=1).trie
    for before in (b"", b"the ca", b"\xc3", b"q"):
        last = [byte_ppm.Trie.logs(trie, np.frombuffer(before + bytes([b]), np.uint8), np.array([0, len(before) + 1]))[-1] for b in range(256)]
        assert sum(10**x for x in last) == pytest.approx(1)


@pytest.mark.parametrize("top", [0, 5, 40, 1 << 20])
def test_ppm_learns_all_strings_whatever_is_sent(spark, top):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    model = byte_ppm.fit(df.where("doc_id % 2 = 1"), top=top)
    learn = [b"\n" + stream(t) for i, t in enumerate(TEXTS) if i % 2]
    assert model.strings.count() == len({s[max(0, i - d) : i + 1] for s in learn for i in range(1, len(s)) for d in range(min(6, i + 1))})
    assert len(model.top) <= top + 1
    rows = {r.doc_id: r.score for r in byte_ppm.score(df, model).collect()}
    for i, want in enumerate(brute([t for i, t in enumerate(TEXTS) if i % 2], TEXTS, byte_ppm.ORDER)):
        assert rows[i] == pytest.approx(want, abs=1e-9)


def test_ppm_without_texts_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, score string")
    model = byte_ppm.fit(none)
    assert byte_ppm.score(none, model).count() == 0
    df = spark.createDataFrame([(1, "ab", "x"), (1, "ab", "x"), (None, None, "x")], "doc_id bigint, text string, score string")
    assert [r.score for r in byte_ppm.score(df, model).orderBy(F.desc("n_bytes")).collect()] == pytest.approx([-4 * math.log10(256)] * 2 + [-math.log10(256)])


def test_ppm_beats_its_base_on_held_out_texts(spark):
    r = queries.op1_byte_ppm(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).collect()[0]
    assert r[0] > r[1] and r[2] > 100


def test_language_held_out(spark):
    docs = queries.table(spark, DIR, "documents").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, DIR).join(docs, "doc_id")
    r = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).collect()[0]
    assert r[0] > 0.98 and r[1] <= 2


def test_language_edges(spark):
    learn = queries.table(spark, DIR, "documents").where("doc_id < 300")
    model = language_id.fit(learn, quota=40)
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !?", "a"), (4, "the and of with", "a"), (4, "the and of with", "a"), (5, "der und die " * 20_000, "a")], "doc_id bigint, text string, score string")
    rows = model.predict(df).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in rows[:3]] == [("und", 0.0, True)] * 3
    assert rows[3] == rows[4] and rows[5].lang_pred == "de" and all(0 <= r.score <= 1 for r in rows)
    empty = language_id.fit(learn.limit(0))
    assert [(r.lang_pred, r.score) for r in empty.predict(df.where("doc_id = 4")).collect()] == [("und", 0.0)] * 2
    assert model.predict(df.limit(0)).count() == 0


ODD = [
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από τον τεμπέλη σκύλο και φεύγει μακριά",
    "быстрая коричневая лиса прыгает через ленивую собаку и убегает",
    "我能吞下玻璃而不伤身体因为它很好吃",
    "Den hurtige brune ræv hopper over den dovne hund og løber hjem igen",
    "Den snabba bruna räven hoppar över den lata hunden och springer bort",
    "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee pois metsään",
    "De snelle bruine vos springt over de luie hond en rent weer naar huis",
    "Szybki brazowy lis przeskakuje nad leniwym psem i ucieka do lasu",
    "La veloce volpe marrone salta sopra il cane pigro e corre via",
    "Hizli kahverengi tilki tembel kopegin uzerinden atlar ve kacar",
    "for (int i = 0; i < n; i++) { sum += a[i] * b[i]; } return sum;",
    "asdf jkl qwer asdfj klqw erqw zxcv bnmas dfghj klqwe rtyuiop",
    "xkcd bzzt qrst vwpfgh jklmn bcdfg hjklm npqrs tvwxz",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kaW5n",
]


def test_unlearned_writing_is_rejected(spark):
    """Other scripts, other languages in Latin letters, code and key mashing, while texts of learned languages stay."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(docs.where("doc_id % 4 <> 0"))
    rows = model.predict(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id int, text string")).collect()
    assert len([ODD[r.doc_id] for r in rows if not r.rejected]) <= 2
    others = model.predict(docs.where("doc_id % 4 = 0"))
    assert others.where("rejected").count() < 0.01 * others.count()


def test_limit_by_both_rates():
    """Odd pieces as far as ODD, learned ones no farther than ERROR: against the definition, over texts of few letters."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab "), 60, p=[0.6, 0.3, 0.1])) for _ in range(300)] + ["".join(rng.choice(list("bc"), 60)) for _ in range(300)]
    y = np.repeat([0, 1], 300)
    held = language_id.of_texts(texts)
    table = language_id.log_shares(held, y, 2)
    for bucket in held[0][0]:
        for k in (0, 1):
            n = sum(int(c[ids == bucket].sum()) for (ids, c), own in zip(held, y, strict=True) if own == k)
            total = sum(int(c.sum()) for (_, c), own in zip(held, y, strict=True) if own == k)
            assert np.isclose(table[bucket, k], np.log((n + 0.5) / (total + 0.5 * 65536)))
    likely, limit = language_id.limited(table, texts, y, 5)
    mean = lambda t, cols: [max(sum(likely[b, k] * c for b, c in zip(*h, strict=True)) / h[1].sum() for k in cols) for h in language_id.of_texts(t)]
    again = np.random.default_rng(5)
    odd = np.array(mean(["".join(again.permutation(list(t))) for t in texts], (0, 1)) + mean(texts[:300], (1,)) + mean(texts[300:], (0,)))
    kept = np.array(mean(texts, (0, 1)))
    want = min(np.sort(odd)[int(language_id.ODD * (len(odd) - 1))], np.sort(kept)[int(language_id.ERROR * (len(kept) - 1))])
    assert np.isclose(limit, want, atol=1e-5) and (kept < limit).mean() <= language_id.ERROR


def test_step_like_slopes():
    """One step of learning moves embeddings and softmax down the slope of the cross-entropy, as differences tell."""
    rng = np.random.default_rng(4)
    embed, soft, bias, x_ids, x_share, y = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2), np.array([1, 4]), np.array([0.25, 0.75]), 1

    def loss(e, w, b):
        z = x_share @ e[x_ids] @ w + b
        return np.log(np.exp(z).sum()) - z[y]

    gz = np.exp(x_share @ embed[x_ids] @ soft + bias)
    gz = gz / gz.sum() - np.eye(2)[y]
    x = x_share @ embed[x_ids]
    for i, j in np.ndindex(soft.shape):
        d = np.zeros_like(soft)
        d[i, j] = 1e-6
        assert np.isclose((loss(embed, soft + d, bias) - loss(embed, soft - d, bias)) / 2e-6, np.outer(x, gz)[i, j], atol=1e-6)
    for i, j in np.ndindex(embed.shape):
        d = np.zeros_like(embed)
        d[i, j] = 1e-6
        want = x_share[list(x_ids).index(i)] * (soft @ gz)[j] if i in x_ids else 0
        assert np.isclose((loss(embed + d, soft, bias) - loss(embed - d, soft, bias)) / 2e-6, want, atol=1e-6)


def test_language_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(i, "same text", x) for i, x in enumerate(["b", "a"] * 5)], "doc_id int, text string, lang string")
    zero = np.zeros(((1 << language_id.BITS) + 1, 2), np.float32)
    model = language_id.LanguageModel(["a", "b"], zero, np.zeros(2), zero, -1.0)
    assert {(r.lang_pred, r.score) for r in model.predict(df).collect()} == {("a", 0.5)}


def test_samples_do_not_depend_on_partitions(spark):
    from faultspan.llm.common import sampled

    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("x"))
    rows = [sorted(tuple(r) for r in sampled(d, ["k", "x"], 200, each).collect()) for each in ("x", None) for d in (df.repartition(1), df.union(df).repartition(7))]
    assert rows[0] == rows[1] and rows[2] == rows[3] and 450 < len(rows[0]) < 750 and 150 < len(rows[2]) < 250
    assert sampled(df.limit(0), ["k"], 5).count() == 0 and sampled(df.limit(4), ["k"], 9).count() == 4


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = queries.table(spark, d, "labels").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, d).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted")).collect()
    share = {r[0]: r[1] for r in rows}
    assert share[1] > 0.6 and share[0] < 0.03


def test_toxicity_edges(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=20)) + (" vileword" if i % 5 == 0 else ""), "x") for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "vileword", "x"), (900, None, "x"), (901, "", "x"), (902, "vileword " * 50_000, "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400, 2)] + [(0, 0), (0, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.fit(df, labels).predict(df).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400)) and got[None].predicted == got[902].predicted == 1
    assert got[900].score == got[901].score and got[900].predicted == 0
    none = toxicity.fit(df, labels.where("toxic = 0"))
    assert {r.score for r in none.predict(df).collect()} <= {r for r in [1e-9 / (1 + 1e-9)]} or all(r.predicted == 0 for r in none.predict(df).collect())
    assert toxicity.fit(df.limit(0), labels.limit(0)).predict(df.limit(0)).count() == 0


def test_remainders(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 1, 17, 123456)], "doc_id bigint")
    assert [r.x for r in df.select(remainder("doc_id", 7).alias("x")).collect()] == [zlib.crc32(str(i).encode()) % 7 for i in (0, 1, 17, 123456)]


def test_risk_like_brute_force(spark):
    """A few turns against slopes by differences of the non-negative risk itself, with its sign switch where the clean part is negative."""
    rng = np.random.default_rng(7)
    bad, good = ["scum", "idiot", "vile", "hate"], [f"word{i}" for i in range(12)]
    texts = {i: " ".join([*rng.choice(bad, 3), *rng.choice(good, 3)]) if i < 30 else " ".join(rng.choice(good, 6)) for i in range(60)}
    texts[60] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(20)] + [(i, 0) for i in range(40, 50)], "doc_id int, toxic int")
    switched = 0
    for prior in (0.3, 0.9):
        turns, rate, shrink, least, lift = 12, 0.3, 1e-4, 4, 1.5
        model = toxicity.fit(df, marks, prior=prior, turns=turns, rate=rate, shrink=shrink, least=least, lift=lift)
        sets = {}
        for i, t in texts.items():
            if t is not None:
                data = np.frombuffer(t.encode(), np.uint8)
                sets[i] = set(toxicity.features(data, np.array([0, len(data)]))[1].tolist())
        p, u = [sets[i] for i in range(20)], list(sets.values())
        # equal texts are one in the samples
        p, u = ([sets[next(k for k in texts if texts[k] == t)] for t in dict.fromkeys(texts[i] for i in ids)] for ids in (range(20), sets))
        kept = sorted(f for f in set().union(*p) if (a := sum(f in s for s in p)) >= least and a / len(p) >= lift * (sum(f in s for s in u) + 1) / len(u))
        xp, xu = (np.array([[f in s for f in kept] for s in part], float) for part in (p, u))
        n = len(kept)

        def parts(w, b, prior=prior, xp=xp, xu=xu):
            zp, zu = xp @ w + b, xu @ w + b
            loss = lambda z: np.logaddexp(0, z)
            return prior * loss(-zp).mean(), loss(zu).mean() - prior * loss(zp).mean()

        w, b, state = np.zeros(n), np.log(prior / (1 - prior)), [np.zeros(n + 1), np.zeros(n + 1)]
        for turn in range(1, turns + 1):
            negative = parts(w, b)[1] < 0
            switched += negative
            goal = lambda x: -parts(x[:-1], x[-1])[1] if negative else sum(parts(x[:-1], x[-1]))  # noqa: E731, B023
            x = np.append(w, b)
            g = np.array([(goal(x + d) - goal(x - d)) / 2e-5 for d in np.eye(n + 1) * 1e-5])
            state = [0.9 * state[0] + 0.1 * g, 0.99 * state[1] + 0.01 * g * g]
            scale = np.sqrt(state[1] / (1 - 0.99**turn)) + 1e-4
            x -= rate / np.sqrt(turn) * (state[0] / (1 - 0.9**turn)) / scale
            w, b = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - rate / np.sqrt(turn) * shrink / scale[:-1], 0), x[-1]
        assert n > 5 and set(np.flatnonzero(model.weights)) <= set(kept)
        assert np.allclose(model.weights[kept], w, atol=2e-3) and np.isclose(model.bias, b, atol=2e-3)
    assert switched
