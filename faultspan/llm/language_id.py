"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

A text is the mean of the embeddings of its hashed character pairs and triples (letters in lower case, every run of
other characters a word boundary). The embeddings and the softmax are trained in numpy on a bounded sample of
labelled texts, `quota` of each language, those with the smallest hash. A fifth of the sample is kept
back: it gives the temperature that calibrates the probabilities, and the limit below which a text is rejected.

What is held against the limit is how likely the learned languages make a text's subwords: the mean logarithm, each piece of
WINDOW characters by the language that makes it likeliest, by counts in the learning texts, less the median of that language's
own pieces. So a text in two learned languages is no odd one; and confidence alone doesn't tell, as a softmax is as sure of
texts in a language that it hasn't learned. Odd texts are made of those kept back: pieces with their characters shuffled, and pieces
of each language in turn as if it had not been learned. The limit rejects the share ODD of them, but never more than the share
ERROR of the pieces as they are; whole texts vary less than pieces.
The mean and the softmax's input are linear, so scoring needs one row of each table per subword.

Null texts and texts without a letter are `und` with score 0 and are rejected; very long texts are read whole; ties
go to the language that sorts first; repeated rows get equal results. With no labelled text every prediction is
`und`. Other columns pass through; outputs replace input columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix, sampled, slices

BITS = 16
#: Texts of each language to learn from, but for what the estimate of their number is off by.
QUOTA = 400
#: Share of odd texts that the limit is to reject, share of texts of learned languages that it may reject at most, characters
#: of the pieces, how many of these are drawn from a text kept back, and what is added to each count.
ODD, ERROR, WINDOW, PIECES, SMOOTH = 0.95, 0.005, 60, 8, 0.5

_FOLD = np.array([ord(c.lower()) if (c := chr(i)).isalpha() and len(c.lower()) == 1 else i if c.isalpha() else 32 for i in range(0x3000)], np.uint32)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's characters: (bucket of the pair and of the triple that begin there, or 1 << BITS; the rows' offsets)."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    at = seen[offsets]
    if at[-1] != len(chars):  # not UTF-8: one character for each byte
        chars, at = data.astype(np.uint32), offsets
    folded = np.where(chars < len(_FOLD), _FOLD[np.minimum(chars, len(_FOLD) - 1)], chars).astype(np.uint64)
    out = np.full((2, len(chars)), 1 << BITS, np.int32)
    edge = np.zeros(len(chars) + 1, bool)
    edge[at] = True
    inner = ~edge[1:-1] if len(chars) else edge[:0]  # the pair at i lies in one row
    if len(chars) > 1:
        pair = folded[:-1] << np.uint64(21) | folded[1:]
        good = inner & (pair != (32 << 21 | 32))
        out[0, :-1][good] = (mix(pair[good]) >> np.uint64(64 - BITS)).astype(np.int32)
        if len(chars) > 2:
            triple = pair[:-1] << np.uint64(21) | folded[2:]
            good = inner[:-1] & inner[1:] & (folded[1:-1] != 32)
            out[1, :-2][good] = (mix(triple[good] ^ np.uint64(1 << 63)) >> np.uint64(64 - BITS)).astype(np.int32)
    return out, at


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (buckets + 1) x languages, divided by the temperature
    bias: np.ndarray
    likely: np.ndarray  # (buckets + 1) x languages: logarithms of the buckets' shares, less the languages' medians
    limit: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the languages' probabilities, and how likely its subwords are."""
        grams, at = subwords(data, offsets)
        rows, n = np.zeros((len(at) - 1, len(self.languages))), np.zeros(len(at) - 1)
        full = np.flatnonzero(np.diff(at))
        pieces = -(-np.diff(at) // WINDOW)
        row = np.repeat(np.arange(len(pieces)), pieces)
        begin = np.repeat(at[:-1], pieces) + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        likely = np.zeros((len(row), len(self.languages)))
        if len(full):
            for g in grams:
                rows[full] += np.add.reduceat(self.table[g], at[full], axis=0, dtype=np.float64)
                n[full] += np.add.reduceat(g < 1 << BITS, at[full], dtype=np.int64)
                likely += np.add.reduceat(self.likely[g], begin, axis=0, dtype=np.float64)
        logits = rows / np.maximum(n, 1)[:, None] + self.bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        own = np.bincount(row, likely.max(axis=1), len(n)) if len(row) else np.zeros(len(n))
        return e / e.sum(axis=1, keepdims=True), own / np.maximum(n, 1)

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add `lang_pred string, score double, rejected boolean`."""
        new = "lang_pred string, score double, rejected boolean"
        keep = [c for c in df.columns if c.lower() not in ("lang_pred", "score", "rejected")]
        letter = F.coalesce(df[text].rlike(r"\p{L}"), F.lit(False)).alias("__letter")
        given = df.select(*(df[c] for c in keep), df[text].alias("__text"), letter)
        model = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            for batch in batches:
                for part, data, offsets in slices(batch, "__text"):
                    known = part.column("__letter").to_numpy(zero_copy_only=False).astype(bool) & bool(own.languages)
                    likely = np.zeros(part.num_rows)
                    if own.languages:
                        p, likely = own.probabilities(data, offsets)
                        best = p.argmax(axis=1)
                        score, names = np.where(known, p.max(axis=1), 0.0), np.array(own.languages, object)[best]
                    else:
                        score, names = np.zeros(part.num_rows), np.full(part.num_rows, "und", object)
                    names = np.where(known, names, "und")
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score), pa.array(~known | (likely < own.limit))], [*keep, "lang_pred", "score", "rejected"])

        return given.mapInArrow(run, StructType([df.schema[c] for c in keep] + StructType.fromDDL(new).fields))


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text the buckets, and how often each is there."""
    grams, at = subwords(data, offsets)
    ids, counts = [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        u, n = np.unique(grams[:, a:b], return_counts=True)
        ids.append(u[u < 1 << BITS])
        counts.append(n[u < 1 << BITS])
    return ids, counts


def is_kept_back(hashes: np.ndarray) -> np.ndarray:
    return (hashes & 0x7FFFFFFF) % 5 == 0


def pieces(text: str, seed: int) -> list[str]:
    """PIECES pieces of WINDOW characters from places drawn at random; none of a shorter text."""
    last = len(text) - WINDOW
    return [text[at : at + WINDOW] for at in np.random.default_rng(seed).integers(0, last + 1, PIECES).tolist()] if last >= 0 else []


@dataclass
class Sample:
    """Languages and hashes of the texts, in order of the hash; buckets and counts of each; the pieces of those kept back and the language of each piece."""

    lang: np.ndarray
    hashes: np.ndarray
    whole: list[tuple[np.ndarray, np.ndarray]]
    cut: list[str]
    cut_lang: list[str]


def sample(df: DataFrame, text: str, lang: str, key: str, quota: int) -> Sample:
    """About quota texts of each language, those with the smallest hash of key and text."""
    own = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("__lang"), F.col(key).alias("__key"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                ids, counts = counted(data, offsets)
                hashes = part.column("__hash").to_numpy()
                own = [pieces(data[a:b].tobytes().decode("utf-8", "replace"), h & 0x7FFFFFFF) if back else [] for a, b, h, back in zip(offsets[:-1], offsets[1:], hashes.tolist(), is_kept_back(hashes), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("__lang"), part.column("__hash"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.string()))], ["lang", "hash", "ids", "n", "pieces"])

    got = sampled(own, ["__lang", "__key", "__text"], quota, "__lang").mapInArrow(run, "lang string, hash bigint, ids array<int>, n array<int>, pieces array<string>").toArrow()
    names, hashes = np.array(got["lang"].to_pylist(), object), got["hash"].to_numpy()
    order = np.argsort(hashes, kind="stable")
    ids, n = ([x.values.to_numpy() for x in got[c]] for c in ("ids", "n"))
    held = got["pieces"].to_pylist()
    return Sample(names[order], hashes[order], [(ids[i], n[i]) for i in order], [p for i in order for p in held[i]], [names[i] for i in order for _ in held[i]])


def of_texts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of each of a few texts."""
    packed = [t.encode() for t in texts]
    return list(zip(*counted(np.frombuffer(b"".join(packed), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype(np.int64)), strict=True))


def log_shares(held: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: int) -> np.ndarray:
    """Logarithms of each bucket's smoothed share of a language's subwords; no subword has none."""
    n = np.zeros(((1 << BITS) + 1, languages))
    for (ids, count), k in zip(held, y, strict=True):
        n[ids, k] += count
    out = np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * (1 << BITS)))
    out[-1] = 0
    return out


def means(shares: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each piece that has subwords their mean by the likeliest language."""
    return np.array([(n @ shares[ids]).max() / n.sum() for ids, n in held if len(ids)])


def limited(shares: np.ndarray, cut: list[str], y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """How likely each bucket is in each language, and the limit, from pieces of learned languages."""
    languages, rng = shares.shape[1], np.random.default_rng(seed)
    if not cut:
        return shares, -np.inf
    held = of_texts(cut)
    for k in range(languages):
        own = means(shares[:, [k]], [h for h, own in zip(held, y, strict=True) if own == k])
        shares[:-1, k] -= np.median(own) if len(own) else 0.0
    odd = [means(shares, of_texts(["".join(rng.permutation(list(t))) for t in cut]))]
    for k in range(languages if languages > 1 else 0):
        odd.append(means(np.delete(shares, k, axis=1), [h for h, own in zip(held, y, strict=True) if own == k]))
    limits = [np.quantile(x, q, method="lower") for x, q in ((np.concatenate(odd), ODD), (means(shares, held), ERROR)) if len(x)]
    return shares, float(min(limits)) - 1e-6 if limits else -np.inf


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", quota: int = QUOTA, dims: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> LanguageModel:
    s = sample(df, text, lang, key, quota)
    languages = sorted(set(s.lang))
    use = [i for i in range(len(s.lang)) if len(s.whole[i][0])]
    ids, shares = [w[0] for w in s.whole], [(w[1] / max(1, w[1].sum())).astype(np.float32) for w in s.whole]
    rng = np.random.default_rng(seed)
    embed, soft, bias = rng.normal(0, 1, ((1 << BITS) + 1, dims)), np.zeros((dims, len(languages))), np.zeros(len(languages))
    embed[-1] = 0
    y = np.array([languages.index(n) for n in s.lang], int)
    kept_back = [i for i in use if is_kept_back(s.hashes)[i]]
    learn = np.array([i for i in use if i not in set(kept_back)] or use, int)
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            lr = rate * (1 - step / (epochs * len(learn)))
            step += 1
            x = shares[i] @ embed[ids[i]]
            z = x @ soft + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = soft @ g
            soft -= lr * np.outer(x, g)
            bias -= 0.01 * lr * g
            embed[ids[i]] -= lr * np.outer(shares[i] / shares[i].max(), back) / 10
    table = embed @ soft
    likely, limit = limited(log_shares([s.whole[i] for i in learn], y[learn], len(languages)), s.cut, np.array([languages.index(n) for n in s.cut_lang], int), seed)
    if kept_back:
        z = np.array([shares[i] @ table[ids[i]] for i in kept_back]) + bias

        def p(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        at = np.arange(len(kept_back)), y[kept_back]
        best = min(np.geomspace(0.1, 10, 41), key=lambda t: -np.log(np.maximum(p(t)[at], 1e-12)).mean())
        table, bias = table / best, bias / best
    return LanguageModel(languages, table.astype(np.float32), bias, likely.astype(np.float32), limit)
