"""Toxicity: non-negative positive-unlabelled learning of linear classifiers in numpy.

Learning takes confirmed toxic texts and a sample of all texts, whatever their labels, as the unlabelled ones, which the
method asks for; labels of other kinds are only counted, for the class prior. With prior p the risk of a linear scorer is p * loss(toxic as 1) + max(0, loss(unlabelled as 0) -
p * loss(toxic as 0)); while the part in max() is negative the step goes the other way, which keeps the model from
fitting the unlabelled toxic texts as clean. Features are the distinct hashed words and byte 4- and 5-grams of the whole
text that occur in several confirmed toxic texts, with at
least `lift` times their share of all texts; a shrinking step at each turn keeps the weights of all others at 0.

Both samples are bounded by parameters and are the texts with the smallest hash of key and text, so they do not depend
on how rows are dealt out. Null texts count as
empty and have the score of the bias alone; repeated rows get equal results; rows without a key are never learned
from; without any toxic text the score is the prior, 0 if unknown. Outputs replace input columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _BYTE, LOWER, SPACE, _power, discarded, mix, sampled, saved, slices, words

BITS = 20
GRAMS = (4, 5)
#: Texts of each sample, but for what the estimate of their number is off by.
POSITIVES, UNLABELLED = 3000, 6000
#: Tasks that turn the samples into features.
TASKS = 12


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and of every run of GRAMS bytes inside one word."""
    rows, hashes = words(data, offsets)
    buckets = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[: len(data)], out=total[1:])
    seen = np.zeros(len(data) + 1, np.int32)
    np.cumsum(SPACE[data], out=seen[1:])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = [(rows, buckets)]
    for size in (n for n in GRAMS if n <= len(data)):
        at = np.flatnonzero((seen[size:] == seen[:-size]) & (doc[size - 1 :] == doc[: len(doc) - size + 1]))
        hashes = mix(((total[at + size] - total[at]) * down[at]) ^ np.uint64(0xABCDEF * size))
        out.append((doc[at], (hashes >> np.uint64(64 - BITS)).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    prior: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, buckets = features(data, offsets)
        hit = np.flatnonzero(self.weights[buckets])
        both = np.unique(rows[hit].astype(np.int64) << BITS | buckets[hit])
        z = self.bias + np.bincount(both >> BITS, self.weights[both & ((1 << BITS) - 1)], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def predict(self, df: DataFrame, text: str = "text", limit: float = 0.7) -> DataFrame:
        """Add `score double, predicted int` (1 from the limit on)."""
        keep = [c for c in df.columns if c.lower() not in ("score", "predicted")]
        model = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in slices(batch, "__text"):
                    score = model.value.probabilities(data, offsets)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score), pa.array((score >= limit).astype(np.int32))], [*keep, "score", "predicted"])

        return df.select(*(df[c] for c in keep), df[text].alias("__text")).mapInArrow(run, StructType([df.schema[c] for c in keep] + StructType.fromDDL("score double, predicted int").fields))


def learned(toxic: DataFrame, other: DataFrame) -> DataFrame:
    """toxic boolean, hash, ids: the distinct buckets of the texts (__hash, __text) of both samples, saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                rows, buckets = features(data, offsets)
                both = np.unique(rows.astype(np.int64) << BITS | buckets)
                cuts = np.searchsorted(both >> BITS, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays([part.column("__toxic"), part.column("__hash"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))], ["toxic", "hash", "ids"])

    rows = toxic.select(F.lit(True).alias("__toxic"), "__hash", "__text").unionByName(other.select(F.lit(False).alias("__toxic"), "__hash", "__text"))
    return saved(rows.repartition(TASKS, "__hash").mapInArrow(run, "toxic boolean, hash bigint, ids array<int>"), "toxicity-sample")


def narrowed(rows: DataFrame, often: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For the toxic and the other texts, in order of their hashes: (row, feature) of every feature that a text has, and how many texts there are."""
    place = rows.sparkSession.sparkContext.broadcast(np.where(often, np.cumsum(often) - 1, -1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(p := place.value[x.values.to_numpy()])[p >= 0] for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("hash"), pa.array(kept, pa.list_(pa.int32()))], ["toxic", "hash", "ids"])

    got = rows.mapInArrow(run, "toxic boolean, hash bigint, ids array<int>").toArrow().combine_chunks().sort_by("hash")
    place.unpersist()
    out = []
    for kind in (True, False):
        ids = got.filter(pc.equal(got["toxic"], kind))["ids"].combine_chunks()
        lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        out.append((np.repeat(np.arange(len(ids), dtype=np.int32), lengths), ids.flatten().to_numpy(), len(ids)))
    return out


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None, turns: int = 300, rate: float = 0.3, shrink: float = 1e-4, least: int = 4, lift: float = 2.5) -> ToxicityModel:
    """Learn from df, whose texts the labels (key, label 0 or 1 or null) mark in part; the prior is their share of 1 unless given.

    A key with several labels is toxic if one of them says so.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__mark"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    marks = saved(marks.join(rows.select("__key"), "__key", "left_semi"), "toxicity-marks")
    if prior is None:
        prior = marks.agg(F.avg("__mark")).collect()[0][0] or 0.0
    # the keys are a bounded sample, so they may be sent to all executors
    keys = sampled(marks.where("__mark = 1"), ["__key"], positives).select("__key")
    rows = rows.where("__text IS NOT NULL")
    both = learned(sampled(rows.join(F.broadcast(keys), "__key"), ["__key", "__text"], positives), sampled(rows, ["__key", "__text"], unlabelled))
    sizes = {r[0]: r[1] for r in both.groupBy("toxic").count().collect()}
    if not sizes.get(True) or not prior:
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(max(prior, 1e-9) / (1 - min(prior, 1 - 1e-9)))), prior)
    each = both.select("toxic", F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.when(F.col("toxic"), 1)).alias("inside"), F.count(F.when(~F.col("toxic"), 1)).alias("around"))
    lifted = F.col("inside") / sizes[True] >= lift * (F.col("around") + 1) / sizes[False]
    often = np.zeros(1 << BITS, bool)
    often[each.where((F.col("inside") >= min(least, sizes[True])) & lifted).select("id").toArrow()["id"].to_numpy()] = True
    n = int(often.sum())
    p, u = narrowed(both, often)
    discarded(df.sparkSession, marks, both)
    w, bias = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for turn in range(1, turns + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(bias + np.bincount(r, w[c], k), -60, 60))) for r, c, k in (p, u))
        unfit = np.logaddexp(0, np.log(su + 1e-12) - np.log1p(-su + 1e-12)).mean() - prior * np.logaddexp(0, np.log(sp + 1e-12) - np.log1p(-sp + 1e-12)).mean()
        # slopes of the three mean losses by each text's score
        up, as_clean, of_all = -prior * (1 - sp) / p[2], prior * sp / p[2], su / u[2]
        gp, gu = (up - as_clean, of_all) if unfit >= 0 else (as_clean, -of_all)
        g = np.bincount(p[1], gp[p[0]], n) + np.bincount(u[1], gu[u[0]], n)
        gb = gp.sum() + gu.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        size = rate / np.sqrt(turn)
        w -= size * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-4)
        w = np.sign(w) * np.maximum(np.abs(w) - size * shrink / (np.sqrt(v / (1 - 0.99**turn)) + 1e-4), 0)
        bias -= size * (mb / (1 - 0.9**turn)) / (np.sqrt(vb / (1 - 0.99**turn)) + 1e-4)
    weights = np.zeros(1 << BITS, np.float32)
    weights[often] = w
    return ToxicityModel(weights, float(bias), float(prior))
