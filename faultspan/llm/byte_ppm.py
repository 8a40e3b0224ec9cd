"""LM scoring by prediction by partial matching over bytes, with a pretrained context trie.

A text is read as its words (runs of bytes outside 09-0D and 20, A-Z lower-cased), each with one space behind it, and
one newline as the end. The trie holds all strings of up to ORDER + 1 bytes of the learning texts, with their counts; a
text begins in the context of one newline. A byte is coded in its longest known context:
with count c of n in all and q kinds, as (c - 1/2) / n, and as an escape, q / 2n, otherwise; after an escape the next
shorter context leaves out the bytes that the longer one has. Below the empty context all bytes left are alike. As the
trie is fixed, what a byte costs follows from the longest string up to it alone. The score is the log10 probability of all bytes.

Nothing is cut off: strings and contexts are written tables. Only what the places of the TOP most frequent longest strings
cost goes to the executors, worked out from the whole tables; the strings of all other places are joined, each once a
text. So are word counts, for the base, but for those of the HEAD most frequent words.

Null texts count as empty: one end and nothing else. Repeated rows are scored one by one; rows with a null id count
as id ''. Without any learning text every byte costs log10 256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, discarded, mix, saved, slices, words

ORDER = 5
#: Longest strings whose costs every executor holds.
TOP = 1 << 20
#: Words whose counts every executor holds.
HEAD = 1 << 16
#: The end of a text counts as a word; no word has this hash but by chance.
END = np.uint64(1)
#: Distinct strings or words that a task holds before it hands them on.
HELD = 1 << 21


def read(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes to code of all rows, and their offsets."""
    n = len(offsets) - 1
    wide = np.full(len(data) + 2 * n, 32, np.uint8)
    at = offsets + 2 * np.arange(n + 1)
    wide[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets))] = LOWER[data]
    space = SPACE[wide]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space behind a word; every row ends in spaces, so words don't meet
    wide[space] = 32
    wide[at[1:] - 1], keep[at[1:] - 1] = 10, True
    seen = np.zeros(len(wide) + 1, np.int64)
    np.cumsum(keep, out=seen[1:])
    return wide[keep], seen[at]


def strings(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For lengths from 1 on: the last so many bytes up to each place as a number; and how many there are in its row, with the newline before it."""
    own = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    depth = np.minimum(place + 2, longest).astype(np.int8)
    keys, out = own, [own]
    for d in range(1, longest):
        before = np.full(len(data), 10, np.uint64)
        before[d:] = own[:-d] if d < len(data) else own[:0]
        before[place == d - 1] = 10
        keys = keys | before << np.uint64(8 * d)
        out.append(keys)
    return out, depth


def tagged(keys: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
    return keys | np.asarray(depth).astype(np.uint64) << np.uint64(56)


def longest(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The tagged number of the longest string up to each place."""
    keys, depth = strings(data, offsets, order + 1)
    out = tagged(keys[-1], depth)
    for d in range(1, order + 1):
        at = np.flatnonzero(depth == d)
        out[at] = tagged(keys[d - 1][at], d)
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, counts, len(u)).astype(np.int64)


def counted(df: DataFrame, text: str, order: int) -> DataFrame:
    """kind (0: longest string up to each place, 1: word), key, n: counts over whole texts, one row for each kind and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                keys, counts = merged(held[kind])
                for k in range(0, len(keys), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int8)), pa.array(keys[part].view(np.int64)), pa.array(counts[part])], ["kind", "key", "n"])
                held[kind] = []

        held: list[list] = [[], []]
        for batch in batches:
            for _, data, offsets in slices(batch, "__text"):
                coded, at = read(data, offsets)
                own = longest(coded, at, order)
                rows, hashes = words(data, offsets)
                hashes = np.concatenate([hashes, np.full(len(offsets) - 1, END)])
                for kind, x in enumerate((own, hashes)):
                    held[kind].append(np.unique(x, return_counts=True))
                    if len(held[kind]) >= 16 or sum(len(p[0]) for p in held[kind]) > HELD:
                        held[kind] = [merged(held[kind])]
                        if len(held[kind][0][0]) > HELD:
                            yield from out(kind)
        yield from out(0)
        yield from out(1)

    return df.select(F.col(text).alias("__text")).mapInArrow(run, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Places:
    """Places of strings by their tagged number; place 0 is the empty one's."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, n = keys, len(keys)
        bits = max(4, int(np.ceil(np.log2(3 * n + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left = np.arange(n)
        slot = (mix(self.keys) >> self.shift).astype(np.int64)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each string, or -1."""
        keys = np.asarray(keys, np.uint64)
        slot = (mix(keys) >> self.shift).astype(np.int64)
        out = self.table[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            out[left] = self.table[slot[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out


class Trie(Places):
    """The same costs worked out in memory, for small tables."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int) -> None:
        super().__init__(keys)
        self.counts, self.order = counts, order
        lengths = (self.keys >> np.uint64(56)).astype(np.int64)
        plain = self.keys & np.uint64((1 << 56) - 1)
        n = len(self.keys)
        context = self.find(np.where(lengths > 1, tagged(plain >> np.uint64(8), lengths - 1), 0))
        context[lengths == 0] = -1
        suffix = self.find(np.where(lengths > 1, tagged(plain & ((np.uint64(1) << (8 * np.maximum(lengths - 1, 0)).astype(np.uint64)) - np.uint64(1)), lengths - 1), 0))
        child = np.flatnonzero(context >= 0)
        own = self.counts.astype(float)
        total = np.bincount(context[child], own[child], n)
        self.kinds = np.bincount(context[child], minlength=n)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.hit = np.where(context >= 0, np.log10((own - 0.5) / total[context]), 0.0)
            self.escape = np.log10(self.kinds / (2 * total))
            # what the next shorter context has beside the bytes of this one
            said = np.bincount(context[child], np.where(lengths[child] > 1, own[suffix[child]], 0), n)
            left_total, left_kinds = total[suffix] - said, self.kinds[suffix] - self.kinds
            self.log_left = np.log10(left_total)
            self.escape_left = np.where(left_kinds > 0, np.log10(left_kinds / (2 * left_total)), 0.0)
        self.log_count = np.log10(np.maximum(own - 0.5, 0.5))

    def logs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each byte."""
        most = self.order + 1
        keys, depth = strings(data, offsets, most)
        out = np.zeros(len(data))
        # the commonest case first: the whole string is known
        place = self.find(tagged(keys[-1], most))
        good = (depth == most) & (place >= 0)
        out[good] = self.hit[place[good]]
        at = np.flatnonzero(~good)
        came = np.full(len(at), -1)
        for d in range(self.order, -1, -1):
            context = self.find(tagged(keys[d][at] >> np.uint64(8), d)) if d else np.zeros(len(at), np.int32)
            known = (context >= 0) & (depth[at] > d)
            known &= self.kinds[np.maximum(context, 0)] > 0
            place = self.find(tagged(keys[d][at], d + 1))
            hit, first = known & (place >= 0), came < 0
            h, e = hit & first, known & ~hit & first
            out[at[h]] += self.hit[place[h]]
            out[at[e]] += self.escape[context[e]]
            h, e = hit & ~first, known & ~hit & ~first
            out[at[h]] += self.log_count[place[h]] - self.log_left[came[h]]
            out[at[e]] += self.escape_left[came[e]]
            came = np.where(known, context, came)[~hit]
            at = at[~hit]
        out[at] -= np.log10(max(1, 256 - int(self.kinds[0])))
        return out


def length(key: str) -> F.Column:
    return F.shiftrightunsigned(key, 56).cast("int")


def last(key: str, n: F.Column | str) -> F.Column:
    """The tagged number of a string's last n bytes; 0 if there are none."""
    n = F.col(n) if isinstance(n, str) else n
    mask = F.element_at(F.array(*(F.lit((1 << 8 * d) - 1).cast("bigint") for d in range(8))), n + 1)
    return F.col(key).bitwiseAND(mask).bitwiseOR(F.call_function("shiftleft", n.cast("bigint"), F.lit(56)))


def context(key: str) -> F.Column:
    """The tagged number of a string without its last byte."""
    plain = F.shiftrightunsigned(F.col(key).bitwiseAND((1 << 56) - 1), 8)
    return plain.bitwiseOR(F.call_function("shiftleft", (length(key) - 1).cast("bigint"), F.lit(56)))


@dataclass
class Model:
    """strings: key, n, hit (log10 probability in its own context); contexts: key, escape, log_left, escape_left; counts: words' key, n."""

    order: int
    strings: DataFrame = field(repr=False)
    contexts: DataFrame = field(repr=False)
    root_kinds: int
    tokens: int
    kinds: int
    head: np.ndarray
    head_counts: np.ndarray
    counts: DataFrame = field(repr=False)
    top: np.ndarray = field(init=False, repr=False)
    top_costs: np.ndarray = field(init=False, repr=False)

    @property
    def trie(self) -> Trie:
        all_of = self.strings.select("key", "n").toArrow()
        return Trie(np.concatenate([[0], all_of["key"].to_numpy()]).astype(np.int64).view(np.uint64), np.concatenate([[0], all_of["n"].to_numpy()]), self.order)

    def costs(self, needed: DataFrame) -> DataFrame:
        """key, cost: log10 probability of the last byte of each distinct longest string."""
        x = saved(needed.join(self.strings.select("key", "hit"), "key", "left"), "ppm-needed")
        new = x.where("hit IS NULL").select("key")
        level = new.select("key", F.explode(F.sequence(F.lit(1), length("key"))).alias("d")).withColumn("child", last("key", "d")).withColumn("context", context("child"))
        own, before = self.strings.withColumnRenamed("key", "child"), self.contexts.withColumnRenamed("key", "context")
        # short strings are few, and many places have them in common
        short = level.where("d <= 2").join(F.broadcast(own.where(length("child") <= 2)), "child", "left").join(F.broadcast(before.where(length("context") < 2)), "context", "left")
        both = short.unionByName(level.where("d > 2").join(own, "child", "left").join(before, "context", "left"))
        there, known = F.when(F.col("n").isNotNull(), F.col("d")), F.when(F.col("escape").isNotNull(), F.col("d"))
        walk = both.where("escape IS NOT NULL").groupBy("key").agg(
            F.max(there).alias("found"), F.max_by(F.struct("n", "hit"), there).alias("own"), F.max(known).alias("deepest"), F.max_by("escape", known).alias("escape"),
            F.collect_list(F.struct("d", "escape_left", "log_left")).alias("later"),
        )
        found = F.coalesce("found", F.lit(0))
        passed = F.aggregate(F.filter("later", lambda e: e["d"] > found + 1), F.lit(0.0), lambda a, e: a + e["escape_left"])
        end = F.lit(-float(np.log10(max(1, 256 - self.root_kinds))))
        rest = F.when(F.col("found").isNull(), end).otherwise(F.log10(F.col("own.n") - 0.5) - F.get(F.filter("later", lambda e: e["d"] == found + 1), F.lit(0))["log_left"])
        # a place escapes from its deepest known context and from each shorter one, down to the one that has the byte
        walk = walk.select("key", F.when(F.col("found") == F.col("deepest"), F.col("own.hit")).otherwise(F.col("escape") + passed + rest).alias("cost"))
        return x.where("hit IS NOT NULL").select("key", F.col("hit").alias("cost")).unionByName(new.join(walk, "key", "left").select("key", F.coalesce("cost", end).alias("cost")))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, up to `most`: those above a limit that a small histogram gives, so that nothing is sorted in one task."""
    size = F.floor(F.log2("n") * 64)
    left, limit = most, None
    for r in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        left -= r["count"]
        if left < 0:
            break
        limit = r["size"]
    return counts.where(size >= limit) if limit is not None else counts.limit(0)


def fit(df: DataFrame, text: str = "text", order: int = ORDER, least: int = 1, head: int = HEAD, top: int = TOP) -> Model:
    counts = saved(counted(df, text, order), "ppm-counts")
    # a longest string counts for each of its suffixes
    shorter = counts.where("kind = 0").select("n", "key", F.explode(F.sequence(F.lit(1), length("key"))).alias("d"))
    every = saved(shorter.select(last("key", "d").alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "ppm-every")
    child = every.select("key", "n", context("key").alias("context"), last("key", length("key") - 1).alias("suffix"))
    child = child.join(every.select(F.col("key").alias("suffix"), F.col("n").alias("said")), "suffix", "left")
    own = saved(child.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("said").alias("said")).withColumnRenamed("context", "key"), "ppm-own")
    after = own.select(F.col("key").alias("suffix"), F.col("total").alias("after_total"), F.col("kinds").alias("after_kinds"))
    # what the next shorter context has beside the bytes of this one
    x = own.withColumn("suffix", F.when(F.col("key") != 0, last("key", length("key") - 1))).join(after, "suffix", "left")
    x = x.withColumns({"left_total": F.col("after_total") - F.coalesce("said", F.lit(0)), "left_kinds": F.col("after_kinds") - F.col("kinds")})
    contexts = x.select(
        "key", F.log10(F.col("kinds") / (2 * F.col("total"))).alias("escape"), F.when(F.col("left_total") > 0, F.log10("left_total")).alias("log_left"),
        F.when((F.col("left_kinds") > 0) & (F.col("left_total") > 0), F.log10(F.col("left_kinds") / (2 * F.col("left_total")))).otherwise(0.0).alias("escape_left"),
    )
    contexts = saved(contexts, "ppm-contexts")
    hit = F.log10((F.col("n") - 0.5) / F.col("total")).alias("hit")
    known = saved(every.withColumn("context", context("key")).join(own.select(F.col("key").alias("context"), "total"), "context").select("key", "n", hit), "ppm-strings")
    root = own.where("key = 0").select("kinds").collect()
    words_only = counts.where("kind = 1").select("key", "n")
    tokens, kinds = words_only.agg(F.sum("n"), F.count("*")).collect()[0]
    most = frequent(words_only, head).toArrow()
    order_of = np.argsort(own_words := most["key"].to_numpy().view(np.uint64))
    model = Model(order, known, contexts, root[0][0] if root else 0, tokens or 0, kinds, own_words[order_of], most["n"].to_numpy()[order_of], words_only)
    near = model.costs(frequent(counts.where("kind = 0"), top).select("key")).toArrow()
    model.top = np.concatenate([[0], near["key"].to_numpy()]).astype(np.int64).view(np.uint64)
    model.top_costs = np.concatenate([[0.0], near["cost"].to_numpy()])
    discarded(df.sparkSession, every, own)
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: the key, n_tokens, n_known, train_tokens long, base_score and score double, n_bytes long (as coded)."""
    spark = df.sparkSession
    order_of_model = model.order
    sent = spark.sparkContext.broadcast((Places(model.top), model.top_costs, model.head, model.head_counts))
    scale = float(np.log10(model.tokens + model.kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bags(r: np.ndarray, h: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
            """For each of n rows the distinct values, and how often each is there."""
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(r)))
            cuts = pa.array(np.searchsorted(r[first], np.arange(n + 1)), pa.int32())
            return pa.ListArray.from_arrays(cuts, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))

        near_strings, costs, head, head_counts = sent.value
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                n = part.num_rows
                coded, at = read(data, offsets)
                own = longest(coded, at, order_of_model)
                place = near_strings.find(own)
                far = np.flatnonzero(place < 0)
                total = np.add.reduceat(np.where(place < 0, 0.0, costs[place]), at[:-1])  # no row is without its end
                far_bags = bags(np.searchsorted(at, far, side="right") - 1, own[far], n)
                rows, hashes = words(data, offsets)
                rows, hashes = np.concatenate([rows, np.arange(n)]), np.concatenate([hashes, np.full(n, END)])
                tokens = np.bincount(rows, minlength=n)
                near = np.minimum(np.searchsorted(head, hashes), max(0, len(head) - 1))
                there = head[near] == hashes if len(head) else np.zeros(len(hashes), bool)
                base = np.bincount(rows[there], np.log10(head_counts[near[there]] + 1.0), n) if there.any() else np.zeros(n)
                known = np.bincount(rows[there], minlength=n)
                arrays = [part.column("__key"), *map(pa.array, (tokens, known, base, total, np.diff(at))), *bags(rows[~there], hashes[~there], n), *far_bags]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "n_tokens", "head_known", "head_base", "head_score", "n_bytes", "words", "times", "strings", "string_times"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"key {kind}, n_tokens bigint, head_known bigint, head_base double, head_score double, n_bytes bigint, words array<bigint>, times array<int>, strings array<bigint>, string_times array<int>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "ppm-rows")
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rest = rest.join(model.counts.withColumnsRenamed({"key": "word"}), "word").groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_base"))
    far = rows.select("row", F.explode(F.arrays_zip("strings", "string_times")).alias("s")).select("row", F.col("s.strings").alias("key"), F.col("s.string_times").alias("times"))
    cost = model.costs(far.select("key").distinct())
    far = far.join(cost, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("tail_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("words", "times", "strings", "string_times").join(rest, "row", "left").join(far, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("head_known") + zero("tail_known")).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + zero("tail_base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("head_score") + zero("tail_score")).alias("score"), "n_bytes",
    )
