"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with single spaces. An item of n characters may differ from a passage by
k = n * rate (rounded down) edits. Cut into k + 1 pieces, at least one piece then stands in the passage unchanged, so an
automaton over all pieces finds the places to look at, and Myers' bit-parallel distance over the item and the text
around each place decides. The items go to the executors in blocks of a bounded number of characters, one pass each;
documents are never paired with items other than through a piece. Where there are several blocks, each is a job of its own whose
result is written and whose items are taken back from the executors before the next is sent, so that these and the driver hold
one block at a time, whatever the benchmark's size. A worker makes a block's automaton once, and the bit
masks of an item's parts when a hit first asks for them, each part's once.

Null and blank items match nothing, null and empty texts have no match; texts are read whole, however long. Of the
passages of one item in one text the one with the fewest edits is told, the first one among equals. Repeated documents
and repeated items each give their own rows.
"""

from __future__ import annotations

import functools
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import discarded, saved

RATE = 0.1
#: Characters of items that one pass takes at most, unless a single item is longer.
BLOCK_CHARS = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(start: int, end: int, budget: int) -> list[list[tuple[int, int, int]]]:
    """budget + 1 pieces of nearly one length that make up the item, each as its path (start, end, budget) up to the whole item.

    Of two halves with budgets that add up to one less than the budget, one stays within its own; so a passage within the
    budget has a whole path whose every part is within its budget, and a piece hit is followed upwards only while that holds.
    """
    whole = (start, end, budget)
    if not budget:
        return [[whole]]
    left = (budget - 1) // 2
    cut = start + (end - start) * (left + 1) // (budget + 1)
    return [[*path, whole] for path in pieces(start, cut, left) + pieces(cut, end, budget - 1 - left)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def nearest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a substring of the text, and the first place where such a one ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, at


class Matcher:
    """Items (id, normal text) ready to be looked for."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE) -> None:
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        self.known: dict[tuple[int, int, int], dict[str, int]] = {}
        owners: dict[str, list[tuple[int, int, list]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(self.items):
            for path in pieces(0, len(text), budget):
                owners[text[path[0][0] : path[0][1]]].append((n, path[0][0], path[1:]))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def masks(self, n: int, start: int, end: int) -> dict[str, int]:
        """The masks of a part of an item, made when first asked for and shared by all pieces in it; backwards where end < start."""
        if (n, start, end) not in self.known:
            text = self.items[n][1]
            self.known[n, start, end] = masks(text[start:end] if start <= end else text[::-1])
        return self.known[n, start, end]

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, edits, start, end) for each item within its budget, best passage each; text must be normal."""
        if not self.items or not text:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: dict[tuple[int, int, int, int], tuple[int, int]] = {}  # pieces of one passage lead to the same places
        for last, (size, own) in self.automaton.iter(text):
            for n, at, above in own:
                if n in best and not best[n][0]:
                    continue  # the first passage without edits is the best
                zero, found = last + 1 - size - at, (0, last + 1)
                for a, b, k in above:
                    low = max(0, zero + a - k)
                    if (n, a, b, zero) not in tried:
                        tried[n, a, b, zero] = nearest(self.masks(n, a, b), b - a, text[low : zero + b + k])
                    edits, end = tried[n, a, b, zero]
                    if edits > k:
                        break
                    found = edits, low + end
                else:
                    if n not in best or found < best[n]:
                        best[n] = found
        out = []
        for n, (edits, end) in sorted(best.items()):
            item, pattern, budget = self.items[n]
            _, length = nearest(self.masks(n, len(pattern), 0), len(pattern), text[max(0, end - len(pattern) - budget) : end][::-1])
            out.append((item, edits, end - length, end))
        return out


_last: list = []


def matcher(key: str, sent: Broadcast, rate: float) -> Matcher:
    """The matcher of a block of items, made once by a worker for all its tasks in a row."""
    if not _last or _last[0] != key:
        _last[:] = key, Matcher(sent.value, rate)
    return _last[1]


def find(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """key, item_id, edits int, start and end int (characters of the normal text) of every item in every text."""
    schema = StructType([df.schema[key], items.schema[item]] + StructType.fromDDL("edits int, start int, end int").fields)
    own = df.select(df[key].alias("__key"), df[text].alias("__text"))
    given = items.schema[item].name

    def over(sent: Broadcast) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = matcher(name, sent, rate)
            for batch in batches:
                keys, rows = batch.column("__key"), []
                for k, t in enumerate(batch.column("__text")):
                    rows += [(k, *found) for found in own.find(normal(t.as_py()))]
                if rows:
                    at, *cols = zip(*rows, strict=True)
                    kinds = (to_arrow_type(schema[given].dataType), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [key, given, "edits", "start", "end"])

        return own.mapInArrow(run, schema)

    found = list(passes(df.sparkSession, blocks(items.select(items[item].alias("i"), items[item_text].alias("t")), block), over))
    return functools.reduce(DataFrame.unionByName, found)


def clean(df: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", rate: float = RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text has none of the items, with every column as it was."""
    schema = df.schema

    def keep(sent: Broadcast, rows: DataFrame) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = matcher(name, sent, rate)
            for batch in batches:
                yield batch.filter(pa.array([not own.find(normal(t.as_py())) for t in batch.column(text)], pa.bool_()))

        return rows.mapInArrow(run, schema)

    left, own = df, None
    for kept in passes(df.sparkSession, blocks(items.select(items[item_text].alias("i"), items[item_text].alias("t")), block), lambda sent: keep(sent, left)):
        if own is not None:  # what the block before left, written here; the rows given stay where they are
            discarded(df.sparkSession, own)
        left, own = kept, kept if kept is not df and hasattr(kept, "saved_at") else None
    return left


def passes(spark: SparkSession, held: Iterator[list[tuple[object, str]]], over: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """The answer to each block of items: of a single one the plan, of several each written before the next block is sent."""
    now = next(held, [])
    several = False
    while now is not None:
        after = next(held, None)
        several = several or after is not None
        sent = spark.sparkContext.broadcast(now)
        answer = over(sent)
        if several:
            answer = saved(answer, "decontaminated")
            sent.destroy()
        yield answer
        now = after


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """The items (i, t) that are not blank, in blocks of up to `most` characters."""
    held, chars = [], 0
    for row in items.toLocalIterator():
        t = normal(row["t"])
        if held and chars + len(t) > most:
            yield held
            held, chars = [], 0
        if t:
            held.append((row["i"], t))
            chars += len(t)
    if held:
        yield held
