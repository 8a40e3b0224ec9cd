"""Periodic runs of words: maximal stretches of a text that repeat with a period, found through suffix trees.

The longest Lyndon word that begins at a place, by an order of the words or by the opposite one, has the period of a run
for some place of every run. So each place gives two candidates, and each is extended to both sides by the longest common
extension of two places: the depth of the lowest common ancestor of two leaves in a suffix tree, as a minimum over its
Euler tour in constant time. Trees of the words and of the reversed words are built by Ukkonen's algorithm.

Trees are only built for stretches that can hold a run: in a run of TIMES periods or more and LEAST words or more, every
GRAM words in a row are there again at a distance of one period, within the run. What isn't repeated that near inside its
stretch cuts the stretch, over and over; what is left are the runs and little else, whatever the length of the text. A
stretch takes about 1 kB a word while its trees are there.

Null and empty texts and texts without words have no runs and nothing to keep. Rows are worked on one by one, so repeated
rows, ties and null keys change nothing. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, mix, slices, spans, words

LEAST, TIMES = 6, 4
#: Words that are looked for again; runs of LEAST words and TIMES periods repeat at least so many (see stretches).
GRAM = 4
#: Turns of cutting; more would only make stretches shorter.
TURNS = 50
BLOCK = 16
_WEIGHTS = mix(np.arange(1, GRAM + 1, dtype=np.uint64))


def stretches(row: np.ndarray, word: np.ndarray) -> list[tuple[int, int]]:
    """(first, after the last) of the stretches of words in which a run can be.

    A run of period q and length n >= max(6, 4q) has n - 3 places where four words begin; each has the same four words q
    places before or behind it, inside the run (n - 3 > 2q for q > 1, and n - 3 >= 3 for q = 1), and 4q is no more than the
    length of the stretch that the run is in.
    """
    if len(row) < LEAST:
        return []
    n = len(row) - GRAM + 1
    gram = np.zeros(n, np.uint64)
    for j in range(GRAM):
        gram += word[j : n + j] * _WEIGHTS[j]
    gram = mix(gram)
    at = np.flatnonzero(row[:n] == row[GRAM - 1 :])
    own = row[at]
    for _ in range(TURNS):
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
        own = np.cumsum(new)
        size = np.bincount(own)[own] if len(own) else own
        order = np.lexsort((at, gram[at], own))
        far = np.full(len(at) + 1, np.iinfo(np.int64).max)
        same = (own[order][1:] == own[order][:-1]) & (gram[at[order]][1:] == gram[at[order]][:-1])
        far[1:-1][same] = np.diff(at[order])[same]
        near = np.empty(len(at), np.int64)
        near[order] = np.minimum(far[:-1], far[1:])
        keep = (near <= (size + GRAM - 1) // TIMES) & (size >= LEAST - GRAM + 1)
        if keep.all():
            break
        at, own = at[keep], own[keep]
    if not len(at):
        return []
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.append(begin[1:], len(at)) - 1
    return [(a, b + GRAM) for a, b in zip(at[begin].tolist(), at[last].tolist(), strict=True) if b + GRAM - a >= LEAST]


class SuffixTree:
    """Of a list of numbers from 1 on, whose end is marked by a 0."""

    def __init__(self, s: list[int]) -> None:
        s = [*s, 0]
        self.n, self.width = len(s), max(s) + 1
        self.start, self.stop, self.edge = _ukkonen(s, self.width)
        keys, kids = (np.fromiter(x, np.int64, len(self.edge)) for x in (self.edge.keys(), self.edge.values()))
        self.edge = {}
        order = np.argsort(keys)
        self.kids = kids[order].tolist()
        parent = keys[order] // self.width
        self.ends_here = (keys[order] % self.width == 0).tolist()
        self.first = np.searchsorted(parent, np.arange(len(self.start) + 1)).tolist()

    def leaves(self, end_last: bool = False) -> list[int]:
        """Beginnings of all suffixes in the order of the words; the end comes before all words, or after them."""
        start, stop, first, kids, n = self.start, self.stop, self.first, self.kids, self.n
        out, stack = [], [(0, 0)]
        while stack:
            v, deep = stack.pop()
            a, b = first[v], first[v + 1]
            if a == b:
                out.append(n - deep)
                continue
            own = kids[a:b]
            if end_last and self.ends_here[a]:
                own = own[1:] + own[:1]
            stack += [(k, deep + stop[k] - start[k]) for k in reversed(own)]
        return out

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """Depths (in words) along an Euler tour, and each suffix's place in it."""
        start, stop, first, kids, n = self.start, self.stop, self.first, self.kids, self.n
        deep, place, stack = [], [0] * n, [(0, 0)]
        while stack:
            v, d = stack.pop()
            if v < 0:
                deep.append(d)
                continue
            a, b = first[v], first[v + 1]
            if a == b:
                place[n - d] = len(deep)
                deep.append(d)
                continue
            for k in reversed(kids[a + 1 : b]):
                stack.append((k, d + stop[k] - start[k]))
                stack.append((-1, d))  # back here between two children
            stack.append((kids[a], d + stop[kids[a]] - start[kids[a]]))
            deep.append(d)
        return np.array(deep, np.int32), np.array(place, np.int64)


def _ukkonen(s: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Each node's label as s[start:stop], and edges by node * width + first number; node 0 is the root."""
    n = len(s)
    start, stop, link, edge = [0], [0], [0], {}
    node = at = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                at = i
            key = node * width + s[at]
            child = edge.get(key)
            if child is None:
                edge[key] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                begin = start[child]
                size = stop[child] - begin
                if length >= size:
                    at += size
                    length -= size
                    node = child
                    continue
                if s[begin + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(start)
                edge[key] = middle
                start += (begin, i)
                stop += (begin + length, n)
                link += (0, 0)
                start[child] = begin + length
                edge[middle * width + s[begin + length]] = child
                edge[middle * width + c] = middle + 1
                if last:
                    link[last] = middle
                last = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - waiting + 1
    return start, stop, edge


class Extensions:
    """How many words two places have in common from there on: the least depth between their leaves in the tour, by blocks."""

    def __init__(self, tree: SuffixTree) -> None:
        deep, self.place = tree.tour()
        blocks = -(-len(deep) // BLOCK)
        self.deep = np.full((blocks, BLOCK), np.iinfo(np.int32).max, np.int32)
        self.deep.ravel()[: len(deep)] = deep
        self.before = np.minimum.accumulate(self.deep, axis=1).ravel()
        self.behind = np.minimum.accumulate(self.deep[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [self.deep.min(axis=1)]
        while (w := 1 << (len(self.levels) - 1)) * 2 <= blocks:
            self.levels.append(np.minimum(self.levels[-1][:-w], self.levels[-1][w:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i <> j."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.behind[a], self.before[b])
        k = np.flatnonzero(x == y)
        if len(k):
            grid = np.arange(BLOCK)
            inside = (grid >= (a[k] % BLOCK)[:, None]) & (grid <= (b[k] % BLOCK)[:, None])
            out[k] = np.where(inside, self.deep[x[k]], np.iinfo(np.int32).max).min(axis=1)
        k = np.flatnonzero(y - x > 1)
        level = np.frexp((y - x - 1)[k].astype(np.float64))[1] - 1
        for e in np.unique(level).tolist():
            m = k[level == e]
            out[m] = np.minimum(out[m], np.minimum(self.levels[e][x[m] + 1], self.levels[e][y[m] - (1 << e)]))
        return out.astype(np.int64)


def lyndon(rank: list[int]) -> np.ndarray:
    """Of each place, the length of the longest Lyndon word there: up to the next suffix with a lower rank."""
    n, out, stack = len(rank), [0] * len(rank), []
    for i in range(n - 1, -1, -1):
        while stack and rank[stack[-1]] > rank[i]:
            stack.pop()
        out[i] = (stack[-1] if stack else n) - i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(s: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of numbers from 1 on, in order."""
    n = len(s)
    if n < 2:
        return []
    tree = SuffixTree(s)
    ahead = Extensions(tree)
    orders = [tree.leaves(), tree.leaves(end_last=True)[::-1]]
    del tree
    back, found = Extensions(SuffixTree(s[::-1])), []
    for order in orders:
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.arange(n + 1)
        i, p = np.arange(n), lyndon(rank[:n].tolist())
        right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        k = np.flatnonzero(i + p < n)
        right[k] = ahead.common(i[k], i[k] + p[k])
        k = i[1:]
        left[k] = back.common(n - k, n - k - p[k])
        size = left + p + right
        good = (size >= least) & (size >= times * p)
        found.append(np.stack([i - left, p, size], axis=1)[good])
    return [(a, c, b) for a, b, c in np.unique(np.concatenate(found), axis=0).tolist()]


def runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period), collapsed (the words that are in no run behind its first period, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "__text"):
                rows = part.num_rows
                row, start, end = spans(data, offsets)
                first = np.searchsorted(row, np.arange(rows + 1))
                keep, found = np.ones(len(row), bool), []
                for a, b in stretches(row, words(data, offsets)[1]):
                    names: dict[bytes, int] = {}
                    held = data[start[a] : end[b - 1]].tobytes()
                    s = [names.setdefault(held[x:y], len(names) + 1) for x, y in zip((start[a:b] - start[a]).tolist(), (end[a:b] - start[a]).tolist(), strict=True)]
                    for x, n, q in runs_of(s):
                        keep[a + x + q : a + x + n] = False
                        found.append((int(row[a]), a + x - int(first[row[a]]), n, q))
                found.sort(key=lambda r: (r[0], r[1], r[3]))
                cuts = pa.array(np.searchsorted([r[0] for r in found], np.arange(rows + 1)), pa.int32())
                parts = pa.StructArray.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in (1, 2, 3)], ["start", "length", "period"])
                out, at, _, _ = joined(data, row[keep], start[keep], end[keep], rows)
                texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(np.diff(first)), pa.ListArray.from_arrays(cuts, parts), texts], ["key", "n_words", "runs", "collapsed"])

    kind = f"key {df.schema[key].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    found = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, kind)
    return found.withColumnRenamed("key", key)
