"""Periodic runs of words by the suffix tree of each text, after Stoye and Gusfield.

The tree stands in arrays: its leaves in order are the suffix array, its inner nodes the intervals of common prefixes. At
each node the leaf lists of all children but the largest are walked: leaf i and leaf i + depth under different children are
a branching tandem repeat. Each is rotated to the left as far as it goes, repeats of a multiple of the period of
another with the same end are merged into it, and what comes of it is a maximal run. Work is O(n log n) words.

The trees of a slice of texts are built together, each text having words of its own, so no repeat crosses texts.

Defined results: a null or empty text has no words and no runs; a row without doc_id has runs like any other and no tail
is repeated in it; repeated rows are searched each for itself; a very long text is searched whole, with memory in
proportion to its length and to the logarithm of its longest repeat; of equally long runs the one that begins first, then
the one with the shorter period is the longest; an empty table gives an empty result; further columns, whatever their
names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import array_slices, distinct_words

#: Words that a run has at least; twice its period it has in any case.
LEAST_LENGTH = 12
#: Characters of a slice, unless one text has more.
SLICE_CHARS = 1_000_000


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, place, common): the suffixes in order, the place of each, and the length of the prefix that each has in
    common with the one before it (-1 at the first). Each text ends with a symbol that occurs nowhere else."""
    n = len(symbols)
    order = np.argsort(symbols)
    head = np.ones(n, bool)
    head[1:] = np.diff(symbols[order]) != 0
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    split = np.where(head, 0, 127).astype(np.int8)  # the round in which a suffix was set apart from the one before it
    levels: list[tuple[np.ndarray, np.ndarray]] = []  # suffixes that still have equals, and their groups
    while True:
        open_ = np.flatnonzero(~head | ~np.append(head[1:], True))
        if not len(open_):
            break
        at = order[open_]
        levels.append((at, place[at]))
        key = place[at] * n + place[at + (1 << len(levels) - 1)]
        by_key = np.argsort(key)
        key, at = key[by_key], at[by_key]
        order[open_] = at
        new = np.ones(len(key), bool)
        new[1:] = np.diff(key) != 0
        found = open_[new & ~head[open_]]
        head[found], split[found] = True, len(levels)
        place[at] = np.maximum.accumulate(np.where(new, open_, 0))
    common = np.zeros(n, np.int64)
    group = -1 - np.arange(n)
    for k in reversed(range(len(levels))):  # from the longest prefixes down
        common[split == k + 1] = 1 << k
        deeper = np.flatnonzero(split > k + 1)
        if len(deeper):
            at, its = levels[k]
            group[at] = its
            a, b = order[deeper - 1] + common[deeper], order[deeper] + common[deeper]
            common[deeper[group[a] == group[b]]] += 1 << k
            group[at] = -1 - at
    common[:1] = -1
    return order, place, common


def _borders(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last smaller value before each place and the first that isn't larger after it."""
    values, n = common.tolist(), len(common)
    before, after, stack, top = [0] * n, [n] * n, [0], -1
    for t in range(1, n):
        value = values[t]
        while top >= value:
            after[stack.pop()] = t
            top = values[stack[-1]]
        before[t] = stack[-1]
        stack.append(t)
        top = value
    return np.array(before), np.array(after)


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each branching tandem repeat: a stretch and its copy behind it, followed by different words."""
    order, place, common = suffixes(symbols)
    before, after = _borders(common)
    cut = np.flatnonzero(common > 0)
    none = np.zeros(0, np.int64)
    if not len(cut):
        return none, none
    depth_at = before[cut] * (common.max() + 1) + common[cut]
    by_node = np.argsort(depth_at, kind="stable")
    cut, depth_at = cut[by_node], depth_at[by_node]
    first = np.append(True, np.diff(depth_at) != 0)
    last = np.append(first[1:], True)
    node = np.cumsum(first) - 1
    low, high, depth = before[cut[first]], after[cut[last]], common[cut[first]]
    # Children of a node: up to its first cut, between cuts, and from its last one.
    child_node = np.concatenate([node, node[last]])
    start = np.concatenate([np.where(first, before[cut], np.append(0, cut[:-1])), cut[last]])
    stop = np.concatenate([cut, high])
    by_node = np.argsort(child_node, kind="stable")
    child_node, start, stop = child_node[by_node], start[by_node], stop[by_node]
    size = stop - start
    firsts = np.flatnonzero(np.append(True, np.diff(child_node) != 0))
    largest = np.flatnonzero(size == np.maximum.reduceat(size, firsts)[child_node])
    walked = np.ones(len(size), bool)
    walked[largest[np.append(True, np.diff(child_node[largest]) != 0)]] = False
    child_node, start, stop, size = child_node[walked], start[walked], stop[walked], size[walked]
    child = np.repeat(np.arange(len(size)), size)
    leaf = order[np.arange(len(child)) + np.repeat(start - np.cumsum(size) + size, size)]
    far = depth[child_node][child]
    out = []
    for other, begin in ((leaf + far, leaf), (leaf - far, leaf - far)):
        inside = np.flatnonzero((other >= 0) & (other < len(symbols)))
        inside = inside[symbols[other[inside]] == symbols[leaf[inside]]]
        its, p = child[inside], place[other[inside]]
        own = child_node[its]
        inside = inside[(p >= low[own]) & (p < high[own]) & ((p < start[its]) | (p >= stop[its]))]
        out.append(np.column_stack([begin[inside], far[inside]]))
    found = np.unique(np.concatenate(out), axis=0)
    return found[:, 0], found[:, 1]


def _rotations(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How many words to the left each repeat can be rotated."""
    out, alive = np.zeros(len(start), np.int64), np.arange(len(start))
    for step in range(1, 33):
        alive = alive[start[alive] >= step]
        at = start[alive] - step
        alive = alive[symbols[at] == symbols[at + period[alive]]]
        out[alive] = step
    for k in alive.tolist():
        i, q, n, block = int(start[k]), int(period[k]), 32, 64
        while n < i:
            low = max(0, i - n - block)
            other = np.flatnonzero(symbols[low : i - n] != symbols[low + q : i - n + q])
            if len(other):
                n = i - low - int(other[-1]) - 1
                break
            n, block = i - low, block * 4
        out[k] = n
    return out


def maximal_runs(symbols: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """(start, length, period) of the runs, by start, then period."""
    start, period = branching_repeats(symbols)
    end = start + 2 * period
    by_end = np.lexsort((period, end))
    start, period, end = start[by_end], period[by_end], end[by_end]
    found = [np.zeros((0, 3), np.int64)]
    while len(end):
        first = np.append(True, np.diff(end) != 0)
        begin = start[first] - _rotations(symbols, start[first], period[first])
        found.append(np.column_stack([begin, end[first] - begin, period[first]]))
        group = np.cumsum(first) - 1
        merged = (period % period[first][group] == 0) & (2 * period <= (end[first] - begin)[group])
        start, period, end = start[~merged], period[~merged], end[~merged]
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(least, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeat_tails(doc_ids: list, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The words with the tail of every tenth text, by a hash of its id, made periodic."""
    out = places.copy()
    for doc_id, low, high in zip(doc_ids, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        if doc_id is None or low == high or (h := zlib.crc32(str(doc_id).encode())) % 10:
            continue
        g, n = h // 10, high - low
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[low + a : high] = places[low + a + np.arange(n - a) % p]
    return out


def _of_slice(doc_ids: list, texts: pa.Array, least: int, tails: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(runs, their texts, the texts without what runs repeat)."""
    ends, places, words = distinct_words(texts)
    places = places.astype(np.int64)
    if tails:
        places = repeat_tails(doc_ids, ends, places)
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    # A symbol for each text's word, and behind each text one of its own.
    where = np.arange(len(places)) + text
    symbols = -1 - np.arange(len(places) + len(sizes))
    symbols[where] = places * len(sizes) + text
    runs = maximal_runs(symbols, least)
    begins = ends - sizes + np.arange(len(sizes))
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = (np.cumsum(change)[:-1] == 0)[where]
    left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), words.take(pa.array(places[kept]))), " ")
    runs[:, 0] -= begins[owner]
    return runs, owner, collapsed


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH, tails: bool = False) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> by start, then period, and collapsed, the text's words less those
    that a run repeats, for each whole text. tails: every tenth text gets a periodic tail first."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in array_slices(batches, SLICE_CHARS):
            runs, owner, collapsed = _of_slice(ids.to_pylist(), texts, least, tails)
            offsets = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(run))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), each), collapsed.cast(pa.string())], schema=kinds)

    return text_of(docs).mapInArrow(found, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.before")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.shorter")).alias("period"),
        F.expr("1000 * longest.length div -longest.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
