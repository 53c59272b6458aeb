"""Near-duplicates by exact Jaccard similarity of word shingles, candidates from SimHash fingerprints and MinHash bands.

Rows with equal shingle sets are linked as they are. Of the others, those whose fingerprints the vantage-point trees of
simhash link are candidates, each checked exactly. Similar texts may differ in more bits than the trees can search, so those
that share a band of minima are candidates too: each is held against its bucket's least row, then against some peers of the same bucket unless they are linked by now. In
buckets that still hold several components every row outside the largest is held against all rows of other components,
in cells of a bounded number of rows, so no candidate is left out; only links leave a cell, never its pairs.
A link needs a Jaccard similarity of `least` or more between whole shingle sets. A pair at 0.8 shares none of the 20 bands
of four minima with a chance of 3 in 100 000. Most groups are linked by the first two steps, at a cost that follows the
rows; the last one's work grows with the product of what is left apart in a bucket.

Defined results: a null text is empty; a text of fewer words than a shingle is one shingle; texts without words
are alike; a null doc_id is a row like any other; a very long text is shingled whole; repeated rows are linked; an empty
table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import hot_join, numbered, one_per_component, written
from .graph import components
from .tokens import array_slices, distinct_words

SHINGLE, LEAST, BANDS, DEPTH, PEERS = 5, 0.8, 20, 4, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    ends, places, found = distinct_words(pc.ascii_lower(texts))
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in found.cast(pa.binary()).to_pylist()], np.uint64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    flat = hashes[places] if len(places) else np.zeros(0, np.uint64)
    stop = np.repeat(ends, ends - starts)
    at = np.arange(len(flat))
    h = np.zeros(len(flat), np.uint64)
    for k in range(words):  # what lies beyond the text's end counts as nothing
        h = _mixed(h * _STEP + np.where(at + k < stop, flat[np.minimum(at + k, max(0, len(flat) - 1))], np.uint64(0)))
    return [np.unique(h[a : max(a + 1, b - words + 1)]) if b > a else np.zeros(1, np.uint64) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def bands_of(sets: list[np.ndarray], bands: int = BANDS, depth: int = DEPTH) -> np.ndarray:
    """texts x bands: the minima of each set under bands * depth multiplications, combined by band."""
    rng = np.random.default_rng(13)
    times, plus = rng.integers(0, 1 << 63, (2, bands * depth), dtype=np.uint64)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands * depth):
        least = np.minimum.reduceat(flat * (times[k] | np.uint64(1)) + plus[k], starts)
        out[:, k // depth] = _mixed(out[:, k // depth] * _STEP + least)
    return out


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """__row, whole (a digest of the shingle set), bands."""
    kinds = pa.schema([("__row", pa.int64()), ("whole", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for ids, texts in array_slices(batches, 3_000_000):
            sets = shingle_sets(texts, words)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(list(bands_of(sets).view(np.int64)), kinds.field(2).type)], schema=kinds)

    return rows.select("__row", F.coalesce("text", F.lit(""))).mapInArrow(made, "__row long, whole binary, bands array<long>")


def whole_sets(rows: DataFrame, words: int) -> DataFrame:
    kinds = pa.schema([("__row", pa.int64()), ("set", pa.list_(pa.int64()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in array_slices(batches, 1_000_000):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in shingle_sets(texts, words)], kinds.field(1).type)], schema=kinds)

    return rows.select("__row", F.coalesce("text", F.lit(""))).mapInArrow(made, "__row long, set array<long>")


def linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity."""
    x = sets.select(F.col("__row").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("__row").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(x.hint("merge"), "a").where(F.size("x") > 0).join(y.hint("merge"), "b")
    return found.where(both / (F.size("x") + F.size("y") - both) >= least).select("a", "b")


def fingerprint_pairs(rows: DataFrame, words: int = SHINGLE, bits: int = simhash.BITS) -> DataFrame:
    """Pairs (a, b), a < b, of the rows (__row, text): each row with the least one of its fingerprint, and the least ones of
    fingerprints that simhash links."""
    prints = written(simhash.fingerprints(rows.select(F.col("__row").alias("doc_id"), "text"), words).select(F.col("doc_id").alias("__row"), "fp"), "prints")
    fps = written(prints.groupBy("fp").agg(F.min("__row").alias("least")), "fps")
    equal = hot_join(prints, fps, "fp").where("__row <> least").select(F.col("least").alias("a"), F.col("__row").alias("b"))
    tied = written(simhash.links(fps.select("fp"), bits), "tied")
    of = lambda side: fps.select(F.col("fp").alias(side), F.col("least").alias(f"of_{side}")).hint("merge")
    near = tied.join(of("a"), "a").join(of("b"), "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return equal.unionByName(near)


def near_roots(rows: DataFrame, words: int = SHINGLE, least: float = LEAST, peers: int = PEERS) -> DataFrame:
    """__row, root for each of the rows (__row, text) that is linked to another."""
    signed = written(signatures(rows, words), "signatures")
    one = written(signed.groupBy("whole").agg(F.min(F.struct("__row", "bands")).alias("one"), F.count(F.lit(1)).alias("n")), "one")
    equal = signed.select("__row", "whole").join(one.where("n > 1").select("whole", F.col("one.__row").alias("b")), "whole").where("__row <> b").select(F.col("__row").alias("a"), "b")
    equal = written(equal, "equal")
    placed = one.select(F.col("one.__row").alias("__row"), F.posexplode("one.bands").alias("band", "h"))
    buckets = placed.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("lead")).where("n > 1")
    buckets = written(buckets, "buckets")
    members = written(hot_join(placed, buckets, ["band", "h"], "inner", buckets), "members")
    ones = one.select(F.col("one.__row").alias("__row"))  # rows of equal sets are linked already
    pairs = written(fingerprint_pairs(rows.join(ones.hint("merge"), "__row", "left_semi"), words), "pairs")
    asked = written(members.select("__row").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("__row"))).distinct(), "asked")
    sets = written(whole_sets(rows.join(asked.hint("merge"), "__row", "left_semi"), words), "sets")

    leads = members.where("__row <> lead").select(F.col("lead").alias("a"), F.col("__row").alias("b")).distinct()
    edges = written(linked(leads.unionByName(pairs).distinct(), sets, least), "led")
    roots = written(components(edges), "led-roots")
    part = F.pmod(F.xxhash64("__row", "band"), F.ceil(F.col("n") / peers))
    groups = members.where("n > 2").groupBy("band", "h", part.alias("part")).agg(F.collect_list("__row").alias("rows"))
    rest = groups.select(F.explode("rows").alias("a"), "rows").select("a", F.explode(F.filter("rows", lambda r: r > F.col("a"))).alias("b")).distinct()
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"of_{side}"))
    rest = rest.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    more = written(linked(written(rest.join(leads, ["a", "b"], "left_anti"), "rest"), sets, least), "more")
    apart = open_links(members, written(components(edges.unionByName(more)), "more-roots"), sets, least)
    return components(equal.unionByName(edges).unionByName(more).unionByName(apart)).select(F.col("node").alias("__row"), "root")


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both >= least * (len(x) + len(y) - both)


def open_links(members: DataFrame, roots: DataFrame, sets: DataFrame, least: float, asked_rows: int = 64, held_rows: int = 256) -> DataFrame:
    """Links (a, b) between different components of one bucket, by comparing all that are left apart there."""
    at = members.select("band", "h", "__row").join(roots.withColumnsRenamed({"node": "__row"}), "__row", "left").withColumn("root", F.coalesce("root", "__row"))
    at = written(at, "rooted")
    sizes = at.groupBy("band", "h", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("band", "h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "root")).alias("top")).where("k > 1")
    parts = written(open_.select("band", "h", "n", F.ceil(F.col("n") / held_rows).alias("hs"), F.ceil((F.col("n") - F.col("top.n")) / asked_rows).alias("qs"), F.col("top.root").alias("top")), "open")
    rows = hot_join(at, parts.drop("n"), ["band", "h"], "inner", parts)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("__row"), F.col(n))
    held = rows.select("band", "h", "__row", "root", F.lit(0).alias("side"), each("qs").alias("q"), own("hs").alias("p"))
    asked = rows.where("root <> top").select("band", "h", "__row", "root", F.lit(1).alias("side"), own("qs").alias("q"), each("hs").alias("p"))
    cells = held.unionByName(asked).join(sets, "__row").repartition("band", "h", "q", "p").sortWithinPartitions("band", "h", "q", "p", "side", "__row")

    def links_of(held: list, asked: list) -> list[tuple[int, int]]:
        """Links between rows (key, root, set); components that one link has joined are not compared again."""
        joined, out = {}, []

        def top(r):
            while r in joined:
                r = joined[r]
            return r

        for a, ra, x in asked:
            for b, rb, y in held:
                if (i := top(ra)) != (j := top(rb)) and similar(x, y, least):
                    joined[max(i, j)] = min(i, j)
                    out.append((a, b))
        return out

    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda links: pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        cell, sides = None, ([], [])
        for batch in parts:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "h", "q", "p")), strict=True))
            ids, roots_, side = (batch.column(c).to_pylist() for c in ("__row", "root", "side"))
            lists = batch.column("set")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for k, key in enumerate(keys):
                if key != cell:
                    if found := links_of(*sides):
                        yield made(found)
                    cell, sides = key, ([], [])
                sides[side[k]].append((ids[k], roots_[k], flat[ends[k] : ends[k + 1]]))
        if found := links_of(*sides):
            yield made(found)

    return cells.mapInArrow(compared, "a long, b long")


def near_dedup(docs: DataFrame, words: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of each component, that with the smallest doc_id (nulls last, then by row), with the columns of docs."""
    rows = numbered(docs)
    return one_per_component(rows, written(near_roots(rows.select("__row", "__doc.text"), words, least), "near"))
