"""Near-duplicates by SimHash, searched through vantage-point trees.

Two fingerprints that differ in at most four of 64 bits differ in at most two bits of one half. So for each half a tree
of vantage points, drawn from a bounded sample, parts the halves by Hamming distance into shards. A
fingerprint is a member of one shard and a query to each shard that its ball of two bits reaches by
the triangle bounds. A shard's tasks build a vantage-point tree of their own, prune by the same bounds, and compare all
64 bits of what is left. Each task returns the links as a spanning forest, never all pairs of a group.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like any other;
repeated rows share a component; a null doc_id takes its component's id from the others, null if there are none; a very
long text is fingerprinted whole; a bit set in exactly half the hashes is 0; an empty table gives an empty result; further
columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, numbered, one_per_component, text_of, written
from .graph import components
from .tokens import in_slices

SHINGLE, BITS = 4, 4


def fingerprint(text: str, words: int = SHINGLE) -> int:
    import xxhash

    parts = text.encode().lower().split()  # of bytes: A-Z only, and white space is the contract's
    if not parts:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1 :] - 1
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[k : min(n, k + 65_536)].tolist(), stops[k : k + 65_536].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long."""
    kinds = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in in_slices(batches):
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(fp)], schema=kinds)

    return text_of(docs).mapInArrow(made, "doc_id long, fp long")


class Tree:
    """Vantage points over 32-bit halves: inner nodes are (point, radius, near, far), leaves are shard numbers."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 7):
        self.rng, self.leaves = np.random.default_rng(seed), 0
        self.root = self._grow(sample, shards)

    def _grow(self, points: np.ndarray, shards: int):
        if shards > 1 and len(points) > 1:
            point = points[self.rng.integers(len(points))]
            d = np.bitwise_count(points ^ point)
            radius = int(np.median(d))
            radius -= bool((d <= radius).all())
            near = d <= radius
            if near.any() and not near.all():
                return point, radius, self._grow(points[near], shards // 2), self._grow(points[~near], shards - shards // 2)
        self.leaves += 1
        return self.leaves - 1

    def homes(self, halves: np.ndarray) -> np.ndarray:
        return self._walk(halves, 0)[1]

    def reached(self, halves: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, shards): every shard that holds a half within `bits` of the one at the position."""
        return self._walk(halves, bits)

    def _walk(self, halves: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        at, shard, todo = [], [], [(self.root, np.arange(len(halves)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                at.append(rows)
                shard.append(np.full(len(rows), node))
                continue
            point, radius, near, far = node
            d = np.bitwise_count(halves[rows] ^ point).astype(np.int64)
            todo += [(near, rows[d - bits <= radius]), (far, rows[d + bits > radius])]
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, shard = np.concatenate(at), np.concatenate(shard)
        order = np.argsort(at, kind="stable")
        return at[order], shard[order]


class Forest:
    """Linked sets of positions: the parent of each is its set's smallest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while True:
            ra, rb = p[a], p[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = p[p]
                if (up == p).all():
                    break
                p[:] = up


def search(members: np.ndarray, queries: np.ndarray, shift: int, bits: int, link, rng, block: int = 1 << 19, leaf: int = 128) -> None:
    """link(query positions, member positions) for all within `bits` on 64 bits whose half at shift is within bits // 2."""
    half = lambda x: (x >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
    m_half, q_half = half(members), half(queries)
    todo = [(np.arange(len(members)), np.arange(len(queries)), 0)]
    while todo:
        m, q, failed = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > leaf and failed < 3 and len(m) * len(q) > 4096:
            point = m_half[m[rng.integers(len(m))]]
            d = np.bitwise_count(m_half[m] ^ point).astype(np.int64)
            radius = int(np.median(d))
            radius -= bool((d <= radius).all())
            near = d <= radius
            e = np.bitwise_count(q_half[q] ^ point).astype(np.int64)
            q_near, q_far = q[e - bits // 2 <= radius], q[e + bits // 2 > radius]
            if near.any() and not near.all():
                again = failed + 1 if len(q_near) + len(q_far) > 1.9 * len(q) else 0  # a ball too dense to part
                todo += [(m[near], q_near, again), (m[~near], q_far, again)]
                continue
        step = max(1, block // len(m))
        for k in range(0, len(q), step):
            some = q[k : k + step]
            i, j = np.nonzero(np.bitwise_count(queries[some][:, None] ^ members[m][None, :]) <= bits)
            if len(i):
                link(some[i], m[j])


def links(fps: DataFrame, bits: int = BITS, sample_rows: int = 4096, shard_rows: int = 131_072, task_queries: int = 32_768, most_sample: int = 262_144) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fps (fp) exactly as all links within `bits` do.

    The sample only places the vantage points. It is drawn by hash, eight fingerprints for each shard wanted, from
    sample_rows to most_sample of them, and no task sees more of it than its own part.
    """
    total = fps.count()
    wanted = -(-total // shard_rows)
    drawn = min(most_sample, max(sample_rows, 8 * wanted))
    picked = written(fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, total))) < drawn).select("fp"), "sample")
    sample = np.sort(np.array([r["fp"] for r in picked.limit(2 * drawn).collect()], np.int64).view(np.uint64))
    shards = max(1, min(wanted, max(1, len(sample) // 8)))
    shifts = (0, 32)
    trees = [Tree((sample >> np.uint64(s)) & np.uint64(0xFFFFFFFF), shards) for s in shifts]

    def routed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            fp = pdf["fp"].to_numpy(np.int64)
            for side, s in enumerate(shifts):
                halves = (fp.view(np.uint64) >> np.uint64(s)) & np.uint64(0xFFFFFFFF)
                home = trees[side].homes(halves)
                at, shard = trees[side].reached(halves, bits // 2)
                yield pd.DataFrame({"side": side, "shard": shard, "fp": fp[at], "member": shard == home[at]})

    routes = written(fps.select("fp").mapInPandas(routed, "side int, shard long, fp long, member boolean"), "routes")
    sizes = routes.groupBy("side", "shard").agg(F.count(F.lit(1)).alias("q"), F.count(F.when(F.col("member"), 1)).alias("m"))
    # A shard's queries and members are both cut in parts, and each part of the one meets each of the other.
    parts = F.broadcast(written(sizes.select("side", "shard", F.ceil(F.col("q") / task_queries).alias("qs"), F.ceil(F.col("m") / (2 * shard_rows)).alias("ms")).where("ms > 0"), "shards"))  # a row for each shard
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    routes = routes.join(parts, ["side", "shard"])
    queries = routes.select("side", "shard", own("qs").alias("q"), all_of("ms").alias("m"), "fp")
    # A part of the members is one array of about 2 * shard_rows at most, so what each part of the queries gets is a row.
    held = written(routes.where("member").groupBy("side", "shard", "qs", own("ms").alias("mp")).agg(F.collect_list("fp").alias("held")), "members")
    members = held.select(F.col("side").alias("s"), F.col("shard").alias("h"), all_of("qs").alias("qp"), "mp", "held")

    def searched(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        members = np.sort(np.asarray(held["held"].iloc[0], np.int64).view(np.uint64))
        queries = np.sort(asked["fp"].to_numpy(np.int64).view(np.uint64))
        nodes = np.unique(np.concatenate([members, queries]))
        forest = Forest(len(nodes))
        m_at, q_at = np.searchsorted(nodes, members), np.searchsorted(nodes, queries)
        search(members, queries, shifts[int(key[0])], bits, lambda q, m: forest.link(q_at[q], m_at[m]), np.random.default_rng(11))
        tied = np.flatnonzero(forest.parent != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[tied].view(np.int64), "b": nodes[forest.parent[tied]].view(np.int64)})

    return queries.groupBy("side", "shard", "q", "m").cogroup(members.groupBy("s", "h", "qp", "mp")).applyInPandas(searched, "a long, b long")


def rooted(prints: DataFrame, bits: int) -> DataFrame:
    """fp, root for each distinct fingerprint of prints (doc_id, fp), with the least doc_id of its rows."""
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = written(components(links(fps, bits)), "roots").select(F.col("node").alias("fp"), "root")
    return fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    prints = written(fingerprints(docs, words), "prints")
    roots = written(rooted(prints, bits), "rooted")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    # Rows meet their component by fingerprint; only distinct fingerprints are dealt out by root.
    found = hot_join(prints, written(hot_join(roots.select("fp", "root"), least, "root").select("fp", "component_id"), "least"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each component, that with the smallest doc_id (nulls last, then by row), as it was."""
    rows = numbered(docs)
    prints = written(fingerprints(rows.select(F.col("__row").alias("doc_id"), "__doc.text"), words), "prints")
    roots = written(rooted(prints, bits).select("fp", "root"), "rooted")
    return one_per_component(rows, written(hot_join(prints, roots, "fp").select(F.col("doc_id").alias("__row"), "root"), "components"))
