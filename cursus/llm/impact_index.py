"""Ranked lexical search on a bit-sliced impact index.

Documents are indexed in blocks. For each block and term the index has which documents hold the term and, over
those, one bitmap for each bit of the term's impact in them (tf against length, without the term's weight, which grows with
the corpus). A search reads the bitmaps of the terms it asks for, spreads them over the block, and adds them, once for each
bit that is set in the term's weight, by full adders on whole bitmaps. The highest scores are found from the most
significant slice down. Blocks are bounded, so a term that all documents hold is many rows, and no task has more than
a block at a time; of each block at most k documents an item leave the task.

Defined results: a null or empty text has no terms and is never found; rows without doc_id count in all statistics and are
never found, as nothing could name them; repeated rows, of documents or items, are each ranked for themselves; equal scores
rank by ascending doc_id; a very long text is indexed whole, as a block of its own if need be; an empty table on either
side gives an empty result; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .tokens import array_slices, distinct_words

#: Characters and documents of a block, unless one text has more characters.
BLOCK_CHARS, BLOCK_DOCS = 8_000_000, 8192
#: Bits of an impact: it is below a million.
IMPACT_BITS = 20
#: Items, and characters of theirs, that are searched for by one job, and items that a task adds up side by side.
JOB_ITEMS, JOB_CHARS, SIDE_BY_SIDE = 1024, 4_000_000, 64

_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_IN_TERM = np.frombuffer(_BYTES, np.uint8) != 0x20


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """(where each text begins, and the end; the bytes)."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int32), b""
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return at - at[0], memoryview(data)[at[0] : at[-1]].tobytes()


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As distinct_words: runs of letters and digits, A-Z in lower case, and of all characters beyond ASCII."""
    at, data = _bytes_of(texts)
    return distinct_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(data.translate(_BYTES))))


def _count_terms(texts: pa.Array) -> np.ndarray:
    """How many terms each text has."""
    at, data = _bytes_of(texts)
    inside = _IN_TERM[np.frombuffer(data, np.uint8)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = at[:-1][np.diff(at) > 0]
    begins[firsts] = inside[firsts]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[at])


@dataclass
class Index:
    """blocks: (block, term, n, docs, slices), and for each block a row without term that has the documents' ids in docs, n of
    them. n_docs and n_terms: the documents with a term, and all their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def _statistics(docs: DataFrame) -> tuple[int, int]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for _, texts in array_slices(batches, BLOCK_CHARS):
            each = _count_terms(texts)
            n, length = n + int((each > 0).sum()), length + int(each.sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "length": pa.array([length], pa.int64())})

    total = text_of(docs).mapInArrow(counted, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    return total["n"] or 0, total["length"] or 0


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])


def _block(ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> tuple[pa.Array, np.ndarray, pa.Array, pa.Array]:
    """(terms, how many documents hold each, which, their impacts' slices)."""
    ends, places, words = terms_of(texts)
    sizes = np.diff(ends, prepend=0)
    key = np.sort(places.astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes))
    at = np.flatnonzero(np.append(True, np.diff(key) != 0)[: len(key)])
    tf = np.diff(np.append(at, len(key)))
    term, doc = np.divmod(key[at], len(ids))
    m = np.array([10 + 90 * n * n_docs // n_terms if n else 0 for n in sizes.tolist()], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    held = np.bincount(term, minlength=len(words))
    last = np.cumsum((IMPACT_BITS * held + 7) // 8)
    bit = np.concatenate([[0], last])[term] * 8 + np.arange(len(term)) - (np.cumsum(held) - held)[term]
    bits = np.zeros(8 * int(last[-1] if len(last) else 0), np.uint8)
    for s in range(IMPACT_BITS):
        bits[bit] = impact >> s & 1
        bit += held[term]
    present = held > 0
    keep = pa.array(present)
    return words.filter(keep), held[present], _binary(doc.astype("<u2"), 2 * np.cumsum(held[present])), _binary(np.packbits(bits, bitorder="little"), last[present])


def build(docs: DataFrame, block_chars: int = BLOCK_CHARS, block_docs: int = BLOCK_DOCS) -> Index:
    """Every term of every whole text; the index is written to the shared folder. block_docs: 65536 at most."""
    n_docs, n_terms = _statistics(docs)
    kinds = pa.schema([("block", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("docs", pa.binary()), ("slices", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for its, texts in array_slices(batches, block_chars):
            order = pc.sort_indices(its, null_placement="at_end")
            its, texts = its.take(order), texts.take(order)
            for k in range(0, len(its), block_docs):
                ids = its[k : k + block_docs]
                named = ids.drop_null()
                terms, held, which, slices = _block(ids, texts[k : k + block_docs], n_docs, n_terms)
                columns = [
                    pa.array(np.full(len(terms) + 1, block), pa.int64()),
                    pa.concat_arrays([pa.array([None], pa.string()), terms.cast(pa.string())]),
                    pa.array(np.append(len(named), held), pa.int32()),
                    pa.concat_arrays([pa.array([named.to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), which]),
                    pa.concat_arrays([pa.array([b""], pa.binary()), slices]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)
                block += 1

    found = text_of(docs).mapInArrow(blocks, "block long, term string, n int, docs binary, slices binary")
    return Index(written(found, "impacts"), n_docs, n_terms)


class Asked:
    """What one job searches for: items, and (item, term, weight) triples in the items' order."""

    def __init__(self, items: list, item: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.items, self.item, self.term, self.weight = items, item, term, weight
        self.slices = max(1, int(np.bincount(item, weight, 1).max() * 1e6 + 1).bit_length())


def _spread(docs: list[bytes], slices: list[bytes], width: int) -> np.ndarray:
    """(bit of the impact, term, 64 documents): the terms' slices over the block, and at last a term without any."""
    out = np.zeros((IMPACT_BITS, len(docs) + 1, width), np.uint64)
    for k, (which, bits) in enumerate(zip(docs, slices, strict=True)):
        at = np.frombuffer(which, "<u2")
        dense = np.zeros((IMPACT_BITS, 64 * width), np.uint8)
        dense[:, at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=IMPACT_BITS * len(at), bitorder="little").reshape(IMPACT_BITS, len(at))
        out[:, k] = np.packbits(dense, axis=1, bitorder="little").view("<u8")
    return out


def _add(total: np.ndarray, slices: np.ndarray, shift: int) -> None:
    """total += slices << shift, each a number of bitmaps, the least significant first."""
    carry = np.zeros_like(total[0])
    for s, x in enumerate(slices, shift):
        a = total[s]
        half = a ^ x
        both = a & x
        np.bitwise_xor(half, carry, out=a)
        half &= carry
        carry = both | half
    for s in range(shift + len(slices), len(total)):
        if not carry.any():
            break
        both = total[s] & carry
        total[s] ^= carry
        carry = both


def _top(total: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps by item: those surely among the k highest, and those that share the last places."""
    open_ = np.bitwise_or.reduce(total, axis=0) & valid
    sure = np.zeros_like(open_)
    for s in reversed(range(len(total))):
        set_ = open_ & total[s]
        n = np.bitwise_count(sure).sum(axis=1, dtype=np.int64) + np.bitwise_count(set_).sum(axis=1, dtype=np.int64)
        many = (n > k)[:, None]
        sure = np.where(many, sure, sure | set_)
        open_ = np.where(many, set_, open_ & ~set_)
    return sure, open_


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _search_block(asked: Asked, table: pa.Table, k: int, side: int) -> tuple[list, list, list]:
    """(items, documents, scores) of a block's k highest for each item."""
    number = table.column("number").to_pylist()
    docs, slices = table.column("docs").to_pylist(), table.column("slices").to_pylist()
    ids = np.frombuffer(docs[number.index(None)], "<i8")
    row_of = np.full(int(asked.term.max(initial=-1)) + 1, -1)
    for row, n in enumerate(number):
        if n is not None:
            row_of[n] = row
    here = row_of[asked.term] >= 0
    item, row, weight = asked.item[here], row_of[asked.term[here]], asked.weight[here]
    # Rows without doc_id come last in a block; bits beyond the named ones are never looked at.
    held = [len(d) // 2 for d in docs]
    last = max((int(np.frombuffer(docs[r], "<u2")[-1]) for r in range(len(docs)) if number[r] is not None and held[r]), default=0)
    width = max(last, len(ids) - 1) // 64 + 1
    valid = np.packbits(np.arange(64 * width) < len(ids), bitorder="little").view("<u8")
    out: tuple[list, list, list] = ([], [], [])
    for low in range(0, len(asked.items), side):
        part = slice(*np.searchsorted(item, [low, low + side]))
        rows, its, weights = row[part], item[part] - low, weight[part]
        if not len(rows):
            continue
        used, rows = np.unique(rows, return_inverse=True)
        spread = _spread([docs[r] for r in used], [slices[r] for r in used], width)
        n = min(side, len(asked.items) - low)
        total = np.zeros((asked.slices, n, width), np.uint64)
        for bit in range(int(weights.max()).bit_length()):
            has = np.flatnonzero(weights >> bit & 1)
            nth = np.arange(len(has)) - np.searchsorted(its[has], its[has])
            for turn in range(int(nth.max(initial=-1)) + 1):
                its_term = np.full(n, len(used))
                now = has[nth == turn]
                its_term[its[now]] = rows[now]
                _add(total, spread[:, its_term], bit)
        sure, ties = _top(total, valid, k)
        for i in np.flatnonzero((sure | ties).any(axis=1)).tolist():
            at = _places(sure[i])
            at = np.concatenate([at, _places(ties[i])[: k - len(at)]])
            scores = sum((total[s, i, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << s for s in range(asked.slices))
            out[0].extend([low + i] * len(at))
            out[1].extend(ids[at].tolist())
            out[2].extend(scores.tolist())
    return out


def _jobs(items: DataFrame) -> Iterator[list]:
    """(item_id, text) of the items, as many as one job asks for."""
    held, size = [], 0
    for r in items.select(F.col("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if len(held) >= JOB_ITEMS or size >= JOB_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _job(index: Index, items: list, k: int) -> DataFrame | None:
    """(item, doc_id, score): each block's k highest."""
    spark = index.blocks.sparkSession
    ends, places, words = terms_of(pa.array([t for _, t in items], pa.string()))
    pairs = np.unique(np.repeat(np.arange(len(items)), np.diff(ends, prepend=0)) * max(1, len(words)) + places)
    item, term = np.divmod(pairs, max(1, len(words)))
    if not len(pairs):
        return None
    terms = F.broadcast(spark.createDataFrame(list(enumerate(words.to_pylist())), "number int, term string"))  # those of JOB_CHARS characters
    df = {r["number"]: r["df"] for r in index.blocks.select("term", "n").join(terms, "term").groupBy("number").agg(F.sum("n").alias("df")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(words))], np.int64)
    some = weights[term] > 0
    if not some.any():
        return None
    shared = spark.sparkContext.broadcast(Asked(items, item[some], term[some], weights[term[some]]))
    asked_for = index.blocks.join(terms, "term", "left").where(F.col("number").isNotNull() | F.col("term").isNull())

    side = SIDE_BY_SIDE

    def searched(table: pa.Table) -> pa.Table:
        its, docs, scores = _search_block(shared.value, table, k, side)
        ids = [shared.value.items[i][0] for i in its]
        return pa.table({"item": pa.array(its, pa.int64()), "item_id": pa.array(ids, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return asked_for.select("block", "number", "docs", "slices").groupBy("block").applyInArrow(searched, "item long, item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item (item_id, text), in jobs of bounded blocks of items."""
    spark = index.blocks.sparkSession
    out = None
    for n, held in enumerate(_jobs(items)):
        found = _job(index, held, k)
        if found is not None:
            found = found.withColumn("job", F.lit(n))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = Window.partitionBy("job", "item").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB SQL for the ten best documents of each item; doc_id and item_id are unique there.
SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
