"""Brown class-based n-grams: exchange clustering, class transitions and word emissions.

Every word that the training texts hold `least` times or more is clustered for itself, at most `most_words` of them, the
commonest first; all other words, unseen ones too, share units by length and ending, which are clustered like words. The
number of classes grows with the number of words. Each sweep gathers, over the whole training text, how often each unit
stands before and after each class. The commonest units are then moved one at a time to the class that raises the
likelihood of class bigrams most; each of the others goes where the derivative of the likelihood is greatest. The
assignment of the sweep with the highest likelihood stays. The probability of a token is
    weight * P(class | class before) * P(word | class) + (1 - weight) * P(word),
the last two with one added to each count and to one unseen word. Over the words seen and one unseen word of each class
it sums to one but for at most (classes - 1) / tokens, as the last term counts its one unseen word for each class.

Words are counted by block: a slice of a partition keeps its texts as numbers into a vocabulary of its own, so the
corpus-wide counts reach the texts by a join of vocabularies and are never sent to all tasks. As a token's count is a
factor of both terms, its logarithm is in the base score already, and later passes need the units of tokens only.

Defined results: a null or empty text is the end token alone; repeated rows count each time; a null doc_id is in the
training part; a very long text is a block of its own; of equally common words the smaller, of equally good classes the
first counts; an empty table gives an empty result; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, remove, text_of, written, written_at
from .tokens import array_slices, distinct_words

#: Words clustered for themselves: how often they must occur, and how many there are at most (two bytes a class and 2 * 4
#: bytes a class and word are what tasks and driver hold). SHAPES units stand for all others; EXACT units move one at a time.
LEAST, MOST_WORDS, SHAPES, EXACT, SWEEPS, WEIGHT = 50, 64_512, 1024, 2048, 5, 0.9
#: The end of a text; no word is empty.
END = b""


def is_training(doc_id: int | None, folds: int = 7, held: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != held


def n_classes_for(words: int) -> int:
    """A power of two near half the root of the number of words, from 16 to 128."""
    return 1 << min(7, max(4, round(math.log2(max(words, 1) ** 0.5 / 2))))


#: Numbers below it take two bytes, others four.
_SHORT = 40_000


def numbers(x: np.ndarray) -> bytes:
    """Numbers as 16-bit units; a unit of _SHORT or more adds its excess, times _SHORT, to the unit after it."""
    x = x.astype(np.int64)
    more = x >= _SHORT
    ends = np.cumsum(1 + more)
    out = np.empty(ends[-1] if len(x) else 0, np.uint16)
    out[ends - 1] = x % _SHORT
    out[ends[more] - 2] = x[more] // _SHORT + _SHORT
    return out.tobytes()


def of_numbers(data: bytes) -> np.ndarray:
    units = np.frombuffer(data, np.uint16).astype(np.int64)
    more = units >= _SHORT
    added = np.where(more, (units - _SHORT) * _SHORT, 0)
    units[1:] += added[:-1]
    return units[~more]


def blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Texts as numbers into their block's words, the words of each block with their training counts, and where both lie."""
    kinds = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()), ("ids", pa.binary()), ("word", pa.binary()), ("local", pa.int32()), ("n", pa.int64()), ("kind", pa.string())])
    schema = "block long, doc_id long, training boolean, ids binary, word binary, local int, n long, kind string"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, (doc_ids, texts) in enumerate(array_slices(batches, 12_000_000)):
            ends, places, found = distinct_words(pc.ascii_lower(texts))
            words = found.cast(pa.binary()).to_pylist()
            if END not in words:  # it is there when a text begins or ends with white space
                words.append(END)
            ends, end, doc_ids = ends.tolist(), np.array([words.index(END)]), doc_ids.to_pylist()
            ids = [np.append(places[a:b], end) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            training = [is_training(d) for d in doc_ids]
            learned = [x for x, learns in zip(ids, training, strict=True) if learns]
            counts = np.bincount(np.concatenate(learned), minlength=len(words)) if learned else np.zeros(len(words), np.int64)

            def batch(size: int, **columns) -> pa.RecordBatch:
                full = {"block": [first | k] * size} | columns  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(full[f.name], f.type) if f.name in full else pa.nulls(size, f.type) for f in kinds], schema=kinds)

            for a in range(0, len(ids), 2000):
                some = ids[a : a + 2000]
                yield batch(len(some), doc_id=doc_ids[a : a + 2000], training=training[a : a + 2000], ids=[numbers(x) for x in some], kind=["text"] * len(some))
            for a in range(0, len(words), 50_000):
                some = words[a : a + 50_000]
                yield batch(len(some), word=some, local=np.arange(a, a + len(some), dtype=np.int32), n=counts[a : a + 50_000], kind=["word"] * len(some))

    both, place = written_at(text_of(docs).mapInArrow(numbered, schema), "blocks", partition_by="kind")
    return both.where("kind = 'text'").select("block", "doc_id", "training", "ids"), both.where("kind = 'word'").select("block", "word", "local", "n"), place


def counted(words: DataFrame, least: int, most_words: int, shapes: int) -> tuple[DataFrame, int]:
    """(word, c, unit, rows) of each word, rows being its blocks, and how many words are units of their own."""
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("rows")), "counts")
    common = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(most_words)
    common = written(common.select("word", (F.row_number().over(Window.orderBy(F.desc("c"), "word")) - 1).alias("rank")), "common")  # most_words rows at most
    n = common.count()
    ending = F.concat(F.least(F.octet_length("word"), F.lit(12)).cast("string").cast("binary"), F.substring("word", -3, 3))
    unit = F.coalesce("rank", (F.pmod(F.crc32(ending), F.lit(shapes)) + n).cast("int"))
    return counts.join(F.broadcast(common), "word", "left").select("word", "c", unit.alias("unit"), "rows"), n


def unit_texts(texts: DataFrame, vocabularies: DataFrame, total: int, distinct: int) -> DataFrame:
    """doc_id, training, n_tokens, n_known, base_score and units (numbers) of each text, from its block's words (block,
    local, c, unit)."""
    names = ["doc_id", "training", "n_tokens", "n_known", "base_score", "units"]

    def joined(text: pd.DataFrame, word: pd.DataFrame) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({c: [] for c in names})
        c, unit = np.zeros(len(word)), np.zeros(len(word), np.int64)
        c[word["local"]], unit[word["local"]] = word["c"], word["unit"]
        base = np.log10((c + 1) / (total + distinct + 1))
        rows = []
        for d, training, x in zip(text["doc_id"], text["training"], text["ids"], strict=True):
            ids = of_numbers(x)
            rows.append((d, training, len(ids), int((c[ids] > 0).sum()), float(base[ids].sum()), numbers(unit[ids])))
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, units binary"
    vocabularies = vocabularies.withColumnRenamed("block", "of")
    return written(texts.groupBy("block").cogroup(vocabularies.groupBy("of")).applyInPandas(joined, schema), "units")


#: Units whose counts travel as one row.
TOGETHER = 256


def neighbours(texts: DataFrame, classes: np.ndarray, n_classes: int, end: int) -> np.ndarray:
    """2 x units x classes: how often each unit stands before, and after, each class in training texts."""
    units = len(classes)
    ranges = -(-units // TOGETHER)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, ranges * TOGETHER * n_classes), np.int32)
        for batch in batches:
            t = np.concatenate([[end], *(of_numbers(x) for x in batch.column(0).to_pylist())])
            c = classes[t].astype(np.int64)
            for side, keys in ((0, t[:-1] * n_classes + c[1:]), (1, t[1:] * n_classes + c[:-1])):
                held[side] += np.bincount(keys, minlength=held.shape[1]).astype(np.int32)
        if held.any():
            rows = held.reshape(2, ranges, -1).transpose(1, 0, 2)
            yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True) for x in rows], pa.binary())], names=["part", "counts"])

    size = 2 * TOGETHER * n_classes
    opened = lambda x, kind: np.frombuffer(pa.decompress(x, decompressed_size=size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for x in pdf["counts"]:
            total += opened(x, np.int32)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [pa.compress(total, codec="zstd", asbytes=True)]})

    parts = texts.where("training").select("units").mapInArrow(counted, "part int, counts binary")
    rows = parts.groupBy("part").applyInPandas(summed, "part int, counts binary").collect()  # most_words and SHAPES units in all
    out = np.zeros((2, ranges * TOGETHER, n_classes), np.float32)
    for r in rows:
        lo = r["part"] * TOGETHER
        out[:, lo : lo + TOGETHER] = opened(r["counts"], np.int64).reshape(2, TOGETHER, n_classes)
    return out[:, :units]


def bigrams(texts: DataFrame, units: int, end: int) -> np.ndarray:
    """How often each of the first units stands before each of them in training texts; a bounded square."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(units * units, np.int64)
        for batch in batches:
            t = np.concatenate([[end], *(of_numbers(x) for x in batch.column(0).to_pylist())])
            both = (t[:-1] < units) & (t[1:] < units)
            held += np.bincount(t[:-1][both] * units + t[1:][both], minlength=len(held))
        rows = held.reshape(units, units)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([rows[u].astype(np.int32).tobytes() for u in used], pa.binary())], names=["unit", "counts"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {u: np.sum([np.frombuffer(x, np.int32) for x in g], axis=0, dtype=np.int64) for u, g in pdf.groupby("unit")["counts"]}
        return pd.DataFrame({"unit": np.array(list(out), np.int32), "counts": [x.tobytes() for x in out.values()]})

    out = np.zeros((units, units))
    parts = texts.where("training").select("units").mapInArrow(counted, "unit int, counts binary")
    for r in parts.groupBy(F.floor(F.col("unit") / 16)).applyInPandas(summed, "unit int, counts binary").collect():
        out[r["unit"]] = np.frombuffer(r["counts"], np.int64)
    return out


def pairs_of(after: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    out = np.zeros((n_classes, n_classes))
    np.add.at(out, classes, after)
    return out


def likelihood(pairs: np.ndarray) -> float:
    """Of the class bigrams, less what doesn't depend on the classes."""
    f = lambda x: x * np.log(np.maximum(x, 1))
    return float(f(pairs).sum() - f(pairs.sum(axis=0)).sum() - f(pairs.sum(axis=1)).sum())


def exchange(classes: np.ndarray, counts: np.ndarray, totals: np.ndarray, n_classes: int, first: np.ndarray, together: int = 256) -> np.ndarray:
    """One sweep. The commonest units, whose bigrams `first` holds, go one after another to the class that raises the
    likelihood most; the rest, `together` at once, to that where its derivative is greatest, given what has moved so far."""
    classes, exact = classes.copy(), len(first)
    after, before = counts
    own_after, own_before = after[:exact].astype(float), before[:exact].astype(float)
    pairs = pairs_of(after, classes, n_classes)
    sizes = np.bincount(classes, weights=totals, minlength=n_classes)
    f = lambda x: x * np.log(np.maximum(x, 1))
    for t in range(exact):
        if not totals[t]:
            continue
        own, a, b, itself = classes[t], own_after[t].copy(), own_before[t].copy(), first[t, t]
        a[own] -= itself
        b[own] -= itself
        pairs[own] -= a
        pairs[:, own] -= b
        pairs[own, own] -= itself
        sizes[own] -= totals[t]
        held = np.maximum(pairs, 0)
        cols, rows = np.flatnonzero(a), np.flatnonzero(b)
        gain = (f(held[:, cols] + a[cols]) - f(held[:, cols])).sum(axis=1)
        gain += (f(held[rows] + b[rows][:, None]) - f(held[rows])).sum(axis=0)
        gain -= 2 * (f(np.maximum(sizes, 0) + totals[t]) - f(np.maximum(sizes, 0)))
        best = int(np.argmax(gain))
        best = best if gain[best] > gain[own] else own
        pairs[best] += a
        pairs[:, best] += b
        pairs[best, best] += itself
        sizes[best] += totals[t]
        if best != own:
            classes[t] = best
            own_after[:, own] -= first[:, t]
            own_after[:, best] += first[:, t]
            own_before[:, own] -= first[t]
            own_before[:, best] += first[t]
    order = exact + np.argsort(-totals[exact:], kind="stable")
    rest = order[totals[order] > 0]
    for k in range(0, len(rest), together):
        t = rest[k : k + together]
        a, b, own = after[t].astype(float), before[t].astype(float), classes[t]
        # A half is added to each count, so that a class pair not met yet is costly, not impossible.
        logs, size = np.log(np.maximum(pairs, 0) + 0.5), np.log(np.maximum(sizes, 0) + 0.5 * n_classes)
        best = (a @ logs.T + b @ logs - 2 * totals[t][:, None] * size).argmax(axis=1)
        for side, counts_of in ((pairs, a), (pairs.T, b)):
            np.add.at(side, own, -counts_of)
            np.add.at(side, best, counts_of)
        np.add.at(sizes, own, -totals[t])
        np.add.at(sizes, best, totals[t])
        classes[t] = best
    return classes


def clustered(texts: DataFrame, totals: np.ndarray, n_classes: int, end: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes, pairs): the best assignment of units to classes that the sweeps met, and its class bigrams."""
    classes = np.zeros(len(totals), np.uint8)
    classes[np.argsort(-totals, kind="stable")] = np.arange(len(totals)) % n_classes
    best, first = None, bigrams(texts, min(EXACT, len(totals)), end)
    for sweep in range(sweeps + 1):
        counts = neighbours(texts, classes, n_classes, end)
        pairs = pairs_of(counts[0], classes, n_classes)
        if best is None or (now := likelihood(pairs)) > best[0]:
            best = (likelihood(pairs), classes, pairs)
        if sweep < sweeps:
            classes = exchange(classes, counts, totals, n_classes, first).astype(np.uint8)
    return best[1], best[2]


def score(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, n_classes: int | None = None, sweeps: int = SWEEPS, weight: float = WEIGHT, shapes: int = SHAPES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole text (log10)."""
    texts, words, place = blocks(docs)
    counts, n_words = counted(words, least, most_words, shapes)
    counts = written(counts, "word-units")
    by_unit = counts.groupBy("unit").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect()  # one row for each unit
    totals, known = np.zeros(n_words + shapes), np.zeros(n_words + shapes)
    for r in by_unit:
        totals[r["unit"]], known[r["unit"]] = r["c"], r["v"]
    n, v = int(totals.sum()), int(known.sum())
    ends = counts.where(F.octet_length("word") == 0).select("unit").first()
    end, n_classes = (ends["unit"] if ends else 0), n_classes or n_classes_for(n_words)
    # A common word has a row for each block.
    many = counts.select("word", F.col("rows").alias("n"))
    held = unit_texts(texts, hot_join(words, counts.drop("rows"), "word", "inner", many).select("block", "local", "c", "unit"), n, v)
    remove(docs.sparkSession, place)  # what comes later reads the units alone

    classes, pairs = clustered(held, totals, n_classes, end, sweeps) if n else (np.zeros(len(totals), np.uint8), np.zeros((n_classes, n_classes)))
    size = np.bincount(classes, weights=totals, minlength=n_classes)
    distinct = np.bincount(classes, weights=known, minlength=n_classes)
    prior = (size + 1) / (size.sum() + n_classes)
    move = (pairs + 10 * prior) / (pairs.sum(axis=1, keepdims=True) + 10)
    #: log10 of what a token's count plus one is multiplied by, by the classes of the token before it and its own
    factor = np.log10(weight * move / (size + distinct + 1) + (1 - weight) / (n + v + 1))
    whole = math.log10(n + v + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for units, base in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist(), strict=True):
                k = classes[np.concatenate([[end], of_numbers(units)])]
                scores.append(base + (len(k) - 1) * whole + float(factor[k[:-1], k[1:]].sum()))
            held_out = pc.invert(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), held_out, batch.column(2), batch.column(3), pa.array([n] * len(scores), pa.int64()), batch.column(4), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return held.select("doc_id", "training", "n_tokens", "n_known", "base_score", "units").mapInArrow(scored, schema)
