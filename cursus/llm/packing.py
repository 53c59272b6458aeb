"""Bounded-space online packing of token ids into training sequences.

Each partition holds a fixed number of open windows. A document goes where it leaves the smallest gap; where
none fits, the fullest window is emitted, after the head of the document has filled its gap if that is
wide enough. What is still open at the end of the partitions is merged, a fixed number of partitions at a time.

Defined results: a null text is empty, so its document is the end id alone; repeated rows are packed each for
itself; an empty table gives an empty result; a document longer than a window is cut; of windows with equal gaps the
one opened first is taken; a null doc_id stays null; further columns, whatever their names, play no part. Only open
windows and one slice of texts are in memory; a very long text is a slice of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .pieces import ODD, Cut, buffers, kinds_of, spread
from .tokens import array_slices, of_worker, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); emit gets the pieces of each sequence."""

    def __init__(self, length: int, windows: int, least_cut: int, emit):
        self.length, self.windows, self.least_cut, self.emit = length, windows, least_cut, emit
        self.open: list[list] = []  # [free, pieces]

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids):
            n = len(ids)
            if n >= self.length:
                take, window = self.length, None
            else:
                window = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
                take = n
                if window is None and len(self.open) >= self.windows:
                    window = min(self.open, key=lambda w: w[0])
                    if window[0] < self.least_cut:
                        self.open.remove(window)
                        self.emit(window[1])
                        window = None
                    else:
                        take = window[0]
            if window is None:
                window = [self.length, []]
                self.open.append(window)
            window[1].append((doc_id, start, ids[:take], doc_tokens))
            window[0] -= take
            if not window[0]:
                self.open.remove(window)
                self.emit(window[1])
            start, ids = start + take, ids[take:]


class Rows:
    """Sequences as rows of SCHEMA; open ones keep their id and say so."""

    def __init__(self, first_id: int):
        self.next_id, self.rows = first_id, []

    def add(self, pieces: list[tuple], is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), doc_tokens, self.next_id, offset, is_open))
            offset += len(ids)
        self.next_id += 1

    def take(self) -> list[list]:
        out, self.rows = [list(c) for c in zip(*self.rows, strict=True)], []
        return out


#: First bytes of the two-byte letters that this module lowers itself; words with any other go to the tokenizer whole.
LATIN = np.zeros(256, bool)
LATIN[0xC3] = True


class WordEncoder:
    """The ids of texts under a tokenizer that drops white space and never looks across it: a text's ids are those of
    its words in a row, and a plain word's those of its runs of letters, digits and marks."""

    def __init__(self, name: str, most: int = 300_000):
        self.held, self.most = {}, most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def pretokens(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of pre-tokens. Each ends at the one id that ends a word, so many are encoded in one call."""
        ids, sizes = [], []
        for i in range(0, len(items), 16_384):
            some = items[i : i + 16_384]
            got = np.array(self.tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.ends_word[got]) + 1
            if len(cuts) == len(some):
                ids.append(got)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                got, ends = self.words(some)
                ids.append(got)
                sizes.append(np.diff(ends, prepend=0))
        return np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))

    def remembered(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """pretokens(items), with the ids of at most `most` pre-tokens kept from slice to slice: those met again first."""
        values = list(map(self.held.get, items))
        new = [p for p, v in zip(items, values, strict=True) if v is None]
        ids, ends = self.pretokens(new)
        data, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
        made = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if len(self.held) + len(new) > self.most:
            self.held = {p: v for p, v in zip(items, values, strict=True) if v is not None}
        self.held.update(islice(zip(new, made, strict=True), max(0, self.most - len(self.held))))
        rest = iter(made)
        values = [next(rest) if v is None else v for v in values]
        return np.frombuffer(b"".join(values), "<u4").astype(np.int64), np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // 4)

    def words(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the texts in a row, and how many there are up to the end of each."""
        data, starts = buffers(texts)
        kinds = kinds_of(data, LATIN)
        kinds[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))] = ODD  # special strings begin so
        cut = Cut(data, starts[:-1], kinds, spaced=False)
        cut.data = self._lowered(data, cut)
        places, found = cut.numbered()
        whole = np.zeros(len(found), bool)
        whole[places[cut.whole]] = True
        blank = pc.match_substring_regex(found, r"^[\t-\r ]*$").to_numpy(zero_copy_only=False)
        plain = ~whole & ~blank
        first, size = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        ids, ends = self.remembered(found.filter(pa.array(plain)).cast(pa.string()).to_pylist())
        more, more_ends = self.words(found.filter(pa.array(whole)).cast(pa.string()).to_pylist())
        first[plain], size[plain] = ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0)
        first[whole], size[whole] = len(ids) + more_ends - np.diff(more_ends, prepend=0), np.diff(more_ends, prepend=0)
        out, piece_ends = spread(np.concatenate([ids, more]), first, size, places)
        if not len(texts):
            return out, piece_ends
        return out, np.concatenate([[0], piece_ends])[np.append(cut.first[1:], len(places))]

    @staticmethod
    def _lowered(data: np.ndarray, cut: Cut) -> np.ndarray:
        """Plain words in lower case, as the tokenizer makes them itself: fewer are distinct then. A word left whole
        keeps its case, as a mark after a letter may join with the one and not with the other."""
        upper = (data >= 65) & (data <= 90)
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        latin = latin[(data[latin] <= 0x9E) & (data[latin] != 0x97)]
        upper[latin] = True
        if cut.whole.any():
            upper &= ~np.repeat(cut.whole, np.diff(cut.starts, append=len(data)))
        return data + upper * np.uint8(32)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, length: int = 4096, windows: int = 32, least_cut: int = 32, merge_partitions: int = 8) -> DataFrame:
    """One row for each piece: its ids (binary, little-endian unsigned 32-bit) and its place in a sequence."""
    end = np.array([end_id], "<u4")
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(WordEncoder, tokenizer)
        rows = Rows(TaskContext.get().partitionId() << 32)
        packer = Packer(length, windows, least_cut, rows.add)
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.take(), kinds.types, strict=True)], schema=kinds)
        for doc_ids, texts in array_slices(batches, 6_000_000):
            ids, cuts = encoder.encode(texts)
            ids, cuts = ids.astype("<u4"), cuts.tolist()
            for doc_id, lo, hi in zip(doc_ids.to_pylist(), [0, *cuts[:-1]], cuts, strict=True):
                own = np.append(ids[lo:hi], end)
                packer.add(doc_id, 0, own, len(own))
            if rows.rows:
                yield as_batch()
        for _, pieces in packer.open:
            rows.add(pieces, True)
        if rows.rows:
            yield as_batch()

    pieces = written(text_of(docs).mapInArrow(packed, SCHEMA + ", open boolean"), "pieces")

    def merged(pdf):
        """The open windows of some partitions in one go: filled to the brim, the last one aside."""
        group = int(pdf["sequence_id"].iloc[0] >> 32) // merge_partitions
        rows = Rows((1 << 62) | group << 32)
        packer = Packer(length, 1, 1, rows.add)
        pdf = pdf.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True])
        for r in pdf.itertuples(index=False):
            packer.add(r.doc_id, r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens)
        for _, pieces in packer.open:
            rows.add(pieces)
        import pandas as pd

        out = pd.DataFrame(dict(zip(kinds.names, rows.take(), strict=True))).drop(columns="open")
        return out.astype({"doc_id": "Int64"})

    group = F.floor(F.shiftright("sequence_id", 32) / merge_partitions)
    left = pieces.where("open").drop("open").groupBy(group.alias("group")).applyInPandas(merged, SCHEMA)
    return pieces.where("not open").drop("open").unionByName(left)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
