"""Byte-pair encoding and decoding through an index of pair occurrences.

The distinct pre-tokens of a slice of a partition lie side by side in one array. An index maps each adjacent pair
to all its positions; active ranks are applied in ascending order, each to all its positions, and the lists
of the pairs that appear are extended. Nothing is kept from one slice to the next.

Defined results: a null text is empty and has no ids; repeated rows are encoded each for itself; an empty
table gives an empty result; a very long text is a slice of its own and takes memory in proportion to its length;
of equal pairs in a run the left one joins first; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .pieces import Cut, buffers, kinds_of, spread
from .tokens import array_slices, of_worker, tokenizer_path

#: Fixed value: the byte-level pre-token pattern that the public tokenizer states.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space beyond ASCII; texts that hold any are cut by the pattern as a whole.
WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_names()
        self.of_byte = np.array([vocab[c] for c in names], np.int64)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        #: what each rank joins, and the ranks in the order of their pairs
        self.joins = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([a << 32 | b for a, b, _ in self.joins], np.int64)
        self.key_ranks = np.argsort(keys)
        self.keys = keys[self.key_ranks]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        import regex

        self.split = regex.compile(PATTERN).findall
        back = {c: b for b, c in enumerate(names)}
        bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items() if i not in self.special.values()} | {i: c.encode() for c, i in self.special.items()}
        #: the bytes of each id
        self.tokens = pa.array([bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)], pa.large_binary())

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where they don't join."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == keys), self.key_ranks[at], -1)

    def encode_pretokens(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the pre-tokens, which lie in a row in data, and how many there are up to each.

        In the array of symbols -1 stands between two pre-tokens, so no pair crosses it."""
        starts = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1
        symbols = np.full(starts[-1] + 1, -1, np.int64)
        is_byte = np.ones(len(symbols), bool)
        is_byte[0], is_byte[-1], is_byte[starts - 1] = False, False, False
        symbols[is_byte] = self.of_byte[data]
        before, after = np.arange(len(symbols)) - 1, np.arange(len(symbols)) + 1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray, ranks: np.ndarray) -> None:
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lows, firsts = [0, *cuts.tolist()], ranks[np.concatenate([[0], cuts])].tolist()
            for r, lo, hi in zip(firsts, lows, [*lows[1:], len(at)], strict=True):
                if r in places:
                    places[r].append(at[lo:hi])
                else:
                    places[r] = [at[lo:hi]]
                    heappush(active, r)

        index(np.arange(len(symbols) - 1), self.ranks_of(symbols[:-1], symbols[1:]))
        while active:
            r = heappop(active)
            a, b, new = self.joins[r]
            lists = places.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[(symbols[at] == a) & (symbols[after[at]] == b)]
            if a == b and len(at) > 1:  # runs of one symbol: every second place from the left
                free, taken = [], -1
                for i in at.tolist():
                    if i != taken:
                        free.append(i)
                        taken = int(after[i])
                at = np.array(free)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone] = new, -2
            after[at], before[beyond] = beyond, at
            left = before[at]
            index(np.concatenate([at, left]), self.ranks_of(np.concatenate([symbols[at], symbols[left]]), np.concatenate([symbols[beyond], symbols[at]])))
        return symbols[symbols >= 0], np.cumsum(symbols >= 0)[starts[1:] - 2] if len(sizes) else sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the texts in a row, and how many there are up to the end of each."""
        marked = [k for s in self.special for k in np.flatnonzero(pc.match_substring(texts, s)).tolist()]
        odd = sorted({*marked, *np.flatnonzero(pc.match_substring_regex(texts, WIDE_SPACE)).tolist()})
        plain = np.ones(len(texts), bool)
        plain[odd] = False
        data, starts = buffers(pc.if_else(pa.array(plain), texts, "") if odd else texts)
        cut = Cut(data, starts[:-1], kinds_of(data), spaced=True)
        places, found = cut.numbered()
        whole = np.zeros(len(found), bool)
        whole[places[cut.whole]] = True
        simple = found.filter(pa.array(~whole))
        words = [w.decode() for w in found.filter(pa.array(whole)).to_pylist()]
        #: pieces: the simple ones, then the parts of words left whole, then those of the odd texts
        apart = [[p.encode() for p in self.split(w)] for w in words]
        between = [self._parts(texts[k].as_py()) for k in odd]
        tail = [p for x in (*apart, *between) for p in x if isinstance(p, bytes)]
        own, own_starts = buffers(simple.cast(pa.large_binary()).view(pa.large_string()))
        joined = np.concatenate([own, np.frombuffer(b"".join(tail), np.uint8)])
        ids, ends = self.encode_pretokens(joined, np.concatenate([np.diff(own_starts), np.fromiter(map(len, tail), np.int64, len(tail))]))
        ends = np.concatenate([[0], ends])
        n, counts = len(simple), np.fromiter(map(len, apart), np.int64, len(apart))
        cuts = n + np.concatenate([[0], np.cumsum(counts)])
        first, size = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
        first[~whole], size[~whole] = ends[:n], np.diff(ends[: n + 1])
        first[whole], size[whole] = ends[cuts[:-1]], ends[cuts[1:]] - ends[cuts[:-1]]
        out, piece_ends = spread(ids, first, size, places)
        text_ends = np.concatenate([[0], piece_ends])[np.append(cut.first[1:], len(places))] if len(texts) else piece_ends
        if not odd:
            return out, text_ends
        parts, done, k = [], 0, int(cuts[-1])  # the odd texts' ids go in at their places
        added = np.zeros(len(texts), np.int64)
        for i, pieces in zip(odd, between, strict=True):
            parts.append(out[done : text_ends[i]])
            done = text_ends[i]
            for p in pieces:
                parts.append(ids[ends[k] : ends[k + 1]] if isinstance(p, bytes) else np.array([p]))
                k += isinstance(p, bytes)
                added[i] += len(parts[-1])
        return np.concatenate([*parts, out[done:]]), text_ends + np.cumsum(added)

    def _parts(self, text: str) -> list[bytes | int]:
        """Pre-tokens as bytes, and the ids of special strings between them."""
        out: list[bytes | int] = []
        for k, part in enumerate(re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]):
            out += [self.special[part]] if k % 2 else [p.encode() for p in self.split(part)]
        return out


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids array<int> of each whole text."""
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of_worker(PairIndexBpe, tokenizer_path(tokenizer))
        for doc_ids, texts in array_slices(batches, 6_000_000):
            ids, ends = bpe.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([doc_ids, lists], schema=kinds)

    return text_of(docs).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids and the decoded text; bytes that are no UTF-8 become replacement characters."""
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = of_worker(PairIndexBpe, tokenizer_path(tokenizer)).tokens
        for batch in batches:
            ids = batch.column(1)
            if ids.null_count:
                ids = pc.coalesce(ids, pa.scalar([], ids.type))
            for k in range(0, len(ids), 1000):  # so the bytes of a part stay far below what one array can hold
                part = ids.slice(k, 1000)
                ends, flat = part.offsets.to_numpy(), part.values
                spelt = tokens.take(flat.slice(ends[0], ends[-1] - ends[0]))
                at = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(spelt)).astype(np.int64))])[ends - ends[0]]
                data = b"".join(spelt.to_pylist()) if spelt.offset else (spelt.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1000), part.cast(kinds.field(1).type), pa.array(texts, pa.string())], schema=kinds)

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoded, "doc_id long, ids array<int>, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
