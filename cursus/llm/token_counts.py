"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens go into a trie. A node's best forward score depends on the path to it alone, so it is
computed once for all pre-tokens that share the prefix; a terminal's count is the number of pieces on its best path.

The pieces are those of a public vocabulary, in the order of their ids. Their scores are a Zipf prior
over that order, log(1 / (rank + 1)) less the log of its sum; a character that no piece has
falls back to its UTF-8 bytes, one token for each, at the score of the last rank. A pre-token is the word mark and
what stands between ASCII white space. Of equal scores the path with fewer tokens counts.

Defined results: a null or empty text has 0 tokens and log probability 0; repeated rows are counted each
for itself; a very long text is a slice of its own, and so long a pre-token is scored without being kept; an empty table
gives an empty result; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of
from .tokens import Remembered, array_slices, distinct_words, of_worker, tokenizer_path

MARK = "▁"
#: Characters of a pre-token that stand in the trie. A pre-token of a million characters takes no more room than that.
SHARED = 64


class Unigram:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces) + 1)))
        #: Pieces by character: a node is (score or None, children).
        self.pieces: list = [None, {}]
        for r, p in enumerate(pieces):
            node = self.pieces
            for c in p:
                node = node[1].setdefault(c, [None, {}])
            node[0] = -math.log(r + 1) - total
        self.byte_score = -math.log(len(pieces) + 1) - total

    def forward(self, words: list[str]) -> list[tuple[int, float]]:
        """(tokens, log probability) of the best path of each word.

        A node of the words' trie holds its score, its tokens, its children, and the pieces that run on through it.
        """
        out, first = [], self.pieces
        root = (0.0, 0, {}, ())
        for word in words:
            node = root
            for depth, c in enumerate(MARK + word):
                child = node[2].get(c)
                if child is None:
                    n = len(c.encode())
                    score, tokens = node[0], node[1]
                    best, count, on = score + n * self.byte_score, tokens + n, []
                    for s, t, piece in (*node[3], (score, tokens, first)):
                        if (piece := piece[1].get(c)) is not None:
                            if (own := piece[0]) is not None and (s + own > best or s + own == best and t + 1 < count):
                                best, count = s + own, t + 1
                            if piece[1]:
                                on.append((s, t, piece))
                    child = (best, count, {}, on)
                    if depth < SHARED:  # what lies deeper is scored the same way, but not kept
                        node[2][c] = child
                node = child
            out.append((node[1], node[0]))
        return out


def _scores(name: str) -> Remembered:
    return Remembered(Unigram(tokenizer_path(name)).forward, 600_000)


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_words, n_tokens, log_prob of each whole text."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = of_worker(_scores, tokenizer)
        for doc_ids, texts in array_slices(batches, 4_000_000):
            ends, places, words = distinct_words(texts)
            found = remembered.of([words.to_pylist()])[0]
            counts, scores = np.array([n for n, _ in found], float), np.array([x for _, x in found], float)
            sizes = np.diff(ends, prepend=0)
            doc = np.repeat(np.arange(len(ends)), sizes)
            total = lambda x: np.bincount(doc, weights=x[places], minlength=len(ends))  # noqa: B023, E731
            columns = doc_ids, sizes, total(counts).astype(np.int64), total(scores)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return text_of(docs).mapInArrow(counted, "doc_id long, n_words long, n_tokens long, log_prob double")
