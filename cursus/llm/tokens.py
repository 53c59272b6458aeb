"""Public tokenizers' files, and what the token operators share on the executors."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the sense of Unicode's White_Space, as the tokenizers' own patterns have it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f"[^{WHITE}]+")


def tokenizer_path(name: str) -> str:
    """A file's place on this machine; names without a folder are those of the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """Values of distinct pieces of text, worked out in bulk; at most `most` are held, the oldest half goes first."""

    def __init__(self, work: Callable[[list[str]], Iterable], most: int = 400_000):
        self.work, self.most, self.held = work, most, {}

    def of(self, texts: list[list[str]]) -> list[list]:
        """The values of the pieces of each text."""
        found = [list(map(self.held.get, pieces)) for pieces in texts]
        short = [k for k, values in enumerate(found) if None in values]
        new = {p for k in short for p, v in zip(texts[k], found[k], strict=True) if v is None}
        if new:
            if len(self.held) + len(new) > self.most:
                self.held = dict(islice(self.held.items(), len(self.held) // 2, None))
            pieces = sorted(new)
            made = dict(zip(pieces, self.work(pieces), strict=True))
            self.held.update(made)
            for k in short:
                found[k] = [made[p] if v is None else v for p, v in zip(texts[k], found[k], strict=True)]
        return found


_OF_WORKER: dict = {}


def of_worker(make: Callable, *args):
    """make(*args), kept for the later tasks of this Python worker."""
    if (make, args) not in _OF_WORKER:
        _OF_WORKER[make, args] = make(*args)
    return _OF_WORKER[make, args]


def words_of(text: str) -> list[str]:
    """What stands between white space; str.split also parts at four control characters that are none."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return WORD.findall(text)
    return text.split()


def array_slices(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_ids, texts) of about `chars` characters at a time; a text is never cut.

    The cycle collector rests meanwhile: the operators make millions of small objects and no cycles.
    """
    gc.disable()
    try:
        for batch in batches:
            ids, texts, held, size = batch.column(0), batch.column(1), 0, 0
            ends = np.asarray(pc.fill_null(pc.utf8_length(texts), 0))
            for i, n in enumerate(ends.tolist()):
                size += n
                if size >= chars or i + 1 == len(ends):
                    yield ids.slice(held, i + 1 - held), texts.slice(held, i + 1 - held)
                    held, size = i + 1, 0
    finally:
        gc.enable()


def in_slices(batches: Iterator[pa.RecordBatch], chars: int = 3_000_000) -> Iterator[tuple[list, list[str]]]:
    for ids, texts in array_slices(batches, chars):
        yield ids.to_pylist(), texts.to_pylist()


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ends, places, words): the distinct pieces between ASCII white space, the place among them of each piece
    of the texts in turn, and how many pieces there are up to the end of each text."""
    lists = pc.ascii_split_whitespace(texts)
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    places = flat.indices.to_numpy(zero_copy_only=False)
    words = flat.dictionary
    ends = np.cumsum(sizes)
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # where a text begins or ends with white space
        real = places != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        places = places[real]
    return ends, places, words
