"""Pre-tokens of whole slices of text at once, as ranges of their bytes.

Words whose bytes settle their pre-tokens (ASCII without an apostrophe, and two-byte letters) are cut by byte class
in array operations; any other word is left whole, for the tokenizer's own pattern. Equal pieces are then numbered by one
dictionary, so that only a slice's distinct pieces are ever encoded and nothing has to be remembered between slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WHITE, _LETTER, _DIGIT, _MARK, ODD = range(5)
_KINDS = np.full(256, ODD, np.uint8)
_KINDS[:128] = _MARK
_KINDS[[9, 10, 11, 12, 13, 32]] = _WHITE
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[39] = ODD  # the apostrophe: what follows it decides
#: First bytes of two-byte characters that are all letters, but for two signs after C3.
_LETTERS = np.zeros(256, bool)
_LETTERS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of the texts in a row; starts has one more place than texts. Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def kinds_of(data: np.ndarray, letters: np.ndarray = _LETTERS) -> np.ndarray:
    kinds = _KINDS[data]
    high = np.flatnonzero(letters[data])
    after = data[np.minimum(high + 1, len(data) - 1)] if len(high) else data[:0]
    high = high[(data[high] != 0xC3) | ((after != 0x97) & (after != 0xB7))]
    kinds[high], kinds[high + 1] = _LETTER, _LETTER
    return kinds


class Cut:
    """Pieces of texts: starts (bytes), whole (words left whole), and `first`, the number of pieces before each text."""

    def __init__(self, data: np.ndarray, text_starts: np.ndarray, kinds: np.ndarray, spaced: bool):
        """spaced: a single space belongs to the word after it, and the rest of a run of white space is a piece.
        Otherwise runs of white space are pieces and each digit is one."""
        n = len(data)
        white = kinds == _WHITE
        begins = np.zeros(n + 1, bool)
        begins[text_starts] = True  # of empty texts too: the next text's first byte
        before = np.empty(n, bool)
        before[:1], before[1:] = False, white[:-1]
        if spaced:
            last = white.copy()  # the last of a run, with a word after it in the same text
            last[:-1] &= ~white[1:]
            last &= ~begins[1:]
            last[-1:] = False
            begins[:n] |= (white & ~before) | (last & before)
            begins[1:n] |= ~white[1:] & white[:-1] & (data[:-1] != 32)
        else:
            begins[:n] |= white != before
        begins[n] = False
        words = np.flatnonzero(begins[:n])
        odd = np.flatnonzero(kinds == ODD)
        whole = np.zeros(len(words), bool)
        whole[np.searchsorted(words, odd, "right") - 1] = True
        parts = np.zeros(n, bool)
        parts[1:] = (kinds[1:] != kinds[:-1]) & ~white[1:] & ~white[:-1]
        if not spaced:
            parts |= kinds == _DIGIT
        sizes = np.diff(words, append=n)
        if len(odd):
            parts &= ~np.repeat(whole, sizes)
        self.starts = np.flatnonzero(parts | begins[:n])
        self.whole = np.zeros(len(self.starts), bool)
        self.whole[np.searchsorted(self.starts, words[whole])] = True
        self.first = np.searchsorted(self.starts, text_starts)
        self.data = data

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """(place of each piece among the distinct ones, the distinct pieces)."""
        offsets = np.append(self.starts, len(self.data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data))])
        found = pieces.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the values flat[start : start + size] of each place in turn, and how many there are up to each."""
    each = sizes[places]
    ends = np.cumsum(each)
    at = np.repeat(starts[places] - ends + each, each)
    at += np.arange(ends[-1] if len(ends) else 0)
    return flat[at], ends
