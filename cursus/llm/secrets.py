"""Secret scan by one combined deterministic automaton.

All rules are compiled into one minimal automaton that runs once over the bytes of a text and signals the earliest
place where a rule matches. The rule's reversed automaton then finds where the match begins and its
forward automaton where it ends; matches of a rule are leftmost, longest and don't overlap. Where two kinds begin at one
place the rule listed first goes first. A very long text is scanned whole; it takes memory in proportion to its length.

Defined results: a null or empty text has no spans; repeated rows are scanned each for itself; an empty table gives an
empty result; further columns play no part. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Dfa, parse, reversed_
from .common import text_of
from .tokens import in_slices, of_worker

#: kind: (pattern, letters in either case, least characters of the match). The first three are the base.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 0),
    "access": (r"AKIA[A-Z0-9]+", False, 18),
    "hex": (r"[0-9a-f]{16,}", False, 16),
    "github": (r"gh[opsur]_[A-Za-z0-9]+", False, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", False, 16),
    "google": (r"AIza[0-9A-Za-z_-]+", False, 39),
    "payment": (r"[rs]k_(live|test)_[0-9A-Za-z]+", False, 24),
    "web_token": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0),
    "private_key": (r"-----BEGIN\x20([A-Z]+\x20)?PRIVATE\x20KEY-----", False, 0),
}
BASE = ("assign", "access", "hex")
#: Characters of an assigned value at least, and where in the match it begins.
ASSIGNED = 12
_VALUE = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?""")


class Scanner:
    def __init__(self):
        expressions = [parse(p, fold) for p, fold, _ in RULES.values()]
        self.kinds, self.least = list(RULES), [n for _, _, n in RULES.values()]
        self.combined = Dfa(expressions, anywhere=True)
        self.start = self.combined.rows()[0]
        self.forward = [self._walker(Dfa([e], anywhere=False)) for e in expressions]
        self.backward = [self._walker(Dfa([reversed_(e)], anywhere=False)) for e in expressions]

    @staticmethod
    def _walker(dfa: Dfa) -> tuple:
        return dfa.next.tolist(), [bool(a) for a in dfa.accepts], dfa.dead()

    @staticmethod
    def _walk(walker: tuple, data: bytes, places: range) -> int:
        """How many bytes of the places the longest match takes."""
        table, accepts, dead = walker
        state, best = 0, 0
        for n, i in enumerate(places, 1):
            state = table[state][data[i]]
            if accepts[state]:
                best = n
            elif dead[state]:
                break
        return best

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) by start, then in the order of the kinds."""
        data = text.encode()
        done, found, row = [0] * len(self.kinds), [], self.start
        for i, byte in enumerate(data):
            row = row[byte]
            if row[256]:
                for r in row[256]:
                    if i >= done[r] and (back := self._walk(self.backward[r], data, range(i, done[r] - 1, -1))):
                        start = i + 1 - back
                        done[r] = start + self._walk(self.forward[r], data, range(start, len(data)))
                        found.append((start, r, done[r]))
        out, chars, at = [], 0, 0
        plain = len(data) == len(text)
        for start, r, end in sorted(found):
            if end - start < self.least[r]:
                continue
            if r == 0 and end - _VALUE.match(data, start, end).end() < ASSIGNED:
                continue
            if not plain:
                chars, at = chars + len(data[at:start].decode()), start
            first = start if plain else chars
            out.append((first, self.kinds[r], first + end - start))  # all rules are of ASCII characters
        return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of each whole text."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = pa.schema([("doc_id", pa.int64()), ("spans", spans)])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = of_worker(Scanner)
        for doc_ids, texts in in_slices(batches):
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(found, spans)], schema=kinds)

    return text_of(docs).mapInArrow(scanned, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
