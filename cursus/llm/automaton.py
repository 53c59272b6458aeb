"""Regexes over bytes compiled by subset construction and minimisation into transition arrays.

Syntax: literals, \\xHH and escaped characters, classes, groups, alternation, and ? * + {n} {n,}.
"""

from __future__ import annotations

import numpy as np

# An expression is ("set", frozenset of bytes), ("cat", [...]), ("or", [...]), ("star", e).


def parse(pattern: str, fold: bool = False) -> tuple:
    """fold: letters match in either case."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def of(chars: set[int]) -> tuple:
        if fold:
            chars = chars | {c ^ 32 for c in chars if 65 <= c & ~32 <= 90}
        return "set", frozenset(chars)

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inside = choice()
            at += 1
            return inside
        if pattern[at] != "[":
            return of({char()})
        at += 1
        out = pattern[at] == "^"
        at += out
        chars: set[int] = set()
        while pattern[at] != "]":
            low = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                chars |= set(range(low, char() + 1))
            else:
                chars.add(low)
        at += 1
        return of(set(range(256)) - chars if out else chars)

    def repeated() -> tuple:
        nonlocal at
        e = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                least, comma, most = pattern[at:end].partition(",")
                at = end + 1
                if comma and most:
                    raise ValueError("{n,m} isn't used here")
                e = ("cat", [e] * int(least) + ([("star", e)] if comma else []))
            else:
                e = {"?": ("or", [("cat", []), e]), "*": ("star", e), "+": ("cat", [e, ("star", e)])}[c]
        return e

    def choice() -> tuple:
        nonlocal at
        options, now = [], []
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                options.append(("cat", now))
                now = []
            else:
                now.append(repeated())
        return ("or", [*options, ("cat", now)]) if options else ("cat", now)

    return choice()


def reversed_(e: tuple) -> tuple:
    kind, x = e
    if kind == "cat":
        return kind, [reversed_(y) for y in reversed(x)]
    if kind == "or":
        return kind, [reversed_(y) for y in x]
    return (kind, reversed_(x)) if kind == "star" else e


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append([])
        return len(self.on) - 1

    def add(self, e: tuple, start: int) -> int:
        """The state where e, begun at start, ends."""
        kind, x = e
        if kind == "set":
            end = self.state()
            self.on[start].append((x, end))
        elif kind == "cat":
            end = start
            for y in x:
                end = self.add(y, end)
        elif kind == "or":
            end = self.state()
            for y in x:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(y, first)].append(end)
        else:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(x, loop)].append(loop)
            self.empty[loop].append(end)
        return end

    def closure(self, states: frozenset) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)


class Dfa:
    """next: states x 256; accepts: the rules that each state ends. State 0 is the start.

    anywhere: a match may begin at any byte, and a rule's thread ends where it first accepts.
    """

    def __init__(self, rules: list[tuple], anywhere: bool):
        nfa = _Nfa()
        start = nfa.state()
        ends: dict[int, int] = {}
        for r, e in enumerate(rules):
            first = nfa.state()
            nfa.empty[start].append(first)
            ends[nfa.add(e, first)] = r
        if anywhere:
            for s in ends:
                nfa.empty[s] = []
                nfa.on[s] = []
        sets = sorted({x for moves in nfa.on for x, _ in moves}, key=sorted)
        kinds: dict[tuple, list[int]] = {}
        for b in range(256):
            kinds.setdefault(tuple(b in x for x in sets), []).append(b)
        groups = list(kinds.values())
        #: By state: what it leads to on each group of bytes, closed, as bits.
        bits = lambda states: sum(1 << t for t in nfa.closure(frozenset(states)))
        moves = [[bits({t for x, t in on if group[0] in x}) if on else 0 for group in groups] for on in nfa.on]
        moving = sum(1 << s for s, on in enumerate(nfa.on) if on)
        again = bits({start}) if anywhere else 0
        first = bits({start})
        number, todo, table = {first: 0}, [first], []
        for now in todo:  # grows as states are found
            live, rows = now & moving, []
            while live:
                low = live & -live
                rows.append(moves[low.bit_length() - 1])
                live ^= low
            row = []
            for column in zip(*rows, strict=True) if rows else [()] * len(groups):
                to = again
                for x in column:
                    to |= x
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        accepts = [tuple(sorted(r for s, r in ends.items() if states >> s & 1)) for states in number]
        self.built = len(table)
        self._minimise(np.array(table), accepts, groups)

    def _minimise(self, table: np.ndarray, accepts: list[tuple], groups: list[list[int]]) -> None:
        """States are split by what they accept, then by the parts that their moves lead to, until none splits."""
        labels = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
        part = np.array([labels[a] for a in accepts])
        while True:
            _, new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
            new = new.reshape(-1)
            if new.max() == part.max():
                break
            part = new
        order = {int(p): i for i, p in enumerate(dict.fromkeys(part.tolist()))}  # the start's part comes first
        part = np.array([order[p] for p in part.tolist()])
        _, shown = np.unique(part, return_index=True)
        self.accepts = [accepts[s] for s in shown]
        self.next = np.zeros((len(shown), 256), np.int32)
        for k, group in enumerate(groups):
            self.next[:, group] = part[table[shown, k]][:, None]

    def rows(self) -> list[list]:
        """The transition arrays linked to each other: row[byte] is the next row, row[256] what it accepts."""
        rows: list[list] = [[] for _ in self.accepts]
        for row, to, accepted in zip(rows, self.next.tolist(), self.accepts, strict=True):
            row += [rows[t] for t in to]
            row.append(accepted)
        return rows

    def dead(self) -> list[bool]:
        """States from which nothing is accepted any more."""
        return [not a and bool((self.next[s] == s).all()) for s, a in enumerate(self.accepts)]
