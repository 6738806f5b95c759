"""Byte automata: a small regex parser, Thompson construction, subset construction, minimisation.

Rules are compiled together into one deterministic automaton whose states carry the set of rules that
accept there; one pass over the bytes serves all rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))


class _Parser:
    """Regex subset: literals, \\xHH and escaped characters, classes, groups, (?i:..), |, ?, *, +, {m,n}."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def parse(self):
        tree = self.alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alt(self):
        options = [self.seq()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.seq())
        return options[0] if len(options) == 1 else ("alt", options)

    def seq(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeat())
        return ("seq", items)

    def repeat(self):
        atom = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                a, b = int(low), (int(high) if high else None) if comma else int(low)
            else:
                a, b = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            atom = ("rep", atom, a, b)
        return atom

    def escape(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def chars(self, codes: set[int], negated: bool = False):
        if self.fold:
            codes |= {c ^ 32 for c in codes if 65 <= c <= 90 or 97 <= c <= 122}
        return ("set", ALL - codes if negated else frozenset(codes))

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            before = self.fold
            if self.p.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.alt()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            self.fold = before
            return tree
        if c == "[":
            negated = self.peek() == "^"
            self.i += negated
            codes: set[int] = set()
            while (c := self.p[self.i]) != "]":
                self.i += 1
                a = self.escape() if c == "\\" else ord(c)
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    c = self.p[self.i]
                    self.i += 1
                    codes |= set(range(a, (self.escape() if c == "\\" else ord(c)) + 1))
                else:
                    codes.add(a)
            self.i += 1
            return self.chars(codes, negated)
        if c == "\\":
            return self.chars({self.escape()})
        if c == ".":
            return ("set", ALL - {10})
        return self.chars({ord(c)})


def parse(pattern: str):
    return _Parser(pattern).parse()


def reversed_tree(t):
    kind = t[0]
    if kind == "set":
        return t
    if kind == "rep":
        return ("rep", reversed_tree(t[1]), t[2], t[3])
    if kind == "alt":
        return ("alt", [reversed_tree(x) for x in t[1]])
    return ("seq", [reversed_tree(x) for x in reversed(t[1])])


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.move: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append([])
        return len(self.eps) - 1

    def add(self, t, a: int) -> int:
        """Attach t behind state a; returns its end state."""
        kind = t[0]
        if kind == "set":
            b = self.state()
            self.move[a].append((t[1], b))
            return b
        if kind == "seq":
            for x in t[1]:
                a = self.add(x, a)
            return a
        if kind == "alt":
            end = self.state()
            for x in t[1]:
                s = self.state()
                self.eps[a].append(s)
                self.eps[self.add(x, s)].append(end)
            return end
        _, x, low, high = t
        for _ in range(low):
            a = self.add(x, a)
        if high is None:
            s, end = self.state(), self.state()
            self.eps[a] += [s, end]
            self.eps[self.add(x, s)] += [s, end]
            return end
        end = self.state()
        for _ in range(high - low):
            self.eps[a].append(end)
            a = self.add(x, a)
        self.eps[a].append(end)
        return end


@dataclass
class Dfa:
    """next[state, byte], with state 0 the start; accepts[state] is a bit per rule; dead is -1 or the dead state."""

    next: np.ndarray
    accepts: np.ndarray
    dead: int


def compile_dfa(trees: list, anchored: bool) -> Dfa:
    """One automaton for all trees; not anchored: a match may begin at every byte."""
    nfa, ends = _Nfa(), {}
    start = nfa.state()
    for rule, t in enumerate(trees):
        s = nfa.state()
        nfa.eps[start].append(s)
        ends[nfa.add(t, s)] = rule
    closures: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in closures:
            seen, todo = {s}, [s]
            while todo:
                for x in nfa.eps[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closures[s] = frozenset(x for x in seen if nfa.move[x] or x in ends)
        return closures[s]

    # bytes that no rule tells apart share a column
    sets = list({s for moves in nfa.move for s, _ in moves})
    signature: dict[tuple, int] = {}
    column = np.array([signature.setdefault(tuple(c in s for s in sets), len(signature)) for c in range(256)])
    some = [int(np.flatnonzero(column == k)[0]) for k in range(len(signature))]
    steps = {s: [[y for codes, y in nfa.move[s] if c in codes] for c in some] for s in range(len(nfa.move)) if nfa.move[s]}
    first = closure(start)
    index, order, table = {first: 0}, [first], []
    for state in order:
        row = []
        for k in range(len(some)):
            to: set[int] = set() if anchored else set(first)
            for s in state:
                if s in steps:
                    for y in steps[s][k]:
                        to |= closure(y)
            key = frozenset(to)
            if key not in index:
                index[key] = len(order)
                order.append(key)
            row.append(index[key])
        table.append(row)
    trans = np.array(table)
    accepts = np.array([sum(1 << ends[s] for s in state if s in ends) for state in order], np.int64)
    # minimisation by refining the partition until it is stable
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        signatures = np.column_stack([part, part[trans]])
        refined = np.unique(signatures, axis=0, return_inverse=True)[1].reshape(-1)
        if refined.max() == part.max():
            break
        part = refined
    n = int(part.max()) + 1
    one = np.zeros(n, np.int64)
    one[part[::-1]] = np.arange(len(part))[::-1]
    renumber = np.concatenate([[part[0]], [p for p in range(n) if p != part[0]]])
    place = np.empty(n, np.int64)
    place[renumber] = np.arange(n)
    rows = one[renumber]
    compact = place[part[trans[rows]]]
    acc = accepts[rows]
    dead = [s for s in range(n) if acc[s] == 0 and (compact[s] == s).all()]
    return Dfa(compact[:, column].astype(np.int32), acc, dead[0] if dead else -1)
