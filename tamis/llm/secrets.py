"""Secret scan by one combined deterministic automaton.

All rule regexes are compiled together by subset construction and minimised into a transition array.
One pass over the bytes of a text drives it; entering an accepting state leaves the fast loop and notes
(rule, end).  Exact spans follow from two small automata per rule: the reversed rule, run backwards from
the noted end, gives the leftmost start, and the rule itself, run forwards, the longest end.

Matches are leftmost and do not overlap within a kind; those that fail a rule's length test are dropped
but still consume their text.  Null and empty texts have no spans; the empty table gives an empty result.
Extra columns are ignored, repeated rows are scanned like any other row, a null id is returned as null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.llm.automaton import Dfa, compile_dfa, parse, reversed_tree


@dataclass(frozen=True)
class Rule:
    """pattern: what matches. head: the part before the value, for rules whose value has a length of its own.
    least: characters of the value (of the match, without head) below which a match is dropped."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 0


_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _HEAD + r"[A-Za-z0-9+/_.=-]+", _HEAD, 6),
    Rule("access", r"AKIA[A-Z0-9]+", "", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_", 30),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_.-]+", "", 40),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", r"[rs]k_live_", 16),
    Rule("login", r"://[^\x00-\x20@/:]+:[^\x00-\x20@/:]+@"),
)


class Scanner:
    """The compiled rules. `find` returns spans (start, kind index, end) in bytes, in order."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.scan = compile_dfa(trees, anchored=False)
        self.forward = [compile_dfa([t], anchored=True) for t in trees]
        self.backward = [compile_dfa([reversed_tree(t)], anchored=True) for t in trees]
        self.heads = [compile_dfa([parse(r.head)], anchored=True) if r.head else None for r in rules]
        self._rows: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def rows(self) -> tuple[bytes, list]:
        """Byte to class, and a list per state: by class the next state's list, or None where that accepts; last its number."""
        if self._rows is None:
            columns, kind = np.unique(self.scan.next, axis=1, return_inverse=True)
            rows: list[list] = [[] for _ in range(len(columns))]
            for s, to in enumerate(columns.tolist()):
                rows[s].extend(None if self.scan.accepts[t] else rows[t] for t in to)
                rows[s].append(s)
            self._rows = kind.reshape(-1).astype(np.uint8).tobytes(), rows, columns
        return self._rows

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, bits of the rules that accept there), for all ends, in one pass."""
        kind, rows, columns = self.rows()
        accepts, found, row, todo = self.scan.accepts, [], rows[0], iter(data.translate(kind))
        while True:
            for c in todo:
                before, row = row, row[c]
                if row is None:
                    break
            else:
                return found
            state = int(columns[before[-1], c])
            found.append((len(data) - todo.__length_hint__(), int(accepts[state])))
            row = rows[state]

    @staticmethod
    def _run(dfa: Dfa, data: bytes, at: int, stop: int, step: int) -> int:
        """Furthest accepting position from `at` towards `stop`, or -1."""
        s, best, table, accepts = 0, -1, dfa.next, dfa.accepts
        while at != stop:
            s = table[s, data[at] if step > 0 else data[at - 1]]
            if s == dfa.dead:
                break
            at += step
            if accepts[s]:
                best = at
        return best

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        spans, until = [], [0] * len(self.rules)
        for end, bits in self.ends(data):
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and end > until[k]:
                    start = self._run(self.backward[k], data, end, until[k], -1)
                    if start < 0:
                        continue
                    until[k] = stop = max(end, self._run(self.forward[k], data, start, len(data), 1))
                    value = start if self.heads[k] is None else self._run(self.heads[k], data, start, stop, 1)
                    if stop - value >= rule.least:
                        spans.append((start, k, stop))
        return sorted(spans)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    tail = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)])
    return [(int(s - tail[s]), k, int(e - tail[e])) for s, k, e in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(id, kinds array, starts array, ends array) of every secret, in code points, ordered by start and rule."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    kinds = [r.kind for r in rules]

    def body(batches):
        own = scanner.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                out.append(code_points(data, own.find(data)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([[kinds[k] for _, k, _ in x] for x in out], pa.list_(pa.string())),
                    pa.array([[s for s, _, _ in x] for x in out], pa.list_(pa.int64())),
                    pa.array([[e for _, _, e in x] for x in out], pa.list_(pa.int64())),
                ],
                ["doc_id", "kinds", "starts", "ends"],
            )

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        body, "doc_id bigint, kinds array<string>, starts array<bigint>, ends array<bigint>"
    )


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
