"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate; Viterbi
decoding gives the best sequence, and the share of words in content lines decides whether the document is
kept.  Lines without a word take no part.  The features are properties of a line's bytes and words (symbols,
capitals, repeated words, repeated lines, length, closing mark); no list of words is used.

The field is trained in numpy by gradient ascent on the log-likelihood.  No line labels exist, so lines take
the quality label of their document; the bounded sample (`max_rows` labelled documents, chosen by the hash of
the id) teaches the weights, and the chain carries the verdict over single lines that look the other way.
Without both labels in the sample a fixed set of weights is used (`Field.prior`).

Base figures of each document: word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
equal to an earlier line), n_repeat_words (words in 8-word windows that come twice or more).  `base_failed`:
under 20 words, or over 30 % of the words repeated.  Null and empty texts have zero figures and fail.  A null
id is returned as null, repeated rows are judged one by one, extra columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_sample
from tamis.llm.words import Texts, chunks, repeats, span_hashes, sums, texts_of, windows, words_of

WINDOW = 8
MIN_WORDS = 20
FEATURES = 16

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, np.int8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_DIGIT = np.zeros(256, np.int8)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, np.int8)
_MARK[[ord(c) for c in "!?"]] = 1
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in ".!?:;\"')"]] = True


@dataclass
class Lines:
    """Per document the base figures; per line with a word its document, words and features."""

    base: dict[str, np.ndarray]
    doc: np.ndarray
    words: np.ndarray
    x: np.ndarray


def lines_of(texts: Texts) -> Lines:
    buf, off = texts.buf, texts.off
    w = words_of(texts, lower=False)
    n = len(w.hash)
    # lines: from each document's start or the byte after a line feed, up to the next of these
    feeds = np.flatnonzero(buf == 10)
    start = np.union1d(off[:-1][np.diff(off) > 0], feeds + 1)
    start = start[start < len(buf)]
    end = np.append(start[1:], len(buf))
    first = np.searchsorted(w.start, start)
    count = np.diff(np.append(first, n))
    has = count > 0
    start, end, first, count = start[has], end[has], first[has], count[has]
    doc = np.searchsorted(off, start, "right") - 1
    body = end - (buf[end - 1] == 10)
    _, dup = repeats(doc, span_hashes(buf, start, body))
    # words of repeated windows
    at, h = windows(w, WINDOW)
    again, before = repeats(w.doc[at], h)
    hit = at[again | before]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.subtract.at(cover, hit + WINDOW, 1)
    covered = np.cumsum(cover)[:n] > 0
    edges = np.append(off[:-1], len(buf))
    point = (buf & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(point)])
    length = chars[w.end] - chars[w.start]
    base = {
        "n_words": w.counts,
        "word_chars": sums(length, w.first),
        "n_symbols": sums(_SYMBOL[buf], edges),
        "n_dup_lines": np.bincount(doc[dup], minlength=texts.n),
        "n_repeat_words": sums(covered, w.first),
    }
    total = np.concatenate([[0], np.cumsum(count)])
    off_w = np.append(first, n)
    twice = np.zeros(n, bool)
    twice[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    size = np.maximum(body - start, 1)
    span = np.append(start, len(buf))
    share = lambda kind: sums(kind[buf], span) / size
    symbols, upper, digits, marks = share(_SYMBOL), share(_UPPER), share(_DIGIT), sums(_MARK[buf], span) / count
    adjacent, again8 = sums(twice, off_w) / count, sums(covered, off_w) / count
    lone = sums(length <= 1, off_w) / count
    close = _CLOSE[buf[w.end[off_w[1:] - 1] - 1]]
    x = np.column_stack(
        [
            np.ones(len(start)), symbols > 0, symbols > 0.03, symbols > 0.1, upper > 0.3, marks > 0.3, adjacent > 0.05, adjacent > 0.3,
            dup, again8 > 0.3, digits > 0.15, count < 4, count >= 12, ~close, lone > 0.25, share(_LETTER) < 0.6,
        ]
    ).astype(np.float64)
    assert x.shape[1] == FEATURES and total[-1] == n
    return Lines(base, doc, count, x)


class Field:
    """Two labels: 0 boilerplate, 1 content. Score of a sequence: w.x for each content line, plus moves between labels."""

    def __init__(self, w: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.w, self.move, self.begin = w, move, begin

    @staticmethod
    def prior() -> Field:
        w = np.array([2.5, -0.2, -2, -2, -3, -2, -2, -2, -1, -2, -0.5, -0.3, 0.3, -0.2, -1, -1.5])
        return Field(w, np.array([[0.5, -0.5], [-0.5, 0.5]]), np.array([0.0, 0.5]))

    @staticmethod
    def _steps(lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sequences by falling length; for each step the sequences (of that order) that still have a line there."""
        order = np.argsort(-lengths, kind="stable")
        alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        return order, alive.tolist()

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi over all sequences at once; x holds their lines one after the other."""
        start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        order, alive = self._steps(lengths)
        unary = x @ self.w
        back = np.zeros((len(x), 2), np.int8)
        path = np.zeros(len(x), np.int8)
        if not alive:
            return path
        start = start[order]
        v = np.tile(self.begin, (len(order), 1))
        for t, k in enumerate(alive):
            at = start[:k] + t
            if t:
                options = v[:k, :, None] + self.move
                back[at] = options.argmax(1)
                v[:k] = options.max(1)
            v[:k, 1] += unary[at]
        state = v.argmax(1).astype(np.int8)
        for t in range(len(alive) - 1, -1, -1):
            k = alive[t]
            at = start[:k] + t
            path[at] = state[:k]
            state[:k] = back[at, state[:k]]
        return path

    def _likelihood(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray):
        """Gradient of the log-likelihood, by forward and backward sums."""
        start = (np.concatenate([[0], np.cumsum(lengths)])[:-1])
        order, alive = self._steps(lengths)
        start = start[order]
        unary = x @ self.w
        a, b = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t, k in enumerate(alive):
            at = start[:k] + t
            a[at] = self.begin if t == 0 else np.logaddexp.reduce(a[at - 1][:, :, None] + self.move, axis=1)
            a[at, 1] += unary[at]
        for t in range(len(alive) - 2, -1, -1):
            k = alive[t + 1]
            at = start[:k] + t
            after = b[at + 1].copy()
            after[:, 1] += unary[at + 1]
            b[at] = np.logaddexp.reduce(self.move[None] + after[:, None, :], axis=2)
        last = start + lengths[order] - 1
        z = np.empty(len(order))
        z[:] = np.logaddexp(a[last, 0], a[last, 1])
        zline = np.repeat(z[np.argsort(order)], lengths)
        p = np.exp(a[:, 1] + b[:, 1] - zline)
        gw = x.T @ (y - p)
        inner = np.ones(len(x), bool)
        inner[np.concatenate([[0], np.cumsum(lengths)])[:-1]] = False
        i = np.flatnonzero(inner)
        after = b[i].copy()
        after[:, 1] += unary[i]
        pair = np.exp(a[i - 1][:, :, None] + self.move + after[:, None, :] - zline[i][:, None, None])
        gm = -pair.sum(0)
        np.add.at(gm, (y[i - 1], y[i]), 1)
        head = np.flatnonzero(~inner)
        gb = np.array([np.sum(y[head] == 0) - np.sum(1 - p[head]), np.sum(y[head]) - np.sum(p[head])])
        return gw, gm, gb

    @staticmethod
    def train(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, l2: float = 1.0) -> Field:
        """Adam on the mean log-likelihood with an L2 term; sequences without a line must not be passed."""
        theta = np.zeros(FEATURES + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        n = max(len(x), 1)
        for step in range(1, rounds + 1):
            field = Field(theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :])
            gw, gm, gb = field._likelihood(x, lengths, y)
            g = (np.concatenate([gw, gm.reshape(-1), gb]) - l2 * theta) / n
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return Field(theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000) -> Field:
    """Learn from at most max_rows labelled documents (a documented bound; everything else covers all rows)."""
    rows = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    half = max_rows // 2
    chosen = bounded_sample(rows.filter("y = 1"), F.col("doc_id"), half).unionByName(bounded_sample(rows.filter("y = 0"), F.col("doc_id"), half))
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "doc_id")

    def body(batches):
        for batch in batches:
            y = batch.column(1).to_pylist()
            for a, _, part in chunks(texts_of(batch.column(0))):
                got = lines_of(part)
                cut = np.searchsorted(got.doc, np.arange(part.n + 1))
                bits = (got.x.astype(np.int64) << np.arange(FEATURES)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(y[a : a + part.n], pa.int32()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bits, pa.int32()))], ["y", "lines"])

    sample = texts.select("text", "y").mapInArrow(body, "y int, lines array<int>").collect()
    sample = sorted((r["y"], tuple(r["lines"])) for r in sample if r["lines"])
    if len({y for y, _ in sample}) < 2:
        return Field.prior()
    lengths = np.array([len(x) for _, x in sample])
    bits = np.concatenate([np.array(x) for _, x in sample])
    x = (bits[:, None] >> np.arange(FEATURES) & 1).astype(np.float64)
    return Field.train(x, lengths, np.repeat(np.array([y for y, _ in sample]), lengths))


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Base figures, content share and verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def body(batches):
        own = shared.value
        for batch in batches:
            for a, b, part in chunks(texts_of(batch.column(1))):
                got = lines_of(part)
                lengths = np.bincount(got.doc, minlength=part.n)
                label = own.decode(got.x, lengths)
                content = np.bincount(got.doc, got.words * label, part.n)[: part.n]
                words = got.base["n_words"]
                share = content / np.maximum(words, 1)
                failed = (words < MIN_WORDS) | (100 * got.base["n_repeat_words"] > 30 * words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(got.base[k], pa.int64()) for k in names), pa.array(failed), pa.array(~failed & (share >= least)), pa.array(share), pa.array(lengths - np.bincount(got.doc, label, part.n)[: part.n].astype(np.int64), pa.int64())],
                    ["doc_id", *names, "base_failed", "kept", "content_share", "n_boilerplate_lines"],
                )

    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in names) + ", base_failed boolean, kept boolean, content_share double, n_boilerplate_lines bigint"
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(body, schema)
