"""Language identification by prediction by partial matching.

Per language a byte context tree of variable order (up to `order`) with escape probabilities (method C: a context
that was seen T times before D different bytes escapes with D / (T + D)).  The bytes that a context has seen are
excluded when it escapes, so each context's distribution over the 256 bytes sums to 1; below order 0 all bytes are
equally likely.  The statistics are frozen after training; a text's code length under a language is then exact,
and the language with the shortest code wins.  Contexts and symbols are the bytes as they are.

With exclusion, an unseen byte costs its context one fixed factor, escape / (1 - what the parent gives the seen
bytes), times the parent's probability.  So a tree is stored sparsely: a row for each (context, byte) that some
language saw, a factor for each context, and a mask of the bytes seen, by which a row is found in constant time.
Languages are kept in tables of at most GROUP of them, so the model grows in proportion to the languages.

Null texts and texts without a letter give `und` and score 0.  Training reads at most `max_rows` distinct whole
texts and `max_bytes` bytes of each language (see `sampled_texts`); contexts are counted where the texts lie and
only the counts come to the driver.  Rows with null language or text are not learned from.  Without any training
row everything is `und`.  The score is the posterior of the winner with equal priors.  Ties go to the first
language by name.  Very long texts are scored in pieces of PIECE bytes, each with the context before it, so memory
does not grow with a text's length.  Repeated rows are predicted one by one; extra columns are ignored; a null id
is returned as null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import sampled_texts
from tamis.llm.words import Texts, texts_of

START = 32  # the context before the first byte
GROUP = 16
PIECE = 1_000_000


def grams_of(texts: Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the last `order` bytes and the byte itself, count) over all positions of the texts."""
    out = []
    for i in range(texts.n):
        x = np.concatenate([np.full(order, START, np.uint8), texts.buf[texts.off[i] : texts.off[i + 1]]]).astype(np.int64)
        g = np.zeros(len(x) - order, np.int64)
        for k in range(order + 1):
            g = g << 8 | x[k : k + len(g)]
        out.append(g)
    return np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, np.int64),) * 2


class Level:
    """Contexts of one length: their numbers, what escaping from each costs, and rows of log-probabilities."""

    def __init__(self, contexts, masks, bases, escapes, logp):
        self.contexts, self.masks, self.bases, self.escapes, self.logp = contexts, masks, bases, escapes, logp


class Table:
    """Context trees of a few languages. counts: for each language (gram numbers, counts)."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], order: int):
        self.order, n_langs = order, len(counts)
        self.levels: list[Level] = []
        below_pairs, below = np.zeros(0, np.int64), np.zeros((0, n_langs))
        for k in range(order + 1):
            own = []
            for grams, n in counts:
                pair, inverse = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
                own.append((pair, np.bincount(inverse, n, len(pair))))
            pairs = np.unique(np.concatenate([p for p, _ in own]))
            seen = np.zeros((len(pairs), n_langs))
            for j, (pair, n) in enumerate(own):
                seen[np.searchsorted(pairs, pair), j] = n
            contexts, row = np.unique(pairs >> 8, return_inverse=True)
            parent = np.full((len(pairs), n_langs), 1 / 256)
            if k:
                parent = below[np.searchsorted(below_pairs, pairs & ((1 << 8 * k) - 1))]
            p, escapes = np.empty_like(seen), np.empty((len(contexts), n_langs))
            for j in range(n_langs):
                total = np.bincount(row, seen[:, j], len(contexts))
                kinds = np.bincount(row, seen[:, j] > 0, len(contexts))
                left = 1 - np.bincount(row, np.where(seen[:, j] > 0, parent[:, j], 0), len(contexts))
                whole = left < 1e-12  # nothing is left to escape to
                escape = np.where(total > 0, np.where(whole, 0, kinds / np.maximum(total + kinds, 1)), 1.0)
                factor = escape / np.where(whole, 1, left)
                escapes[:, j] = factor
                p[:, j] = np.where(seen[:, j] > 0, seen[:, j] / np.maximum(total, 1)[row] * (1 - escape)[row], factor[row] * parent[:, j])
            byte = pairs & 255
            masks = np.zeros((len(contexts), 4), np.uint64)
            np.bitwise_or.at(masks, (row, byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
            fill = np.bitwise_count(masks).astype(np.int64).reshape(-1)
            bases = (np.cumsum(fill) - fill).astype(np.int32)
            with np.errstate(divide="ignore"):
                self.levels.append(Level(contexts, masks.reshape(-1), bases, np.log(escapes).astype(np.float32), np.log(p).astype(np.float32)))
            below_pairs, below = pairs, p
        used = np.zeros(256, bool)
        for k in range(1, order + 1):
            for j in range(k):
                used[self.levels[k].contexts >> 8 * j & 255] = True
        self.width = int(used.sum()) + 1
        self.symbols = np.full(256, self.width - 1, np.int32)  # bytes that end no context share one number
        self.symbols[used] = np.arange(self.width - 1, dtype=np.int32)
        self._places: list[np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def places(self) -> list[np.ndarray]:
        """For each length the row of a context by the number of its symbols; made once in each worker."""
        if self._places is None:
            self._places = []
            for k, level in enumerate(self.levels):
                place = np.full(self.width**k, -1, np.int32)
                number = np.zeros(len(level.contexts), np.int64)
                for j in range(k):
                    number = number * self.width + self.symbols[level.contexts >> 8 * (k - 1 - j) & 255]
                place[number] = np.arange(len(number), dtype=np.int32)
                self._places.append(place)
        return self._places

    def score(self, buf: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Log-probability of every byte under every language; before[k]: the symbol k + 1 bytes back."""
        out = np.zeros((len(buf), self.levels[0].logp.shape[1]), np.float32)
        todo = np.arange(len(buf))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            number = np.zeros(len(todo), np.int32 if self.width**k < 2**31 else np.int64)
            for j in range(k - 1, -1, -1):
                number = number * self.width + before[j][todo]
            row = self.places()[k][number]
            known = row >= 0
            at, r, x = todo[known], row[known].astype(np.int64), buf[todo[known]].astype(np.int64)
            cell = r * 4 + (x >> 6)
            mask, bit = level.masks[cell], (x & 63).astype(np.uint64)
            hit = (mask >> bit & np.uint64(1)).astype(bool)
            here = cell[hit]
            index = level.bases[here] + np.bitwise_count(mask[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[at[hit]] += level.logp[index]
            miss = at[~hit]
            out[miss] += level.escapes[r[~hit]]
            todo = np.concatenate([todo[~known], miss])
            if not len(todo):
                return out
        out[todo] += np.float32(-np.log(256))
        return out


class Model:
    """Languages by name, and their context trees in tables of GROUP."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = 3):
        self.langs, self.order = sorted(counts), order
        self.tables = [Table([counts[x] for x in self.langs[i : i + GROUP]], order) for i in range(0, len(self.langs), GROUP)]

    def code(self, texts: Texts) -> np.ndarray:
        """Log-likelihood of every text (rows) under every language (columns)."""
        out = np.zeros((texts.n, len(self.langs)))
        for a in range(0, len(texts.buf), PIECE):
            b = min(a + PIECE, len(texts.buf))
            first = int(np.searchsorted(texts.off, a, "right")) - 1
            last = int(np.searchsorted(texts.off, b, "left"))
            edges = np.clip(texts.off[first : last + 1], a, b)
            own = first + np.flatnonzero(np.diff(edges))
            heads = edges[:-1][np.diff(edges) > 0] - a
            start = np.repeat(texts.off[own], np.diff(edges)[np.diff(edges) > 0])
            place = np.arange(a, b)
            back = [np.where(place - k >= start, texts.buf[np.maximum(place - k, 0)], START) for k in range(1, self.order + 1)]
            for i, table in enumerate(self.tables):
                per = table.score(texts.buf[a:b], [table.symbols[x] for x in back])
                out[own, i * GROUP : i * GROUP + per.shape[1]] += np.add.reduceat(per, heads, axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, max_rows: int = 300, max_bytes: int = 1_000_000, order: int = 3) -> Model | None:
    """where: condition for a row to be learned from. Two passes over the rows, however many languages there are."""
    rows = (docs.filter(where) if where is not None else docs).select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.filter("lang is not null and text is not null and length(text) > 0")

    def body(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                grams, n = grams_of(texts_of(batch.column(1).filter(pa.array(langs == lang))), order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    sample = sampled_texts(rows, max_rows, max_bytes, ["lang"]).select("lang", "text").repartition("lang")  # max_bytes of a language in a task
    counted = sample.mapInArrow(body, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by max_bytes for each language
    langs = np.array(counted.column("lang").to_pylist(), object)
    gram, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    counts = {}
    for lang in set(langs.tolist()):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(gram[own])]
        counts[lang] = (gram[own], n[own])
    return Model(counts, order) if counts else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def body(batches):
        own = shared.value
        for batch in batches:
            text = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(text)
            names, score = np.full(n, "und", object), np.zeros(n)
            if own is not None:
                ll = own.code(texts_of(text))
                posterior = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
                names[letters] = np.array(own.langs, object)[ll.argmax(1)[letters]]
                score[letters] = posterior[letters]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(body, "doc_id bigint, lang_pred string, score double")
