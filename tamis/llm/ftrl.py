"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each hashed into 2**bits coordinates and counted once: words, pairs of neighbours,
pairs with one word skipped, beginnings of words (inflected or composed forms share them), and whether a
beginning comes twice, four or eight times.  Per-coordinate rates and the L1 term leave a short list of
weights, which is broadcast; its size is bounded by 2**bits.

Training runs in one task on a bounded sample of labelled rows (`max_rows`, half of them at most from the rarer label),
chosen by the hash of the id; the intercept is moved from the sample's share of label 1 to the share among
all labelled rows.  Null and empty texts get the intercept's score.  Without both labels nothing can be
learned and every score is the share of label 1 (0 without labels).  Rows with a null label or null id are
not learned from; a null id is scored and returned as null.  Repeated label rows of one id count once, with
the higher label.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_sample
from tamis.llm.words import Texts, chunks, mix, texts_of, words_of

HEADS = (4, 5, 6)


@dataclass
class Model:
    bits: int
    bias: float = 0.0
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def _coordinates(texts: Texts, bits: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate), each pair once. With weights only the coordinates that have one."""
    words = words_of(texts, alnum=True, heads_of=HEADS)
    shift = np.uint64(64 - bits)
    docs, coords = [], []

    def add(doc: np.ndarray, h: np.ndarray) -> None:
        c = (h >> shift).astype(np.int64)
        if weights is not None:
            keep = weights[c] != 0
            doc, c = doc[keep], c[keep]
        docs.append(doc)
        coords.append(c)

    h, doc = words.hash, words.doc
    with np.errstate(over="ignore"):
        add(doc, h)
        for gap in (1, 2):
            same = doc[:-gap] == doc[gap:]
            add(doc[:-gap][same], mix(h[:-gap][same] * np.uint64(3) + h[gap:][same] + np.uint64(gap)))
        for heads in words.heads:
            own = np.flatnonzero(heads)
            add(doc[own], heads[own])
            # how often a beginning comes in its document: sorted by (document, hash), the k-th of a run stands k places on
            key = mix(heads[own] + doc[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            sk = key[order]
            for times in (2, 4, 8):
                if len(sk) >= times:
                    hit = np.flatnonzero(sk[times - 1 :] == sk[: len(sk) - times + 1])
                    at = own[order[hit]]
                    add(doc[at], mix(heads[at] ^ np.uint64(times * 0x1F3D5B79)))
    pairs = np.unique(np.concatenate(docs) << bits | np.concatenate(coords))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def train(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 4) -> Model:
    """FTRL-proximal (per-coordinate rates alpha / (beta + sqrt(sum g^2)), L1 and L2), rows in a fixed shuffled order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = bias_n = 0.0
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, y = rows[i]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + root) / alpha + l2))
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - y
            now = nx + g * g
            z[x] = zx + g - (np.sqrt(now) - root) / alpha * w
            n[x] = now
            bias_n += g * g
            bias -= alpha / (beta + math.sqrt(bias_n)) * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    index = np.flatnonzero(w)
    return Model(bits, bias, index, w[index])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, max_rows: int = 6000, bits: int = 20) -> Model:
    """where: a condition on the column `doc_id` that a labelled row must meet to be learned from."""
    rows = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if where is not None:
        rows = rows.filter(where)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    zero, one = counts.get(0, 0), counts.get(1, 0)
    if not zero or not one:
        return Model(bits, 40.0 if one else -40.0)
    quota = {1: min(one, max(max_rows // 2, max_rows - zero)), 0: 0}
    quota[1] = min(quota[1], max_rows // 3) if zero > max_rows else quota[1]
    quota[0] = min(zero, max_rows - quota[1])
    chosen = bounded_sample(rows.filter("y = 1"), F.col("doc_id"), quota[1]).unionByName(bounded_sample(rows.filter("y = 0"), F.col("doc_id"), quota[0]))
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").select("text", "y")  # at most max_rows rows of two integers

    def body(batches):
        for batch in batches:
            whole, y = texts_of(batch.column(0)), batch.column(1)
            for a, b, part in chunks(whole):
                doc, coord = _coordinates(part, bits)
                cut = np.searchsorted(doc, np.arange(part.n + 1))
                yield pa.RecordBatch.from_arrays([y.slice(a, b - a).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(coord, pa.int32()))], ["y", "x"])

    shift = math.log(one / zero)

    def learn(batches):
        """All rows of the sample in one task: only the weights leave it."""
        sample = []
        for batch in batches:
            x = batch.column("x")
            off, flat = x.offsets.to_numpy(), x.values.to_numpy()
            sample += [(flat[s:e].copy(), y) for s, e, y in zip(off[:-1], off[1:], batch.column("y").to_pylist(), strict=True)]
        sample.sort(key=lambda r: (r[1], len(r[0]), r[0][:8].tolist()))  # the order of arrival does not matter
        if len({y for _, y in sample}) == 2:
            model = train(sample, bits)
            ones = sum(y for _, y in sample)
            bias = model.bias + shift - math.log(ones / (len(sample) - ones))
            yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([model.index.astype(np.int64).tobytes()]), pa.array([model.weight.astype(np.float64).tobytes()])], ["bias", "index", "weight"])

    got = texts.mapInArrow(body, "y int, x array<int>").repartition(1).mapInArrow(learn, "bias double, index binary, weight binary").first()
    if got is None:
        return Model(bits, -40.0)
    return Model(bits, got["bias"], np.frombuffer(got["index"], np.int64), np.frombuffer(got["weight"], np.float64))


def _probability(own: Model, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    logits = [np.zeros(0)]
    for _, _, part in chunks(texts_of(column)):
        doc, coord = _coordinates(part, own.bits, weights)
        logits.append(own.bias + np.bincount(doc, weights[coord], part.n)[: part.n])
    return 1 / (1 + np.exp(-np.clip(np.concatenate(logits), -35, 35)))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def body(batches):
        own = shared.value
        weights = own.dense()
        for batch in batches:
            yield batch.filter(pa.array(_probability(own, weights, batch.column(at)) < threshold))

    return docs.mapInArrow(body, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def body(batches):
        own = shared.value
        weights = own.dense()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_probability(own, weights, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(body, "doc_id bigint, score double")
