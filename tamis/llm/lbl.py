"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Tokens are lower-cased words and one end for each text.  The modelled vocabulary grows with the corpus: its most
frequent words, those above a count, up to the root of the corpus size in number (`vocabulary_size`).  They are dealt into classes of like
frequency; the end is a class of its own, and all other words fall into REST classes by the ending of the word.
With the two tokens before, c1 and c2 (ends before the first word), and q = A_c1 + B_c2, the model is
P(class) = softmax(R . q + b) over all classes times, in a class of words, P(word | class) = softmax(S . q + d) over
the words of the class; a word w of a rest class has (c(w) + 1) / (N_class + V_class + 1) instead.  So the
distribution over words, with one share for those never seen in each rest class, sums to 1, and normalising costs
about twice the root of the vocabulary.  Scoring works in batched matrix products over distinct contexts, and over
the tokens of each class.

Corpus counts c(w), N, V cover every training text: blocks of documents send their distinct words with counts
to buckets by hash, and get back the totals of their own words, so no vocabulary is ever gathered in one
place.  Word identity is a 59-bit hash.  Training: a warm start on a bounded sample (`warm_docs` distinct texts and
`warm_bytes` bytes, chosen by hash), then one pass over all training texts, each partition on its own, and the
weighted mean of their parameters (summed in levels).  Noise comes from the unigrams of the whole corpus: over
classes, shared by a batch, and over the words of the target's class.

Null texts are empty and have one token, the end.  Without training texts all counts are 0 and the model is
uniform over classes.  Repeated rows count and are scored one by one; a null id is not held out; ties in frequency go
by hash.  Texts are handled whole: a task holds a block of about BLOCK_BYTES, or one longer text, at some twenty
times its size.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import glob
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import checkpointed, partitions_for, runs, sampled_texts
from tamis.llm.words import LOWER, Texts, chunks, mix, split, texts_from, texts_of, trim, words_of

REST = 32
LEVELS = 32
DIM = 24
NOISE = 32
NOISE_IN_CLASS = 2
MAX_VOCABULARY = 65_000  # of the broadcast model: 19 MB of parameters; numbers fit in 16 bits
BATCH = 2048
SCALE = 0.25  # of the summed gradient of a batch
RATES = (0.15, 0.08)  # of the warm start, of the pass over all texts
BLOCK_BYTES = 3_000_000
END = np.uint64(0xE14D3A5C77B20FC0)  # its last five bits are 0


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, offsets by document); a word's last five bits are its rest class, an end closes each text."""
    w = words_of(texts)
    end = w.end - 1
    last, before = LOWER[texts.buf[end]], LOWER[texts.buf[np.maximum(end - 1, w.start)]]
    tail = last.astype(np.uint64) << np.uint64(8) | before.astype(np.uint64)
    h = w.hash & ~np.uint64(REST - 1) | mix(tail) % np.uint64(REST)
    off = w.first + np.arange(texts.n + 1)
    out = np.full(int(off[-1]), END, np.uint64)
    out[np.arange(len(h)) + w.doc] = h
    return out, off


def one_thread() -> None:
    """Matrix products of a task on its own core: more threads would only wait for one another."""
    for path in glob.glob(f"{Path(np.__file__).parent.parent}/numpy.libs/*openblas*"):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def vocabulary_size(n_bytes: int) -> int:
    """Words that get parameters of their own: about the root of half the number of tokens."""
    return min(MAX_VOCABULARY, max(512, math.isqrt(n_bytes // 12)))


def _sum_exp(logits: np.ndarray) -> np.ndarray:
    """Logarithm of the row sums of exp."""
    high = float(logits.max())
    if abs(high) < 40:
        total = np.exp(logits).sum(1)
        if total.min() > 1e-30:
            return np.log(total)
    top = logits.max(1)
    return top + np.log(np.exp(logits - top[:, None]).sum(1))


def _one_more(q: np.ndarray) -> np.ndarray:
    """q with a last column of ones, which meets the bias."""
    return np.concatenate([q, np.ones((len(q), 1), q.dtype)], axis=1)


class Model:
    """words: hashes of the vocabulary, the words of a class together; theta: A, B, R with b and S with d as last columns."""

    def __init__(self, words: np.ndarray, freq: np.ndarray, ends: int, rest_n: np.ndarray, rest_v: np.ndarray, tokens: int, distinct: int):
        self.rest_n, self.rest_v, self.tokens, self.distinct = rest_n, rest_v, tokens, distinct
        order = np.lexsort((words, -freq))
        root = np.sqrt(freq[order])
        self.n_classes = math.isqrt(len(words)) if len(words) else 0
        cls = np.minimum(((np.cumsum(root) - root) / max(root.sum(), 1e-9) * self.n_classes).astype(np.int64), self.n_classes - 1) if len(words) else np.zeros(0, np.int64)
        cls = np.unique(cls, return_inverse=True)[1] if len(words) else cls
        self.n_classes = int(cls.max()) + 1 if len(words) else 0
        self.words, self.cls, freq = words[order], cls, freq[order]
        self.start = np.searchsorted(cls, np.arange(self.n_classes + 1))
        self.by_hash = np.argsort(self.words)
        self.sorted = self.words[self.by_hash]
        in_class = np.bincount(cls, freq, self.n_classes)
        self.share = freq / in_class[cls] if len(words) else freq
        every = np.concatenate([in_class, [ends], rest_n]) + 1.0
        self.noise = every / every.sum()
        # noise within classes: class k lies between k and k + 1
        upto = np.cumsum(self.share)
        self.within = self.cls + (upto - np.concatenate([[0], upto])[self.start[:-1]][cls]) if len(words) else upto
        rng = np.random.default_rng(3)
        v, k = len(words) + 1 + REST, len(self.noise)
        draw = lambda n: (rng.standard_normal((n, DIM)) * 0.1).astype(np.float32)
        biased = lambda x, share: np.concatenate([x, np.log(np.maximum(share, 1e-12)).astype(np.float32)[:, None]], axis=1)
        self.theta = [draw(v), draw(v), biased(draw(k), self.noise), biased(draw(len(words)) * 0, self.share)]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of every token: 0.. words of the vocabulary, then the end, then the rest classes."""
        k = len(self.words)
        out = (k + 1 + (h & np.uint64(REST - 1))).astype(np.int64)
        if k:
            at = np.minimum(np.searchsorted(self.sorted, h), k - 1)
            hit = self.sorted[at] == h
            out[hit] = self.by_hash[at[hit]]
        out[h == END] = k
        return out

    def classes(self, number: np.ndarray) -> np.ndarray:
        k = len(self.words)
        out = number - k + self.n_classes
        known = number < k
        out[known] = self.cls[number[known]]
        return out

    def contexts(self, number: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers one and two tokens before; the end stands before a text."""
        end = len(self.words)
        one, two = np.empty_like(number), np.empty_like(number)
        one[1:], two[2:] = number[:-1], number[:-2]
        heads = off[:-1]
        one[heads] = end
        two[heads] = end
        second = heads[np.diff(off) > 1] + 1
        two[second] = end
        return one, two

    def logp(self, h: np.ndarray, off: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Natural log-probability of every token; count: its corpus count."""
        a, b, r, s = self.theta
        number = self.numbers(h)
        cls = self.classes(number)
        one, two = self.contexts(number, off)
        key, inverse = np.unique(one * len(a) + two, return_inverse=True)
        q = _one_more(a[key // len(a)] + b[key % len(a)])
        z = np.empty(len(key), np.float32)
        for i in range(0, len(key), 4096):
            z[i : i + 4096] = _sum_exp(q[i : i + 4096] @ r.T)
        out = np.empty(len(h))
        for i in range(0, len(h), 1 << 16):
            at = slice(i, i + (1 << 16))
            out[at] = np.einsum("ij,ij->i", q[inverse[at]], r[cls[at]]) - z[inverse[at]]
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.n_classes + 1))
        for k in range(self.n_classes):
            lo, hi = self.start[k], self.start[k + 1]
            if hi - lo < 2:
                continue
            for i in range(bounds[k], bounds[k + 1], 4096):
                at = order[i : min(i + 4096, bounds[k + 1])]
                logits = q[inverse[at]] @ s[lo:hi].T
                out[at] += logits[np.arange(len(at)), number[at] - lo] - _sum_exp(logits)
        rest = cls - self.n_classes - 1
        own = rest >= 0
        out[own] += np.log((count[own] + 1.0) / (self.rest_n[rest[own]] + self.rest_v[rest[own]] + 1.0))
        return out


class Trainer:
    """Noise-contrastive estimation by Adagrad over minibatches; the class noise of a batch is shared by its tokens."""

    def __init__(self, model: Model, rate: float, seed: int):
        self.m, self.rate = model, rate
        self.theta = [x.copy() for x in model.theta]
        self.seen = [np.full_like(x, 0.1) for x in self.theta]
        self.rng = np.random.default_rng(seed)
        self.cut = np.cumsum(model.noise)
        self.log_noise = np.log(NOISE * np.maximum(model.noise, 1e-12)).astype(np.float32)
        self.log_within = np.log(NOISE_IN_CLASS * np.maximum(model.share, 1e-12)).astype(np.float32)
        self.alone = np.diff(model.start) < 2
        self.tokens = 0

    def learn(self, h: np.ndarray, off: np.ndarray) -> None:
        number = self.m.numbers(h)
        cls = self.m.classes(number)
        one, two = self.m.contexts(number, off)
        order = self.rng.permutation(len(number))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            self._step(number[at], cls[at], one[at], two[at])
        self.tokens += len(number)

    def _add(self, k: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """One Adagrad step on the rows that occur."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
        sorted_rows = rows[order]
        heads = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        at = sorted_rows[heads]
        g = np.add.reduceat(grad[order], heads, axis=0) * np.float32(SCALE)
        seen = self.seen[k][at] + g * g
        self.seen[k][at] = seen
        self.theta[k][at] += np.float32(self.rate) * g / np.sqrt(seen)

    def _step(self, target: np.ndarray, cls: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        a, b, r, s = self.theta
        q = _one_more(a[one] + b[two])
        noise = np.minimum(np.searchsorted(self.cut, self.rng.random(NOISE) * self.cut[-1], "right"), len(r) - 1)
        up, down = _pull(np.einsum("ij,ij->i", q, r[cls]) - self.log_noise[cls], q @ r[noise].T - self.log_noise[noise])
        gq = up[:, None] * r[cls] + down @ r[noise]
        # words of classes that have several
        i = np.flatnonzero(cls < self.m.n_classes)
        i = i[~self.alone[cls[i]]]
        if len(i):
            t, qi = target[i], q[i]
            other = np.searchsorted(self.m.within, cls[i][:, None] + self.rng.random((len(i), NOISE_IN_CLASS)), "left")
            other = np.minimum(other, self.m.start[cls[i] + 1][:, None] - 1)
            st, so = s[t], s[other]
            up_in, down_in = _pull(np.einsum("ij,ij->i", qi, st) - self.log_within[t], np.einsum("ij,ikj->ik", qi, so) - self.log_within[other])
            gq[i] += up_in[:, None] * st + np.einsum("ik,ikj->ij", down_in, so)
            self._add(3, np.concatenate([t, other.reshape(-1)]), np.concatenate([up_in[:, None] * qi, (down_in[:, :, None] * qi[:, None, :]).reshape(-1, DIM + 1)]))
        self._add(0, one, gq[:, :DIM])
        self._add(1, two, gq[:, :DIM])
        self._add(2, np.concatenate([cls, noise]), np.concatenate([up[:, None] * q, down.T @ q]))


def _pull(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of telling targets from noise, by their scores."""
    return 1 / (1 + np.exp(np.clip(good, -30, 30))), -1 / (1 + np.exp(-np.clip(bad, -30, 30)))


def _send_words(buckets: int):
    def body(key: tuple, docs: pa.Table) -> pa.Table:
        trim()
        hs, train = [], []
        flags = docs.column("train").to_numpy()
        for a, b, part in chunks(texts_of(docs.column("text"))):
            h, off = tokens_of(part)
            hs.append(h)
            train.append(np.repeat(flags[a:b], np.diff(off)))
        uniq, inverse = np.unique(np.concatenate(hs), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(train)).astype(np.uint64)
        order, some, cut = _by_bucket(uniq, buckets)
        uniq, n = uniq[order], n[order]
        return pa.table(
            {
                "bucket": pa.array(some, pa.int64()),
                "block": pa.array(np.full(len(some), key[0].as_py()), pa.int64()),
                "h": pa.array([uniq[a:b].tobytes() for a, b in cut], pa.binary()),
                "n": pa.array([n[a:b].tobytes() for a, b in cut], pa.binary()),
            }
        )

    return body


def _by_bucket(uniq: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Order by bucket, the buckets that occur and the bounds of each: work in proportion to the words, not the buckets."""
    return split((mix(uniq) % np.uint64(buckets)).astype(np.int64))


TOP, CLASS = -1, -2  # in place of a block


def _count_words(top: int):
    """Bucket -> the totals of each block's words; the bucket's most frequent words; sums by rest class."""

    def body(batches):
        for table in runs(batches, "bucket"):
            trim()
            hs = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
            n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint64)
            uniq, inverse = np.unique(np.concatenate(hs), return_inverse=True)
            total = np.bincount(inverse, n).astype(np.int64)
            ends = np.cumsum([0] + [len(x) for x in hs])
            mine = total[inverse]
            bucket = table.column("bucket")[0].as_py()
            best = np.lexsort((uniq, -total))[:top]
            best = best[(total[best] > 0) & (uniq[best] != END)]
            word = uniq != END
            cls = (uniq & np.uint64(REST - 1)).astype(np.int64)
            nc = np.bincount(cls[word], total[word], REST).astype(np.int64)
            vc = np.bincount(cls[word], total[word] > 0, REST).astype(np.int64)
            ends_n = int(total[~word].sum())
            block = np.concatenate([table.column("block").to_numpy(), np.full(len(best), TOP), np.full(REST + 1, CLASS)])
            a = np.concatenate([np.full(len(hs), bucket), uniq[best].view(np.int64), np.arange(REST + 1)])
            b = np.concatenate([np.zeros(len(hs), np.int64), total[best], nc, [ends_n]])
            c = np.concatenate([np.zeros(len(hs) + len(best), np.int64), vc, [int(ends_n > 0)]])
            counts = [mine[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)] + [None] * (len(best) + REST + 1)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(counts, pa.binary())], ["block", "a", "b", "c", "counts"])

    return body


def _pack(theta: list[np.ndarray]) -> bytes:
    return np.concatenate([x.reshape(-1) for x in theta]).astype(np.float32).tobytes()


def _unpack(raw: bytes, like: list[np.ndarray]) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.float32), [], 0
    for x in like:
        out.append(flat[at : at + x.size].reshape(x.shape).copy())
        at += x.size
    return out


def _train_part(shared, rate: float):
    def body(batches):
        one_thread()
        model = shared.value
        trainer = Trainer(model, rate=rate, seed=5)
        for batch in batches:
            for _, _, part in chunks(texts_of(batch.column(0))):
                trainer.learn(*tokens_of(part))
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([_pack(trainer.theta)], pa.binary())], ["part", "tokens", "theta"])

    return body


def _mean_part(batches):
    """Sum of tokens * parameters over the rows of a partition, one at a time."""
    acc, tokens = None, 0
    for batch in batches:
        for n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = np.frombuffer(raw, np.float32).astype(np.float64) * n
            acc = x if acc is None else acc + x
            tokens += n
    if acc is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([tokens], pa.int64()), pa.array([(acc / tokens).astype(np.float32).tobytes()], pa.binary())], ["part", "tokens", "theta"])


def _score(shared, buckets: int):
    def body(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        one_thread()
        model: Model = shared.value
        texts = texts_of(docs.column("text"))
        parts = [tokens_of(p) for _, _, p in chunks(texts)]
        h = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
        lens = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, np.int64)
        off = np.concatenate([[0], np.cumsum(lens)])
        uniq, inverse = np.unique(h, return_inverse=True)
        order, some, cut = _by_bucket(uniq, buckets)
        count, bounds = np.zeros(len(uniq), np.int64), dict(zip(some.tolist(), cut, strict=True))
        for b, raw in zip(answers.column("a").to_pylist(), answers.column("counts").to_pylist(), strict=True):
            count[order[slice(*bounds[b])]] = np.frombuffer(raw, np.int64)
        c = count[inverse]
        base = np.log10((c + 1.0) / (model.tokens + model.distinct + 1.0))
        own = model.logp(h, off, c) / math.log(10)
        heads = off[:-1]
        per = lambda x: np.add.reduceat(x, heads) if len(heads) else np.zeros(0)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_tokens": pa.array(lens, pa.int64()),
                "n_known": pa.array(per((c > 0).astype(np.int64)).astype(np.int64), pa.int64()),
                "train_tokens": pa.array(np.full(len(lens), model.tokens), pa.int64()),
                "base_score": pa.array(per(base), pa.float64()),
                "score": pa.array(per(own), pa.float64()),
            }
        )

    return body


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", top: int | None = None, warm_docs: int = 1500, warm_bytes: int = 6_000_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), log10; train: condition over the column doc_id."""
    spark = docs.sparkSession
    plain = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    total = plain.select(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first()["n"] or 0
    parts = partitions_for(spark, total)
    top = vocabulary_size(total) if top is None else top
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, total // 4_000_000)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))  # rows of null or repeated ids are spread by their texts
    rows = plain.withColumn("train", train.cast("int")).withColumn("block", block).repartition(parts, "block")
    by_block = rows.groupBy("block")
    sent = by_block.applyInArrow(_send_words(buckets), "bucket bigint, block bigint, h binary, n binary")
    counted = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count_words(top), "block bigint, a bigint, b bigint, c bigint, counts binary")
    counted = checkpointed(counted)

    # words above a count: as many as the vocabulary may hold, found from how many words have which count
    known = counted.filter(F.col("block") == TOP).withColumn("level", F.floor(F.log2("b") * LEVELS).cast("int"))
    levels = known.groupBy("level").count().orderBy(F.desc("level")).collect()  # LEVELS for each doubling of the largest count
    upto = np.cumsum([r["count"] for r in levels])
    least = min((r["level"] for r, n in zip(levels, upto, strict=True) if n <= top), default=None)
    best = known.filter(F.col("level") >= least).collect() if least is not None else []
    sums = counted.filter(F.col("block") == CLASS).groupBy("a").agg(F.sum("b").alias("n"), F.sum("c").alias("v")).collect()  # REST + 1 rows
    words = np.array([r["a"] for r in best], np.int64).view(np.uint64)
    freq = np.array([r["b"] for r in best], np.float64)
    n, v = np.zeros(REST + 1, np.int64), np.zeros(REST + 1, np.int64)
    for r in sums:
        n[r["a"]], v[r["a"]] = r["n"], r["v"]
    tokens, distinct = int(n.sum()), int(v.sum())
    cls = (words & np.uint64(REST - 1)).astype(np.int64)
    rest_n = n[:REST] - np.bincount(cls, freq, REST)[:REST].astype(np.int64)
    rest_v = v[:REST] - np.bincount(cls, minlength=REST)[:REST]
    model = Model(words, freq, int(n[REST]), rest_n, rest_v, tokens, distinct)

    learned = plain.filter(train)
    if tokens:
        warm = texts_from(sorted(r["text"] for r in sampled_texts(learned.select("text"), warm_docs, warm_bytes).collect()))
        trainer = Trainer(model, rate=RATES[0], seed=4)
        for _ in range(3):
            for _, _, part in chunks(warm, 1_000_000):
                trainer.learn(*tokens_of(part))
        model.theta = trainer.theta
        shared = spark.sparkContext.broadcast(model)
        each = learned.select("text").mapInArrow(_train_part(shared, RATES[1]), "part bigint, tokens bigint, theta binary")
        few = max(1, math.isqrt(parts))
        schema = "part bigint, tokens bigint, theta binary"
        mean = each.repartition(few, "part").mapInArrow(_mean_part, schema).repartition(1).mapInArrow(_mean_part, schema).first()
        model.theta = _unpack(mean["theta"], model.theta)
    answers = counted.filter("block >= 0").select("block", "a", "counts")
    shared = spark.sparkContext.broadcast(model)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_score(shared, buckets), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
