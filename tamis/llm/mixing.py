"""Soft-membership mixing: document rates whose expected domain totals match target weights.

A naive Bayes classifier gives each document a posterior over the domains.  Its features are hashed words and
hashed ends of words, and whether a word repeats the one before; it is fitted by counts over a bounded sample of the
labelled table (`max_rows` documents of each domain, chosen by the hash of the id).  A text's evidence is divided by
the root of its number of words, so that posteriors of long texts stay soft.

A document of n words (all of them counted) and posterior p spreads its words as n * p_k.  Rates r >= 0 then
minimise  sum_k (sum_d r_d n_d p_dk - T_k)^2 / M_kk  by projected gradient steps
r_d <- max(0, r_d - eta * sum_k p_dk res_k / M_kk)  from r = 1, where M = sum_d n_d p_d p_d'.  Every document has
its own posterior and rate; a step is one distributed aggregate over all documents, which yields the K residuals.

All steps are DataFrame expressions.  `total` is the words wanted; by default the most that needs no rate above 1 in
expectation.  Domains without a labelled document are left out and the other weights scaled to 1; without any,
every rate is 1.  Null and empty texts have no words and the sample's shares as posterior; rows with null labels
are not learned from; of several domains of one id the first by name counts; repeated rows are separate rows with
equal rates; a null id is returned as null; very long texts are held whole, as one array of words; extra columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import checkpointed

BUCKETS = 2048  # of words; as many of ends; and two for repeated and other words
SPACE = "[ \\t-\\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def features(tokens: Column) -> Column:
    """Array of feature numbers: three for each word."""
    word = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    end = F.transform(tokens, lambda w: (F.pmod(F.xxhash64(F.substring(w, -3, 3)), F.lit(BUCKETS)) + BUCKETS).cast("int"))
    again = F.transform(tokens, lambda w, i: F.when((i > 0) & (w == F.get(tokens, i - 1)), 2 * BUCKETS + 1).otherwise(2 * BUCKETS))
    return F.concat(word, end, again)


class Classifier:
    """domains; start[k]: log share; weight[f, k]: log-probability of a feature."""

    def __init__(self, domains: list[str], start: np.ndarray, weight: np.ndarray):
        self.domains, self.start, self.weight = domains, start, weight

    def add_posterior(self, rows: DataFrame) -> DataFrame:
        """rows with p, an array of shares, a domain each; rows has a column w, the array of a text's words.

        Step by step in columns of their own, so that nothing is computed twice."""
        if not self.domains:
            return rows.withColumn("p", F.expr("cast(array() as array<double>)"))
        plain = rows.columns
        rows = rows.withColumn("found", features(F.col("w"))).withColumn("root", F.sqrt(F.greatest(F.size("w"), F.lit(1)).cast("double")))
        rest = self.weight - self.weight[:, :1]  # against the first domain
        logits = [F.lit(float(x)) + (_summed("found", rest[:, k]) / F.col("root") if k else F.lit(0.0)) for k, x in enumerate(self.start)]
        k = len(self.domains)
        rows = rows.select(*plain, *[x.alias(f"l{i}") for i, x in enumerate(logits)])
        rows = rows.select(*plain, *[f"l{i}" for i in range(k)], reduce(lambda a, b: F.when(a > b, a).otherwise(b), [F.col(f"l{i}") for i in range(k)]).alias("top"))
        rows = rows.select(*plain, *[F.exp(F.col(f"l{i}") - F.col("top")).alias(f"e{i}") for i in range(k)])
        rows = rows.withColumn("all", reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in range(k)]))
        return rows.select(*plain, F.array(*[F.col(f"e{i}") / F.col("all") for i in range(k)]).alias("p"))


def _summed(column: str, weight: np.ndarray) -> Column:
    """Sum of the weights of an array of feature numbers; the weights are one literal, folded once."""
    table = F.split(F.lit(" ".join(f"{x:.5g}" for x in weight)), " ").cast("array<double>")
    return F.aggregate(column, F.lit(0.0), lambda a, f: a + F.get(table, f))


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 1000) -> Classifier:
    """Naive Bayes from at most max_rows documents of each domain; labelled: (doc_id, domain). Add-one counts."""
    rows = labelled.filter("domain is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("domain").alias("domain"))
    shares = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    # hashes of distinct ids are even, so 1.5 * max_rows + 100 of a domain lie below this bound, and few more
    bound = [F.when(F.col("domain") == k, int(min(1.0, (1.5 * max_rows + 100) / n) * (1 << 40))) for k, n in shares.items()]
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40))
    few = rows.withColumn("place", place).filter(F.col("place") <= F.coalesce(*bound, F.lit(0)))
    order = F.row_number().over(Window.partitionBy("domain").orderBy("place", "doc_id"))
    chosen = few.withColumn("rank", order).filter(F.col("rank") <= max_rows).select("doc_id", "domain")
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("domain", words(F.col("text")).alias("w"))  # max_rows ids a domain
    cells = sample.select("domain", F.explode(features(F.col("w"))).alias("f")).groupBy("domain", "f").agg(F.count("*").alias("n")).collect()  # domains x features
    domains = sorted({r["domain"] for r in cells})
    counts = np.ones((2 * BUCKETS + 2, len(domains)))
    for r in cells:
        counts[r["f"], domains.index(r["domain"])] += r["n"]
    each = np.concatenate([x / x.sum(0) for x in (counts[:BUCKETS], counts[BUCKETS : 2 * BUCKETS], counts[2 * BUCKETS :])])
    start = np.array([float(shares[k]) for k in domains])
    return Classifier(domains, np.log(start / start.sum()) if domains else start, np.log(each))


def describe(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p)."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), words(docs[text_col]).alias("w"))
    return model.add_posterior(rows).select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), "p")


def _moved(rate: Column, p: list[Column], move: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), rate - reduce(lambda a, b: a + b, [x * float(v) for x, v in zip(p, move, strict=True)]))


def fit_steps(described: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None, steps: int = 60, tolerance: float = 1e-6, every: int = 8) -> list[np.ndarray]:
    """The moves of the projected gradient: a document's rate is 1 after all of them in turn (see `rate_of`).

    described: (n_tokens, p). Each step sums rate * n * p over all documents; lineage and expression are cut every
    few steps."""
    k = len(domains)
    wanted = np.array([max(0.0, weights.get(x, 0.0)) for x in domains])
    if not wanted.sum():
        return []
    wanted = wanted / wanted.sum()
    p = [F.col("p")[i] for i in range(k)]
    n = F.col("n_tokens").cast("double")
    first = described.agg(*[F.sum(n * p[i]).alias(f"c{i}") for i in range(k)], *[F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    have = np.array([first[f"c{i}"] or 0.0 for i in range(k)])
    moment = np.array([[first[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    if total is None:
        total = min((have[i] / wanted[i] for i in range(k) if wanted[i] > 0), default=0.0)
    target = wanted * total
    diag = np.where(np.diag(moment) > 0, np.diag(moment), 1.0)
    eta = 1.0 / max(float(np.abs(np.linalg.eigvals(moment / diag)).max()), 1e-12)
    rows = described.select(n.alias("n_tokens"), "p", F.lit(1.0).alias("rate"))
    moves: list[np.ndarray] = []
    got = have
    for step in range(1, steps + 1):
        residual = got - target
        if np.abs(residual).max() <= tolerance * max(total, 1.0):
            break
        moves.append(eta * residual / diag)
        rows = rows.withColumn("rate", _moved(F.col("rate"), p, moves[-1]))
        if step % every == 0:
            rows = checkpointed(rows)
        sums = rows.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * p[i]).alias(f"e{i}") for i in range(k)]).first()
        got = np.array([sums[f"e{i}"] or 0.0 for i in range(k)])
    return moves


def rate_of(p: Column, moves: list[np.ndarray]) -> Column:
    """The rate of a document with posterior p: the same moves again, one after the other."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in moves])
    dot = lambda m: F.aggregate(F.zip_with(p, m, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.lit(1.0), lambda r, m: F.greatest(F.lit(0.0), r - dot(m)))


def copies(rate: Column, id_col: Column) -> Column:
    """floor(rate + u), with u in [0, 1) from the hash of the id: rate copies on average."""
    return F.floor(rate + F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 20)) / float(1 << 20)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", total: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, posterior map, rate, copies) of every row; labelled: (doc_id, domain)."""
    model = fit(docs, labelled, id_col, text_col)
    described = checkpointed(describe(docs, model, id_col, text_col))
    rate = rate_of(F.col("p"), fit_steps(described, model.domains, weights, total))
    named = F.map_from_arrays(F.array(*[F.lit(x) for x in model.domains]), "p") if model.domains else F.expr("cast(map() as map<string,double>)")
    return described.select("doc_id", "n_tokens", named.alias("posterior"), rate.alias("rate")).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def thin(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that get a copy at these rates; each at most once."""
    model = fit(docs, labelled, id_col, text_col)
    moves = fit_steps(checkpointed(describe(docs, model, id_col, text_col).select("n_tokens", "p")), model.domains, weights)
    # the row stands apart as one struct, so its columns may have any name
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("bigint").alias("id"), words(docs[text_col]).alias("w"))
    # the rate comes out of an explode of one value: a filter on it stays above, and is not written out word by word below
    rated = model.add_posterior(rows).select("row", "id", F.explode(F.array(rate_of(F.col("p"), moves))).alias("rate"))
    return rated.filter(copies(F.col("rate"), F.col("id")) >= 1).select("row.*")
