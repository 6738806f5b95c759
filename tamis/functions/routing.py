"""Question complexity, model choice, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.lexicon import COMPLEX_WORDS, CONDITION_WORDS, DEFAULT_MODEL, METHOD_WORDS, NUMBER_WORDS, PRICES, RELATED_WORDS, SIMPLE_WORDS, TASK_VERBS
from tamis.functions.text import mentions, strip

DEFAULT_RULES = [(0.3, "gpt-4o-mini"), (1.0, "gpt-4o")]


def intents(query: Column) -> dict[str, Column]:
    return {"wants_numbers": mentions(query, NUMBER_WORDS), "wants_method": mentions(query, METHOD_WORDS), "wants_related": mentions(query, RELATED_WORDS)}


def _hits(q: Column, phrases: list[str]) -> Column:
    return sum((F.contains(q, F.lit(p)).cast("int") for p in phrases), start=F.lit(0))


def complexity(query: Column) -> Column:
    q = strip(F.lower(query))
    n = F.regexp_count(q, F.lit(r"\b[a-z]+\b"))
    score = F.when(n > 50, 0.25).when(n > 25, 0.15).when(n > 10, 0.05).otherwise(0.0)
    score = score + F.least(F.lit(0.4), _hits(q, COMPLEX_WORDS) * 0.1) - F.least(F.lit(0.2), _hits(q, SIMPLE_WORDS) * 0.1)
    score = score + F.when(F.regexp_count(q, F.lit(r"\?")) >= 2, 0.1).otherwise(0.0) + F.when(mentions(q, CONDITION_WORDS), 0.1).otherwise(0.0)
    score = score + F.when((n <= 12) & mentions(q, TASK_VERBS), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def choose_model(score: Column, rules: list[tuple[float, str]] | None = None) -> Column:
    """The first rule, by rising limit, that the score does not exceed; else the last."""
    rules = sorted(rules if rules is not None else DEFAULT_RULES, key=lambda r: r[0])
    if not rules:
        return F.lit(DEFAULT_MODEL)
    out = F.lit(rules[-1][1])
    for limit, model in reversed(rules):
        out = F.when(score <= limit, F.lit(model)).otherwise(out)
    return out


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i, a, b) for i, (m, a, b) in enumerate(PRICES)], "model string, ord int, input_per_1k double, output_per_1k double")


def with_prices(df: DataFrame, name_col: str = "model_name") -> DataFrame:
    """Price of each model name: the exact one, else the first preset that holds the name or is held by it, else the default."""
    key = F.lower(F.trim(F.col(name_col)))
    chosen = F.coalesce(
        *[F.when(key == m, F.lit(m)) for m, _, _ in PRICES],
        *[F.when(F.contains(key, F.lit(m)) | F.contains(F.lit(m), key), F.lit(m)) for m, _, _ in PRICES],
        F.lit(DEFAULT_MODEL),
    )
    price = lambda k: F.element_at(F.create_map(*[x for row in PRICES for x in (F.lit(row[0]), F.lit(row[k]))]), F.col("priced_as"))
    return df.withColumn("priced_as", chosen).withColumn("input_per_1k", price(1)).withColumn("output_per_1k", price(2))


def cost(tokens_in: Column, tokens_out: Column, input_per_1k: Column, output_per_1k: Column) -> Column:
    return tokens_in / 1000.0 * input_per_1k + tokens_out / 1000.0 * output_per_1k


def reduction_pct(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.greatest(F.lit(0.0), (before - after) / before * 100.0)).otherwise(F.lit(0.0))
