"""Choosing chunks under a token budget: protected entities, neighbours, greedy packing, summaries, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import chunking as ch
from tamis.functions import entities as en
from tamis.functions import text as t
from tamis.functions.routing import cost, reduction_pct
from tamis.session import cut

BY = ["query_id", "context_id"]
GAP = "\n\n"


@dataclass(frozen=True)
class EngineConfig:
    max_context_tokens: int = 4000
    min_relevance: float = 0.15
    conservative: bool = False
    chunk_min_chars: int = 100
    chunk_merge_under: int = 200
    include_entities: bool = True
    summary_max_chars: int = 1200
    input_per_1k: float = 0.00015
    output_per_1k: float = 0.0006

    @property
    def relevance(self) -> float:
        return min(self.min_relevance, 0.05) if self.conservative else self.min_relevance


def explode_chunks(contexts: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(context_id, chunk_idx, text) from (context_id, text[, doc_type])."""
    kind = F.col("doc_type") if "doc_type" in contexts.columns else F.lit("auto")
    return contexts.select("context_id", F.posexplode(ch.smart_chunks(F.col("text"), kind, cfg.chunk_min_chars, cfg.chunk_merge_under)).alias("chunk_idx", "text"))


def shrinking_summary(text: Column, max_tokens: Column, summary_max_chars: int) -> Column:
    """The longest of a falling row of summaries that fits the tokens; empty if none does.

    The row of budgets is fixed by its first: each is 0.8 of the one before, down to 40 characters."""
    first = F.least(F.lit(summary_max_chars), F.greatest(F.lit(80), max_tokens * 4))
    budgets = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.array(first.cast("int")), lambda a, _: F.concat(a, F.array(F.floor(F.element_at(a, -1) * 0.8).cast("int"))))
    budgets = F.filter(budgets, lambda b: (b >= 40) | (b == F.element_at(budgets, 1)))
    fits = F.filter(F.transform(budgets, lambda b: ch.summary(text, b)), lambda s: (s != "") & (t.token_estimate(s) <= max_tokens))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(""))


def pack(items: Column, max_tokens: Column) -> Column:
    """Greedy first fit over an ordered array of structs with a field `tokens`: what does not fit is passed over."""
    start = F.struct(F.slice(items, 1, 0).alias("out"), F.lit(0).alias("used"))

    def add(a: Column, x: Column) -> Column:
        fits = a["used"] + x["tokens"] <= max_tokens
        return F.struct(F.when(fits, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"), (a["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"))

    return F.aggregate(items, start, add, lambda a: a["out"])


def could_fit(rows: DataFrame, max_tokens: int, by: list[str] = BY) -> DataFrame:
    """rows without those that greedy packing by score can never take.

    Of the rows with t tokens only the best max_tokens / t can be taken, as each uses t; passing over the others
    changes nothing. What is left for a group is at most max_tokens * ln(max_tokens) rows, however many there were."""
    sized = rows.withColumn("_t", t.token_estimate(F.col("text")))
    rank = F.row_number().over(Window.partitionBy(*by, "_t").orderBy(F.desc("score"), "chunk_idx"))
    return sized.withColumn("_r", rank).filter(F.col("_r") * F.col("_t") <= max_tokens).drop("_t", "_r")


def enforce_budget(rows: DataFrame, max_tokens: int, by: list[str] = BY, summary_max_chars: int = 1200) -> DataFrame:
    """by.., selected: array of (idx, text) in order of selection. rows: by.., chunk_idx, text, score, keep.

    Protected chunks come first, then by score. If the protected ones alone exceed the budget, one summary of them
    stands for all; if nothing fits, a summary of the first chunk. One array per context: a context's chunks are
    what one prompt could hold, never a corpus."""
    item = _packable(F.col("keep"), F.col("score"), F.col("chunk_idx"), F.col("text"))
    return _choose(rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items")), max_tokens, summary_max_chars).select(*by, "selected")


def _packable(keep: Column, score: Column, idx: Column, text: Column) -> Column:
    return F.struct((~keep).cast("int").alias("late"), (-score).alias("rank"), idx.alias("idx"), text.alias("text"), t.token_estimate(text).alias("tokens"))


def _choose(lists: DataFrame, max_tokens: int, summary_max_chars: int) -> DataFrame:
    """lists with `selected`, from `items`: a sorted array of what _packable gives."""
    limit = F.lit(max_tokens)
    kept = F.array_sort(F.transform(F.filter("items", lambda x: x["late"] == 0), lambda x: F.struct(x["idx"].alias("idx"), x["text"].alias("text"))))
    lists = lists.withColumn("kept", kept).withColumn("kept_text", t.strip(F.array_join(F.transform("kept", lambda x: x["text"]), GAP)))
    over = (F.col("kept_text") != "") & (t.token_estimate(F.col("kept_text")) > limit)
    lists = lists.withColumn("whole", F.when(over, shrinking_summary(F.col("kept_text"), limit, summary_max_chars)).otherwise(F.lit("")))
    lists = lists.withColumn("packed", F.transform(pack(F.col("items"), limit), lambda x: F.struct(x["idx"].alias("idx"), x["text"].alias("text"))))
    best = F.element_at("items", 1)
    lists = lists.withColumn("one", F.when(F.size("packed") == 0, shrinking_summary(best["text"], limit, summary_max_chars)).otherwise(F.lit("")))
    none = F.slice(F.col("packed"), 1, 0)
    single = lambda idx, text: F.array(F.struct(idx.alias("idx"), text.alias("text")))
    selected = F.when(limit <= 0, none).when(F.col("whole") != "", single(F.element_at("kept", 1)["idx"], F.col("whole"))).when(F.size("packed") > 0, F.col("packed")).when(F.col("one") != "", single(best["idx"], F.col("one"))).otherwise(none)
    return lists.withColumn("selected", selected).drop("kept", "kept_text", "whole", "packed", "one")


def context_entities(scored: DataFrame, queries: DataFrame, top: int = 8) -> DataFrame:
    """(query_id, context_id, prompt_entities, found): entities of the question, and of the best chunks in rank order."""
    rank = F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("score"), "chunk_idx"))
    best = scored.withColumn("rn", rank).filter(F.col("rn") <= top).groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("top"))
    text = F.array_join(F.transform("top", lambda x: x["text"]), GAP)
    return best.join(queries.select("query_id", "query_text"), "query_id").select(*BY, en.extract(F.col("query_text")).alias("prompt_entities"), en.extract(text).alias("found"))


def keep_flags(scored: DataFrame, entities: DataFrame, relevance: float) -> DataFrame:
    """scored with `by_entity` (holds a protected entity, or stands beside one) and `keep`; a context never loses all."""
    needles = F.concat("prompt_entities", F.filter("found", en.keep_worthy))
    rows = scored.join(entities, BY).withColumn("has", t.contains_any(F.col("text"), needles))
    w = Window.partitionBy(*BY).orderBy("chunk_idx")
    beside = F.coalesce(F.lag("has").over(w), F.lit(False)) | F.coalesce(F.lead("has").over(w), F.lit(False))
    # an entity in the first or last chunk also protects that chunk itself
    rows = rows.withColumn("by_entity", F.col("has") | beside).withColumn("keep", F.col("by_entity") | (F.col("score") >= relevance))
    whole = Window.partitionBy(*BY)
    first = F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("score"), "chunk_idx")) == 1
    return rows.withColumn("keep", F.col("keep") | (first & ~F.max("keep").over(whole))).drop("has")


def _with_entities_and_items(lists: DataFrame, relevance: float, top: int = 8) -> DataFrame:
    """What context_entities and keep_flags give, inside one row for each question and context, with no more shuffles: from query_text and
    `chunks`, an array of (chunk_idx, text, score) by chunk_idx, come prompt_entities, found, and the kept chunks as `items`."""
    one = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  computes value once, however often body names it
    ranked = F.array_sort(F.transform("chunks", lambda x: F.struct((-x["score"]).alias("rank"), x["chunk_idx"].alias("idx"), x["text"].alias("text"))))
    lists = lists.withColumn("ranked", F.slice(ranked, 1, top))
    lists = lists.withColumn("prompt_entities", en.extract(F.col("query_text"))).withColumn("found", en.extract(F.array_join(F.transform("ranked", lambda x: x["text"]), GAP)))
    needles = F.concat("prompt_entities", F.filter("found", en.keep_worthy))
    lists = lists.withColumn("has", one(needles, lambda n: F.transform("chunks", lambda x: t.contains_any(x["text"], n))))
    at = lambda i: F.coalesce(F.get("has", i), F.lit(False))
    # an entity in the first or last chunk also protects that chunk itself
    flagged = F.transform("chunks", lambda x, i: F.struct(x["chunk_idx"].alias("idx"), x["text"].alias("text"), x["score"].alias("score"), (at(i) | at(i - 1) | at(i + 1)).alias("by_entity")))
    keep = lambda x: x["by_entity"] | (x["score"] >= relevance)
    best = F.element_at("ranked", 1)["idx"]
    kept = one(flagged, lambda a: one(F.filter(a, keep), lambda k: F.when(F.size(k) > 0, k).otherwise(F.filter(a, lambda x: x["idx"] == best))))
    items = F.array_sort(F.transform(kept, lambda x: _packable(x["by_entity"], x["score"], x["idx"], x["text"])))
    return lists.withColumn("items", items).drop("ranked", "has", "chunks")


def compress(queries: DataFrame, contexts: DataFrame, scorer, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One row for each query and its context: the prompt and its report.

    queries: (query_id, context_id, query_text); contexts: (context_id, text[, doc_type]) or chunks
    (context_id, chunk_idx, text). scorer(queries, chunks) gives (query_id, context_id, chunk_idx, score).

    Questions and chunks are read several times and computed once (`cut`), and so are scores: the plan of the whole is
    their sum, where it was their product. A context's scored chunks meet in one row, where all the rest is done."""
    queries = cut(queries)
    chunks = cut(contexts if "chunk_idx" in contexts.columns else explode_chunks(contexts, cfg))
    scored = cut(scorer(queries, chunks).select(*BY, "chunk_idx", "score")).join(chunks, ["context_id", "chunk_idx"])
    lists = scored.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text", "score"))).alias("chunks"))
    chosen = _choose(_with_entities_and_items(lists.join(queries, BY), cfg.relevance), cfg.max_context_tokens, cfg.summary_max_chars)
    sizes = chunks.groupBy("context_id").agg(F.count("*").cast("int").alias("total_chunks"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("context_chars"))
    rows = queries.join(sizes, "context_id", "left").join(chosen.select(*BY, "selected", "prompt_entities", "found"), BY, "left")
    empty = F.col("total_chunks").isNull()
    question = F.col("query_text")
    listed = F.array_distinct(F.concat("prompt_entities", F.filter("found", lambda e: F.array_contains(F.col("prompt_entities"), e) | en.keep_worthy(e))))
    rows = rows.withColumn("entities", F.coalesce(listed, F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn("context", t.strip(F.array_join(F.transform("selected", lambda x: x["text"]), GAP)))
    parts = [
        F.when(F.lit(cfg.include_entities) & (F.size("entities") > 0), F.concat(F.lit("KeyEntities:\n- "), F.array_join("entities", "\n- "))),
        F.when(F.col("context") != "", F.concat(F.lit("Context:\n"), F.col("context"))),
        F.concat(F.lit("User:\n"), t.strip(question)),
    ]
    rows = rows.withColumn("prompt", F.when(empty, question).otherwise(F.concat(t.strip(F.concat_ws(GAP, *parts)), F.lit("\n"))))
    before_chars = F.col("context_chars") + F.length(question) + len("Context:\n") + len("\n\nUser:\n") + 1
    before = F.when(empty, t.token_estimate(question)).otherwise(t.token_estimate_of_length(before_chars))
    after = F.when(empty, before).otherwise(t.token_estimate(F.col("prompt")))
    rows = rows.withColumn("original_prompt_tokens", before).withColumn("final_prompt_tokens", after)
    price = lambda c: cost(F.col(c), F.lit(0), F.lit(cfg.input_per_1k), F.lit(cfg.output_per_1k))
    return rows.select(
        *BY,
        "prompt",
        "original_prompt_tokens",
        "final_prompt_tokens",
        F.when(empty, 0).otherwise(t.token_estimate_of_length(F.col("context_chars"))).alias("original_context_tokens"),
        F.when(F.coalesce("context", F.lit("")) == "", 0).otherwise(t.token_estimate(F.col("context"))).alias("final_context_tokens"),
        reduction_pct(F.col("original_prompt_tokens"), F.col("final_prompt_tokens")).alias("reduction_pct"),
        F.greatest(F.lit(0.0), price("original_prompt_tokens") - price("final_prompt_tokens")).alias("estimated_savings"),
        F.coalesce(F.size("selected"), F.lit(0)).alias("kept_chunks"),
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        "entities",
        F.coalesce(F.transform("selected", lambda x: x["idx"]), F.expr("cast(array() as array<int>)")).alias("selected_indices"),
    )


def compress_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, contexts) of chats (conv_id, turn, role, text): system messages are the context, the first user message the question."""
    user = F.min(F.when((F.col("role") == "user") & (F.col("text") != ""), F.struct("turn", "text")))["text"]
    system = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))), lambda x: x["text"]), GAP)
    chats = messages.groupBy("conv_id").agg(F.coalesce(user, F.lit("Process the context.")).alias("query_text"), system.alias("text"), F.max((F.col("role") == "system").cast("int")).alias("any"))
    chats = chats.filter("any = 1")
    key = F.col("conv_id")
    return chats.select(key.alias("query_id"), key.alias("context_id"), "query_text"), chats.select(key.alias("context_id"), "text")


def survival(cases: DataFrame, prompts: DataFrame) -> DataFrame:
    """Answer and entity survival in per cent, mean reduction. cases: (query_id, expected, required); prompts: from compress."""
    rows = cases.join(prompts, "query_id")
    alive = F.size(F.filter("required", lambda e: F.contains(F.col("prompt"), e) & F.array_contains(F.col("entities"), e)))
    total = F.sum(F.size("required"))
    return rows.agg(
        F.count("*").alias("cases"),
        F.coalesce(100.0 * F.avg(F.contains("prompt", F.col("expected")).cast("int")), F.lit(0.0)).alias("answer_survival"),
        F.when(total > 0, 100.0 * F.sum(alive) / total).otherwise(100.0).alias("entity_survival"),
        F.coalesce(F.avg("reduction_pct"), F.lit(0.0)).alias("mean_reduction_pct"),
    )


def p95_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by.., p95: from counts of distinct values and their running sum, so no group is collected."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    return run.filter(F.col("upto") > F.floor(0.95 * (F.col("n") - 1))).groupBy(*by).agg(F.min(value).alias("p95"))


def quality_gate(row, min_answer: float = 85.0, need_entity: float = 100.0) -> tuple[bool, str]:
    if row["entity_survival"] + 1e-9 < need_entity:
        return False, f"FAIL: entity survival {row['entity_survival']:.1f}% < {need_entity:.1f}%"
    if row["answer_survival"] + 1e-9 < min_answer:
        return False, f"FAIL: answer survival {row['answer_survival']:.1f}% < {min_answer:.1f}%"
    return True, "PASS"
