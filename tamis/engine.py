"""Facades for one question at a time, over the set operators: engine, retriever, pipeline, chat wrapper, tools."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import caches
from tamis.functions import routing, text
from tamis.operators import scoring, selection, vectors
from tamis.sources import loaders

EMBEDDERS = {"localhash": None, "openai": "openai", "ollama": "requests", "sbert": "sentence_transformers", "gemini": "google.genai"}


def make_embedder(name: str) -> str:
    """The name of an embedder that can run here; only `localhash` needs nothing."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {name}")
    if EMBEDDERS[name]:
        try:
            importlib.import_module(EMBEDDERS[name])
        except ImportError as e:
            raise ImportError(f"embedder {name} needs the package {EMBEDDERS[name]}") from e
        raise NotImplementedError(f"embedder {name} calls a service; pass vectors of your own instead")
    return name


def semantic_scores(queries: DataFrame, chunks: DataFrame, dims: int = 256) -> DataFrame:
    """(query_id, context_id, chunk_idx, score): cosine of hash embeddings, 0 without a common bucket."""
    q = vectors.hash_weights(queries.withColumnRenamed("query_text", "text"), ["query_id"], dims=dims).withColumnRenamed("weight", "qw")
    keyed = "context_id" in queries.columns
    pairs = queries.select("query_id", *(["context_id"] if keyed else []))
    every = chunks.select("context_id", "chunk_idx").join(pairs, "context_id") if keyed else chunks.select("context_id", "chunk_idx").crossJoin(scoring.small_side(pairs))
    found = q.join(vectors.hash_weights(chunks, ["context_id", "chunk_idx"], dims=dims), "bucket").groupBy("query_id", "context_id", "chunk_idx").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    return every.join(found, ["query_id", "context_id", "chunk_idx"], "left").fillna(0.0, ["score"])


def embedded_scorer(embed: Callable[[Sequence[str]], list[list[float]]]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A scorer by the cosine of vectors that `embed` gives for lists of texts; it runs on Arrow batches of chunks."""

    def vectors_of(rows: DataFrame, keys: str) -> DataFrame:
        def body(batches):
            for batch in batches:
                found = embed(batch.column(batch.num_columns - 1).to_pylist()) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([[float(x) for x in v] for v in found], pa.list_(pa.float64()))], [*batch.schema.names[:-1], "vector"])

        return rows.mapInArrow(body, f"{keys}, vector array<double>")

    def scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
        kind = {c: chunks.schema[c].dataType.simpleString() for c in ("context_id", "chunk_idx")}
        keyed = "context_id" in queries.columns
        qid = queries.schema["query_id"].dataType.simpleString()
        q = vectors_of(queries.select("query_id", *(["context_id"] if keyed else []), "query_text"), f"query_id {qid}" + (f", context_id {kind['context_id']}" if keyed else "")).withColumnRenamed("vector", "qv")
        c = vectors_of(chunks.select("context_id", "chunk_idx", "text"), f"context_id {kind['context_id']}, chunk_idx {kind['chunk_idx']}")
        pairs = c.join(q, "context_id") if keyed else c.crossJoin(scoring.small_side(q))
        return pairs.select("query_id", "context_id", "chunk_idx", text.cosine(F.col("qv"), F.col("vector")).alias("score"))

    return scores


@dataclass
class Engine:
    """Smallest context that still answers a question.

    The scorer is the one given; else the cosine of `embedder`, a function from texts to vectors; else the hybrid
    score, with the synonyms of `thesaurus` (groups of words, see `scoring.read_thesaurus`) if there is one."""

    spark: SparkSession
    config: selection.EngineConfig = field(default_factory=selection.EngineConfig)
    scorer: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    embedder: Callable[[Sequence[str]], list[list[float]]] | None = None
    thesaurus: list[list[str]] | None = None
    last_report: dict | None = None

    def __post_init__(self):
        if self.scorer is None and self.embedder is not None:
            self.scorer = embedded_scorer(self.embedder)
        elif self.scorer is None:
            words = None
            if self.thesaurus:
                rows = [(i, w) for i, group in enumerate(self.thesaurus) for w in group]
                words = scoring.synonym_table(self.spark.createDataFrame(rows, "group_id int, word string"))
            self.scorer = lambda q, c: scoring.hybrid_scores(q, c, words)

    def build_prompt(self, question: str, context: str | Sequence[str]) -> tuple[str, dict]:
        q = self.spark.createDataFrame([(1, 1, question)], "query_id bigint, context_id bigint, query_text string")
        if isinstance(context, str):
            rows = self.spark.createDataFrame([(1, context)], "context_id bigint, text string")
        else:
            rows = self.spark.createDataFrame([(1, i, c) for i, c in enumerate(context)], "context_id bigint, chunk_idx int, text string")
        r = selection.compress(q, rows, self.scorer, self.config).first().asDict()
        if r["final_context_tokens"] > r["original_context_tokens"]:
            raise RuntimeError("the selected context is larger than the input")
        self.last_report = r
        return r.pop("prompt"), r

    def stages(self, question: str, context):
        """Progress: start, chunked, scored, done (with the prompt)."""
        yield "start", None
        n = len(context) if not isinstance(context, str) else selection.explode_chunks(self.spark.createDataFrame([(1, context)], "context_id bigint, text string"), self.config).count()
        yield "chunked", n
        prompt, report = self.build_prompt(question, context)
        yield "scored", report["kept_chunks"]
        yield "done", prompt

    def run(self, question: str, context, llm: Callable[[str], str]) -> str:
        return llm(self.build_prompt(question, context)[0])


@dataclass
class Retriever:
    """Nearest chunks of a store by hash embedding, then selection among them."""

    engine: Engine
    store: DataFrame  # ord, chunk, chunk_md5, ..
    top_k: int = 20

    def retrieve(self, question: str) -> DataFrame:
        q = self.engine.spark.createDataFrame([(1, question)], "query_id bigint, text string")
        found = vectors.hash_cosine(q, self.store.select("ord", F.col("chunk").alias("text")), "query_id", "ord")
        return vectors.top_k(found, ["query_id"], [F.desc("score"), "ord"], self.top_k).join(self.store, "ord").orderBy("rank")

    def build_prompt(self, question: str) -> tuple[str, dict]:
        return self.engine.build_prompt(question, [r["chunk"] for r in self.retrieve(question).collect()])  # at most top_k rows


@dataclass
class Pipeline:
    """Ingest, retrieve, select, route, call, with answers kept by question."""

    spark: SparkSession
    config: selection.EngineConfig = field(default_factory=selection.EngineConfig)
    rules: list[tuple[float, str]] | None = None
    store: DataFrame | None = None
    answers: caches.FileCache = field(default_factory=lambda: caches.FileCache(ttl_seconds=3600.0))
    last_report: dict | None = None

    def add(self, source) -> Pipeline:
        new = loaders.load(self.spark, source).select(F.xxhash64("path", "chunk_idx").alias("ord"), "chunk", F.col("path").alias("source"))
        fresh = vectors.add_to_store(self.store, new)
        self.store = fresh if self.store is None else self.store.unionByName(fresh.select(self.store.columns))
        return self

    def route(self, question: str) -> str:
        one = self.spark.createDataFrame([(question,)], "q string")
        return one.select(routing.choose_model(routing.complexity(F.col("q")), self.rules).alias("m")).first()["m"]

    @classmethod
    def from_sources(cls, spark: SparkSession, sources: Sequence[str], **options) -> Pipeline:
        out = cls(spark, **options)
        for source in sources:
            out.add(source)
        return out

    def query(self, question: str, llms: dict[str, Callable[[str], str]] | Callable[[str], str]) -> str:
        """The answer of the model that suits the question; a cached one if it is young enough."""
        known = self.answers.get(question)
        if known is None:
            prompt, self.last_report = Retriever(Engine(self.spark, self.config), self.store).build_prompt(question)
            llm = llms if callable(llms) else llms.get(self.route(question), next(iter(llms.values())))
            known = llm(prompt)
            self.answers.put(known, question)
        return known


def compress_chat(engine: Engine, messages: list[dict]) -> list[dict]:
    """System messages become one selected context in front; without any the messages stay as they are."""
    system = [str(m.get("content", "")) for m in messages if m.get("role") == "system"]
    if not system:
        return list(messages)
    question = next((str(m.get("content", "")) for m in messages if m.get("role") == "user" and m.get("content")), "Process the context.")
    prompt, _ = engine.build_prompt(question, "\n\n".join(system))
    return [{"role": "system", "content": prompt}, *[m for m in messages if m.get("role") != "system"]]


def search_tool(retriever: Retriever) -> dict:
    """A tool definition for agents, and its handler."""

    def handler(query: str) -> str:
        rows = retriever.retrieve(query).collect()
        return "\n\n".join(f"[{i}] (score: {r['score']:.2f}, source: {r['source'] if 'source' in r else 'unknown'})\n{r['chunk']}" for i, r in enumerate(rows, 1)) or "No relevant documents found."

    parameters = {"type": "object", "properties": {"query": {"type": "string", "description": "What to look for."}}, "required": ["query"]}
    return {"type": "function", "function": {"name": "search_documents", "description": "Search the document store.", "parameters": parameters}, "handler": handler}


def compress_tool(engine: Engine) -> dict:
    """A tool definition that compresses a context, and its handler."""

    def handler(context: str, prompt: str = "Process the context.") -> str:
        text_, report = engine.build_prompt(prompt, context)
        return json.dumps(
            {
                "compressed_prompt": text_,
                "original_tokens": report["original_prompt_tokens"],
                "final_tokens": report["final_prompt_tokens"],
                "reduction_pct": round(report["reduction_pct"], 1),
                "entities_preserved": list(report["entities"]),
            }
        )

    about = {"context": "The text to compress.", "prompt": "The question to compress it for."}
    parameters = {"type": "object", "properties": {k: {"type": "string", "description": v} for k, v in about.items()}, "required": ["context"]}
    return {"type": "function", "function": {"name": "compress_context", "description": "Compress a large context for a question.", "parameters": parameters}, "handler": handler}


def call_tool(call, tools: list[dict]) -> str:
    """The answer of the tool that a model's call names; the call is an object or a dict, its arguments JSON or a dict."""
    asked = call.get("function", {}) if isinstance(call, dict) else vars(call.function) if hasattr(call.function, "__dict__") else {"name": call.function.name, "arguments": call.function.arguments}
    given = asked.get("arguments") or {}
    for tool in tools:
        if tool["function"]["name"] == asked.get("name"):
            return tool["handler"](**(json.loads(given) if isinstance(given, str) else given))
    return json.dumps({"error": f"Unknown tool: {asked.get('name', '')}"})


#: How much a prompt shrinks while its answer survives: (name, document, question, expected, required entities).
_FILLER = "\n\n".join(["The committee met again and adjourned without a decision. " * 40] * 25)
BENCH_CASES = [
    ("contract", "ARTICLE IV - DELIVERY\n4.1 Goods arrive within 21 days of the order date.\n4.2 Storage is charged after 60 days.\n\n" + _FILLER, "When do goods arrive?", "arrive within 21 days", []),
    ("ticket", "Ticket ZEN-4410 of account_id=acct_77120.\n\nInvoice INV-55102 issued 2025-11-03. Amount: $1,250.00 USD.\n\n" + _FILLER, "Which invoice was issued and when?", "INV-55102 issued 2025-11-03", ["INV-55102", "2025-11-03"]),
    ("code", "import math\n\ndef area_of(radius):\n    return math.pi * radius ** 2\n\n" + "# nothing to see\n" * 1000, "What does area_of return?", "math.pi * radius", []),
]


def run_bench(spark: SparkSession, cases: list[tuple] | None = None, config: selection.EngineConfig | None = None) -> dict:
    """Survival of answers and entities, mean reduction, and the mean and 95th percentile of the time for one prompt."""
    engine = Engine(spark, config or selection.EngineConfig(max_context_tokens=1200, conservative=True))
    alive, found, wanted, saved, times = 0, 0, 0, [], []
    for _, document, question, expected, required in cases or BENCH_CASES:
        began = time.perf_counter()
        prompt, report = engine.build_prompt(question, document)
        times.append(1000 * (time.perf_counter() - began))
        alive += expected in prompt
        wanted += len(required)
        found += sum(e in prompt and e in report["entities"] for e in required)
        saved.append(report["reduction_pct"])
    n = len(times)
    return {
        "cases": n,
        "answer_survival": 100.0 * alive / n if n else 0.0,
        "entity_survival": 100.0 * found / wanted if wanted else 100.0,
        "mean_reduction_pct": sum(saved) / n if n else 0.0,
        "mean_latency_ms": sum(times) / n if n else 0.0,
        "p95_latency_ms": sorted(times)[int(0.95 * (n - 1))] if n else 0.0,
    }


def format_report(report: dict, width: int = 58) -> str:
    before, after = report["original_prompt_tokens"], report["final_prompt_tokens"]
    full = int(30 * max(0.0, min(1.0, (before - after) / before))) if before else 0
    lines = [
        f"Tokens   before {before}   after {after}",
        f"Saved    -{report['reduction_pct']:.1f}%   est. ${report['estimated_savings']:.4f}",
        f"[{'#' * full}{'.' * (30 - full)}] {before - after} tokens freed",
        f"Chunks   total {report['total_chunks']}  kept {report['kept_chunks']}  pruned {report['total_chunks'] - report['kept_chunks']}",
    ]
    if report["entities"]:
        more = len(report["entities"]) - 5
        lines.append("Entities " + ", ".join(report["entities"][:5]) + (f" +{more} more" if more > 0 else ""))
    return "\n".join(["+" + "-" * width + "+", *[f"|  {x[: width - 4]:<{width - 4}}  |" for x in lines], "+" + "-" * width + "+"])


def tokens_of(spark: SparkSession, value: str) -> int:
    return spark.createDataFrame([(value,)], "t string").select(text.token_estimate(F.col("t")).alias("n")).first()["n"]
