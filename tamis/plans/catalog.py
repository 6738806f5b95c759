"""Named queries over the standard tables, each beside the SQL that another engine can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import chunking as ch
from tamis.functions import entities as en
from tamis.functions import lexicon as lex
from tamis.functions import routing as ro
from tamis.functions import text as t
from tamis.operators import code, kb, scoring, selection, vectors
from tamis.plans import oracle as o
from tamis.plans.catalog_values import MODEL_NAMES, QUESTIONS, SYNONYM_GROUPS
from tamis.sources import loaders

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus(spark, sf_dir) -> DataFrame:
    """All documents as the chunks of one context."""
    return documents(spark, sf_dir).select(F.lit(0).cast("bigint").alias("context_id"), F.col("doc_id").alias("chunk_idx"), "text")


def questions(spark) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id bigint, query_text string")


def chat_contexts(spark, sf_dir) -> DataFrame:
    """(context_id, text): the turns of a conversation, apart by blank lines."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return turns.select(F.col("conv_id").alias("context_id"), F.array_join(F.transform("x", lambda y: y["text"]), "\n\n").alias("text"))


def chat_chunks(spark, sf_dir) -> DataFrame:
    return chat_contexts(spark, sf_dir).select("context_id", F.posexplode(ch.paragraphs(F.col("text"))).alias("chunk_idx", "text"))


def synonyms(spark) -> DataFrame:
    return scoring.synonym_table(spark.createDataFrame(SYNONYM_GROUPS, "group_id int, word string"))


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


# --- text functions -------------------------------------------------------------------------------------------


@query("select lang, count(*) as n_docs, sum(greatest(1, length(text) // 4))::bigint as tokens, max(greatest(1, length(text) // 4))::int as largest from documents group by lang")
def token_estimate_by_lang(spark, sf_dir):
    tokens = t.token_estimate(F.col("text"))
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("largest"))


@query(f"select doc_id, word as term, count(*) as tf from (select doc_id, unnest({o.words('text')}) as word from documents) where length(word) > 1 and word not in ({o.stops()}) group by doc_id, word having count(*) >= 5")
def word_tf_top(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(t.content_words(t.words(F.col("text")))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).filter("tf >= 5")


@query(f"select word as term, count(distinct doc_id) as df from (select doc_id, unnest({o.words('text')}) as word from documents) where length(word) > 1 and word not in ({o.stops()}) group by word")
def doc_freq(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(t.content_words(t.words(F.col("text"))))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


@query(f"with vocab as (select distinct unnest({o.words('text')}) as word from documents), {o.stems('vocab')} select word, stem from stems")
def stem_vocab(spark, sf_dir):
    return t.stems(documents(spark, sf_dir).select(F.explode(t.words(F.col("text"))).alias("word")).distinct())


@query(f"with vocab as (select distinct unnest({o.words('text')}) as word from documents), {o.stems('vocab')} select substr(stem, 1, 1) as letter, count(distinct stem) as stems, count(*) as words, sum({o.measure('stem')})::bigint as measures from stems group by 1")
def stem_letter_counts(spark, sf_dir):
    s = stem_vocab(spark, sf_dir)
    return s.groupBy(F.substring("stem", 1, 1).alias("letter")).agg(F.count_distinct("stem").alias("stems"), F.count("*").alias("words"), F.sum(t.measure(F.col("stem"))).alias("measures"))


@query(
    "with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as word from documents) "
    "select doc_id, (('0x' || substr(md5(word), 1, 16))::ubigint % 256)::int as bucket, sum(case when ('0x' || substr(md5(word), 1, 16))::ubigint % 2 = 1 then -1.0 else 1.0 end) as v from w group by 1, 2"
)
def hash_bucket_counts(spark, sf_dir):
    w = documents(spark, sf_dir).select("doc_id", F.explode(t.embed_words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return w.groupBy("doc_id", t.bucket(F.col("word")).alias("bucket")).agg(F.sum(F.col("n") * t.sign(F.col("word"))).alias("v"))


@query("select doc_id, md5(text) as text_md5, substr(sha256('local|' || text), 1, 24) as cache_key, sha1(source || ':' || lang || ':doc:1:2') as symbol, case when length(text) > 40 then regexp_replace(left(text, 40), '\\s+$', '') || chr(10) || '...' else text end as preview from documents")
def text_ids(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", t.md5_of(F.col("text")).alias("text_md5"), t.key_hash(F.lit("local"), F.col("text")).alias("cache_key"),
        t.symbol_id(F.col("source"), F.col("lang"), F.lit("doc"), F.lit(1), F.lit(2)).alias("symbol"), t.preview(F.col("text"), 40).alias("preview"),
    )


@query(f"with items as (select item_id, unnest({o.words('text')}) as w from benchmark) select item_id, w as word, {o.grams('w')} as grams_sorted from (select distinct item_id, w from items)")
def word_ngrams(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(t.words(F.col("text")))).alias("word"))
    return rows.withColumn("grams_sorted", F.array_join(F.array_sort(t.grams(F.col("word"))), ","))


# --- lexical scoring ------------------------------------------------------------------------------------------


@query(o.bm25_sql(QUESTIONS) + " select query_id, chunk_idx as doc_id, round(bm25, 6) as score from bm25 qualify row_number() over (partition by query_id order by round(bm25, 6) desc, chunk_idx) <= 20")
def bm25_topk(spark, sf_dir):
    found = scoring.bm25(questions(spark), corpus(spark, sf_dir)).select("query_id", F.col("chunk_idx").alias("doc_id"), r6(F.col("bm25")).alias("score"))
    return vectors.top_k(found, ["query_id"], [F.desc("score"), "doc_id"], 20, None).select("query_id", "doc_id", "score")


@query(o.bm25_sql(None) + " select query_id, count(*) as n, round(sum(bm25 / m), 4) as norm_total, sum((bm25 / m >= 0.5)::int)::bigint as strong from (select *, max(bm25) over (partition by query_id) as m from bm25) group by query_id")
def bm25_multi_query_norm(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = scoring.scaled(scoring.bm25(q, corpus(spark, sf_dir)), ["bm25"], q, corpus(spark, sf_dir)).withColumnRenamed("bm25_share", "norm")
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("norm"), 4).alias("norm_total"), F.sum((F.col("norm") >= 0.5).cast("int")).alias("strong"))


@query(o.trigram_sql())
def trigram_jaccard_join(spark, sf_dir):
    asked = questions(spark).select(F.explode(t.content_words(t.words(F.col("query_text")))).alias("word")).distinct()
    vocab = documents(spark, sf_dir).select(F.explode(t.content_words(t.words(F.col("text")))).alias("word")).distinct()
    return scoring.similar_words(asked, vocab).select("a", "b", r6(F.col("similarity")).alias("similarity"))


@query(o.hybrid_sql(QUESTIONS, SYNONYM_GROUPS) + " select query_id, chunk_idx, round(synonym, 6) as score from syn")
def synonym_hits(spark, sf_dir):
    return scoring.synonym_scores(questions(spark), corpus(spark, sf_dir), synonyms(spark)).select("query_id", "chunk_idx", r6(F.col("synonym")).alias("score"))


@query(o.hybrid_sql(QUESTIONS, SYNONYM_GROUPS) + o.HYBRID_END)
def hybrid_score(spark, sf_dir):
    rows = scoring.hybrid_scores(questions(spark), corpus(spark, sf_dir), synonyms(spark))
    return rows.select("query_id", F.col("chunk_idx").alias("doc_id"), F.round("bm25", 5).alias("bm25"), F.round("ngram", 5).alias("ngram"), F.round("synonym", 5).alias("synonym"), F.round("score", 5).alias("score"))


@query(
    "select conv_id, turn, " + ", ".join(f"{o.any_of('text', words)} as {name}" for name, words in (("wants_numbers", lex.NUMBER_WORDS), ("wants_method", lex.METHOD_WORDS), ("wants_related", lex.RELATED_WORDS))) + " from conversations where role = 'user'"
)
def intent_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", *[v.alias(k) for k, v in ro.intents(F.col("text")).items()])


@query(o.complexity_sql() + " select conv_id, turn, round(c, 6) as complexity from scored")
def query_complexity(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", r6(ro.complexity(F.col("text"))).alias("complexity"))


@query(o.complexity_sql() + " select case when round(c, 6) <= 0.3 then 'gpt-4o-mini' else 'gpt-4o' end as model, count(*) as n from scored group by 1")
def route_model(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select(ro.choose_model(F.round(ro.complexity(F.col("text")), 6)).alias("model")).groupBy("model").agg(F.count("*").alias("n"))


# --- vectors and stores ---------------------------------------------------------------------------------------


@query(o.hash_cosine_sql() + " select item_id, doc_id, round(score, 6) as score from scored qualify row_number() over (partition by item_id order by round(score, 6) desc, doc_id) <= 5")
def hash_cosine_topk(spark, sf_dir):
    found = vectors.hash_cosine(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir), "item_id", "doc_id").withColumn("score", r6(F.col("score")))
    return vectors.top_k(found, ["item_id"], [F.desc("score"), "doc_id"], 5, None).select("item_id", "doc_id", "score")


@query(
    "with q as (select vec_id as query_id, embedding as vector from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, "
    "list_sum(list_transform(range(1, 65), lambda i: vector[i]::double * embedding[i]::double)) / sqrt(list_sum(list_transform(vector, lambda x: x::double * x::double)) * list_sum(list_transform(embedding, lambda x: x::double * x::double))) as score from q, embeddings) "
    "select query_id, vec_id, round(score, 6) as score from s where score >= 0 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10"
)
def dense_cosine_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.dense_neighbours(q, e, 10).select("query_id", "vec_id", r6(F.col("score")).alias("score"))


@query("select md5(c) as chunk_md5, min(doc_id) as ord, count(*) as copies from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as c from documents) where c <> '' group by 1")
def dedup_store(spark, sf_dir):
    new = documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("text").alias("chunk"))
    kept = vectors.add_to_store(None, new)
    copies = vectors.add_to_store(None, new, deduplicate=False).groupBy("chunk_md5").agg(F.count("*").alias("copies"))
    return kept.select("chunk_md5", "ord").join(copies, "chunk_md5")


@query("select min(doc_id) as doc_id, md5(text) as chunk_md5 from documents where doc_id % 2 = 1 and md5(text) not in (select md5(text) from documents where doc_id % 2 = 0) group by md5(text)")
def store_antijoin_increment(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("text").alias("chunk"))
    store = vectors.add_to_store(None, d.filter("ord % 2 = 0"))
    return vectors.add_to_store(store, d.filter("ord % 2 = 1")).select(F.col("ord").alias("doc_id"), "chunk_md5")


@query(
    "with k as (select substr(sha256('|' || text), 1, 24) as key, turn from conversations), c as (select distinct key from k where turn = 0), l as (select k.key in (select key from c) as hit from k where turn > 0) "
    "select count(*) as lookups, coalesce(sum(hit::int), 0)::bigint as hits, (count(*) - coalesce(sum(hit::int), 0))::bigint as misses, round(coalesce(sum(hit::int) / nullif(count(*), 0), 0), 6) as hit_rate from l"
)
def cache_hit_rate(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.xxhash64("conv_id", "turn").alias("id"), "turn", "text")
    cache = turns.filter("turn = 0").select(t.key_hash(F.lit(""), F.col("text")).alias("key")).distinct().withColumn("vector", F.array(F.lit(1.0)))
    hits, misses = vectors.cached_embeddings(turns.filter("turn > 0"), cache)
    rows = hits.select(F.lit(True).alias("hit")).unionByName(misses.select(F.lit(False).alias("hit")))
    return vectors.hit_rate(rows).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "with c as (select lang, source, count(*) as n from documents group by 1, 2), r as (select lang as list_id, row_number() over (partition by lang order by n desc, source) - 1 as pos, source as key from c) "
    "select key, round(sum(case when list_id = 'en' then 2.0 else 1.0 end / (60 + pos + 1)), 6) as score from r where key <> '' group by key"
)
def rrf_fusion(spark, sf_dir):
    counts = documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    pos = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source")) - 1
    ranked = counts.select(F.col("lang").alias("list_id"), pos.alias("pos"), F.col("source").alias("key"))
    return vectors.fuse_rankings(ranked, 60, {"en": 2.0}).select("key", r6(F.col("score")).alias("score"))


# --- entities and selection -----------------------------------------------------------------------------------

_ASCII_KINDS = ["email", "iso_date", "us_date", "uuid", "ticket", "ipv4", "version", "policy", "git_sha"]


@query(" union all ".join(f"select '{k}' as kind, sum(len(regexp_extract_all(text, {o.quoted(lex.ENTITIES[k])})))::bigint as found, count(*) filter (len(regexp_extract_all(text, {o.quoted(lex.ENTITIES[k])})) > 0) as docs from documents" for k in _ASCII_KINDS))
def entity_counts(spark, sf_dir):
    d = documents(spark, sf_dir)
    found = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.size(en.matches(F.col("text"), k)).alias("n")) for k in _ASCII_KINDS])).alias("x"))
    return found.groupBy(F.col("x")["kind"].alias("kind")).agg(F.sum(F.col("x")["n"]).alias("found"), F.count_if(F.col("x")["n"] > 0).alias("docs"))


@query(
    "with f as (select doc_id, flatten([" + ", ".join(f"regexp_extract_all(text, {o.quoted(lex.ENTITIES[k])})" for k in ("email", "ipv4", "version", "git_sha")) + "]) as found from documents), "
    "d as (select doc_id, list_filter(found, lambda x, i: list_position(found, x) = i) as u from f) select doc_id, array_to_string(u[1:50], ',') as entities from d where len(u) > 0"
)
def entity_list(spark, sf_dir):
    kinds = ("email", "ipv4", "version", "git_sha")
    found = F.concat(*[en.matches(F.col("text"), k) for k in kinds])
    rows = documents(spark, sf_dir).select("doc_id", F.slice(F.array_distinct(found), 1, en.MAX_ENTITIES).alias("e"))
    return rows.filter(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("entities"))


@query(
    f"with c as ({o.PARAGRAPHS}), f as (select *, regexp_matches(lower(text), 'thing|attion') as has from c), "
    "n as (select *, coalesce(lag(has) over w, false) or coalesce(lead(has) over w, false) as beside from f window w as (partition by context_id order by chunk_idx)) "
    "select context_id, chunk_idx, has or beside as keep from n"
)
def entity_keep_neighbours(spark, sf_dir):
    rows = chat_chunks(spark, sf_dir).select(F.lit(1).cast("bigint").alias("query_id"), "*", F.lit(0.0).alias("score"))
    needles = rows.select("query_id", "context_id").distinct().withColumn("prompt_entities", F.array(F.lit("thing"), F.lit("Attion"))).withColumn("found", F.expr("cast(array() as array<string>)"))
    return selection.keep_flags(rows, needles, 2.0).select("context_id", "chunk_idx", F.col("by_entity").alias("keep"))


@query(o.PARAGRAPHS)
def paragraph_split(spark, sf_dir):
    return chat_chunks(spark, sf_dir).select("context_id", "chunk_idx", "text")


@query(o.merge_sql())
def chunk_merge(spark, sf_dir):
    rows = chat_contexts(spark, sf_dir).select("context_id", F.posexplode(ch.merge_under(ch.paragraphs(F.col("text")), 200)).alias("chunk_idx", "text"))
    return rows.select("context_id", "chunk_idx", F.length("text").alias("n"), F.md5("text").alias("h"))


@query(o.greedy_sql())
def greedy_budget(spark, sf_dir):
    rows = chat_chunks(spark, sf_dir)
    item = F.struct((-F.length("text")).alias("s"), F.col("chunk_idx").alias("idx"), t.token_estimate(F.col("text")).alias("tokens"))
    lists = rows.groupBy("context_id").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("p", selection.pack(F.col("items"), F.lit(300)))
    return lists.select("context_id", F.array_join(F.transform("p", lambda x: x["idx"].cast("string")), ",").alias("picked"), F.aggregate("p", F.lit(0), lambda a, x: a + x["tokens"]).alias("tokens"))


@query(o.summary_sql(300))
def sentence_summary(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ch.summary(F.col("text"), F.lit(300)).alias("summary"))


def _chat_queries(spark, sf_dir) -> DataFrame:
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query_text"))
    return first.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("context_id"), "query_text")


@query()
def compress_report(spark, sf_dir):
    cfg = selection.EngineConfig(max_context_tokens=300)
    scorer = lambda q, c: scoring.hybrid_scores(q, c, synonyms(spark))
    rows = selection.compress(_chat_queries(spark, sf_dir), chat_contexts(spark, sf_dir), scorer, cfg)
    return rows.select(
        "query_id", "original_prompt_tokens", "final_prompt_tokens", "original_context_tokens", "final_context_tokens", F.round("reduction_pct", 4).alias("reduction_pct"),
        F.round("estimated_savings", 8).alias("estimated_savings"), "kept_chunks", "total_chunks", F.array_join("entities", ",").alias("entities"), F.array_join(F.transform("selected_indices", lambda x: x.cast("string")), ",").alias("selected"),
    )


@query(o.message_sql())
def message_compress(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, "system").otherwise(F.col("role")))
    q, c = selection.compress_messages(turns)
    return q.join(c.withColumnRenamed("text", "context_text"), "context_id").select("context_id", F.md5("query_text").alias("question"), F.md5("context_text").alias("context"))


@query(
    "with m(model_name, ord) as (values " + ", ".join(f"({o.quoted(m)}, {i})" for i, m in enumerate(MODEL_NAMES)) + "), p(model, ord, a, b) as (values " + ", ".join(f"('{m}', {i}, {a}, {b})" for i, (m, a, b) in enumerate(lex.PRICES)) + "), "
    "k as (select m.model_name, lower(trim(m.model_name)) as key from m), x as (select k.model_name, p.model, p.a, p.b, case when p.model = k.key then 0 when contains(k.key, p.model) or contains(p.model, k.key) then 1 + p.ord else 99 end as rank from k, p), "
    "y as (select model_name, coalesce(min_by(model, rank) filter (rank < 99), 'gpt-4o-mini') as priced_as from x group by 1) select y.model_name, priced_as, p.a::double as input_per_1k, p.b::double as output_per_1k, round(1500 / 1000.0 * p.a + 200 / 1000.0 * p.b, 6)::double as cost from y join p on p.model = priced_as"
)
def pricing_lookup(spark, sf_dir):
    rows = ro.with_prices(spark.createDataFrame([(m,) for m in MODEL_NAMES], "model_name string"))
    return rows.withColumn("cost", F.round(ro.cost(F.lit(1500), F.lit(200), F.col("input_per_1k"), F.col("output_per_1k")), 6))


@query(
    "with c as (select conv_id, sum(length(text)) + 2 * (count(*) - 1) as n, max(length(text)) as m from conversations group by conv_id), k as (select conv_id, greatest(1, n // 4) as before, greatest(1, m // 4) as after from c) "
    "select conv_id, before::int as before_tokens, after::int as after_tokens, round(greatest(0.0, (before - after) / before * 100.0), 6) as reduction, round(greatest(0.0, (before - after) / 1000.0 * 0.0025), 8) as savings from k"
)
def cost_savings(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n"), F.max(F.length("text")).alias("m"))
    rows = rows.select("conv_id", t.token_estimate_of_length(F.col("n")).alias("before_tokens"), t.token_estimate_of_length(F.col("m")).alias("after_tokens"))
    saved = ro.cost(F.col("before_tokens"), F.lit(0), F.lit(0.0025), F.lit(0.01)) - ro.cost(F.col("after_tokens"), F.lit(0), F.lit(0.0025), F.lit(0.01))
    return rows.select("*", r6(ro.reduction_pct(F.col("before_tokens"), F.col("after_tokens"))).alias("reduction"), F.round(F.greatest(F.lit(0.0), saved), 8).alias("savings"))


@query(
    "with l as (select doc_id, string_split(text, chr(10)) as lines from documents), p as (select 'doc' || doc_id as path, unnest(range(1, len(lines) + 1)) as line, lines from l), "
    "h as (select path, line, regexp_replace(array_to_string(lines[greatest(1, line - 1):least(len(lines), line + 1)], chr(10)), '^\\s+|\\s+$', '', 'g') as preview from p where contains(lower(lines[line]), 'hehely')), "
    "s as (select path, line, preview, ((length(preview) - length(replace(lower(preview), 'hehely', ''))) / 6)::double as score from h), "
    "d as (select * from s qualify row_number() over (partition by preview order by -score, path, line) = 1), b as (select * from d order by -score, path, line limit 30), "
    "g as (select *, case when line - lag(line) over w <= 3 then 0 else 1 end as st from b window w as (partition by path order by line)), i as (select *, sum(st) over (partition by path order by line) as island from g) "
    "select path, min(line)::int as line, md5(string_agg(preview, chr(10) || '...' || chr(10) order by line)) as preview, max(score) as score from i group by path, island"
)
def kb_search(spark, sf_dir):
    files = documents(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), "text")
    return kb.search_lines(files, "hehely").select("path", "line", F.md5("preview").alias("preview"), "score")


@query(o.page_sql())
def html_main_text(spark, sf_dir):
    return loaders.page_texts(table(spark, sf_dir, "pages"))


@query("select n_nationkey, 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey as chunk from nation")
def csv_row_chunks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", loaders.row_chunks(n, ["n_nationkey", "n_name", "n_regionkey"]).alias("chunk"))


@query("select event_id, k || ': ' || (props->>k) as chunk from (select event_id, props, unnest(json_keys(props)) as k from events)")
def json_kv_chunks(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(loaders.json_chunks(F.col("props"))).alias("chunk"))


# --- graphs, windows, caches ----------------------------------------------------------------------------------


@query(
    "with a as (select user_id, count(*) as n, round(sum(value), 2) as v from events where event_id % 5 <> 0 group by 1), b as (select user_id, count(*) as n, round(sum(value), 2) as v from events where event_id % 7 <> 0 group by 1) "
    "select coalesce(a.user_id, b.user_id) as user_id, case when a.user_id is null then 'new' when b.user_id is null then 'deleted' when a.n = b.n and a.v = b.v then 'same' else 'changed' end as change from a full join b on a.user_id = b.user_id"
)
def fingerprint_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda m: e.filter(F.col("event_id") % m != 0).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return code.fingerprint_diff(side(5), side(7), "user_id")


@query(
    "with e as (select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem), s as (select 'o' || o_orderkey as node from orders where o_orderkey % 100 = 0), "
    "h1 as (select distinct dst as node from e join s on e.src = s.node where dst not in (select node from s)), h2 as (select distinct dst as node from e join h1 on e.src = h1.node where dst not in (select node from h1) and dst not in (select node from s)) "
    "select node, 1.0::double as score, 0 as hop from s union all select node, 0.5, 1 from h1 union all select node, 0.25, 2 from h2"
)
def hop_expand(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = li.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).union(li.select(name("p", "l_partkey"), name("s", "l_suppkey"))).distinct()
    seeds = table(spark, sf_dir, "orders").filter("o_orderkey % 100 = 0").select(name("o", "o_orderkey").alias("node"), F.lit(1.0).alias("score"))
    return code.expand_hops(seeds, edges, 2)


@query(
    "with g as (select user_id, event_id, case when event_id - lag(event_id) over w <= 50 then 0 else 1 end as st from events window w as (partition by user_id order by event_id)), i as (select *, sum(st) over (partition by user_id order by event_id) as island from g) "
    "select user_id, island::bigint as island, min(event_id) as first_event, max(event_id) as last_event, count(*) as n from i group by 1, 2"
)
def island_merge(spark, sf_dir):
    rows = kb.islands(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 50)
    return rows.groupBy("user_id", "island").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@query(o.ttl_sql())
def ttl_cache_replay(spark, sf_dir):
    return vectors.ttl_replay(table(spark, sf_dir, "events"), "user_id", "ts", 3600.0)


@query("select event_type, round(list_extract(list_sort(list(value)), floor(0.95 * (count(value) - 1))::int + 1), 6) as p95 from events where value is not null group by event_type")
def latency_p95(spark, sf_dir):
    return selection.p95_of(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("p95", F.round("p95", 6))


@query(
    "with f as (select conv_id, min_by(text, turn) as question, string_agg(text, chr(10) || chr(10) order by turn) as prompt, min(length(text)) as least from conversations group by conv_id), "
    "c as (select *, string_split(question, ' ')[1] as word, [string_split(question, ' ')[1], 'thing'] as required, list_filter(['thing', string_split(question, ' ')[1]], lambda e: least % 2 = 0 or e = 'thing') as entities from f) "
    "select count(*) as cases, round(100.0 * avg(contains(prompt, word || ' ')::int), 6) as answer_survival, round(100.0 * sum(len(list_filter(required, lambda e: contains(prompt, e) and list_contains(entities, e)))) / sum(len(required)), 6) as entity_survival, round(avg(least / 10.0), 6) as mean_reduction_pct from c"
)
def survival_metrics(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"), F.min(F.length("text")).alias("least"))
    word = F.get(F.split("question", " "), F.lit(0))
    chats = chats.select(F.col("conv_id").alias("query_id"), word.alias("word"), F.array_join(F.transform("x", lambda y: y["text"]), "\n\n").alias("prompt"), "least")
    cases = chats.select("query_id", F.concat("word", F.lit(" ")).alias("expected"), F.array("word", F.lit("thing")).alias("required"))
    prompts = chats.select("query_id", "prompt", F.filter(F.array(F.lit("thing"), F.col("word")), lambda e: (F.col("least") % 2 == 0) | (e == "thing")).alias("entities"), (F.col("least") / 10.0).alias("reduction_pct"))
    found = selection.survival(cases, prompts)
    return found.select("cases", *[F.round(c, 6).alias(c) for c in ("answer_survival", "entity_survival", "mean_reduction_pct")])


# --- graphs over the order tables: an order calls parts, a part is defined by its suppliers -----------------------


def _order_calls(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("shop.p"), F.col("l_partkey").cast("string"), F.lit("(x)"))
    return li.select(F.lit("calls").alias("kind"), F.lit("<module>").alias("caller"), name.alias("callee"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("col"))


@query(
    "with w as (select distinct 'p' || l_partkey as name, 's' || l_suppkey as path from lineitem where l_suppkey % 7 < 3), ok as (select name from w group by name having count(*) <= 3), "
    "e as (select 'o' || l_orderkey as src, w.path as dst, min(l_linenumber) as line from lineitem join w on w.name = 'p' || l_partkey where w.name in (select name from ok) group by 1, 2) "
    "select src, dst from e qualify row_number() over (partition by src order by line, dst) <= 4"
)
def call_target_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_suppkey % 7 < 3")
    syms = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"))
    return code.call_targets(_order_calls(spark, sf_dir), syms, 3, 4)


@query("select 'o' || l_orderkey as path, l_linenumber as line, 'shop.p' || l_partkey || '(x)' as callee from lineitem where l_orderkey % 100 = 0 order by path, line, l_partkey limit 30")
def top_call_edges(spark, sf_dir):
    paths = table(spark, sf_dir, "orders").filter("o_orderkey % 100 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"))
    return code.top_calls(_order_calls(spark, sf_dir), paths, 30).select("path", "line", "callee")


@query(
    "with e as (select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem), s as (select 'p' || p_partkey as node from part where p_partkey % 100 = 0), b as (select distinct src as node from e join s on e.dst = s.node) "
    "select node, 1.0::double as score, 0 as hop from s union all select node, 0.4, 1 from b"
)
def importer_hops(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    seeds = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.lit(1.0).alias("score"))
    return code.expand(seeds, edges, 1, imports=False, importers=True)


@query("select coalesce(nullif(source, ''), '.') as module, count(*) as files from documents group by 1 order by files desc, module limit 20")
def module_top(spark, sf_dir):
    return code.module_counts(documents(spark, sf_dir).select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")))


@query(
    "with a as (select doc_id, md5(text) as h from documents where doc_id % 5 <> 0), b as (select doc_id, md5(text || case when doc_id % 3 = 0 then '!' else '' end) as h from documents where doc_id % 7 <> 0), "
    "k as (select a.* from a join b using (doc_id, h)) select doc_id as path, h, 'kept' as origin from k union all select doc_id, h, 'fresh' from b where doc_id not in (select doc_id from k)"
)
def index_update(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    before = d.filter("path % 5 <> 0").select("path", F.md5("text").alias("h"))
    now = d.filter("path % 7 <> 0").select("path", F.md5(F.concat("text", F.when(F.col("path") % 3 == 0, "!").otherwise(""))).alias("h"))
    changes = code.fingerprint_diff(before, now)
    fresh = now.join(changes.filter("change in ('new', 'changed')").select("path"), "path", "left_semi").withColumn("origin", F.lit("fresh"))
    return code.update_records(before.withColumn("origin", F.lit("kept")), changes, fresh)


@query(
    "with u as (select 0 as part, doc_id as pos, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as chunk from documents where doc_id % 2 = 0 union all select 1, doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') from documents) "
    "select part, pos, md5(chunk) as h from u where chunk <> '' qualify row_number() over (partition by chunk order by part, pos) = 1"
)
def ordered_union_first(spark, sf_dir):
    from tamis.operators import overview

    d = documents(spark, sf_dir).select(F.col("doc_id").alias("pos"), F.col("text").alias("chunk"))
    return overview.ordered_union(d.filter("pos % 2 = 0"), d).select("part", "pos", F.md5("chunk").alias("h"))


@query(
    "with l as (select doc_id, string_split(text, chr(10)) as lines from documents), s as (select doc_id, lines, least(greatest(2, 1), len(lines)) as a from l), r as (select doc_id, lines, a, least(greatest(4, a), len(lines)) as b from s) "
    "select doc_id, md5(regexp_replace(array_to_string(list_concat(lines[a:least(b, a + 1)], case when b - a + 1 > 2 then ['...'] else [] end), chr(10)), '^\\s+|\\s+$', '', 'g')) as span, "
    "md5(regexp_replace('Source: ' || source || ':2-4' || chr(10) || left(text, 50), '^\\s+|\\s+$', '', 'g')) as block from r join documents using (doc_id)"
)
def span_and_block(spark, sf_dir):
    d = documents(spark, sf_dir)
    span = t.span_preview(F.col("text"), F.lit(2), F.lit(4), 2)
    return d.select("doc_id", F.md5(span).alias("span"), F.md5(t.source_block(F.col("source"), F.left("text", F.lit(50)), F.lit(2), F.lit(4))).alias("block"))


@query(
    "with l as (select doc_id, string_split(text, chr(10)) as lines from documents), h as (select doc_id, lines, list_filter(lines, lambda x: contains(lower(x), 'hehely') or contains(lower(x), 'thing')) as hits from l) "
    "select doc_id, md5(regexp_replace(array_to_string((case when len(hits) > 0 then hits else lines end)[1:3], chr(10)), '^\\s+|\\s+$', '', 'g')) as preview from h"
)
def file_previews(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(t.file_preview(F.col("text"), F.lit("Hehely, thing!"), 3)).alias("preview"))


@query("select x as expression, name from (values ('foo', 'foo'), ('pkg.mod.foo', 'foo'), ('obj.run(x)[0]', 'run'), ('a[1].b', 'a'), ('', '')) as v(x, name)")
def callee_names(spark, sf_dir):
    rows = spark.createDataFrame([("foo",), ("pkg.mod.foo",), ("obj.run(x)[0]",), ("a[1].b",), ("",)], "expression string")
    return rows.select("expression", t.callee_name(F.col("expression")).alias("name"))


@query("select md5(text) as chunk_md5, count(*) * 0 + 1 as n from documents group by 1")
def stream_dedup_equals_batch(spark, sf_dir):
    from tamis.streaming.streams import dedup_once

    return dedup_once(spark, f"{sf_dir}/documents.parquet").select("chunk_md5").withColumn("n", F.lit(1).cast("bigint"))


# --- chunks, files and searches of texts made from the order tables -------------------------------------------------


def _order_texts(spark, sf_dir, line, head: str = "") -> DataFrame:
    """(key, text): a text for each order, of one piece for each of its lines."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return rows.select("key", F.concat(F.lit(head), F.array_join(F.transform("x", line), "\n")).alias("text"))


def _contracts(spark, sf_dir) -> DataFrame:
    def line(x):
        more = F.when(x["l_partkey"] % 3 == 0, "  \n\nand more").otherwise("")
        return F.concat(F.lit("Section "), x["l_linenumber"].cast("string"), F.lit(". "), F.repeat(F.lit("goods "), (x["l_partkey"] % 30).cast("int")), F.lit("\nsupplier "), x["l_suppkey"].cast("string"), more)

    return _order_texts(spark, sf_dir, line)


def _programs(spark, sf_dir) -> DataFrame:
    def line(x):
        return F.concat(F.lit("def f"), x["l_partkey"].cast("string"), F.lit("(x):\n"), F.repeat(F.lit("    y = x + 1\n"), (x["l_partkey"] % 60).cast("int")), F.lit("    return x\n"))

    return _order_texts(spark, sf_dir, line, "import os\n")


def _chunk_rows(rows: DataFrame, chunks) -> DataFrame:
    return rows.select("key", F.posexplode(chunks).alias("chunk_idx", "text")).select("key", "chunk_idx", F.length("text").alias("n"), F.md5("text").alias("h"))


@query(o.minimum_sql())
def minimum_merge(spark, sf_dir):
    return _chunk_rows(chat_contexts(spark, sf_dir).withColumnRenamed("context_id", "key"), ch.merge_to_minimum(ch.paragraphs(F.col("text")), 400))


@query(o.dispatch_sql())
def chunks_by_type(spark, sf_dir):
    """Legal texts, PDF texts and texts of no stated type, each by its own rules."""
    kind = F.when(F.col("key") % 3 == 0, "legal").when(F.col("key") % 3 == 1, "pdf").otherwise("auto")
    return _chunk_rows(_contracts(spark, sf_dir), ch.smart_chunks(F.col("text"), kind))


@query(o.program_sql())
def chunks_of_programs(spark, sf_dir):
    return _chunk_rows(_programs(spark, sf_dir), ch.smart_chunks(F.col("text"), F.lit("code")))


@query(o.kinds_sql())
def text_kinds(spark, sf_dir):
    rows = _contracts(spark, sf_dir).withColumn("made", F.lit("contract")).unionByName(_programs(spark, sf_dir).withColumn("made", F.lit("program")))
    return rows.select("key", "made", ch.looks_legal(F.col("text")).alias("legal"), ch.looks_python(F.col("text")).alias("python"))


@query(
    f"with {o.CONTRACTS}, p as (select key, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p from orders_text) "
    "select key, len(p)::int as n, md5(array_to_string(p, chr(1))) as h from p"
)
def plain_paragraphs(spark, sf_dir):
    parts = ch.plain_paragraphs(F.col("text"))
    return _contracts(spark, sf_dir).select("key", F.size(parts).alias("n"), F.md5(F.array_join(parts, "\u0001")).alias("h"))


@query(
    "with w as (select distinct unnest(string_split_regex(text, '\\s+')) as value from documents) "
    "select value, value <> '' and not contains(value, '@') and not regexp_matches(lower(value), '^https?://') and not (regexp_matches(value, '^\\d*\\.\\d*$') and regexp_matches(value, '\\d')) as worthy from w"
)
def keep_worthy_values(spark, sf_dir):
    values = documents(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("value")).distinct()
    return values.select("value", en.keep_worthy(F.col("value")).alias("worthy"))


@query(
    f"with e as (select event_id, 'user_id: ' || user_id || ' Ref' || case event_id % 3 when 0 then '=' when 1 then ' # ' else '  ' end || event_type || '-' || event_id || ', sku ' || (event_id % 5000) || ' grid 12345' as text from events) "
    f"select event_id, array_to_string(regexp_extract_all(text, {o.quoted(lex.ID_LIKE)}, 1), ',') as ids from e"
)
def id_like_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null")
    sign = F.when(F.col("event_id") % 3 == 0, "=").when(F.col("event_id") % 3 == 1, " # ").otherwise("  ")
    text = F.concat(F.lit("user_id: "), F.col("user_id").cast("string"), F.lit(" Ref"), sign, "event_type", F.lit("-"), F.col("event_id").cast("string"), F.lit(", sku "), (F.col("event_id") % 5000).cast("string"), F.lit(" grid 12345"))
    return e.select("event_id", F.array_join(en.matches(text, "id_like"), ",").alias("ids"))


@query("with t as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9_./-]+'), lambda x: x <> '') as t from documents where text is not null) select doc_id, len(t)::int as n, md5(array_to_string(t, ' ')) as h from t")
def graph_terms(spark, sf_dir):
    terms = t.query_terms(F.col("text"))
    return documents(spark, sf_dir).filter("text is not null").select("doc_id", F.size(terms).alias("n"), F.md5(F.array_join(terms, " ")).alias("h"))


@query("select page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) as extension, case when contains(p, '/') then string_split(p, '/')[1] else '.' end as top from (select page_id, url, regexp_replace(url, '^https?://', '') as p from pages)")
def path_parts(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", t.file_extension(F.col("url")).alias("extension"), t.top_directory(path).alias("top"))


@query(
    "with f as (select doc_id, text, octet_length(encode(text)) as bytes, doc_id || case doc_id % 4 when 0 then '/README.md' when 1 then '/a/b/setup.py' when 2 then '/a/Cargo.toml' else '/main.py' end as path from documents where text is not null), "
    "m as (select path, bytes, text from f where doc_id % 4 in (0, 2) and bytes <= 20000 qualify row_number() over (partition by text order by path) = 1) select path, bytes, md5(text) as h from m order by path limit 20"
)
def manifest_list(spark, sf_dir):
    name = F.element_at(F.array(F.lit("/README.md"), F.lit("/a/b/setup.py"), F.lit("/a/Cargo.toml"), F.lit("/main.py")), (F.col("doc_id") % 4 + 1).cast("int"))
    files = documents(spark, sf_dir).filter("text is not null").select(F.concat(F.col("doc_id").cast("string"), name).alias("path"), F.octet_length("text").cast("bigint").alias("bytes"), "text")
    return loaders.manifest_files(files, max_bytes=20_000).select("path", "bytes", F.md5("text").alias("h"))


@query(
    "with d as (select p_partkey as k, p_name as name, p_brand as brand from part) select k || '.csv' as path, 0 as chunk_idx, 'key: ' || k || ' | name: ' || name as chunk from d where k % 3 = 0 "
    "union all select k || '.csv', 1, 'key: 0 | name: ' || brand from d where k % 3 = 0 union all select k || '.json', 0, 'key: ' || k from d where k % 3 = 1 union all select k || '.json', 1, 'name: ' || name from d where k % 3 = 1 "
    "union all select k || '.log', 0, name || chr(10) || brand from d where k % 3 = 2"
)
def files_by_loader(spark, sf_dir):
    """Tables, JSON and plain files, each read by the loader of its extension."""
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    content = F.when(kind == 0, F.concat(F.lit("key,name\n"), key, F.lit(","), "p_name", F.lit("\n0,"), "p_brand", F.lit("\n"))).when(kind == 1, F.to_json(F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")))).otherwise(F.concat("p_name", F.lit("\n"), "p_brand"))
    files = table(spark, sf_dir, "part").select(F.concat(key, F.element_at(F.array(F.lit(".csv"), F.lit(".json"), F.lit(".log")), (kind + 1).cast("int"))).alias("path"), content.cast("binary").alias("content"))
    return loaders.load_files(files)


@query(o.search_sql(["ring", "p17"], 1500))
def graph_search_top(spark, sf_dir):
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    at = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    syms = part.select(F.concat(F.lit("y"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), at("p_partkey").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 1).alias("end_line"))
    edges = li.select(at("l_partkey").alias("src"), at("l_suppkey").alias("dst")).distinct()
    return code.graph_search("Ring: P17", syms, syms.select("path"), edges, top_k=1500)


@query(
    "with w as (select date_trunc('hour', ts) as began, event_type, count(*) as n, sum(value) as total from events group by 1, 2) select strftime(began, '%Y-%m-%d %H') as hour, event_type, n, round(total, 4) as total from w "
    "where began + interval 1 hour <= (select max(ts) from events) - interval 10 minutes"
)
def stream_event_windows(spark, sf_dir):
    """A stream's hourly counts: the windows that its watermark has closed."""
    from tamis.streaming import streams

    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    found = streams.drain(streams.windowed_counts(events), "windows")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


# --- the flagship ---------------------------------------------------------------------------------------------


@query(o.budget_sql(4000))
def select_under_budget(spark, sf_dir):
    """Which documents answer a question best, within a token budget, and what that saves."""
    chunks = corpus(spark, sf_dir)
    scored = scoring.scaled(scoring.bm25(questions(spark), chunks), ["bm25"], questions(spark), chunks).withColumnRenamed("bm25_share", "score")
    above = scored.filter("score >= 0.15").withColumn("score", F.round("score", 6)).join(chunks, ["context_id", "chunk_idx"])
    best = selection.could_fit(above, 4000).select("query_id", "context_id", "chunk_idx", "text", "score", F.lit(False).alias("keep"))
    chosen = selection.enforce_budget(best, 4000)
    sizes = chunks.agg(F.count("*").alias("total"), F.sum(t.token_estimate(F.col("text"))).alias("before"))
    rows = chosen.join(F.broadcast(sizes)).select("query_id", F.size("selected").alias("kept"), "total", F.col("before").alias("tokens_before"), F.aggregate("selected", F.lit(0), lambda a, x: a + t.token_estimate(x["text"])).alias("tokens_after"), F.array_join(F.transform("selected", lambda x: x["idx"].cast("string")), ",").alias("doc_ids"))
    return rows.withColumn("reduction_pct", F.round(ro.reduction_pct(F.col("tokens_before"), F.col("tokens_after")), 4))


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
