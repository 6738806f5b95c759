"""Lexical scoring of chunks against questions, set-wise.

Inputs are relations: queries (query_id, query_text) and chunks (context_id, chunk_idx, text).  Every query meets
every context; statistics (document frequency, mean length, maxima) are per context, or per query and context.
Words are stemmed once per distinct word.  The question side is joined on words and never crossed with them.

A few questions against a corpus need few of its words: the distinct vocabulary is stemmed once, the words that
some question asks for (by stem, synonym or likeness) and those that do not count in lengths are picked from it,
and only these are looked for in the chunks, by a broadcast of checked size (`Wanted`).  Where there are more of
them, all words are counted and joined.

Where questions belong to contexts of their own, a context is what one prompt could hold: its rows meet once, and one
pass scores them (`own_context`).  Contexts with over MAX_OWN pairs of a question and a chunk have their words joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import lexicon as lex
from tamis.functions import text as t
from tamis.functions.routing import intents
from tamis.operators import own_context
from tamis.session import cut

CHUNK = ["context_id", "chunk_idx"]


@dataclass(frozen=True)
class HybridWeights:
    bm25: float = 0.70
    ngram: float = 0.15
    synonym: float = 0.15
    numeric: float = 0.20
    method: float = 0.35
    related: float = 0.35
    k1: float = 1.5
    b: float = 0.75
    ngram_n: int = 3
    ngram_threshold: float = 0.35
    numeric_threshold: float = 0.02


def occurrences(chunks: DataFrame) -> DataFrame:
    """(context_id, chunk_idx, word, n): raw words of each chunk with their counts."""
    rows = chunks.select(*CHUNK, F.explode(t.words(F.col("text"))).alias("word"))
    return rows.groupBy(*CHUNK, "word").agg(F.count("*").alias("n"))


def stemmed(words: DataFrame) -> DataFrame:
    """words with the stem of `word`; distinct words are stemmed, then joined back."""
    return words.join(t.stems(words.select("word").distinct()), "word")


def _content(column: str):
    c = F.col(column)
    return (F.length(c) > 1) & ~c.isin(*lex.STOP_WORDS)


def term_frequencies(chunks: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(context_id, chunk_idx, term, tf) over stems; stop words go after stemming."""
    words = occurrences(chunks) if words is None else words
    rows = stemmed(words).filter(_content("stem"))
    return rows.groupBy(*CHUNK, F.col("stem").alias("term")).agg(F.sum("n").alias("tf"))


MAX_WANTED = 200_000


def small(df: DataFrame) -> DataFrame | None:
    """df as a broadcast side, computed now, if it has at most MAX_WANTED rows; else None."""
    rows = df.limit(MAX_WANTED + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= MAX_WANTED else None


class Wanted:
    """What some questions need of the words of all chunks.

    counts: (context_id, chunk_idx, n_words, word, stem, n) of the words that are asked for, in chunks that have
    any; lengths: (context_id, chunk_idx, dl); sizes: (context_id, n_docs, avg_dl); pairs: (a, b, similarity)."""

    def __init__(self, counts: DataFrame, lengths: DataFrame, sizes: DataFrame, pairs: DataFrame | None):
        self.counts, self.lengths, self.sizes, self.pairs = counts, lengths, sizes, pairs

    @staticmethod
    def of(queries: DataFrame, chunks: DataFrame, asked_stems: DataFrame, synonyms: DataFrame | None = None, fuzzy: HybridWeights | None = None) -> Wanted | None:
        """None if the questions have contexts of their own or need too many words. synonyms: (synonym, stem) wanted."""
        if "context_id" in queries.columns:
            return None
        asked = small(asked_stems.select("term").distinct())
        if asked is None:
            return None
        vocabulary = t.stems(chunks.select(F.explode(t.words(F.col("text"))).alias("word")).distinct()).persist()
        try:
            by_stem = vocabulary.join(asked.withColumnRenamed("term", "stem"), "stem", "left_semi").select("word", "stem")
            silent = vocabulary.filter(~_content("stem")).select("word", "stem")
            wanted, pairs = by_stem.unionByName(silent), None
            if synonyms is not None:
                few = small(synonyms.select("synonym", "stem").distinct())
                if few is None:
                    return None
                wanted = wanted.unionByName(vocabulary.join(few.select("stem"), "stem", "left_semi").select("word", "stem"))
                wanted = wanted.unionByName(vocabulary.join(few.select(F.col("synonym").alias("word")), "word", "left_semi").select("word", "stem"))
            if fuzzy is not None:
                left = queries.select(F.explode(t.content_words(t.words(F.col("query_text")))).alias("word")).distinct()
                pairs = small(similar_words(left, vocabulary.filter(_content("word")).select("word"), fuzzy.ngram_n, fuzzy.ngram_threshold))
                if pairs is None:
                    return None
                wanted = wanted.unionByName(vocabulary.join(pairs.select(F.col("b").alias("word")).distinct(), "word", "left_semi").select("word", "stem"))
            kept = small(wanted.distinct())
        finally:
            vocabulary.unpersist()
        if kept is None:
            return None
        each = chunks.select(*CHUNK, t.words(F.col("text")).alias("w"))
        counts = each.select(*CHUNK, F.size("w").alias("n_words"), F.explode("w").alias("word")).join(kept, "word")
        counts = counts.groupBy(*CHUNK, "n_words", "word", "stem").agg(F.count("*").alias("n"))
        lengths = counts.groupBy(*CHUNK).agg((F.first("n_words") - F.sum(F.when(_content("stem"), 0).otherwise(F.col("n")))).alias("dl"))
        silenced = counts.filter(~_content("stem")).groupBy("context_id").agg(F.sum("n").alias("silent"))
        sizes = each.groupBy("context_id").agg(F.count("*").alias("n_docs"), F.sum(F.size("w")).alias("total")).join(silenced, "context_id", "left")
        sizes = sizes.select("context_id", "n_docs", ((F.col("total") - F.coalesce("silent", F.lit(0))) / F.col("n_docs")).alias("avg_dl"))
        return Wanted(counts, lengths, sizes, pairs)


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("context_id", "term").agg(F.count("*").alias("df"))


def context_sizes(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """(context_id, n_docs, avg_dl); a chunk without terms counts as length 0."""
    n = chunks.groupBy("context_id").agg(F.count("*").alias("n_docs"))
    total = lengths.groupBy("context_id").agg(F.sum("dl").alias("total"))
    return n.join(total, "context_id", "left").select("context_id", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avg_dl"))


def idf(df, n_docs):
    return F.ln((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(tf, idf_, dl, avg_dl, k1: float, b: float):
    down = F.when(avg_dl > 0, tf + k1 * (1.0 - b + b * (dl / avg_dl))).otherwise(tf + k1)
    return idf_ * (tf * (k1 + 1.0) / down)


def query_stems(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): stems of the question without stop words, repeats counted; an intent makes terms unique and adds its own."""
    flags = intents(F.col("query_text"))
    rows = queries.select("query_id", *[v.alias(k) for k, v in flags.items()], F.explode_outer(t.words(F.col("query_text"))).alias("word"))
    plain = stemmed(rows.filter("word is not null")).filter(_content("stem"))
    counted = plain.groupBy("query_id", "wants_method", "wants_related", F.col("stem").alias("term")).agg(F.count("*").alias("times"))
    counted = counted.select("query_id", "term", F.when(F.col("wants_method") | F.col("wants_related"), 1).otherwise(F.col("times")).alias("times"))
    added = [(w, "wants_method") for w in lex.METHOD_EXTRA] + [(w, "wants_related") for w in lex.RELATED_EXTRA]
    extra = t.stems(queries.sparkSession.createDataFrame(added, "word string, flag string")).select(F.col("stem").alias("term"), "flag")
    asked = queries.select("query_id", F.explode(F.filter(F.array(*[F.when(flags[k], F.lit(k)) for k in ("wants_method", "wants_related")]), lambda x: x.isNotNull())).alias("flag"))
    more = asked.join(F.broadcast(extra), "flag").select("query_id", "term", F.lit(1).cast("bigint").alias("times"))  # 25 rows of fixed words
    return counted.unionByName(more).groupBy("query_id", "term").agg(F.max("times").alias("times"))


def _by_context(asked: DataFrame, queries: DataFrame) -> tuple[DataFrame, list[str]]:
    """Questions that belong to one context meet the words of that context only."""
    if "context_id" not in queries.columns:
        return asked, []
    return asked.join(queries.select("query_id", "context_id"), "query_id"), ["context_id"]


def bm25(queries: DataFrame, chunks: DataFrame, w: HybridWeights = HybridWeights(), words: DataFrame | None = None, wanted: Wanted | None = None) -> DataFrame:
    """(query_id, context_id, chunk_idx, bm25): rows with a common term only."""
    asked = query_stems(queries)
    wanted = Wanted.of(queries, chunks, asked) if wanted is None and words is None else wanted
    terms, own = _by_context(asked, queries)
    if wanted is not None:
        tf = wanted.counts.filter(_content("stem")).groupBy(*CHUNK, F.col("stem").alias("term")).agg(F.sum("n").alias("tf"))
        lengths, sizes = wanted.lengths, wanted.sizes
    else:
        tf = term_frequencies(chunks, words)
        lengths = tf.groupBy(*CHUNK).agg(F.sum("tf").alias("dl"))
        sizes = context_sizes(chunks, lengths)
    hits = terms.join(tf, [*own, "term"]).join(document_frequencies(tf), ["context_id", "term"]).join(lengths, CHUNK).join(sizes, "context_id")
    part = F.col("times") * bm25_term(F.col("tf"), idf(F.col("df"), F.col("n_docs")), F.col("dl"), F.col("avg_dl"), w.k1, w.b)
    return hits.groupBy("query_id", *CHUNK).agg(F.sum(part).alias("bm25"))


MAX_PAIRS = 100_000


def scaled(rows: DataFrame, columns: list[str], queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows with each column as a share of the largest of its question and context (a largest of 0 or less counts as 1): the maxima are
    partial aggregates, joined back by a broadcast where the questions and contexts are few, and never a window over
    all rows of a question."""
    by = ["query_id", "context_id"]
    n = queries.count()
    if "context_id" not in queries.columns:
        n *= chunks.select("context_id").distinct().count()
    tops = rows.groupBy(*by).agg(*[F.max(c).alias(f"top_{c}") for c in columns])
    joined = rows.join(F.broadcast(tops) if n <= MAX_PAIRS else tops, by)
    share = {c: F.col(c) / F.when(F.col(f"top_{c}") > 0, F.col(f"top_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return joined.select(*[c for c in rows.columns if c not in columns], *columns, *[x.alias(f"{c}_share") for c, x in share.items()])


def read_thesaurus(path: str) -> list[list[str]]:
    """Groups of words of like meaning from a text file: a group on each line, words apart by commas."""
    with open(path, encoding="utf-8") as lines:
        groups = [[w.strip().lower() for w in line.split("#")[0].split(",") if w.strip()] for line in lines]
    return [g for g in groups if len(g) > 1]


def synonym_table(groups: DataFrame) -> DataFrame:
    """(word, synonym) from (group_id, word): a word of several groups belongs to the last of them."""
    last = groups.groupBy("word").agg(F.max("group_id").alias("group_id"))
    return last.join(groups.withColumnRenamed("word", "synonym"), "group_id").filter("word <> synonym").select("word", "synonym").distinct()


def synonyms_asked(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, synonym, stem): synonyms of a question's words."""
    asked = queries.select("query_id", F.explode(F.array_distinct(t.content_words(t.words(F.col("query_text"))))).alias("word"))
    found = asked.join(synonyms, "word").select("query_id", "synonym").distinct()
    return found.join(t.stems(found.select("synonym").distinct(), "synonym"), "synonym")


def synonym_scores(queries: DataFrame, chunks: DataFrame, synonyms: DataFrame, words: DataFrame | None = None, wanted: Wanted | None = None) -> DataFrame:
    """(query_id, context_id, chunk_idx, synonym): share of the question's synonyms that a chunk has, as they are or by stem."""
    asked = synonyms_asked(queries, synonyms)
    wanted = Wanted.of(queries, chunks, query_stems(queries), asked) if wanted is None and words is None else wanted
    total = asked.groupBy("query_id").agg(F.count("*").alias("total"))
    asked, own = _by_context(asked, queries)
    words = wanted.counts if wanted is not None else stemmed(occurrences(chunks) if words is None else words)
    raw = asked.drop("stem").join(words.filter(_content("word")).withColumn("synonym", F.col("word")), [*own, "synonym"]).select("query_id", *CHUNK, "synonym")
    by_stem = asked.join(words.filter(_content("stem")), [*own, "stem"]).select("query_id", *CHUNK, "synonym")
    hits = raw.unionByName(by_stem).distinct().groupBy("query_id", *CHUNK).agg(F.count("*").alias("hits"))
    return hits.join(total, "query_id").select("query_id", *CHUNK, (F.col("hits") / F.col("total")).alias("synonym"))


def similar_words(left: DataFrame, right: DataFrame, n: int = 3, threshold: float = 0.35, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., a, b, similarity): pairs of distinct words with n-gram Jaccard of the threshold or more, by a join on n-grams.

    left and right have a column `word`, and those of by, which must be equal. The size filter holds for every pair
    above the threshold."""
    a = left.select(*by, F.col("word").alias("a"), t.grams(F.col("word"), n).alias("g")).select(*by, "a", F.size("g").alias("na"), F.explode("g").alias("gram"))
    b = right.select(*by, F.col("word").alias("b"), t.grams(F.col("word"), n).alias("g")).select(*by, "b", F.size("g").alias("nb"), F.explode("g").alias("gram"))
    few = None if by else small(a)
    pairs = b.join(a if few is None else few, [*by, "gram"]).filter((F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na")))
    common = pairs.groupBy(*by, "a", "b", "na", "nb").agg(F.count("*").alias("both"))
    out = common.select(*by, "a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))
    return out.filter(F.col("similarity") >= threshold)


def fuzzy_scores(queries: DataFrame, chunks: DataFrame, w: HybridWeights = HybridWeights(), words: DataFrame | None = None, wanted: Wanted | None = None) -> DataFrame:
    """(query_id, context_id, chunk_idx, ngram): mean over question words of their best match in the chunk, 1 if the word itself is there."""
    words = (wanted.counts if wanted is not None else occurrences(chunks) if words is None else words).filter(_content("word"))
    asked = queries.select("query_id", F.explode(t.content_words(t.words(F.col("query_text")))).alias("a")).groupBy("query_id", "a").agg(F.count("*").alias("times"))
    total = asked.groupBy("query_id").agg(F.sum("times").alias("total"))
    asked, own = _by_context(asked, queries)
    pairs = wanted.pairs if wanted is not None else similar_words(asked.select(*own, F.col("a").alias("word")).distinct(), words.select(*own, "word").distinct(), w.ngram_n, w.ngram_threshold, tuple(own))
    best = asked.join(pairs, [*own, "a"]).join(words.withColumnRenamed("word", "b"), [*own, "b"]).groupBy("query_id", *CHUNK, "a").agg(F.max("similarity").alias("best"), F.first("times").alias("times"))
    summed = best.groupBy("query_id", *CHUNK).agg(F.sum(F.col("best") * F.col("times")).alias("found"))
    return summed.join(total, "query_id").select("query_id", *CHUNK, (F.col("found") / F.col("total")).alias("ngram"))


def cue_columns(text, n_tokens, w: HybridWeights = HybridWeights()) -> dict:
    """Bonuses and damping of a chunk for the three intents."""
    numbers = F.regexp_count(text, F.lit(lex.NUMBER)) / F.greatest(n_tokens, F.lit(1))
    numeric = F.when((n_tokens > 0) & (numbers >= w.numeric_threshold), numbers).otherwise(0.0)
    one = lambda pattern, value=1.0: F.when(text.rlike(pattern), F.lit(value)).otherwise(0.0)
    figure = F.when(t.mentions(text, lex.FIGURE_CUES), 0.6).otherwise(0.0)
    base = F.greatest(one(lex.METHOD_HEADING), one(lex.STEP, 0.7), figure)
    method = F.greatest(F.lit(0.0), base + one(lex.PROPOSED_METHOD, 0.7) - one(lex.ABSTRACT_LIKE, 0.5))
    cites = F.when(n_tokens > 0, F.regexp_count(text, F.lit(lex.CITATION)) / n_tokens).otherwise(0.0)
    related = F.least(F.lit(1.0), one(lex.RELATED_HEADING) + F.least(F.lit(0.6), cites * 10.0))
    return {
        "numeric": numeric,
        "method": method,
        "related": related,
        "method_damping": F.when(text.rlike(lex.ABSTRACT_LIKE), 0.70).otherwise(1.0),
        "related_damping": F.when(text.rlike(lex.RESULTS_LIKE), 0.75).otherwise(1.0),
    }


MAX_BROADCAST_QUESTIONS = 10_000


def small_side(questions: DataFrame) -> DataFrame:
    """questions as a broadcast side if a count shows that they are few; else Spark partitions both sides."""
    return F.broadcast(questions) if questions.count() <= MAX_BROADCAST_QUESTIONS else questions


MAX_OWN = 200_000


def crowded_contexts(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(context_id) of contexts with over MAX_OWN pairs of a question and a chunk."""
    asked = queries.groupBy("context_id").agg(F.count("*").alias("questions"))
    held = chunks.groupBy("context_id").agg(F.count("*").alias("chunks"))
    return asked.join(held, "context_id").filter(F.col("questions") * F.col("chunks") > MAX_OWN).select("context_id")


def own_scores(queries: DataFrame, chunks: DataFrame, synonyms: DataFrame | None = None, w: HybridWeights = HybridWeights()) -> DataFrame:
    """hybrid_scores of questions with contexts of their own: texts are shuffled once, and no words."""
    flags = intents(F.col("query_text"))
    q = queries.select("context_id", F.lit(False).alias("is_chunk"), "query_id", F.col("query_text").alias("text"), *[v.alias(k) for k, v in flags.items()])
    if synonyms is not None:
        words = queries.select("query_id", F.explode(F.array_distinct(t.content_words(t.words(F.col("query_text"))))).alias("word"))
        q = q.join(words.join(synonyms, "word").groupBy("query_id").agg(F.collect_set("synonym").alias("synonyms")), "query_id", "left")
    else:
        q = q.withColumn("synonyms", F.lit(None).cast("array<string>"))
    cues = cue_columns(F.col("text"), F.col("n_tokens"), w)
    c = chunks.withColumn("n_tokens", F.size(t.content_words(t.words(F.col("text"))))).select("context_id", F.lit(True).alias("is_chunk"), "text", "chunk_idx", *[v.cast("double").alias(k) for k, v in cues.items()])
    rows = q.unionByName(c, allowMissingColumns=True).filter("context_id is not null").repartition("context_id").sortWithinPartitions("context_id", "is_chunk")
    kind = lambda name: rows.schema[name].dataType.simpleString()
    values = ", ".join(f"{c} double" for c in ("bm25", "ngram", "synonym", "numeric", "method", "related", "score"))
    return rows.mapInArrow(own_context.scored_batches(w), f"query_id {kind('query_id')}, context_id {kind('context_id')}, chunk_idx {kind('chunk_idx')}, {values}")


def hybrid_scores(queries: DataFrame, chunks: DataFrame, synonyms: DataFrame | None = None, w: HybridWeights = HybridWeights()) -> DataFrame:
    """(query_id, context_id, chunk_idx, bm25, ngram, synonym, numeric, method, related, score) for every chunk of every query.

    If queries has a column context_id, a query meets that context only."""
    if "context_id" not in queries.columns:
        return joined_scores(queries, chunks, synonyms, w)
    crowded = cut(crowded_contexts(queries, chunks))
    if crowded.isEmpty():
        return own_scores(queries, chunks, synonyms, w)
    part = lambda how: (queries.join(F.broadcast(crowded), "context_id", how), chunks.join(F.broadcast(crowded), "context_id", how))  # noqa: E731  a context of these has over MAX_OWN pairs
    return own_scores(*part("left_anti"), synonyms, w).unionByName(joined_scores(*part("left_semi"), synonyms, w))


def joined_scores(queries: DataFrame, chunks: DataFrame, synonyms: DataFrame | None = None, w: HybridWeights = HybridWeights()) -> DataFrame:
    """hybrid_scores by joins on words."""
    asked = synonyms_asked(queries, synonyms) if synonyms is not None else None
    wanted = Wanted.of(queries, chunks, query_stems(queries), asked, w)
    words = None if wanted is not None else occurrences(chunks)
    flags = intents(F.col("query_text"))
    keyed = "context_id" in queries.columns
    q = queries.select("query_id", *(["context_id"] if keyed else []), *[v.alias(k) for k, v in flags.items()])
    cues = cue_columns(F.col("text"), F.size(t.content_words(t.words(F.col("text")))), w)
    facts = chunks.select(*CHUNK, *[v.alias(k) for k, v in cues.items()])
    every = facts.join(q, "context_id") if keyed else facts.crossJoin(small_side(q))  # a stated set of questions against all chunks
    key = ["query_id", *CHUNK]
    # hits of the three scores, each chunk once; chunks without any are filled with zeros below
    parts = [(bm25(queries, chunks, w, words, wanted), "bm25"), (fuzzy_scores(queries, chunks, w, words, wanted), "ngram")]
    if synonyms is not None:
        parts.append((synonym_scores(queries, chunks, synonyms, words, wanted), "synonym"))
    found = [d.select(*key, *[F.col(c) if c == name else F.lit(None).cast("double").alias(c) for c in ("bm25", "ngram", "synonym")]) for d, name in parts]
    hits = reduce(DataFrame.unionByName, found).groupBy(*key).agg(*[F.max(c).alias(c) for c in ("bm25", "ngram", "synonym")])
    if keyed:  # the longest part of the plan, which the maxima below would repeat: a few numbers for each chunk
        hits = cut(hits)
    rows = every.join(hits, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    damped = zero("bm25") * F.when(F.col("wants_method"), F.col("method_damping")).otherwise(1.0) * F.when(F.col("wants_related"), F.col("related_damping")).otherwise(1.0)
    asked = lambda flag, c: F.when(F.col(flag), F.col(c)).otherwise(0.0)
    rows = rows.select(
        *key, "wants_numbers", "wants_method", "wants_related", damped.alias("bm25"), zero("ngram").alias("ngram"), zero("synonym").alias("synonym"),
        asked("wants_numbers", "numeric").alias("numeric"), asked("wants_method", "method").alias("method"), asked("wants_related", "related").alias("related"),
    )
    rows = scaled(rows, ["bm25", "ngram", "synonym", "numeric", "method", "related"], queries, chunks)
    score = w.bm25 * F.col("bm25_share") + w.ngram * F.col("ngram_share") + w.synonym * F.col("synonym_share")
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    for flag, column, weight in (("wants_numbers", "numeric", w.numeric), ("wants_method", "method", w.method), ("wants_related", "related", w.related)):
        score = F.when(F.col(flag) & F.lit(weight > 0), clamp(score + weight * F.col(f"{column}_share"))).otherwise(score)
    return rows.select(*key, "bm25", "ngram", "synonym", "numeric", "method", "related", score.alias("score"))
