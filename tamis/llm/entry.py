"""The opN queries of this subpackage: thin digests over its operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import crc_mod, documents


def _digest(spans, only: tuple[str, ...] = ()):
    kept = F.filter(spans, lambda x: x["kinds"].isin(*only)) if only else spans
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm import crf

    docs = documents(spark, sf_dir)
    return crf.judge(docs, crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.decontam import matches

    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm import ppm

    docs = documents(spark, sf_dir)
    model = ppm.fit(docs, where=crc_mod(docs["doc_id"], 5) != 0)
    return ppm.predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.lpf import remove_repeats

    return remove_repeats(documents(spark, sf_dir), 100).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.shards import shard_by_bytes

    return shard_by_bytes(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm import ftrl

    docs = documents(spark, sf_dir)
    model = ftrl.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=crc_mod(F.col("doc_id"), 3) != 1)
    return ftrl.score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: token shares wanted of the two quality classes of the labelled table
MIX = {"high": 0.96, "low": 0.04}


def quality_domains(labels: DataFrame) -> DataFrame:
    rows = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return rows.select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("domain"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.mixing import mix

    mixed = mix(documents(spark, sf_dir), quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), MIX)
    return mixed.select("doc_id", "n_tokens", F.col("posterior")["high"].alias("p_high"), F.col("posterior")["low"].alias("p_low"), "rate", "copies")


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.lbl import score_texts

    held = crc_mod(F.col("doc_id"), 7) == 2
    scored = score_texts(documents(spark, sf_dir), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.forest import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=4, threshold=(80, 100))


def op10_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.secrets import scan_secrets

    spans = F.arrays_zip("kinds", "starts", "ends")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")
    return scan_secrets(documents(spark, sf_dir)).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_digest(spans, ("assign", "access", "hex")), 256).alias("base_sha256"),
        _digest(spans).alias("spans"),
    )


def base_quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of op1 that SQL can express."""
    return op1_line_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of op8 that SQL can express; the sum rounded to four places."""
    return op8_log_bilinear(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of op10 that SQL can express."""
    return op10_secret_automaton(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("op", "base_")) and callable(f)}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _crc_table() -> str:
    """The 256 steps of the checksum, from its polynomial."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(str(i))
    return "[" + ", ".join(out) + "]::bigint[]"


def _bytes_sql() -> str:
    """(doc_id, text, h): the text's UTF-8 bytes as hex digits."""
    return "select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents"


SHARDS_SQL = (
    f"with t as (select {_crc_table()} as t), d as ({_bytes_sql()}), c as (select doc_id, (length(h) // 2 + 8)::bigint as size, "
    "xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32 from d, t), "
    "o as (select *, row_number() over w - 1 as r, 2 * sum(size) over w - size as mid, sum(size) over () as total from c window w as (order by text_crc32, doc_id nulls first, size rows unbounded preceding)), "
    "g as (select *, sum(size) over q as bytes, min((mid - size) // 2) over q as first from o window q as (partition by text_crc32)), "
    "s as (select *, least(23, (case when bytes * 24 <= total then 2 * first + bytes else mid end * 24) // (2 * total))::int as shard from g) "
    "select doc_id, size, text_crc32, 'bytes' as law, shard, (r - min(r) over (partition by shard))::bigint as slot, null::int as grown_shard from s"
)

REPEATS_SQL = (
    f"with d as ({_bytes_sql()}), n as (select doc_id, h, length(h) // 2 as n from d), w as (select doc_id, unnest(range(0, n - 99)) as i, h from n where n >= 100), "
    "k as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as k from w), f as (select k, min((doc_id, i)) as first from k group by k having count(*) > 1), "
    "g as (select k.doc_id, k.i from k join f using (k) where (k.doc_id, k.i) <> f.first), m as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as b from g), "
    "s as (select doc_id, i, sum(b) over (partition by doc_id order by i) as span from m), p as (select doc_id, min(i) as a, max(i) + 100 as e from s group by doc_id, span), "
    "l as (select doc_id, list(a order by a) as a, list(e order by a) as e, sum(e - a) as gone from p group by doc_id) "
    "select n.doc_id, n.n::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(len(a), 0)::bigint as n_spans, "
    "sha256(unhex(case when a is null then h else array_to_string(list_transform(range(0, len(a) + 1), lambda j: substr(h, 2 * (case when j = 0 then 0 else e[j] end) + 1, 2 * ((case when j = len(a) then n else a[j + 1] end) - (case when j = 0 then 0 else e[j] end)))), '') end)) as kept_sha256 "
    "from n left join l using (doc_id)"
)

NEAR_SQL = (
    f"with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents), "
    "s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w), "
    "n as (select doc_id, len(s)::bigint as n_shingles from s), u as (select doc_id, unnest(s) as sh from s), c as (select a.doc_id as a, b.doc_id as b, count(*) as common from u a join u b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2), "
    "e as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)), "
    "g as (select a, b from e union all select b, a from e), r as (select doc_id as v, doc_id as m from n union select g.b, r.m from r join g on g.a = r.v) "
    "select n.doc_id, n_shingles, min(m) as component_id, n.doc_id = min(m) as kept from n join r on r.v = n.doc_id group by n.doc_id, n_shingles"
)


QUALITY_SQL = (
    "with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents), "
    "l as (select doc_id, unnest(string_split(t, chr(10))) as line from d), dup as (select doc_id, sum(n - 1) as n from (select doc_id, line, count(*) as n from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1, 2) group by 1), "
    "g as (select doc_id, unnest(range(1, len(w) - 6)) as i, w from d where len(w) >= 8), k as (select doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) as k from g), "
    "r as (select doc_id, i from k qualify count(*) over (partition by doc_id, k) > 1), c as (select doc_id, count(distinct i + j) as n from r, range(0, 8) x(j) group by 1) "
    "select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, "
    "coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(w) < 20 or 100 * coalesce(c.n, 0) > 30 * len(w) as base_failed from d left join dup using (doc_id) left join c using (doc_id)"
)

UNIGRAM_SQL = (
    f"with t as (select {_crc_table()} as t), h as (select doc_id, coalesce(text, '') as text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda x: ('0x' || x)::bigint), "
    "lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 7 = 2 as held_out from documents, t), "
    f"w as (select doc_id, held_out, unnest(list_append(list_transform(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+'), lambda x: 'w' || x), 'end')) as w from h), "
    "c as (select w, count(*) as c from w where not held_out group by w), s as (select sum(c) as n, count(*) as v from c) "
    "select doc_id, held_out, count(*) as n_tokens, count(c.c) as n_known, max(s.n)::bigint as train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (s.n + s.v + 1))), 4) as base_score from w left join c using (w), s group by doc_id, held_out"
)

_ASSIGN = """(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRETS_SQL = (
    "with d as (select doc_id, coalesce(text, '') as t from documents) "
    f"select doc_id, len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 1), lambda x: length(x) >= 6))::bigint as n_assign, "
    "len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint as n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint as n_hex from d"
)


def oracle_sql() -> dict[str, str]:
    """The others rest on trained models or automata; tests hold them against brute force."""
    return {
        "op4_previous_factors": REPEATS_SQL,
        "op5_byte_shards": SHARDS_SQL,
        "op9_lsh_forest": NEAR_SQL,
        "base_quality_figures": QUALITY_SQL,
        "base_unigram_scores": UNIGRAM_SQL,
        "base_secret_counts": SECRETS_SQL,
    }
