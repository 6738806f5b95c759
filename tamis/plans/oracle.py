"""SQL text for another engine (DuckDB), built from the same fixed words but from no expression of ours."""

from __future__ import annotations

from tamis.functions import lexicon as lex
from tamis.plans.catalog_values import QUESTIONS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[a-z0-9]+')"


def stops() -> str:
    return ", ".join(quoted(w) for w in lex.STOP_WORDS)


def measure(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[aeiou][^aeiou]'))"


def any_of(column: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({column}), {quoted(p)})" for p in phrases) + ")"


def grams(w: str) -> str:
    return f"case when length({w}) < 3 then {w} else array_to_string(list_sort(list_distinct(list_transform(range(1, length({w}) - 1), lambda i: substr({w}, i, 3)))), ',') end"


def _cut(n: int, w: str = "w") -> str:
    return f"left({w}, length({w}) - {n})"


def stems(source: str) -> str:
    """Chain of named tables that ends in stems(word, stem)."""
    vowel = lambda x: f"regexp_matches({x}, '[aeiou]')"
    cvc = lambda x: f"({measure(x)} = 1 and regexp_matches({x}, '[^aeiou][aeiou][^aeiou]$'))"
    twin = "(length(w) >= 2 and w[-1] = w[-2] and not regexp_matches(w[-1], '[aeiou]'))"
    step = lambda name, before, value: f"{name} as (select word, short, case when short then w else {value} end as w from {before})"
    derived = "case " + " ".join(f"when suffix(w, '{a}') then case when {measure(_cut(len(a)))} > 0 then {_cut(len(a))} || '{b}' else w end" for a, b in lex.DERIVED) + " else w end"
    ending = "case " + " ".join(f"when suffix(w, '{a}') then case when {measure(_cut(len(a)))} > 1 then {_cut(len(a))} else w end" for a in lex.ENDINGS) + " else w end"
    plural = f"case when suffix(w, 'sses') or (suffix(w, 'ies') and length(w) > 4) then {_cut(2)} when suffix(w, 's') and not suffix(w, 'ss') and not suffix(w, 'us') then {_cut(1)} else w end"
    return ", ".join(
        [
            f"st0 as (select word, length(trim(lower(word))) <= 2 as short, trim(lower(word)) as w from {source})",
            step("st1", "st0", plural),
            f"st2 as (select word, short, case when short or suffix(w, 'eed') then 0 when suffix(w, 'ed') and {vowel(_cut(2))} then 2 when suffix(w, 'ing') and {vowel(_cut(3))} then 3 else 0 end as k, w from st1)",
            f"st3 as (select word, short, k, case when k > 0 then left(w, length(w) - k) when not short and suffix(w, 'eed') and {measure(_cut(3))} > 0 then {_cut(1)} else w end as w from st2)",
            f"st4 as (select word, short, case when k = 0 then w when regexp_matches(w, '(at|bl|iz)$') then w || 'e' when {twin} and w[-1] not in ('l', 's', 'z') then {_cut(1)} when {cvc('w')} then w || 'e' else w end as w from st3)",
            step("st5", "st4", f"case when suffix(w, 'y') and length(w) > 2 and {vowel(_cut(1))} then {_cut(1)} || 'i' else w end"),
            step("st6", "st5", derived),
            step("st7", "st6", ending),
            step("st8", "st7", f"case when suffix(w, 'e') and ({measure(_cut(1))} > 1 or ({measure(_cut(1))} = 1 and not regexp_matches({_cut(1)}, '[^aeiou][aeiou][^aeiou]$'))) then {_cut(1)} else w end"),
            f"stems as (select word, case when not short and {twin} and w[-1] not in ('l', 's', 'z') and {measure(_cut(1))} > 1 then {_cut(1)} else w end as stem from st8)",
        ]
    )


PARAGRAPHS = (
    "select context_id, (i - 1)::int as chunk_idx, p[i] as text from (select context_id, p, unnest(range(1, len(p) + 1)) as i from (select context_id, "
    "list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n+'), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '[ \\t]+\\n', chr(10), 'g')), lambda x: x <> '') as p "
    "from (select conv_id as context_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id)))"
)


def _questions(rows) -> str:
    if rows is None:
        return "q as (select item_id as query_id, text as query_text from benchmark)"
    return "q(query_id, query_text) as (values " + ", ".join(f"({i}::bigint, {quoted(x)})" for i, x in rows) + ")"


def bm25_sql(rows) -> str:
    """Chain that ends in bm25(query_id, chunk_idx, bm25) for all documents as chunks of one context, undamped."""
    extra = " union all ".join([f"select {quoted(w)} as word, 1 as flag" for w in lex.METHOD_EXTRA] + [f"select {quoted(w)}, 2" for w in lex.RELATED_EXTRA])
    return (
        f"with {_questions(rows)}, tok as (select doc_id as chunk_idx, unnest({words('text')}) as word from documents), qt as (select query_id, unnest({words('query_text')}) as word from q), extra as ({extra}), "
        f"vocab as (select word from tok union select word from qt union select word from extra), {stems('vocab')}, "
        f"qf as (select query_id, {any_of('query_text', lex.NUMBER_WORDS)} as wn, {any_of('query_text', lex.METHOD_WORDS)} as wm, {any_of('query_text', lex.RELATED_WORDS)} as wr from q), "
        f"tf as (select chunk_idx, stem as term, count(*) as tf from tok join stems using (word) where length(stem) > 1 and stem not in ({stops()}) group by 1, 2), "
        "df as (select term, count(*) as df from tf group by 1), dl as (select chunk_idx, sum(tf) as dl from tf group by 1), cs as (select count(*) as n, (select sum(dl) from dl) / count(*) as avgdl from documents), "
        f"qs0 as (select query_id, stem as term, count(*) as times from qt join stems using (word) where length(stem) > 1 and stem not in ({stops()}) group by 1, 2), "
        "qs1 as (select query_id, term, case when wm or wr then 1 else times end as times from qs0 join qf using (query_id) union all select query_id, stem, 1 from qf, extra join stems using (word) where (flag = 1 and wm) or (flag = 2 and wr)), "
        "qs as (select query_id, term, max(times) as times from qs1 group by 1, 2), "
        "bm25 as (select query_id, chunk_idx, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (dl / avgdl))))) as bm25 from qs join tf using (term) join df using (term) join dl using (chunk_idx), cs group by 1, 2)"
    )


def _gram_list(w: str) -> str:
    return f"case when length({w}) < 3 then [{w}] else list_distinct(list_transform(range(1, length({w}) - 1), lambda i: substr({w}, i, 3))) end"


def trigram_sql() -> str:
    return (
        f"with {_questions(QUESTIONS)}, a as (select distinct word as a from (select unnest({words('query_text')}) as word from q) where length(word) > 1 and word not in ({stops()})), "
        f"b as (select distinct word as b from (select unnest({words('text')}) as word from documents) where length(word) > 1 and word not in ({stops()})), "
        f"ga as (select a, {_gram_list('a')} as g from a), gb as (select b, {_gram_list('b')} as g from b), "
        "s as (select a, b, len(list_intersect(ga.g, gb.g)) / len(list_distinct(list_concat(ga.g, gb.g))) as sim from ga, gb) select a, b, round(sim, 6) as similarity from s where sim >= 0.35"
    )


def hybrid_sql(rows, groups) -> str:
    """bm25_sql, then syn(query_id, chunk_idx, synonym) and fz(query_id, chunk_idx, ngram)."""
    values = ", ".join(f"({g}, {quoted(w)})" for g, w in groups)
    head = bm25_sql(rows).replace("union select word from extra)", f"union select word from extra union select word from (values {values}) as v(g, word))", 1)
    content = f"length(word) > 1 and word not in ({stops()})"
    return head + (
        f", grp(g, word) as (values {values}), own as (select word, max(g) as g from grp group by word), qr as (select query_id, word from qt where {content}), "
        "want as (select distinct query_id, grp.word as syn from qr join own using (word) join grp on grp.g = own.g where grp.word <> qr.word), tot as (select query_id, count(*) as total from want group by 1), "
        f"craw as (select distinct chunk_idx, word from tok where {content}), "
        "hit as (select query_id, chunk_idx, syn from want join craw on craw.word = want.syn union select query_id, chunk_idx, syn from want join stems on stems.word = want.syn join tf on tf.term = stems.stem), "
        "syn as (select query_id, chunk_idx, count(*) / any_value(total) as synonym from hit join tot using (query_id) group by 1, 2), "
        f"aw as (select query_id, word as a, count(*) as times from qr group by 1, 2), at_ as (select query_id, sum(times) as total from aw group by 1), ga as (select a, {_gram_list('a')} as g from (select distinct a from aw)), gb as (select word as b, {_gram_list('word')} as g from (select distinct word from craw)), "
        "sim as (select a, b, len(list_intersect(ga.g, gb.g)) / len(list_distinct(list_concat(ga.g, gb.g))) as s from ga, gb where s >= 0.35), "
        "best as (select query_id, chunk_idx, a, max(s) as s, any_value(times) as times from aw join sim using (a) join craw on craw.word = sim.b group by 1, 2, 3), fz as (select query_id, chunk_idx, sum(s * times) / any_value(total) as ngram from best join at_ using (query_id) group by 1, 2)"
    )


def _one(pattern: str, value: float = 1.0) -> str:
    return f"case when regexp_matches(text, {quoted(pattern)}) then {value} else 0.0 end"


HYBRID_END = (
    f", cue as (select doc_id as chunk_idx, text, len(list_filter({words('text')}, lambda x: length(x) > 1 and x not in ({stops()}))) as nt from documents), "
    f"cu as (select chunk_idx, len(regexp_extract_all(text, {quoted(lex.NUMBER)})) / greatest(nt, 1) as num, nt, "
    f"greatest(0.0, greatest({_one(lex.METHOD_HEADING)}, {_one(lex.STEP, 0.7)}, case when {any_of('text', lex.FIGURE_CUES)} then 0.6 else 0.0 end) + {_one(lex.PROPOSED_METHOD, 0.7)} - {_one(lex.ABSTRACT_LIKE, 0.5)}) as meth, "
    f"least(1.0, {_one(lex.RELATED_HEADING)} + least(0.6, case when nt > 0 then len(regexp_extract_all(text, {quoted(lex.CITATION)})) / nt * 10.0 else 0.0 end)) as rel, "
    f"case when regexp_matches(text, {quoted(lex.ABSTRACT_LIKE)}) then 0.7 else 1.0 end as dm, case when regexp_matches(text, {quoted(lex.RESULTS_LIKE)}) then 0.75 else 1.0 end as dr from cue), "
    "al as (select query_id, cu.chunk_idx, wn, wm, wr, coalesce(bm25.bm25, 0) * case when wm then dm else 1.0 end * case when wr then dr else 1.0 end as bm25, coalesce(ngram, 0) as ngram, coalesce(synonym, 0) as synonym, "
    "case when wn and nt > 0 and num >= 0.02 then num else 0.0 end as num, case when wm then meth else 0.0 end as meth, case when wr then rel else 0.0 end as rel "
    "from qf cross join cu left join bm25 using (query_id, chunk_idx) left join fz using (query_id, chunk_idx) left join syn using (query_id, chunk_idx)), "
    "mx as (select *, " + ", ".join(f"case when max({c}) over w > 0 then max({c}) over w else 1.0 end as m_{c}" for c in ("bm25", "ngram", "synonym", "num", "meth", "rel")) + " from al window w as (partition by query_id)), "
    "s0 as (select *, 0.7 * bm25 / m_bm25 + 0.15 * ngram / m_ngram + 0.15 * synonym / m_synonym as s from mx), s1 as (select * replace (case when wn then least(1.0, greatest(0.0, s + 0.2 * num / m_num)) else s end as s) from s0), "
    "s2 as (select * replace (case when wm then least(1.0, greatest(0.0, s + 0.35 * meth / m_meth)) else s end as s) from s1), s3 as (select * replace (case when wr then least(1.0, greatest(0.0, s + 0.35 * rel / m_rel)) else s end as s) from s2) "
    "select query_id, chunk_idx as doc_id, round(bm25, 5) as bm25, round(ngram, 5) as ngram, round(synonym, 5) as synonym, round(s, 5) as score from s3"
)


def complexity_sql() -> str:
    hits = lambda phrases: " + ".join(f"contains(q, {quoted(p)})::int" for p in phrases)
    return (
        "with u as (select conv_id, turn, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') as q from conversations where role = 'user'), n as (select *, len(list_filter(regexp_extract_all(q, '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))) as n from u), "
        f"scored as (select conv_id, turn, greatest(0.0, least(1.0, (case when n > 50 then 0.25 when n > 25 then 0.15 when n > 10 then 0.05 else 0.0 end)::double + least(0.4, ({hits(lex.COMPLEX_WORDS)}) * 0.1) - least(0.2, ({hits(lex.SIMPLE_WORDS)}) * 0.1) "
        f"+ case when length(q) - length(replace(q, '?', '')) >= 2 then 0.1 else 0.0 end + case when {any_of('q', lex.CONDITION_WORDS)} then 0.1 else 0.0 end + case when n <= 12 and {any_of('q', lex.TASK_VERBS)} then 0.15 else 0.0 end)) as c from n)"
    )


def hash_cosine_sql() -> str:
    side = lambda name, table, key: (
        f"{name}w as (select {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) as word from {table}), "
        f"{name}v as (select {key}, ('0x' || substr(md5(word), 1, 16))::ubigint % 256 as bucket, sum(case when ('0x' || substr(md5(word), 1, 16))::ubigint % 2 = 1 then -1.0::double else 1.0::double end) as v from {name}w group by 1, 2), "
        f"{name} as (select {key}, bucket, v / sqrt(sum(v * v) over (partition by {key})) as w from {name}v)"
    )
    return f"with {side('b', 'benchmark', 'item_id')}, {side('d', 'documents', 'doc_id')}, scored as (select item_id, doc_id, sum(b.w * d.w) as score from b join d using (bucket) group by 1, 2)"


def merge_sql() -> str:
    """Neighbours join while the buffer is under 200 characters: a recursive walk over the paragraphs."""
    return (
        f"with recursive c as ({PARAGRAPHS}), walk as (select context_id, chunk_idx, text as buf, 0 as out_idx from c where chunk_idx = 0 union all "
        "select c.context_id, c.chunk_idx, case when length(w.buf) < 200 then w.buf || chr(10) || chr(10) || c.text else c.text end, case when length(w.buf) < 200 then w.out_idx else w.out_idx + 1 end from walk w join c on c.context_id = w.context_id and c.chunk_idx = w.chunk_idx + 1) "
        "select context_id, out_idx::int as chunk_idx, length(buf)::int as n, md5(buf) as h from (select context_id, out_idx, max_by(buf, chunk_idx) as buf from walk group by 1, 2)"
    )


def message_sql() -> str:
    return (
        "with m as (select conv_id, turn, case when turn % 3 = 0 then 'system' else role end as role, text from conversations) "
        "select conv_id as context_id, md5(coalesce(min_by(text, turn) filter (role = 'user' and text <> ''), 'Process the context.')) as question, md5(string_agg(text, chr(10) || chr(10) order by turn) filter (role = 'system')) as context from m group by conv_id having count(*) filter (role = 'system') > 0"
    )


def greedy_sql() -> str:
    """First fit in order of length: a recursive walk that takes what still fits."""
    return (
        f"with recursive c as ({PARAGRAPHS}), o as (select context_id, chunk_idx, greatest(1, length(text) // 4) as tok, row_number() over (partition by context_id order by -length(text), chunk_idx) as r from c), "
        "walk as (select distinct context_id, 0::bigint as r, 0::bigint as used, '' as picked from o union all select o.context_id, o.r, case when w.used + o.tok <= 300 then w.used + o.tok else w.used end, "
        "case when w.used + o.tok <= 300 then w.picked || case when w.picked = '' then '' else ',' end || o.chunk_idx else w.picked end from walk w join o on o.context_id = w.context_id and o.r = w.r + 1) "
        "select context_id, max_by(picked, r) as picked, max(used)::int as tokens from walk group by context_id"
    )


def ttl_sql() -> str:
    return (
        "with recursive t as (select user_id, epoch(ts)::double as x, row_number() over (partition by user_id order by ts) as r from events), "
        "walk as (select user_id, r, x as set_at, 0 as hits, 1 as misses from t where r = 1 union all select t.user_id, t.r, case when t.x - w.set_at <= 3600 then w.set_at else t.x end, "
        "w.hits + (t.x - w.set_at <= 3600)::int, w.misses + (t.x - w.set_at > 3600)::int from walk w join t on t.user_id = w.user_id and t.r = w.r + 1) select user_id, max_by(hits, r)::int as hits, max_by(misses, r)::int as misses from walk group by user_id"
    )


def summary_sql(limit: int) -> str:
    return (
        "with recursive s0 as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as s from documents), "
        "walk as (select doc_id, s, 0 as i, '' as summary, 0::bigint as n from s0 union all select doc_id, s, i + 1, case when n > 0 then summary || ' ' || s[i + 1] else s[i + 1] end, n + length(s[i + 1]) + (n > 0)::int from walk "
        f"where i < len(s) and n < {limit} and not (n > 0 and n + length(s[i + 1]) + 1 > {limit})) select doc_id, max_by(summary, i) as summary from walk group by doc_id"
    )


def budget_sql(tokens: int) -> str:
    return (
        bm25_sql(QUESTIONS).replace("with ", "with recursive ", 1)
        + ", nm as (select query_id, chunk_idx, bm25 / max(bm25) over (partition by query_id) as s from bm25), tp as (select query_id, chunk_idx, round(s, 6) as s, row_number() over (partition by query_id order by round(s, 6) desc, chunk_idx) as r from nm where s >= 0.15), "
        "it as materialized (select query_id, chunk_idx, r, greatest(1, length(text) // 4) as tok from tp join documents on doc_id = chunk_idx), "
        "walk as (select query_id, 0::bigint as r, 0::bigint as used, 0 as kept, '' as ids from q union all select i.query_id, i.r, w.used + case when w.used + i.tok <= {n} then i.tok else 0 end, w.kept + (w.used + i.tok <= {n})::int, "
        "case when w.used + i.tok <= {n} then w.ids || case when w.ids = '' then '' else ',' end || i.chunk_idx else w.ids end from walk w join it i on i.query_id = w.query_id and i.r = w.r + 1), "
        "fin as (select query_id, max(kept) as kept, max(used) as used, max_by(ids, r) as ids from walk group by query_id), al as (select count(*) as total, sum(greatest(1, length(text) // 4))::bigint as b from documents) "
        "select query_id, kept::int as kept, total, b as tokens_before, used::int as tokens_after, ids as doc_ids, round(greatest(0.0, (b - used) / b * 100.0), 4) as reduction_pct from fin, al where kept > 0".replace("{n}", str(tokens))
    )


# --- chunks of texts made from the order tables ---------------------------------------------------------------------

_HEADER = quoted("^\\s*" + lex.LEGAL_HEADER)
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _lines(text: str, each: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda ln: {each}), chr(10))"


def _opened(text: str) -> str:
    """A blank line before every header."""
    line = "regexp_replace(ln, '\\s+$', '')"
    return _lines(_STRIP.format(text), f"case when regexp_matches({line}, {_HEADER}) then chr(10) || {line} else {line} end")


def _unwrapped(text: str) -> str:
    joined = f"regexp_replace({_lines(text, _STRIP.format('ln'))}, '\\n{{2,}}', chr(1), 'g')"
    return _STRIP.format(f"replace(replace({joined}, chr(10), ' '), chr(1), chr(10) || chr(10))")


def headers(text: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted('(?m)^' + chr(92) + 's*' + lex.LEGAL_HEADER)}))"


def _walk(name: str, source: str, goes_on: str) -> str:
    """name(key, idx, text): a recursive walk over source that joins neighbours while goes_on."""
    return (
        f"{name}_w as (select key, idx, text as buf, 0 as out from {source} where idx = 0 union all select c.key, c.idx, case when {goes_on} then w.buf || chr(10) || chr(10) || c.text else c.text end, "
        f"case when {goes_on} then w.out else w.out + 1 end from {name}_w w join {source} c on c.key = w.key and c.idx = w.idx + 1), "
        f"{name} as (select key, out as idx, max_by(buf, idx) as text from {name}_w group by 1, 2)"
    )


def _numbered(name: str, source: str, pieces: str) -> str:
    return f"{name} as (select key, (i - 1)::int as idx, p[i] as text from (select key, p, unnest(range(1, len(p) + 1)) as i from (select key, list_filter({pieces}, lambda x: x <> '') as p from {source})))"


def chunks(source: str, least: int = 100, under: int = 200) -> str:
    """Chain from source(key, text) to chunked(key, idx, text): paragraphs, joined up to `least`, then up to `under`."""
    clean = f"regexp_replace({_STRIP.format('x')}, '[ \\t]+\\n', chr(10), 'g')"
    return ", ".join(
        [
            _numbered("para", source, f"list_transform(string_split_regex(text, '\\n\\s*\\n+'), lambda x: {clean})"),
            _walk("enough", "para", f"length(w.buf) < {least}"),
            f"tail as (select *, case when idx > 0 and idx = max(idx) over (partition by key) and length(text) < {least} then idx - 1 else idx end as into_ from enough)",
            "folded as (select key, into_ as idx, string_agg(text, chr(10) || chr(10) order by idx) as text from tail group by 1, 2)",
            _walk("chunked", "folded", f"length(w.buf) < {under}"),
        ]
    )


ROWS = "select key, idx::int as chunk_idx, length(text)::int as n, md5(text) as h from chunked"

CONTRACTS = (
    "orders_text as (select l_orderkey as key, string_agg('Section ' || l_linenumber || '. ' || repeat('goods ', (l_partkey % 30)::int) || chr(10) || 'supplier ' || l_suppkey || "
    "case when l_partkey % 3 = 0 then '  ' || chr(10) || chr(10) || 'and more' else '' end, chr(10) order by l_linenumber, l_partkey, l_suppkey) as text from lineitem group by 1)"
)

PROGRAMS = (
    "programs as (select l_orderkey as key, 'import os' || chr(10) || string_agg('def f' || l_partkey || '(x):' || chr(10) || repeat('    y = x + 1' || chr(10), (l_partkey % 60)::int) || '    return x' || chr(10), chr(10) "
    "order by l_linenumber, l_partkey, l_suppkey) as text from lineitem group by 1)"
)


def minimum_sql() -> str:
    return f"with recursive talk as (select conv_id as key, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id), {chunks('talk', 400, 0)} select key, idx::int as chunk_idx, length(text)::int as n, md5(text) as h from folded"


def dispatch_sql() -> str:
    """Contracts as legal, pdf or unnamed texts."""
    pdf = _unwrapped("text")
    return (
        f"with recursive {CONTRACTS}, flat as (select key, text, {pdf} as pdf from orders_text), "
        f"ready as (select key, case key % 3 when 0 then {_opened('text')} when 1 then case when {headers('pdf')} >= 4 then {_opened('pdf')} else pdf end "
        f"else case when {headers('text')} >= 4 then {_opened('text')} else text end end as text from flat), {chunks('ready')} {ROWS}"
    )


def program_sql() -> str:
    border = quoted(r"^(?:import |from |@|(?:def|class)\s+[A-Za-z_]\w*\b)")
    marked = _lines("regexp_replace(text, '\\n+$', '')", f"case when regexp_matches(ln, {border}) then chr(1) || ln else ln end")
    blocks = _numbered("block", "programs", f"list_transform(string_split({marked}, chr(1)), lambda x: regexp_replace(x, '\\s+$', ''))")
    return f"with recursive {PROGRAMS}, {blocks}, {_walk('chunked', 'block', 'length(w.buf) < 1800 and length(w.buf) + 2 + length(c.text) <= 2070')} {ROWS}"


def kinds_sql() -> str:
    indented = "len(list_filter(string_split(text, chr(10)), lambda ln: starts_with(ln, '    ') or starts_with(ln, chr(9))))"
    python = f"len(regexp_extract_all(text, {quoted(lex.PYTHON_DEFINITION)})) >= 1 and {indented} >= 2"
    return f"with {CONTRACTS}, {PROGRAMS}, both_ as (select key, 'contract' as made, text from orders_text union all select key, 'program', text from programs) select key, made, {headers('text')} >= 4 as legal, {python} as python from both_"


def page_sql() -> str:
    """Pages without the tags that are passed over, the first article (or main, or body), a line for each piece of text."""
    from tamis.sources.loaders import SKIPPED_TAGS

    bare = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in sorted(SKIPPED_TAGS):
        bare = f"regexp_replace({bare}, '(?s)<{tag}(?:\\s[^>]*)?>.*?</{tag}>', '<x>', 'g')"
    part = "case " + " ".join(f"when regexp_matches(bare, '<{tag}[ >]') then regexp_extract(bare, '(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)" for tag in ("article", "main", "body")) + " else bare end"
    pieces = f"list_filter(list_transform(string_split_regex(part, '<[^>]*>'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
    text = f"array_to_string({pieces}, chr(10))"
    for name, sign in (("quot", '"'), ("middot", "\u00b7"), ("copy", "\u00a9"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{sign}')"
    return f"select page_id, {text} as text from (select page_id, {part} as part from (select page_id, {bare} as bare from pages))"


def search_sql(terms: list[str], top_k: int) -> str:
    """Symbols and files of the part tables that hold a term, and the files one hop from them."""
    hits = lambda c: " + ".join(f"contains(lower({c}), {quoted(x)})::int" for x in terms)
    return (
        "with syms as (select 'y' || p_partkey as id, p_name as name, 'p' || p_partkey as path, p_size as start_line, p_size + 1 as end_line from part), "
        "e as (select distinct 'p' || l_partkey as src, 'p' || l_suppkey as dst from lineitem), "
        f"s as (select 'symbol' as kind, id, {hits('name')} + 1.0::double as score from syms where {hits('name')} > 0 union all select 'file', path, ({hits('path')}) * 0.7::double from syms where {hits('path')} > 0), "
        f"seeds as (select * from s order by score desc, kind, id limit {max(5, top_k)}), picked as (select syms.*, score from seeds join syms using (id) where kind = 'symbol'), "
        "start as (select node, max(score) as score from (select id as node, score from seeds where kind = 'file' union all select path, score * 0.5 from picked) group by 1), "
        "hop as (select dst as node, greatest(0.25, max(score) * 0.5) as score from start join e on e.src = start.node where dst not in (select node from start) group by 1), "
        "found as (select 'symbol' as kind, path, name, score, start_line, end_line from picked union all select 'file', node, node, score, null, null from (select * from start union all select * from hop)) "
        f"select * from found order by kind desc, score desc, path, start_line limit {top_k}"
    )
