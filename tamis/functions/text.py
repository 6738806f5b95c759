"""Text functions as Column expressions: tokens, stems, n-grams, token estimates, ids, vectors, previews."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.lexicon import DERIVED, ENDINGS, STOP_WORDS

WORD = "[a-z0-9]+"
EMBED_WORD = "[a-z0-9_]{2,}"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def embed_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(EMBED_WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends (all of it, not blanks alone)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def content_words(tokens: Column) -> Column:
    """Tokens of two letters or more that are no stop words."""
    return F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    """max(1, floor(characters / chars_per_token))."""
    if chars_per_token <= 0:
        raise ValueError("chars_per_token must be above 0")
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(float(chars_per_token))).cast("int"))


def token_estimate_of_length(n: Column, chars_per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.floor(n / F.lit(float(chars_per_token))).cast("int"))


def exact_tokens(encode):
    """A function of a text column: the number of tokens that `encode`, from a text to a list, gives. Runs in Arrow batches."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda x: len(encode(x))).astype("int32")

    return count


def measure(w: Column) -> Column:
    """Changes from a vowel to another letter."""
    return ((F.length(w) - F.length(F.regexp_replace(w, "[aeiou][^aeiou]", ""))) / 2).cast("int")


def _head(w: Column, cut: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - cut)


def _has_vowel(w: Column) -> Column:
    return w.rlike("[aeiou]")


def _twin(w: Column) -> Column:
    """Ends in a doubled letter that is no vowel."""
    return (F.length(w) >= 2) & (F.right(w, F.lit(1)) == F.substring(w, -2, 1)) & ~F.right(w, F.lit(1)).rlike("[aeiou]")


def stem(word: Column) -> Column:
    """Suffix stripping in seven steps.

    Every step is a lambda over an array of one word, so a step names its input once however often it looks at it:
    the expression grows by its steps, not by their product, and a filter on the stem can move without blowing up."""
    plain = F.trim(F.lower(word))
    state = F.array(F.struct(plain.alias("w"), F.lit(0).alias("cut")))

    def step(value):
        nonlocal state
        state = F.transform(state, lambda s: F.struct(value(s["w"], s["cut"]).alias("w"), s["cut"].alias("cut")))

    step(lambda w, _: F.when(w.endswith("sses") | (w.endswith("ies") & (F.length(w) > 4)), _head(w, 2)).when(w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us"), _head(w, 1)).otherwise(w))
    # past tense and gerund: how much goes, then what is left is cleaned up
    cut = lambda w: F.when(w.endswith("eed"), 0).when(w.endswith("ed") & _has_vowel(_head(w, 2)), 2).when(w.endswith("ing") & _has_vowel(_head(w, 3)), 3).otherwise(0)
    state = F.transform(state, lambda s: F.struct(s["w"].alias("w"), cut(s["w"]).alias("cut")))
    step(lambda w, k: F.when(w.endswith("eed") & (measure(_head(w, 3)) > 0), _head(w, 1)).otherwise(F.substring(w, F.lit(1), F.length(w) - k)))
    step(
        lambda w, k: F.when(k == 0, w)
        .when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(_twin(w) & ~F.right(w, F.lit(1)).isin("l", "s", "z"), _head(w, 1))
        .when(_closed(w), F.concat(w, F.lit("e")))
        .otherwise(w)
    )
    step(lambda w, _: F.when(w.endswith("y") & (F.length(w) > 2) & _has_vowel(_head(w, 1)), F.concat(_head(w, 1), F.lit("i"))).otherwise(w))

    # of two listed suffixes that fit, the longer stands first in the list, as it does in a match
    to = F.create_map(*[F.lit(x) for pair in DERIVED for x in pair])
    derived_end = "(" + "|".join(a for a, _ in DERIVED) + ")$"
    plain_end = "(" + "|".join(ENDINGS) + ")$"

    def derived(w: Column, _: Column) -> Column:
        base = F.regexp_replace(w, derived_end, "")
        return F.when(w.rlike(derived_end) & (measure(base) > 0), F.concat(base, F.coalesce(F.element_at(to, F.regexp_extract(w, derived_end, 1)), F.lit("")))).otherwise(w)

    def ending(w: Column, _: Column) -> Column:
        base = F.regexp_replace(w, plain_end, "")
        return F.when(w.rlike(plain_end) & (measure(base) > 1), base).otherwise(w)

    step(derived)
    step(ending)
    step(lambda w, _: F.when(w.endswith("e") & ((measure(_head(w, 1)) > 1) | ((measure(_head(w, 1)) == 1) & ~_head(w, 1).rlike("[^aeiou][aeiou][^aeiou]$"))), _head(w, 1)).otherwise(w))
    step(lambda w, _: F.when(_twin(w) & ~F.right(w, F.lit(1)).isin("l", "s", "z") & (measure(_head(w, 1)) > 1), _head(w, 1)).otherwise(w))
    # no step changes a word that ends in none of the listed suffixes, s, ed, ing, y, e or a doubled consonant
    touched = r"(?:s|ed|ing|y|e|([^aeiou])\1|" + "|".join([a for a, _ in DERIVED] + ENDINGS) + ")$"
    return F.when((F.length(plain) <= 2) | ~plain.rlike(touched), plain).otherwise(F.get(state, F.lit(0))["w"])


def stems(vocabulary: DataFrame, column: str = "word") -> DataFrame:
    """vocabulary with a column `stem`. Meant for distinct words: stem once, then join back.

    The stem comes out of an explode of one value, so that a filter on it stays above: pushed down as an expression
    of the word it would run on every occurrence instead of every distinct word."""
    return vocabulary.select("*", F.explode(F.array(stem(F.col(column)))).alias("stem"))


def _closed(w: Column) -> Column:
    """One change to a consonant, and consonant, vowel, consonant at the end."""
    return (measure(w) == 1) & w.rlike("[^aeiou][aeiou][^aeiou]$")


def grams(w: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a word; a shorter word is its own."""
    return F.when(F.length(w) < n, F.array(w)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def token_hash(token: Column) -> Column:
    """The first eight bytes of the md5 as an unsigned number."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(token: Column, dims: int = 256) -> Column:
    return (token_hash(token) % F.lit(dims)).cast("int")


def sign(token: Column) -> Column:
    return F.when(token_hash(token) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; vectors of different length are an error."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors must have the same length")).cast("double"))
    return F.coalesce(same, F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0)))


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def md5_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def key_hash(*parts: Column) -> Column:
    """Cache key: the first 24 digits of the sha256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 24)


def symbol_id(path: Column, name: Column, kind: Column, start: Column, end: Column) -> Column:
    return F.sha1(F.concat_ws(":", path, name, kind, start.cast("string"), end.cast("string")).cast("binary"))


def contains_any(text: Column, needles: Column) -> Column:
    return F.coalesce(F.exists(needles, lambda n: (F.length(n) > 0) & F.contains(F.lower(text), F.lower(n))), F.lit(False))


def mentions(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def query_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"[^a-z0-9_./-]+"), lambda t: t != "")


def preview(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.regexp_replace(F.left(text, F.lit(chars)), r"\s+$", ""), F.lit("\n..."))).otherwise(text)


def span_preview(text: Column, start: Column, end: Column, max_lines: int) -> Column:
    """Lines start..end (from 1, clamped), at most max_lines and then `...`."""
    lines = F.split(text, "\n")
    s = F.least(F.greatest(start, F.lit(1)), F.size(lines))
    e = F.least(F.greatest(end, s), F.size(lines))
    span = F.slice(lines, s, F.least(e - s + 1, F.lit(max_lines)))
    body = F.array_join(F.when(e - s + 1 > max_lines, F.concat(span, F.array(F.lit("...")))).otherwise(span), "\n")
    return F.when((start <= 0) | (end <= 0), F.lit("")).otherwise(strip(body))


def file_preview(text: Column, query: Column, max_lines: int) -> Column:
    """Up to max_lines lines with a term of the query, or else the first lines."""
    lines = F.split(text, "\n")
    hits = F.filter(lines, lambda ln: F.exists(query_terms(query), lambda t: F.contains(F.lower(ln), t)))
    return strip(F.array_join(F.slice(F.when(F.size(hits) > 0, hits).otherwise(lines), 1, max_lines), "\n"))


def source_block(path: Column, body: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """`Source: path[:first[-last]]` and the body."""
    where = F.concat(F.lit("Source: "), path)
    if first is not None:
        where = F.concat(where, F.lit(":"), first.cast("string"))
    if last is not None:
        where = F.concat(where, F.lit("-"), last.cast("string"))
    return strip(F.concat(where, F.lit("\n"), body))


def callee_name(expression: Column) -> Column:
    """Base name of what a call calls: pkg.foo(x)[0] gives foo."""
    s = F.trim(F.coalesce(expression, F.lit("")))
    s = F.trim(F.substring_index(s, "(", 1))
    s = F.trim(F.substring_index(s, "[", 1))
    return F.regexp_replace(F.trim(F.substring_index(s, ".", -1)), "[^A-Za-z0-9_]+", "")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def top_directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(F.lit("."))
