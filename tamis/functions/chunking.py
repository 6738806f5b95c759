"""Segmentation of text into chunks, as folds over arrays inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.lexicon import LEGAL_HEADER, PYTHON_DEFINITION
from tamis.functions.text import strip

GAP = "\n\n"


def clean(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"[ \t]+\n", "\n")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), clean), lambda c: c != "")


def plain_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), strip), lambda c: c != "")


def _fold(chunks: Column, goes_on, close) -> Column:
    """Join neighbours while goes_on(buffer length, next); close(out, buffer, length) ends the list."""
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("n"))

    def merge(a: Column, c: Column) -> Column:
        first = a["buf"].isNull()
        joins = ~first & goes_on(a["n"], c)
        return F.struct(
            F.when(first | joins, a["out"]).otherwise(F.concat(a["out"], F.array(strip(a["buf"])))).alias("out"),
            F.when(joins, F.concat(a["buf"], F.lit(GAP), c)).otherwise(c).alias("buf"),
            F.when(joins, a["n"] + 2 + F.length(c)).otherwise(F.length(c)).alias("n"),
        )

    return F.aggregate(chunks, empty, merge, lambda a: F.when(a["buf"].isNull(), a["out"]).otherwise(close(a["out"], a["buf"], a["n"])))


def _append(out: Column, buf: Column, n: Column) -> Column:
    return F.concat(out, F.array(strip(buf)))


def merge_to_minimum(chunks: Column, min_chars: int = 40) -> Column:
    """Join neighbours until a chunk has min_chars; a short tail folds into the chunk before it."""
    if min_chars <= 0:
        return chunks

    def close(out: Column, buf: Column, n: Column) -> Column:
        tail = F.concat(F.element_at(out, -1), F.lit(GAP), strip(buf))
        return F.when((n >= min_chars) | (F.size(out) == 0), F.concat(out, F.array(strip(buf)))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(tail)))

    return _fold(chunks, lambda n, c: n < min_chars, close)


def merge_under(chunks: Column, under: int = 200) -> Column:
    """A chunk under so many characters takes the next one; the tail stays."""
    return chunks if under <= 0 else _fold(chunks, lambda n, c: n < under, _append)


def chunk_text(text: Column, min_chars: int = 100, under: int = 200) -> Column:
    return merge_under(merge_to_minimum(paragraphs(text), min_chars), under)


def looks_legal(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^\s*" + LEGAL_HEADER)) >= 4


def looks_python(text: Column) -> Column:
    indented = F.size(F.filter(F.split(text, "\r\n|\n|\r"), lambda ln: ln.startswith("    ") | ln.startswith("\t")))
    return (F.regexp_count(text, F.lit(PYTHON_DEFINITION)) >= 1) & (indented >= 2)


def headers_apart(text: Column) -> Column:
    """A blank line before every header, so that it opens a paragraph of its own."""
    lines = F.transform(F.split(strip(text), "\r\n|\n|\r"), lambda ln: F.regexp_replace(ln, r"\s+$", ""))
    return F.array_join(F.transform(lines, lambda ln: F.when(ln.rlike(r"^\s*" + LEGAL_HEADER), F.concat(F.lit("\n"), ln)).otherwise(ln)), "\n")


def chunk_legal(text: Column, min_chars: int = 100, under: int = 200) -> Column:
    """Headers apart, then the rules for all texts (packing to a target size has no net effect)."""
    return chunk_text(headers_apart(text), min_chars, under)


def unwrap_pdf(text: Column) -> Column:
    """Lines of a paragraph joined by blanks; paragraphs stay apart."""
    lines = F.transform(F.split(text, "\r\n|\n|\r"), strip)
    joined = F.array_join(lines, "\n")
    joined = F.regexp_replace(joined, r"\n{2,}", "\u0000")
    return F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(joined, "\n", " "), "\u0000", GAP)), r"^(?:\n)+|(?:\n)+$", "")


def chunk_python(text: Column, target: int = 1800) -> Column:
    """Top-level import, decorator, def and class lines open blocks; huge comment tails part; blocks pack to the target."""
    lines = F.split(F.regexp_replace(text, "\n+$", ""), "\r\n|\n|\r")
    border = r"^(?:import |from |@|(?:def|class)\s+[A-Za-z_]\w*\b)"
    # a border line closes the block before it: mark it, then split on the mark
    marked = F.array_join(F.transform(lines, lambda ln: F.when(ln.rlike(border), F.concat(F.lit("\u0001"), ln)).otherwise(ln)), "\n")
    blocks = F.transform(F.split(marked, "\u0001"), lambda b: F.regexp_replace(b, r"\s+$", ""))
    blocks = F.filter(blocks, lambda b: strip(b) != "")

    def parted(b: Column) -> Column:
        bl = F.split(b, "\n")
        run = F.aggregate(F.reverse(bl), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, ln: F.struct((a["n"] + F.when(a["on"] & ln.rlike(r"^ {0,3}#"), 1).otherwise(0)).alias("n"), (a["on"] & ln.rlike(r"^ {0,3}#")).alias("on")), lambda a: a["n"])
        tail = (F.size(bl) >= 120) & (run >= 80) & (run < F.size(bl))
        head = F.regexp_replace(F.array_join(F.slice(bl, 1, F.greatest(F.size(bl) - run, F.lit(1))), "\n"), r"\s+$", "")
        rest = F.array_join(F.slice(bl, F.size(bl) - run + 1, F.greatest(run, F.lit(1))), "\n")
        return F.when(tail, F.filter(F.array(head, rest), lambda x: strip(x) != "")).otherwise(F.array(b))

    blocks = F.flatten(F.transform(blocks, parted))
    target = max(800, target)
    limit = int(target * 1.15)
    return _fold(blocks, lambda n, c: (n < target) & (n + 2 + F.length(c) <= limit), _append)


def smart_chunks(text: Column, doc_type: Column, min_chars: int = 100, under: int = 200) -> Column:
    """By document type: code, legal or contract, pdf, auto (legal, then code, then paragraphs).

    All but code differ in how the text is made ready, so the folds stand in the plan once. A text that is not blank
    has a paragraph, and so a chunk."""
    kind = F.lower(F.coalesce(doc_type, F.lit("auto")))
    pdf, auto = unwrap_pdf(text), kind == "auto"
    legal = kind.isin("legal", "contract") | (auto & looks_legal(text))
    ready = F.when(legal, headers_apart(text)).when((kind == "pdf") & looks_legal(pdf), headers_apart(pdf)).when(kind == "pdf", pdf).otherwise(text)
    return F.when((kind == "code") | (auto & ~legal & looks_python(text)), chunk_python(text)).otherwise(chunk_text(ready, min_chars, under))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def summary(text: Column, max_chars: Column) -> Column:
    """Leading whole sentences up to max_chars; the first one stays even if it is longer."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def add(a: Column, s: Column) -> Column:
        extra = F.length(s) + F.when(a["n"] > 0, 1).otherwise(0)
        stop = a["done"] | ((a["n"] > 0) & (a["n"] + extra > max_chars))
        n = a["n"] + extra
        return F.struct(
            F.when(stop, a["out"]).when(a["n"] > 0, F.concat(a["out"], F.lit(" "), s)).otherwise(s).alias("out"),
            F.when(stop, a["n"]).otherwise(n).alias("n"),
            (stop | (n >= max_chars)).alias("done"),
        )

    return F.when(max_chars <= 0, F.lit("")).otherwise(F.aggregate(sentences(text), empty, add, lambda a: a["out"]))
