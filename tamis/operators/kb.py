"""Line search over a text collection: matches with context lines, merged where they are close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import text as t
from tamis.operators.vectors import first_occurrences


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a literal in text, case folded, without overlap."""
    low, n = F.lower(text), needle.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("int")


def search_lines(files: DataFrame, query: str, max_matches: int = 30, context_lines: int = 1, case_sensitive: bool = False, group_adjacent: bool = True) -> DataFrame:
    """(path, line, preview, score) from files (path, text). Score: hits in the preview, 2 more if the file's name hits.

    Equal previews count once (the best ranked); the best max_matches are kept, then close ones of a file merge."""
    q = query.strip()
    if not q:
        return files.sparkSession.createDataFrame([], "path string, line int, preview string, score double")
    fold = (lambda c: c) if case_sensitive else F.lower
    needle = q if case_sensitive else q.lower()
    text = files.filter(~F.contains(F.col("text"), F.lit("\u0000"))).select("path", F.split("text", "\r\n|\n|\r").alias("lines"))
    # numbers of the lines that hit, and for these alone a slice of the lines around: no line carries its whole file
    numbered = F.transform("lines", lambda ln, i: F.when(F.contains(fold(ln), F.lit(needle)), i + 1))
    text = text.withColumn("hits", F.array_compact(numbered)).filter(F.size("hits") > 0)
    around = lambda i: F.slice("lines", F.greatest(i - context_lines, F.lit(1)), F.least(i + context_lines, F.size("lines")) - F.greatest(i - context_lines, F.lit(1)) + 1)
    spans = F.transform("hits", lambda i: F.struct(i.alias("line"), F.array_join(around(i), "\n").alias("preview")))
    rows = text.select("path", F.explode(spans).alias("x")).select("path", "x.line", t.strip(F.col("x.preview")).alias("preview"))
    body = F.col("preview") if case_sensitive else F.lower("preview")
    hits = ((F.length(body) - F.length(F.replace(body, F.lit(needle), F.lit("")))) / len(needle)).cast("double")
    name = F.contains(fold(F.substring_index("path", "/", -1)), F.lit(needle))
    rows = rows.select("path", "line", "preview", (hits + F.when(name, 2.0).otherwise(0.0)).alias("score")).withColumn("order", F.struct((-F.col("score")).alias("s"), "path", "line"))
    best = first_occurrences(rows, F.col("preview"), ["order"]).orderBy("order").limit(max_matches)
    if group_adjacent:
        best = merge_close(best, 2 * context_lines + 1)
    return best.select("path", "line", "preview", "score").orderBy(F.desc("score"), "path", "line")


def islands(rows: DataFrame, by: list[str], order: str, gap: int) -> DataFrame:
    """rows with `island`: a new one begins where the step from the row before is above gap."""
    w = Window.partitionBy(*by).orderBy(order)
    begins = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_b", begins).withColumn("island", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def merge_close(rows: DataFrame, gap: int) -> DataFrame:
    grouped = islands(rows, ["path"], "line", gap).groupBy("path", "island")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "preview"))), lambda x: x["preview"]), "\n...\n")
    return grouped.agg(F.min("line").alias("line"), joined.alias("preview"), F.max("score").alias("score")).drop("island")


def as_context(found: DataFrame) -> DataFrame:
    return found.withColumn("chunk", t.source_block(F.col("path"), F.col("preview"), F.col("line")))
