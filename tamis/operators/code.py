"""Source trees as graphs: symbols, imports, calls, search with hops, incremental updates.

files: (path, text) with paths relative to the root.  Parsing runs in Arrow batches; names are resolved by joins
on the file list, so no task looks at a disk."""

from __future__ import annotations

import ast
import posixpath
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import text as t

# What counts as an import of a script, and the extensions that are tried.
JS_IMPORT = re.compile(r"^\s*import[\s\w{},*]+from\s+[\"']([^\"']+)[\"']", re.MULTILINE)
JS_EXT = (".ts", ".tsx", ".js", ".jsx")
FACTS = "path string, fact string, name string, kind string, first int, last int, ord int"


def _python_facts(path: str, text: str):
    """Rows of symbols, module candidates and calls of one file; nothing if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    here = posixpath.dirname(path)
    n = 0
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield "symbol", node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno or node.lineno, 0
        elif isinstance(node, ast.Import):
            for alias in node.names:
                n += 1
                base = alias.name.replace(".", "/")
                yield "import", base + ".py", "", n, 0, 0
                yield "import", base + "/__init__.py", "", n, 0, 1
        elif isinstance(node, ast.ImportFrom) and node.module:
            # names without dots count from the file's own folder, as relative ones do
            n += 1
            base = here
            for _ in range(max(0, (node.level or 0) - 1)):
                base = posixpath.dirname(base)
            base = posixpath.join(base, node.module.replace(".", "/"))
            yield "import", base + ".py", "", n, 0, 0
            yield "import", base + "/__init__.py", "", n, 0, 1
    todo = [(tree, ())]
    while todo:
        node, scope = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = (*scope, child.name) if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else scope
            if isinstance(child, ast.Call):
                yield "call", ast.unparse(child.func), ".".join(scope) or "<module>", child.lineno, child.col_offset, 0
            todo.append((child, inner))


def _js_facts(path: str, text: str):
    for n, m in enumerate(JS_IMPORT.finditer(text)):
        spec = m.group(1)
        if spec.startswith("."):
            base = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
            stem = posixpath.splitext(base)[0]
            for i, name in enumerate([stem + e for e in JS_EXT] + [f"{base}/index{e}" for e in JS_EXT]):
                yield "import", name, "", n, 0, i


def facts(files: DataFrame) -> DataFrame:
    """(path, fact, name, kind, first, last, ord): symbols, import candidates (ord: order of trial) and calls."""

    def body(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ext = posixpath.splitext(path)[1].lower()
                found = _python_facts(path, text or "") if ext == ".py" else _js_facts(path, text or "") if ext in JS_EXT else ()
                rows += [(path, *x) for x in found]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string()] * 4 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "fact", "name", "kind", "first", "last", "ord"])

    return files.select("path", "text").mapInArrow(body, FACTS)


def symbols(found: DataFrame) -> DataFrame:
    rows = found.filter("fact = 'symbol'").select("path", "name", "kind", F.col("first").alias("start_line"), F.col("last").alias("end_line"))
    return rows.withColumn("id", t.symbol_id(F.col("path"), F.col("name"), F.col("kind"), F.col("start_line"), F.col("end_line")))


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): the first candidate of each import that is a file."""
    rows = found.filter("fact = 'import'").join(files.select(F.col("path").alias("name")), "name")
    best = rows.groupBy("path", F.col("first").alias("n")).agg(F.min_by("name", "ord").alias("dst"))
    return best.select(F.col("path").alias("src"), "dst").distinct()


def call_edges(found: DataFrame) -> DataFrame:
    return found.filter("fact = 'call'").select(F.lit("calls").alias("kind"), F.col("kind").alias("caller"), F.col("name").alias("callee"), "path", F.col("first").alias("line"), F.col("last").alias("col"))


def call_targets(calls: DataFrame, syms: DataFrame, max_targets: int = 3, max_edges_per_file: int = 400) -> DataFrame:
    """(src, dst) edges from calls to the files that define the name; ambiguous names give none."""
    where = syms.select("name", "path").distinct()
    clear = where.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= max_targets).select("name")
    targets = where.join(clear, "name").select(F.col("name").alias("base"), F.col("path").alias("dst"))
    rows = calls.select(F.col("path").alias("src"), t.callee_name(F.col("callee")).alias("base"), "line").join(targets, "base").filter("src <> dst")
    edges = rows.groupBy("src", "dst").agg(F.min("line").alias("line"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("line", "dst"))
    return edges.withColumn("r", rank).filter(F.col("r") <= max_edges_per_file).select("src", "dst")


def top_calls(calls: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    return calls.join(paths.select("path"), "path", "left_semi").orderBy("path", "line", "col").limit(limit)


def expand_hops(seeds: DataFrame, edges: DataFrame, hops: int = 1, share: float = 0.5, floor: float = 0.25) -> DataFrame:
    """(node, score, hop): seeds (node, score), then for each hop the new neighbours with the best parent's share.

    A node keeps the score of its earliest hop; each hop is one join of the frontier with the edges."""
    reached = seeds.groupBy("node").agg(F.max("score").alias("score")).withColumn("hop", F.lit(0))
    frontier = reached
    for h in range(1, hops + 1):
        step = frontier.join(edges.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.greatest(F.lit(floor), F.max("score") * share).alias("score"))
        frontier = step.join(reached.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        reached = reached.unionByName(frontier)
    return reached


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1, imports: bool = True, importers: bool = False, importers_from_all: bool = False) -> DataFrame:
    """Imports first; then importers, from the seeds or (in search) from all that was reached."""
    out = expand_hops(seeds, edges, hops) if imports else expand_hops(seeds, edges, 0)
    if importers:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = out.select("node", "score") if importers_from_all else out.filter("hop = 0").select("node", "score")
        more = expand_hops(start, back, hops, 0.4, 0.2).filter("hop > 0")
        out = out.unionByName(more.join(out.select("node"), "node", "left_anti"))
    return out


def graph_search(query: str, syms: DataFrame, files: DataFrame, edges: DataFrame, top_k: int = 20, hops: int = 1, importers: bool = False) -> DataFrame:
    """(kind, path, name, score, start_line, end_line): symbols first, then files of seeds and hops, top_k in all."""
    spark = files.sparkSession
    q = spark.createDataFrame([(query,)], "q string").select(F.filter(F.split(F.lower("q"), r"[^a-z0-9_./-]+"), lambda x: x != "").alias("terms"))
    hits = lambda c: F.size(F.filter("terms", lambda x: F.contains(F.lower(F.col(c)), x)))
    one = F.broadcast(q)  # one row
    s = syms.join(one).withColumn("h", hits("name")).filter("h > 0").select(F.lit("symbol").alias("kind"), "id", (F.col("h") + 1.0).alias("score"))
    f = files.select("path").join(one).withColumn("h", hits("path")).filter("h > 0").select(F.lit("file").alias("kind"), F.col("path").alias("id"), (F.col("h") * 0.7).alias("score"))
    seeds = s.unionByName(f).orderBy(F.desc("score"), "kind", "id").limit(max(5, top_k))
    picked = seeds.filter("kind = 'symbol'").select("id", "score").join(syms, "id")
    start = seeds.filter("kind = 'file'").select(F.col("id").alias("node"), "score").unionByName(picked.select(F.col("path").alias("node"), (F.col("score") * 0.5).alias("score")))
    reached = expand(start, edges, hops, True, importers, importers_from_all=True)
    cols = ["kind", "path", "name", "score", "start_line", "end_line"]
    first = picked.select(F.lit("symbol").alias("kind"), "path", "name", "score", "start_line", "end_line")
    second = reached.select(F.lit("file").alias("kind"), F.col("node").alias("path"), F.col("node").alias("name"), "score", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return first.unionByName(second).orderBy(F.desc("kind"), F.desc("score"), "path", "start_line").limit(top_k).select(cols)


def fingerprint_diff(before: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): new, changed, deleted or same, by a full join of fingerprints (all columns but the key)."""
    facts_of = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    rows = facts_of(before, "a").join(facts_of(now, "b"), key, "full_outer")
    return rows.select(key, F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed").alias("change"))


def update_records(records: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Index rows after an update: those of unchanged files, and the fresh rows of new and changed ones."""
    return records.join(changes.filter("change <> 'same'").select(key), key, "left_anti").unionByName(fresh)


def module_counts(paths: DataFrame, limit: int = 20) -> DataFrame:
    return paths.groupBy(t.top_directory(F.col("path")).alias("module")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "module").limit(limit)
