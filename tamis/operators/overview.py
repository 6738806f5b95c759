"""Vector index over files, and retrieval that joins vectors, graph and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as t
from tamis.operators import code, vectors
from tamis.sources import loaders

# Names of files where a program starts.
ENTRY_POINTS = ["__main__.py", "main.py", "cli.py", "app.py", "server.py", "manage.py"]


def fingerprint(embedder: str, dims: int) -> str:
    """Changes when vectors of an older index can no longer be compared: then the index is built anew."""
    import hashlib

    return hashlib.sha1(f"{embedder}:{dims}".encode()).hexdigest()


def build_records(files: DataFrame, dims: int = 256) -> DataFrame:
    """(id, path, chunk_hash, text, weights) of all chunks of files (path, text); weights are sparse."""
    rows = loaders.load_text(files).select("path", "chunk_idx", F.col("chunk").alias("text")).filter(t.strip(F.col("text")) != "")
    rows = rows.withColumn("chunk_hash", F.sha1(F.col("text").cast("binary"))).withColumn("id", F.sha1(F.concat_ws(":", "path", "chunk_hash").cast("binary")))
    rows = vectors.first_occurrences(rows, F.col("id"), ["path", "chunk_idx"])
    sparse = vectors.hash_weights(rows, ["id"], dims=dims).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("weights"))
    return rows.join(sparse, "id", "left").select("id", "path", "chunk_hash", "text", "weights")


def search_records(records: DataFrame, query: str, top_k: int = 20, min_score: float = 0.0, preview_chars: int = 800, dims: int = 256) -> DataFrame:
    """(path, score, id, preview) of the best chunks for one question."""
    q = vectors.hash_weights(records.sparkSession.createDataFrame([(1, query)], "q int, text string"), ["q"], dims=dims).select("bucket", F.col("weight").alias("qw"))
    hits = records.select("id", F.explode("weights").alias("bucket", "w")).join(F.broadcast(q), "bucket")  # at most dims rows
    scored = hits.groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("score")).filter(F.col("score") >= min_score)
    best = scored.join(records.select("id", "path", "text"), "id").orderBy(F.desc("score"), "path", "id").limit(top_k)
    return best.select("path", "score", "id", t.preview(F.col("text"), preview_chars).alias("preview"), "text")


def ordered_union(*parts: DataFrame) -> DataFrame:
    """(chunk, part, pos): rows (pos, chunk) of several lists, each stripped text once, at its first place."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), "pos", t.strip(F.col("chunk")).alias("chunk")).filter("chunk <> ''")
        rows = p if rows is None else rows.unionByName(p)
    return vectors.first_occurrences(rows, F.col("chunk"), ["part", "pos"]).orderBy("part", "pos")


def _ranked(df: DataFrame, order: list) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))  # a top-k list


def vector_graph_context(query: str, records: DataFrame, files: DataFrame, edges: DataFrame, top_k: int = 20, hops: int = 1, dims: int = 256) -> DataFrame:
    """(chunk, part, pos): the best chunks, then previews of the files that the graph reaches from them."""
    hits = search_records(records, query, top_k, dims=dims)
    first = _ranked(hits, [F.desc("score"), "path", "id"]).select("pos", t.source_block(F.col("path"), F.col("text")).alias("chunk"))
    seeds = hits.groupBy(F.col("path").alias("node")).agg(F.lit(1.0).alias("score"))
    reached = code.expand(seeds, edges, hops).orderBy(F.desc("score"), "node").limit(top_k)
    second = _ranked(reached.join(files.select(F.col("path").alias("node"), "text"), "node"), [F.desc("score"), "node"])
    second = second.select("pos", t.source_block(F.col("node"), t.file_preview(F.col("text"), F.col("node"), 80)).alias("chunk"))
    return ordered_union(first, second)


def project_overview(query: str, records: DataFrame, files: DataFrame, syms: DataFrame, edges: DataFrame, top_k: int = 20, dims: int = 256) -> dict:
    """Context and facts about a source tree: files by rank fusion of vector and graph hits, manifests, entry points, modules.

    A file may come once per chunk in a list and then gains by each, as in fusion by chunks."""
    hits = search_records(records, query, top_k, dims=dims)
    by_vector = _ranked(hits, [F.desc("score"), "path", "id"]).select(F.lit("vector").alias("list_id"), "pos", F.col("path").alias("key"))
    found = code.graph_search(query, syms, files, edges, top_k)
    by_graph = _ranked(found, [F.desc("kind"), F.desc("score"), "path", "start_line"]).select(F.lit("graph").alias("list_id"), "pos", F.col("path").alias("key"))
    fused = vectors.fused_order(vectors.fuse_rankings(by_vector.unionByName(by_graph)), top_k).select(F.col("key").alias("path"), "score")
    kept = _ranked(hits.join(fused.select("path"), "path", "left_semi"), [F.desc("score"), "path", "id"]).select("pos", t.source_block(F.col("path"), F.col("text")).alias("chunk"))
    reached = code.expand(fused.select(F.col("path").alias("node"), F.lit(1.0).alias("score")), edges, 1).orderBy(F.desc("score"), "node").limit(top_k)
    near = _ranked(reached.join(files.select(F.col("path").alias("node"), "text"), "node"), [F.desc("score"), "node"]).select("pos", t.source_block(F.col("node"), t.file_preview(F.col("text"), F.lit(query), 80)).alias("chunk"))
    manifests = _ranked(loaders.manifest_files(files), ["path"]).select("pos", t.source_block(F.col("path"), F.col("text")).alias("chunk"))
    name = F.lower(F.substring_index("path", "/", -1))
    starts = fused.filter(name.isin(*ENTRY_POINTS)).select("path").distinct().orderBy("path").limit(20)
    return {
        "files": fused,
        "context": ordered_union(kept, near, manifests),
        "entry_points": starts,
        "modules": code.module_counts(fused),
        "flows": edges.join(fused.select(F.col("path").alias("src")), "src", "left_semi").orderBy("src", "dst").limit(top_k),
    }
