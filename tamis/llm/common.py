"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id gives -1, so it is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % m, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):  # one machine: its folder is shared by all threads
        return tempfile.mkdtemp(prefix="tamis-checkpoints-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through spark.checkpoint.dir; a folder of our own is set only in local mode where none is named.

    Spark removes the shuffle files of a step that is done when the driver collects the garbage of its plan (in Python,
    then in the JVM), which may be long after; asked for here, only those of the last steps take disk."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint(eager=True)
    gc.collect()
    sc._jvm.System.gc()
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, n_bytes: int) -> int:
    """Partitions of an exchange that carries n_bytes: the session's number, more where they would pass 64 MB each."""
    return max(shuffle_partitions(spark), min(-(-int(n_bytes) // 64_000_000), 100_000))


def bounded_sample(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """min(rows, limit) rows in the order of their key's hash, the same at every run. Keys must be distinct: each
    task keeps its own first `limit` rows and these are merged, so no full sort takes place."""
    return rows.orderBy(F.xxhash64(key, F.lit(7)), key).limit(limit)


def sampled_texts(rows: DataFrame, limit: int, max_bytes: int, by: list[str] | None = None) -> DataFrame:
    """(by.., text): whole texts of rows (by.., text) to learn from, distinct ones, for each value of `by` at most
    `limit` of them and max_bytes in all, in the order of their hashes; where the first alone is larger, the
    shortest of the chosen ones.  Copies count once, so a text that fills the table takes one place."""
    by = by or []
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(7)))
    each = checkpointed(hashed.groupBy(*by, "h").agg(F.max(F.octet_length("text")).alias("size")))
    # hashes of distinct texts are even: about 1.5 * limit + 100 of a group lie below this bound, so few are ranked
    share = F.least(F.lit(1.0), F.lit(1.5 * limit + 100) / F.col("n"))
    counts = each.groupBy(*by).agg(F.count("*").alias("n"))
    sized = each.join(F.broadcast(counts), by) if by else each.crossJoin(F.broadcast(counts))  # a row for each group
    low = sized.filter(F.pmod(F.col("h"), F.lit(1 << 40)) <= share * F.lit(float(1 << 40))).drop("n")
    place = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    first = low.withColumn("rank", F.row_number().over(place.orderBy(F.pmod("h", F.lit(1 << 40)), "h"))).filter(F.col("rank") <= limit)
    total = F.sum("size").over(place.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    shortest = F.row_number().over(place.orderBy("size", "rank"))
    inside = first.withColumn("upto", total).withColumn("short", shortest).withColumn("least", F.min("upto").over(place))
    chosen = inside.filter((F.col("upto") <= max_bytes) | ((F.col("least") > max_bytes) & (F.col("short") == 1))).select(*by, "h")
    # at most `limit` rows of a few numbers for each value of `by`
    return hashed.join(F.broadcast(chosen), [*by, "h"]).groupBy(*by, "h").agg(F.min("text").alias("text")).drop("h")


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, hot: int = 1000) -> DataFrame:
    """rows joined with the unique keys of `keyed`, whose column `count` tells how many rows have the key.

    Keys with over a `hot`-th of all rows (so fewer than `hot` of them) are broadcast, and no key of the other
    rows can fill a task."""
    total = keyed.agg(F.sum(count).alias("n")).first()["n"] or 0
    many = F.col(count) > max(total // hot, 1000)
    few = keyed.filter(many)
    crowded = rows.join(F.broadcast(few.drop(count)), on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(keyed.filter(~many).drop(count), on)
    return crowded.unionByName(rest)


def runs(batches, key: str):
    """Tables of equal key from a stream of Arrow batches that is sorted by it; a run may span batches.

    Only one run is held at a time, so its size must be bounded by how the key was made."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b < len(k):
                yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
                held = []
            else:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): connected components of an edge list (a, b), the component named by its smallest node.

    Alternating large-star and small-star steps; each step moves every edge towards the smallest known
    neighbour, so the edges never grow in number beyond the first list and a star is reached in O(log n) rounds.
    Lineage is cut through the checkpoint folder."""
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
