"""Contiguous balanced shards from global byte-size prefix sums.

Rows are put in one global order (checksum of the text, id, size), so equal texts stand together.  A range
partitioning holds that order; each partition's byte total gives, by a prefix sum over the few totals, the
bytes before it, and a running sum inside the partition gives every row's place in the whole.  The line of
bytes is cut at equal targets: a row goes to the shard that holds its middle byte.  A group of rows with one
checksum that a cut would divide goes whole to the shard of its own middle byte, unless it is larger than a shard;
there are at most n_shards - 1 such groups.  No task sees more than its own partition, and a hot text is split by id.

The range partitioning is cut off through a checkpoint, because its sampled bounds may differ when it is
computed again.  Null texts count as empty (size 8), null ids sort first, repeated rows are separate rows,
extra columns are ignored; an empty table gives an empty result.  Shards may stay empty where there are fewer
rows than shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import checkpointed, shuffle_partitions

ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); slot counts from 0 in each shard, in the global order."""
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["text_crc32", "doc_id", "size"]
    placed = checkpointed(rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(  # a row for each partition
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(inside)) - F.col("size")  # twice the middle byte
    located = placed.join(F.broadcast(starts), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("row"),
        middle.alias("middle"),
        "total",
    )
    shard_of = lambda middle: F.least(F.expr(f"{middle} * {n_shards} div (2 * total)"), F.lit(n_shards - 1)).cast("int")
    located = located.withColumn("shard", shard_of("middle"))
    # the rows that a cut (a multiple of total / n_shards) runs through or stands before: one for each cut
    start, end = f"(middle - size) div 2 * {n_shards}", f"(middle + size) div 2 * {n_shards}"
    at_cut = located.filter(F.expr(f"({start}) div total < ({end}) div total")).select("text_crc32").distinct()
    divided = located.join(F.broadcast(at_cut), "text_crc32").groupBy("text_crc32").agg(F.sum("size").alias("bytes"), F.min(F.expr("(middle - size) div 2")).alias("first"), F.max("total").alias("total"))
    divided = divided.filter(f"bytes * {n_shards} <= total").withColumn("middle", 2 * F.col("first") + F.col("bytes")).select("text_crc32", shard_of("middle").alias("whole"))
    located = located.join(F.broadcast(divided), "text_crc32", "left").withColumn("shard", F.coalesce("whole", "shard")).drop("whole")
    heads = located.groupBy("shard").agg(F.min("row").alias("head"))  # a row for each shard
    return located.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("head")).alias("slot"))
