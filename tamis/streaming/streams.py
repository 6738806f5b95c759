"""Structured Streaming forms: deduplicated store, TTL cache, windowed counts, incremental index upkeep."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamis.functions import text as t


def dedup_stream(texts: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row of every text. With a watermark (column, delay) the state is dropped as time passes."""
    rows = texts.withColumn("chunk", t.strip(F.col("text"))).filter("chunk <> ''").withColumn("chunk_md5", t.md5_of(F.col("chunk")))
    if watermark:
        return rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(["chunk_md5"])
    return rows.dropDuplicates(["chunk_md5"])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a folder of our own in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="tamis-streams-")


def drain(stream: DataFrame, name: str = "stream", mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table of the shared folder, and read that back."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def dedup_once(spark: SparkSession, path: str) -> DataFrame:
    """Deduplicate a parquet table by streaming over its files."""
    schema = spark.read.parquet(path).schema
    source = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be one file or a folder
    return drain(dedup_stream(spark.readStream.schema(schema).parquet(source)).select("doc_id", "chunk_md5"), "dedup")


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark takes no local time
    return timed.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def ttl_cache_stream(requests: DataFrame, ttl_seconds: float, late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, hits, misses) so far for each key and batch; an entry is dropped when event time passes its end."""

    def serve(k: tuple, batches, state: GroupState):
        set_at, hits, misses = state.get if state.exists else (None, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "hits": [hits], "misses": [misses]})
            return
        times = pd.concat([b[ts] for b in batches]).sort_values().astype("int64") / 1e9
        for x in times:
            if set_at is not None and x - set_at <= ttl_seconds:
                hits += 1
            else:
                misses, set_at = misses + 1, float(x)
        state.update((set_at, hits, misses))
        end = int((set_at + ttl_seconds) * 1000) + 1
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({key: [k[0]], "hits": [hits], "misses": [misses]})

    kind = requests.schema[key].dataType.simpleString()
    rows = requests.select(key, ts).withWatermark(ts, late)
    return rows.groupBy(key).applyInPandasWithState(serve, f"{key} {kind}, hits bigint, misses bigint", "set_at double, hits bigint, misses bigint", "update", GroupStateTimeout.EventTimeTimeout)


def maintain_index(files: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Index upkeep: each batch of files is built and replaces those files' rows (partitions by path hash)."""

    context = files.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(files.sparkSession))

    def upsert(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "modified").alias("r")).select("r.*")
        fresh = build(latest).withColumn("path_bucket", F.pmod(F.xxhash64("path"), F.lit(64)).cast("int"))
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(target)
            touched = fresh.select("path_bucket").distinct()
            kept = old.join(touched, "path_bucket", "left_semi").join(latest.select("path"), "path", "left_anti")
            fresh = fresh.unionByName(kept.select(fresh.columns)).checkpoint()  # read before its table is overwritten
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path_bucket").parquet(target)

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
