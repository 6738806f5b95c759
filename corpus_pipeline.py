"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of `documents`.  Decisions: a document that scores 0.7 or more for toxicity goes; of each class of
near-duplicates (five-word shingles, similarity 0.8) the smallest id stays, once; documents with a benchmark
passage go; mixing thins documents of the low-quality domain to its target share (rates above 1, which exceed it
by less than a hundredth, count as 1, so no document comes twice); sharding assigns 24 contiguous shards of equal
bytes.  Null and empty texts have no shingle, passage or toxic word and pass the filters; rows with a null id pass
the near-duplicate stage one by one; of repeated rows one stays, and different texts of one id that stays are all
kept.  Ties go to the smaller id.  Texts are handled whole, however long.  Extra columns pass all stages but the
last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import decontam, forest, ftrl, mixing, shards
from tamis.llm.common import crc_mod, documents, shared_dir
from tamis.llm.entry import MIX, quality_domains


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ftrl.drop_toxic(docs, ftrl.fit(docs, labels, where=crc_mod(F.col("doc_id"), 3) != 1), 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = forest.near_duplicates(docs, size=5, threshold=(80, 100)).filter("kept and doc_id is not null").select("doc_id")
    # rows stand apart as one struct, so that extra columns may have any name; texts are compared by their digests
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    named = rows.join(kept.distinct().withColumnRenamed("doc_id", "id"), "id", "left_semi").dropDuplicates(["id", "digest"])
    return named.unionByName(rows.filter("id is null")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.thin(docs, quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), MIX)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(docs, 24)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", source_mixing), ("sharding", sharding)]

#: No stage before the last can be expressed in SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared checkpoint folder and read again."""
    docs = documents(spark, sf_dir)
    at, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:  # its rows are read; the result reads the last folder only
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
