"""The corpus pipeline against a plain version of its decisions."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tamis.llm import decontam, entry, ftrl, mixing  # noqa: E402
from tamis.llm.common import crc_mod  # noqa: E402

from .test_operators import brute_classes  # noqa: E402


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns

    before, after = kept["toxicity"]
    model = ftrl.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=crc_mod(F.col("doc_id"), 3) != 1)
    assert ids(after) == ids(ftrl.score(before, model).filter("score < 0.7"))

    before, after = kept["near_duplicates"]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert ids(after) == sorted(d for d, (_, c) in classes.items() if c == d)

    before, after = kept["decontamination"]
    dirty = set(ids(decontam.matches(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))))
    text = {r["doc_id"]: " ".join(r["text"].lower().split()) for r in before.collect()}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ids(after) == sorted(set(text) - dirty)
    assert {d for d, t in text.items() if any(i in t for i in items)} <= dirty

    before, after = kept["mixing"]
    mixed = mixing.mix(before, entry.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), entry.MIX)
    assert ids(after) == ids(mixed.filter("copies >= 1"))

    before, after = kept["sharding"]
    assert ids(after) == ids(before)
    sizes = [r["n"] for r in after.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 2 * after.agg(F.max("size")).first()[0]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.count() > 0


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty and repeated rows, two texts under one id, columns of clashing names, and an empty table."""
    toxic = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0 and quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()]
    rows = [(i, x, "s") for i, x in enumerate(toxic)] + [(50, None, None), (51, "", "s"), (52, " \n ", "s"), (None, "a text without any id", "s"), (None, None, None)]
    rows += [(0, toxic[0], "s"), (60, "first text of this id with some words", "s"), (60, "another text that stands under the same id", "s"), (61, toxic[1] + " end", "s")]
    schema = "doc_id bigint, text string, source string, `row` string, rate double, n_tokens int, part int, size int, id string"
    odd = spark.createDataFrame([(*r, "r", 2.0, 3, 4, 5, "i") for r in rows], schema).repartition(3)
    folder = tmp_path / "data"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    odd.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.filter("false")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(folder))
        assert kept.columns == docs.columns and kept.schema == docs.schema
        got = [tuple(r)[:2] for r in kept.collect()]
        assert set(got) <= {r[:2] for r in rows} and ((None, "a text without any id") in got or name == "mixing")
        assert stage(spark, empty, str(folder)).count() == 0
    near = [tuple(r)[:2] for r in stages["near_duplicates"](spark, docs, str(folder)).collect()]
    assert near.count((0, toxic[0])) == 1 and sum(d == 60 for d, _ in near) == 2 and sum(d is None for d, _ in near) == 2
    assert all((d, x) in near for d, x in enumerate(toxic)) and (61, toxic[1] + " end") not in near
    last = stages["sharding"](spark, docs, str(folder))
    assert last.count() == len(rows) and stages["sharding"](spark, empty, str(folder)).count() == 0
