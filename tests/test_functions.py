import pytest
from pyspark.sql import functions as F

from tamis.functions import chunking as ch
from tamis.functions import entities as en
from tamis.functions import routing as ro
from tamis.functions import text as t
from tamis.operators import vectors


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("payments", "payment"), ("running", "run"), ("was", "wa"), ("this", "thi"), ("does", "doe"), ("caresses", "caress"), ("queries", "queri"), ("agreed", "agre"), ("hopping", "hop"),
        ("sized", "size"), ("hoping", "hope"), ("happy", "happi"), ("organization", "organ"), ("relational", "relat"), ("usefulness", "useful"), ("controlling", "controll"), ("status", "status"), ("is", "is"), ("feed", "feed"),
    ],
)
def test_stem(spark, word, stem):
    assert one(spark, t.stem(F.col("w")), w=word) == stem


def test_token_estimate(spark):
    assert [one(spark, t.token_estimate(F.col("w")), w=w) for w in ("", "abcd", "a" * 41)] == [1, 1, 10]
    with pytest.raises(ValueError):
        t.token_estimate(F.col("w"), 0)


def test_previews(spark):
    text = "a\nb\nc\nd"
    assert one(spark, t.span_preview(F.col("x"), F.lit(2), F.lit(9), 2), x=text) == "b\nc\n..."
    assert one(spark, t.span_preview(F.col("x"), F.lit(0), F.lit(9), 2), x=text) == ""
    assert one(spark, t.file_preview(F.col("x"), F.lit("C d"), 5), x=text) == "c\nd"
    assert one(spark, t.file_preview(F.col("x"), F.lit("zz"), 2), x=text) == "a\nb"
    assert one(spark, t.source_block(F.col("x"), F.lit("body"), F.lit(3)), x="p.py") == "Source: p.py:3\nbody"


def test_cosine(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = v.select(t.cosine(F.col("a"), F.col("b")).alias("x"), t.cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert r["x"] == pytest.approx(0.7071067811865475) and r["y"] == 0.0


def test_paragraph_merging(spark):
    text = "one\n\ntwo two two two two\n\n\nthree three three\n\nx"
    assert one(spark, ch.paragraphs(F.col("x")), x=text) == ["one", "two two two two two", "three three three", "x"]
    assert one(spark, ch.merge_to_minimum(ch.paragraphs(F.col("x")), 10), x=text) == ["one\n\ntwo two two two two", "three three three\n\nx"]
    assert one(spark, ch.merge_under(ch.paragraphs(F.col("x")), 5), x=text) == ["one\n\ntwo two two two two", "three three three", "x"]
    assert one(spark, ch.chunk_text(F.col("x")), x="  \n\n ") == []


def test_smart_chunks(spark):
    legal = "\n".join(f"ARTICLE {n}\n1) first clause {'words ' * 30}\n2) second clause {'words ' * 30}" for n in ("I", "II", "III"))
    chunks = one(spark, ch.smart_chunks(F.col("x"), F.lit("auto")), x=legal)
    assert len(chunks) > 1 and all("clause" in c for c in chunks)
    source = "import os\n\ndef f():\n    a = 1\n    return a\n\n\ndef g():\n    return 2\n"
    assert one(spark, ch.looks_python(F.col("x")), x=source)
    code = one(spark, ch.smart_chunks(F.col("x"), F.lit("code")), x=source)
    assert len(code) == 1 and "def f" in code[0] and "def g" in code[0]
    big = "\n".join(f"def f{i}():\n" + "    x = 1\n" * 150 for i in range(3))
    assert len(one(spark, ch.chunk_python(F.col("x")), x=big)) == 3
    assert one(spark, ch.unwrap_pdf(F.col("x")), x="a\nb\n\n\n c \nd") == "a b\n\nc d"
    assert one(spark, ch.smart_chunks(F.col("x"), F.lit("auto")), x="short") == ["short"]


def test_summary(spark):
    text = "One is here. Two is here! Three is here? Four."
    assert one(spark, ch.summary(F.col("x"), F.lit(30)), x=text) == "One is here. Two is here!"
    assert one(spark, ch.summary(F.col("x"), F.lit(3)), x=text) == "One is here."
    assert one(spark, ch.summary(F.col("x"), F.lit(0)), x=text) == ""


def test_entities(spark):
    text = "Mail a@b.io, see https://x.org/y on 2024-01-02 or 03/04/2024; TICKET-12, $1,200.50, 10.0.0.1, v1.2.3, order_id: AB-1234 and POL-2024-A1 a@b.io"
    got = one(spark, en.extract(F.col("x")), x=text)
    assert got[:4] == ["a@b.io", "https://x.org/y", "2024-01-02", "03/04/2024"]
    assert {"TICKET-12", "$1,200.50", "10.0.0.1", "v1.2.3", "AB-1234", "POL-2024-A1"} <= set(got) and len(got) == len(set(got))
    many = " ".join(f"u{i}@x.io" for i in range(100))
    assert len(one(spark, en.extract(F.col("x"), max_entities=5), x=many)) == 5
    assert one(spark, en.extract(F.col("x")), x="identify this") == []
    assert one(spark, en.extract(F.col("x")), x="the reference manual") == ["manual"]
    keep = [one(spark, en.keep_worthy(F.col("x")), x=x) for x in ("INV-1", "a@b.c", "HTTP://x", "12.5", "10.0.0.1", " ")]
    assert keep == [True, False, False, False, True, False]


def test_routing(spark):
    assert one(spark, ro.complexity(F.col("x")), x="what is a name") == 0.0
    assert one(spark, ro.complexity(F.col("x")), x="summarize the contract") == pytest.approx(0.25)
    hard = "Analyze and compare the regulatory implications versus the architecture? And evaluate the strategy?"
    assert one(spark, ro.complexity(F.col("x")), x=hard) == pytest.approx(0.65)
    assert one(spark, ro.choose_model(F.lit(0.31))) == "gpt-4o"
    assert one(spark, ro.choose_model(F.lit(2.0), [(0.5, "a"), (0.1, "b")])) == "a"


def test_rank_fusion(spark):
    rows = [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "y"), ("b", 1, "x"), ("b", 2, "w"), ("b", 3, "")]
    fused = vectors.fuse_rankings(spark.createDataFrame(rows, "list_id string, pos int, key string"))
    got = {r["key"]: r["score"] for r in fused.collect()}
    assert got["x"] == pytest.approx(1 / 61 + 1 / 62) and got["w"] == pytest.approx(1 / 63) and set(got) == {"x", "y", "z", "w"}


def test_store(spark):
    new = spark.createDataFrame([(0, " a b "), (1, "a b"), (2, " "), (3, "c d")], "ord int, chunk string")
    store = vectors.add_to_store(None, new)
    assert sorted((r["ord"], r["chunk"]) for r in store.collect()) == [(0, "a b"), (3, "c d")]
    more = vectors.add_to_store(store, spark.createDataFrame([(4, "c d"), (5, "e")], "ord int, chunk string"))
    assert [r["chunk"] for r in more.collect()] == ["e"]


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha"), (3, "")], "id int, text string")
    got = {r["id"]: r["vector"] for r in vectors.hash_vectors(df, ["id"], dims=16).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0) and got[3] == [0.0] * 16


def test_cache(spark):
    ask = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    cache = spark.createDataFrame([("a", [1.0])], "text string, vector array<double>").select(t.key_hash(F.lit("m"), F.col("text")).alias("key"), "vector")
    hits, misses = vectors.cached_embeddings(ask, cache, "m")
    assert [r["id"] for r in hits.collect()] == [1] and [r["id"] for r in misses.collect()] == [2]
    assert vectors.cached_embeddings(ask, cache, "other")[0].count() == 0
