import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions import lexicon
from tamis.functions import text as t
from tamis.operators import code, kb, scoring, selection
from tamis.sources import loaders


def context(spark, chunks, question, **cfg):
    q = spark.createDataFrame([(1, 7, question)], "query_id bigint, context_id bigint, query_text string")
    rows = spark.createDataFrame([(7, i, c) for i, c in enumerate(chunks)], "context_id bigint, chunk_idx int, text string")
    return selection.compress(q, rows, scoring.hybrid_scores, selection.EngineConfig(**cfg)).first()


def scores(spark, question, chunks, synonyms=None):
    q = spark.createDataFrame([(1, question)], "query_id bigint, query_text string")
    c = spark.createDataFrame([(1, i, x) for i, x in enumerate(chunks)], "context_id bigint, chunk_idx int, text string")
    return [r["score"] for r in scoring.hybrid_scores(q, c, synonyms).orderBy("chunk_idx").collect()]


def test_relevant_chunk_first(spark):
    s = scores(spark, "payment terms", ["Payments are due in thirty days.", "The weather is nice.", "Terms of payment follow."])
    assert s[2] > s[0] > s[1] == 0.0


def test_synonyms(spark):
    groups = scoring.synonym_table(spark.createDataFrame([(1, "car"), (1, "automobile"), (2, "bug"), (2, "error"), (3, "bug"), (3, "problem")], "group_id int, word string"))
    s = scores(spark, "car price", ["automobile market", "garden market"], groups)
    assert s[0] > s[1]
    assert {r["synonym"] for r in groups.filter("word = 'bug'").collect()} == {"problem"}
    assert {r["synonym"] for r in groups.filter("word = 'error'").collect()} == {"bug"}


def test_fuzzy(spark):
    s = scores(spark, "configuraton", ["the configuration file", "another thing"])
    assert s[0] > s[1]


def test_method_intent(spark):
    chunks = ["Abstract: we describe background.", "Proposed methodology: step 1 does this, step 2 does that.", "Related work covers others [1] [2]."]
    s = scores(spark, "what is the working procedure", chunks)
    assert s[1] == max(s)


def test_entities_survive(spark):
    filler = "Plain filler sentence about nothing in particular. " * 6
    r = context(spark, [filler, "Ticket OPS-4521 was closed on 2024-05-06.", filler, filler], "what happened", max_context_tokens=200, min_relevance=0.9)
    assert "OPS-4521" in r["prompt"] and "OPS-4521" in r["entities"] and 1 in r["selected_indices"]
    assert r["final_context_tokens"] <= r["original_context_tokens"]


def test_plan_of_compression_is_a_sum(spark):
    """Parts that are read several times are computed once: the driver holds a plan of some tens of exchanges, not of hundreds."""
    q = spark.createDataFrame([(1, 7, "when is payment due"), (2, 8, "what else")], "query_id bigint, context_id bigint, query_text string")
    rows = spark.createDataFrame([(7, 0, "Payment is due in June."), (7, 1, "Other words."), (8, 0, "Nothing else.")], "context_id bigint, chunk_idx int, text string")
    synonyms = scoring.synonym_table(spark.createDataFrame([(1, "due"), (1, "owed")], "group_id int, word string"))
    found = selection.compress(q, rows, lambda a, b: scoring.hybrid_scores(a, b, synonyms))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 12 and plan.count("Aggregate") <= 12
    assert {r["query_id"]: r["total_chunks"] for r in found.collect()} == {1: 2, 2: 1}


def test_own_contexts_shuffle_no_words(spark, monkeypatch):
    """Questions with contexts of their own: one exchange of texts where words were joined, and the same scores, also beside a crowded context."""
    texts = ["", None, "Step 1: the proposed methodology is described in fig. 2, after 12% and 7.5.", "The cars were priced; automobiles [3] et al. cost more, cars most.",
             "Related works on pricing: doi and results.", "automobile owed owed", "Unrelated words stand here", "KELVIN \u212a \u0130ssues priced caresses"]
    asked = ["How is the price of cars computed, which number of cars?", "related work on the method of pricing and dues", "", None, "zzz the of"]
    q = spark.createDataFrame([(i, i % 2 + 7, x) for i, x in enumerate(asked)] + [(9, None, "cars"), (10, 99, "cars")], "query_id bigint, context_id bigint, query_text string")
    c = spark.createDataFrame([(7 + k, i, x) for k in (0, 1, 3) for i, x in enumerate(texts[k:])] + [(None, 0, "cars")], "context_id bigint, chunk_idx int, text string")
    synonyms = scoring.synonym_table(spark.createDataFrame([(1, "cars"), (1, "automobile"), (2, "dues"), (2, "owed"), (2, "et al")], "group_id int, word string"))
    for groups in (synonyms, None):
        plan = scoring.hybrid_scores(q, c, groups)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") <= 4 and plan.count("Window") == 0
        rows = lambda d: {(r["query_id"], r["context_id"], r["chunk_idx"]): [round(r[k], 9) for k in d.columns if k not in ("query_id", "context_id", "chunk_idx")] for r in d.collect()}
        want = rows(scoring.joined_scores(q, c, groups))
        assert len(want) == 3 * 8 + 2 * 7 and rows(scoring.hybrid_scores(q, c, groups)) == want
    monkeypatch.setattr(scoring, "MAX_OWN", 20)
    assert [r["context_id"] for r in scoring.crowded_contexts(q, c).collect()] == [7]
    assert rows(scoring.hybrid_scores(q, c)) == want


def test_plain_stems(spark):
    """Python's stems, words and n-grams are those of the column expressions."""
    from tamis.functions import plain

    vocabulary = {w for a, b in lexicon.DERIVED for x in ("", "b", "tr", "relat", "hopp", "2a") for w in (x + a, x + b)} | {x + e + s for e in lexicon.ENDINGS for x in ("", "adopt", "e", "troubl") for s in ("", "s", "ed", "ing", "ly")}
    vocabulary |= set("caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing failing filing happy sky bus ss s es ed ing eed eeds y by oy ies iess controll roll 1990s 22 00s aas bb rate cease et\u00e9s".split())
    spark.createDataFrame([(w,) for w in sorted(vocabulary)], "word string").createOrReplaceTempView("plain_words")
    chats = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(F.explode(t.words(F.col("text"))).alias("word"))
    found = t.stems(spark.table("plain_words").union(chats).distinct()).withColumn("grams", t.grams(F.col("word"))).collect()
    assert len(found) > 500 and [(r["word"], r["stem"]) for r in found if plain.stem(r["word"]) != r["stem"] or plain.grams(r["word"]) != set(r["grams"])] == []
    row = spark.createDataFrame([("A b\u212a9 \u0130x \u00c9a-c_d",)], "x string").select(t.words(F.col("x")).alias("w")).first()
    assert plain.words("A b\u212a9 \u0130x \u00c9a-c_d") == row["w"] and plain.words(None) == []


def test_compression_by_row_is_that_by_relations(spark):
    """Entities, kept chunks and choice are made inside one row for each context: no windows, few exchanges, and the same result."""
    asked = [(1, 7, "Is INV-1 due?"), (2, 8, "zzz"), (3, 9, "what else stands here"), (4, 7, "due")]
    q = spark.createDataFrame(asked, "query_id bigint, context_id bigint, query_text string")
    texts = {7: ["Nothing.", "INV-1 is due.", "Beside it.", "Far away words.", "Also due 2024-01-02."], 8: ["first", "second", "third " * 30], 9: [f"Chunk {i} stands. It is {i}.{i} or a@b.cd." for i in range(12)] + ["REF-77 at the end"]}
    c = spark.createDataFrame([(k, 10 * i, x) for k, v in texts.items() for i, x in enumerate(v)], "context_id bigint, chunk_idx int, text string")
    for limit in (30, 6, 400):
        cfg = selection.EngineConfig(max_context_tokens=limit, min_relevance=0.6)
        found = selection.compress(q, c, scoring.hybrid_scores, cfg)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Window") == 0 and plan.count("Join") <= 5
        got = {r["query_id"]: (r["selected_indices"], r["entities"]) for r in found.collect()}
        scored = scoring.hybrid_scores(q, c).select("query_id", "context_id", "chunk_idx", "score").join(c, ["context_id", "chunk_idx"]).cache()
        entities = selection.context_entities(scored, q)
        flagged = selection.keep_flags(scored, entities, cfg.relevance).filter("keep")
        chosen = selection.enforce_budget(flagged.select("query_id", "context_id", "chunk_idx", "text", "score", F.col("by_entity").alias("keep")), limit)
        assert {k: v[0] for k, v in got.items()} == {r["query_id"]: [x["idx"] for x in r["selected"]] for r in chosen.collect()}
        for r in entities.collect():
            assert set(r["prompt_entities"]) <= set(got[r["query_id"]][1]) <= {*r["prompt_entities"], *r["found"]}


def test_budget_and_order(spark):
    rows = spark.createDataFrame([(1, 1, 0, "a" * 40, 0.1, False), (1, 1, 1, "b" * 400, 0.9, False), (1, 1, 2, "c" * 40, 0.5, True)], "query_id int, context_id int, chunk_idx int, text string, score double, keep boolean")
    pick = lambda n: [x["idx"] for x in selection.enforce_budget(rows, n).first()["selected"]]
    assert pick(1000) == [2, 1, 0] and pick(25) == [2, 0] and pick(0) == []


def test_budget_summary(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    rows = spark.createDataFrame([(1, 1, 3, text, 0.5, True)], "query_id int, context_id int, chunk_idx int, text string, score double, keep boolean")
    got = selection.enforce_budget(rows, 30).first()["selected"]
    assert len(got) == 1 and got[0]["idx"] == 3 and got[0]["text"].endswith(".") and len(got[0]["text"]) // 4 <= 30


def test_empty_context(spark):
    q = spark.createDataFrame([(1, 9, "hello there")], "query_id bigint, context_id bigint, query_text string")
    none = spark.createDataFrame([], "context_id bigint, chunk_idx int, text string")
    r = selection.compress(q, none, scoring.hybrid_scores).first()
    assert r["prompt"] == "hello there" and r["kept_chunks"] == 0 and r["reduction_pct"] == 0.0


def test_never_all_dropped(spark):
    assert context(spark, ["first thing here", "second thing here"], "zzz qqq", min_relevance=0.99)["kept_chunks"] == 1


def test_survival_gate(spark):
    prompts = spark.createDataFrame([(1, "The answer is 42 for INV-1", ["INV-1"], 50.0)], "query_id int, prompt string, entities array<string>, reduction_pct double")
    cases = spark.createDataFrame([(1, "42", ["INV-1"])], "query_id int, expected string, required array<string>")
    row = selection.survival(cases, prompts).first()
    assert selection.quality_gate(row) == (True, "PASS")
    assert not selection.quality_gate({"entity_survival": 99.0, "answer_survival": 100.0})[0]


def test_search_lines(spark):
    files = spark.createDataFrame([("a/needle.txt", "x\nthe Needle\ny\nneedle again\nz\nz\nz\nz\nneedle far"), ("b.txt", "nothing")], "path string, text string")
    got = kb.search_lines(files, "needle").collect()
    assert [(r["line"], r["score"]) for r in got] == [(2, 3.0), (9, 3.0)] and "..." in got[0]["preview"]
    assert kb.search_lines(files, " ").count() == 0


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".venv").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("from .b import helper\nimport pkg.c\n\nclass Engine:\n    def run(self):\n        return helper()\n")
    (tmp_path / "pkg" / "b.py").write_text("def helper():\n    return 1\n")
    (tmp_path / "pkg" / "c.py").write_text("def broken(:\n")
    (tmp_path / "ui.ts").write_text("import { x } from './lib/x'\n")
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "x.tsx").write_text("export const x = 1\n")
    (tmp_path / ".venv" / "skip.py").write_text("def no(): pass\n")
    return tmp_path


def test_code_graph(spark, tree):
    files = loaders.read_files(spark, str(tree), extensions=[".py", ".ts", ".tsx"]).select("path", "text").cache()
    assert {r["path"] for r in files.collect()} == {"pkg/a.py", "pkg/b.py", "pkg/c.py", "ui.ts", "lib/x.tsx"}
    found = code.facts(files)
    syms = code.symbols(found)
    assert {(r["name"], r["kind"]) for r in syms.collect()} == {("Engine", "class"), ("run", "function"), ("helper", "function")}
    edges = code.import_edges(found, files)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c.py"), ("ui.ts", "lib/x.tsx")}
    calls = code.call_edges(found)
    assert [(r["caller"], r["callee"], r["line"]) for r in calls.collect()] == [("Engine.run", "helper", 6)]
    assert [(r["src"], r["dst"]) for r in code.call_targets(calls, syms).collect()] == [("pkg/a.py", "pkg/b.py")]
    got = code.graph_search("engine", syms, files, edges).collect()
    assert got[0]["kind"] == "symbol" and {r["path"] for r in got} == {"pkg/a.py", "pkg/b.py", "pkg/c.py"}


def test_incremental_diff(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "path string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("w", 1)], "path string, v int")
    assert {r["path"]: r["change"] for r in code.fingerprint_diff(a, b).collect()} == {"x": "same", "y": "changed", "z": "deleted", "w": "new"}


def test_importers(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, score double")
    assert {r["node"]: r["score"] for r in code.expand(seeds, edges, 1, True, True).collect()} == {"a": 1.0, "b": 0.5, "c": 0.4}


def test_loaders(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,city\nAnn,Rome\nBob,\n")
    (tmp_path / "l.json").write_text('["one", {"a": 1}]')
    (tmp_path / "o.json").write_text('{"k": "v", "n": 2}')
    (tmp_path / "n.txt").write_text("hello world")
    chunks = lambda name: [r["chunk"] for r in loaders.load(spark, str(tmp_path / name)).collect()]
    assert chunks("t.csv") == ["name: Ann | city: Rome", "name: Bob"]
    assert chunks("l.json") == ["one", '{"a": 1}'] and chunks("o.json") == ["k: v", "n: 2"] and chunks("n.txt") == ["hello world"]
    with pytest.raises(FileNotFoundError):
        loaders.load(spark, str(tmp_path / "none.txt"))
    with pytest.raises(PermissionError):
        loaders.checked_root(str(tmp_path), [tmp_path / "inner"])
    with pytest.raises(PermissionError):
        loaders.under_root("../x", tmp_path)


def docx_bytes(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_folder(spark, tmp_path):
    """Every file of a folder by its own loader; broken and ignored ones are left out."""
    (tmp_path / "sub").mkdir()
    (tmp_path / ".venv").mkdir()
    (tmp_path / "a.csv").write_text("name,city\nAnn,Rome\nBob,\n")
    (tmp_path / "sub" / "b.csv").write_text("only,header\n")
    (tmp_path / "c.json").write_text('{"k": "v", "n": [1, 2]}')
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "d.docx").write_bytes(docx_bytes("First part", "Second part"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF pretend")
    (tmp_path / "blank.txt").write_text("  \n ")
    (tmp_path / ".venv" / "f.txt").write_text("hidden")
    got = {(r["path"], r["chunk_idx"]): r["chunk"] for r in loaders.load_directory(spark, str(tmp_path), prefix=False, pdf_reader=lambda b: "text of " + b[1:4].decode()).collect()}
    assert got[("a.csv", 0)] == "name: Ann | city: Rome" and got[("a.csv", 1)] == "name: Bob" and got[("sub/b.csv", 0)] == "only,header"
    assert got[("c.json", 0)] == "k: v" and got[("c.json", 1)] == "n: [1, 2]" and got[("d.docx", 0)] == "First part\nSecond part" and got[("e.pdf", 0)] == "text of PDF"
    assert {p for p, _ in got} == {"a.csv", "sub/b.csv", "c.json", "d.docx", "e.pdf"}
    assert [r["chunk"] for r in loaders.load_docx(spark, str(tmp_path / "d.docx")).collect()] == ["First part\nSecond part"]
    assert [r["chunk"] for r in loaders.load_csv(spark, str(tmp_path / "sub" / "b.csv")).collect()] == ["only,header"]
    both = loaders.load(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.json")])
    assert both.count() == 4
    files = spark.createDataFrame([("z/readme.md", 1, "same"), ("b/readme.md", 1, "same"), ("pom.xml", 1, "x"), ("readme.txt", 1, "other")], "path string, bytes bigint, text string")
    assert [r["path"] for r in loaders.manifest_files(files).collect()] == ["b/readme.md", "readme.txt"]


def test_source_index(spark, tree, tmp_path):
    from tamis.sources.index import SourceIndex, git_head, index_home, now_iso

    index = SourceIndex(spark, str(tree), tmp_path / "index", 64)
    first = index.fresh().manifest()
    assert first["files"] >= 2 and first["symbols"] >= 3 and first["imports"] >= 1 and first["chunks"] >= 2
    assert "pkg/b.py" in {r["path"] for r in index.similar("def helper", 3).collect()} and index.search("helper").count() > 0
    before = {r["path"]: r["chunk_hash"] for r in index.table("records").collect()}
    (tree / "pkg" / "b.py").write_text("def helper():\n    return 'a much changed body of text'\n")
    (tree / "pkg" / "new.py").write_text("def fresh_one():\n    return 1\n")
    second = index.update()
    after = {r["path"]: r["chunk_hash"] for r in index.table("records").collect()}
    assert second["version"] != first["version"] and second["files"] == first["files"] + 1
    assert after["pkg/a.py"] == before["pkg/a.py"] and after["pkg/b.py"] != before["pkg/b.py"] and "pkg/new.py" in after
    assert not index.is_stale()
    (tree / ".git").mkdir()
    (tree / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (tree / ".git" / "packed-refs").write_text("# pack\n" + "1" * 40 + " refs/heads/main\n")
    index.build()
    assert git_head(tree) == "1" * 40 == index.manifest()["git_head"] and not index.is_stale()
    (tree / ".git" / "packed-refs").write_text("2" * 40 + " refs/heads/main\n")
    assert index.is_stale() and not index.fresh().is_stale()
    index.write_calls(str(tmp_path / "calls"))
    assert spark.read.json(str(tmp_path / "calls")).count() == json.loads((tmp_path / "calls.manifest.json").read_text())["edges"]
    assert index_home().name == "indexes" and now_iso().endswith("+00:00")


def test_caches(tmp_path):
    from tamis.caches import CachedEmbedder, FileCache

    now = [0.0]
    answers = FileCache(str(tmp_path / "a.json"), ttl_seconds=10, clock=lambda: now[0])
    answers.put("yes", "q", "m")
    assert answers.get("q", "m") == "yes" and answers.get("q", "other") is None and answers.hit_rate == 0.5
    now[0] = 11
    assert answers.get("q", "m") is None and answers.size == 0
    asked = []
    vectors_ = FileCache(str(tmp_path / "v" / "v.json"))
    embed = CachedEmbedder(lambda xs: asked.extend(xs) or [[float(len(x))] for x in xs], vectors_, "f")
    assert embed(["a", "bb", "a"]) == [[1.0], [2.0], [1.0]] and asked == ["a", "bb"]
    vectors_.save()
    again = CachedEmbedder(lambda xs: 1 / 0, FileCache(str(tmp_path / "v" / "v.json")), "f")
    assert again(["bb"]) == [[2.0]]


def test_injection_and_tools(spark, tmp_path):
    import tamis.engine as e

    counts = lambda xs: [[x.lower().count("alpha"), x.lower().count("beta")] for x in xs]
    cfg = selection.EngineConfig(max_context_tokens=8)
    prompt, _ = e.Engine(spark, cfg, embedder=counts).build_prompt("beta beta", ["alpha alpha things", "beta beta things"])
    assert "beta beta things" in prompt and "alpha alpha" not in prompt
    fixed = lambda q, c: c.crossJoin(q.select("query_id")).selectExpr("query_id", "context_id", "chunk_idx", "cast(chunk_idx = 0 as double) as score")
    prompt, _ = e.Engine(spark, cfg, scorer=fixed, embedder=counts).build_prompt("beta", ["alpha alpha things", "beta beta things"])
    assert "alpha alpha things" in prompt  # a scorer goes before an embedder
    (tmp_path / "t.txt").write_text("car, automobile  # vehicles\nprice, cost\nalone\n")
    groups = scoring.read_thesaurus(str(tmp_path / "t.txt"))
    assert groups == [["car", "automobile"], ["price", "cost"]]
    prompt, _ = e.Engine(spark, cfg, thesaurus=groups).build_prompt("car price", ["some other words", "automobile cost table"])
    assert "automobile cost" in prompt
    tool = e.compress_tool(e.Engine(spark))
    assert json.loads(e.call_tool({"function": {"name": "compress_context", "arguments": '{"context": "one two"}'}}, [tool]))["final_tokens"] > 0
    assert "Unknown tool" in e.call_tool({"function": {"name": "none"}}, [tool])
    got = spark.createDataFrame([("a b c",), (None,)], "t string").select(t.exact_tokens(str.split)("t").alias("n")).collect()
    assert [r["n"] for r in got] == [3, 0]
    row = e.run_bench(spark, e.BENCH_CASES[:2])
    assert row["answer_survival"] == row["entity_survival"] == 100.0 and row["mean_reduction_pct"] > 50 and row["p95_latency_ms"] > 0 and selection.quality_gate(row)[0]


def test_pages():
    page = "<html><body><nav>menu</nav><article><p>One</p><script>x</script><p>Two</p></article><footer>f</footer></body></html>"
    assert loaders.main_text(page) == "One\nTwo"
    assert loaders.main_text("<p>bare</p>") == "bare" and loaders.main_text(None) == ""


def test_pages_with_cut_references(spark, tmp_path):
    """References without their semicolon stay as they are, as the SQL of html_main_text has it."""
    import harness

    from tamis.plans import catalog

    parts = ["and&amp", "a &amp;&amp;&quo", "x &copy y &lt;b&gt;", "&amp;lt; & &", "R&D &ampere; &quot;q&quot;"]
    page = lambda p: f"<html><head><title>{p}</title></head><body><h1>{p}</h1><p>{p} end</p></body></html>"
    spark.createDataFrame([(i, page(p)) for i, p in enumerate(parts)], "page_id bigint, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    assert harness.differences(catalog.queries()["html_main_text"](spark, str(tmp_path)), harness.database(str(tmp_path)), catalog.oracle_sql()["html_main_text"]) == ""
    assert loaders.main_text("<p>and&amp</p><p>&eacute;&#39;&#x27; &amp;amp;</p>") == "and&amp\n\u00e9'' &amp;"


def test_neighbours_on_odd_vectors(spark):
    """Copies, ties, nulls, zeros, huge and tiny vectors, slices and a threshold, against all pairs scored one by one."""
    from tamis.operators import vectors

    rng = np.random.default_rng(5)
    base = [[float(x) for x in v] for v in rng.normal(size=(60, 4)).astype(np.float32)]
    rows = list(enumerate(base * 3 + [[2 * x for x in v] for v in base[:20]] + [base[0]] * 40 + [[0.0] * 4, None, [1.0, None, 0.0, 0.0], [1e120] * 4, [1e-120] * 4, [1e200] * 4]))
    store = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    q = store.filter("vec_id % 7 = 0 or vec_id > 235").selectExpr("vec_id as query_id", "embedding as vector")
    for k, least, size in ((10, 0.0, 50_000), (3, 0.9, 9), (4, None, 20)):
        found = vectors.dense_neighbours(q, store, k, least, size)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        pairs = store.crossJoin(q).select("query_id", "vec_id", t.cosine(F.col("embedding"), F.col("vector")).alias("score"))
        plain = vectors.top_k(pairs, ["query_id"], [F.desc("score"), "vec_id"], k, least)
        listed = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["score"])) for r in df.collect())
        assert listed(found) == listed(plain)
    assert vectors.dense_neighbours(q.filter("false"), store).count() == 0 == vectors.dense_neighbours(q, store.filter("false")).count()
    assert [r["vec_id"] for r in vectors.dense_neighbours(q.filter("vector is null"), store, 2).orderBy("rank").collect()] == [0, 1]
    with pytest.raises(Exception, match="same length"):
        vectors.dense_neighbours(q, store.selectExpr("vec_id", "array(1.0D) as embedding")).collect()


def test_messages(spark):
    chat = spark.createDataFrame([(1, 0, "system", "ctx one"), (1, 1, "user", "ask"), (1, 2, "system", "ctx two"), (2, 0, "user", "alone")], "conv_id int, turn int, role string, text string")
    q, c = selection.compress_messages(chat)
    assert [(r["query_id"], r["query_text"]) for r in q.collect()] == [(1, "ask")] and c.first()["text"] == "ctx one\n\nctx two"


def test_p95(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in (5, 1, 3)] + [("b", 2.0)], "k string, v double")
    assert {r["k"]: r["p95"] for r in selection.p95_of(rows, ["k"], "v").collect()} == {"a": 3.0, "b": 2.0}


def test_streams(spark, tmp_path):
    from tamis.streaming import streams

    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:10:00"), (3, "b", "2024-01-01 02:00:00")], "doc_id int, text string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("doc_id int, text string, ts timestamp").parquet(str(tmp_path / "in"))
    assert streams.drain(streams.dedup_stream(src)).count() == 2
    cache = streams.ttl_cache_stream(src.withColumnRenamed("text", "user_id"), 3600.0)
    run = cache.writeStream.format("memory").queryName("ttl").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination()
    assert {(r["user_id"], r["hits"], r["misses"]) for r in spark.sql("select * from ttl").collect()} >= {("a", 1, 1), ("b", 0, 1)}


def test_index_upkeep(spark, tmp_path):
    from tamis.streaming import streams

    schema = "path string, modified int, text string"
    target = str(tmp_path / "index")
    build = lambda df: df.select("path", "modified", F.upper("text").alias("body"))
    for n, rows in enumerate(([("x", 1, "old"), ("y", 1, "keep")], [("x", 2, "new")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "src"))
        spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
        streams.maintain_index(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), build, target, str(tmp_path / "ck")).awaitTermination()
        assert n >= 0
    assert {(r["path"], r["body"]) for r in spark.read.parquet(target).collect()} == {("x", "NEW"), ("y", "KEEP")}


def test_facades(spark, tmp_path, capsys):
    from tamis import engine as e
    from tamis.__main__ import main

    (tmp_path / "a.txt").write_text("Payment is due in thirty days for INV-1234.\n\n" + "Weather talk goes on and on here. " * 12 + "\n\n" + "Garden notes about roses and tulips follow. " * 12)
    eng = e.Engine(spark, selection.EngineConfig(max_context_tokens=60))
    prompt, report = eng.build_prompt("when is payment due", (tmp_path / "a.txt").read_text())
    assert "thirty days" in prompt and report["final_prompt_tokens"] <= report["original_prompt_tokens"] and "Saved" in e.format_report(report)
    assert [s for s, _ in eng.stages("when is payment due", ["Payment is due.", "x"])] == ["start", "chunked", "scored", "done"]
    pipe = e.Pipeline(spark).add(str(tmp_path / "a.txt"))
    calls = []
    answer = lambda p: calls.append(p) or "thirty"
    assert pipe.query("when is payment due", {"gpt-4o-mini": answer}) == "thirty" == pipe.query("when is payment due", answer) and len(calls) == 1
    chat = e.compress_chat(eng, [{"role": "user", "content": "due?"}, {"role": "system", "content": "Payment is due in May."}])
    assert [m["role"] for m in chat] == ["system", "user"] and "May" in chat[0]["content"]
    assert e.compress_chat(eng, [{"role": "user", "content": "x"}]) == [{"role": "user", "content": "x"}]
    assert "score" in e.search_tool(e.Retriever(eng, pipe.store))["handler"]("payment due")
    with pytest.raises(ValueError):
        e.make_embedder("none")
    assert e.make_embedder("localhash") == "localhash"
    assert main(["compress", "--question", "x", "--file", str(tmp_path / "no")]) == 1


def test_overview(spark, tree):
    from tamis.operators import overview

    (tree / "README.md").write_text("A small engine project.\n")
    files = loaders.read_files(spark, str(tree), extensions=[".py", ".ts", ".tsx", ".md"]).cache()
    found = code.facts(files)
    records = overview.build_records(files, 64).cache()
    assert [r["path"] for r in overview.search_records(records, "def helper", 1, dims=64).collect()] == ["pkg/b.py"]
    edges, syms = code.import_edges(found, files), code.symbols(found)
    context = [r["chunk"] for r in overview.vector_graph_context("class engine run", records, files, edges, 3, dims=64).collect()]
    assert any("pkg/b.py" in c for c in context) and len(context) == len(set(context))
    got = overview.project_overview("engine", records, files, syms, edges, dims=64)
    assert "pkg/a.py" in {r["path"] for r in got["files"].collect()} and any("README.md" in r["chunk"] for r in got["context"].collect())
    assert {r["module"] for r in got["modules"].collect()} >= {"pkg"} and ("pkg/a.py", "pkg/b.py") in {(r["src"], r["dst"]) for r in got["flows"].collect()}
    assert overview.fingerprint("localhash", 64) != overview.fingerprint("localhash", 256)
