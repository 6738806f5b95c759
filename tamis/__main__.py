"""Command line: `compress` a context for a question, `bench` the survival of answers."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tamis.engine import Engine, format_report, run_bench
from tamis.operators import scoring, selection
from tamis.session import session
from tamis.sources import loaders


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tamis")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("--question", required=True)
    c.add_argument("--file")
    c.add_argument("--context")
    c.add_argument("--max-tokens", type=int, default=4000)
    c.add_argument("--thesaurus", help="file of synonyms: a group on each line, words apart by commas")
    b = sub.add_parser("bench")
    b.add_argument("dataset", nargs="?")
    b.add_argument("--json")
    a = p.parse_args(argv)
    if a.command == "compress" and a.file and not Path(a.file).is_file():
        print(f"no such file: {a.file}", file=sys.stderr)
        return 1
    spark = session()
    if a.command == "compress":
        context = Path(a.file).read_text(encoding="utf-8", errors="replace") if a.file else a.context if a.context is not None else sys.stdin.read()
        thesaurus = scoring.read_thesaurus(a.thesaurus) if a.thesaurus else None
        prompt, report = Engine(spark, selection.EngineConfig(max_context_tokens=a.max_tokens), thesaurus=thesaurus).build_prompt(a.question, context)
        print(prompt)
        print(format_report(report), file=sys.stderr)
        return 0
    if not a.dataset:
        row = run_bench(spark)
        ok, message = selection.quality_gate(row)
        if a.json:
            Path(a.json).write_text(json.dumps(row))
        print(json.dumps(row), message)
        return 0 if ok else 1
    cases = loaders.bench_cases(spark, a.dataset).withColumn("query_id", F.xxhash64("name")).withColumn("context_id", F.col("query_id"))
    q = cases.select("query_id", "context_id", F.col("question").alias("query_text"))
    prompts = selection.compress(q, cases.select("context_id", F.col("document").alias("text")), scoring.hybrid_scores, selection.EngineConfig(max_context_tokens=1200, conservative=True))
    row = selection.survival(cases.select("query_id", F.col("expected_substring").alias("expected"), F.col("required_entities").alias("required")), prompts).first().asDict()
    ok, message = selection.quality_gate(row)
    if a.json:
        Path(a.json).write_text(json.dumps(row))
    print(json.dumps(row), message)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
