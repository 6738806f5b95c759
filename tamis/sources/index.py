"""Index of a source tree on disk: symbols, imports, calls, vectors and fingerprints, in versions behind one pointer.

A version is a folder of parquet tables; `current.json` names the version that readers use, with its counts, time
and commit.  An update writes a new version from the rows of unchanged files and fresh rows of the others, and moves
the pointer last, so a reader or a failed update never sees half an index."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import code, overview
from tamis.sources import loaders

TABLES = ("files", "facts", "records")


def index_home(app: str = "tamis") -> Path:
    """Where indexes lie by default: the local application folder if the system names one, else under the home folder."""
    local = os.environ.get("LOCALAPPDATA")
    return Path(local) / app / "indexes" if local else Path.home() / f".{app.lower()}" / "indexes"


def now_iso() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat()


def git_head(root: str | Path) -> str | None:
    """Commit that a source tree stands at, read from its files; None without a repository."""
    folder = Path(root) / ".git"
    try:
        head = (folder / "HEAD").read_text().strip()
        if not head.startswith("ref:"):
            return head or None
        name = head[4:].strip()
        if (folder / name).is_file():
            return (folder / name).read_text().strip()
        packed = (folder / "packed-refs").read_text().splitlines()
        return next((line.split()[0] for line in packed if line.endswith(" " + name)), None)
    except OSError:
        return None


@dataclass
class SourceIndex:
    spark: SparkSession
    root: str
    at: Path
    dims: int = 256
    extensions: tuple[str, ...] = (".py", ".ts", ".tsx", ".js", ".jsx", ".md", ".txt")

    @property
    def pointer(self) -> Path:
        return Path(self.at) / "current.json"

    def manifest(self) -> dict | None:
        return json.loads(self.pointer.read_text()) if self.pointer.is_file() else None

    def table(self, name: str) -> DataFrame:
        found = self.manifest()
        if found is None:
            raise FileNotFoundError(f"no index at {self.at}")
        return self.spark.read.parquet(str(Path(self.at) / found["version"] / name))

    def _files(self) -> DataFrame:
        return loaders.read_files(self.spark, self.root, list(self.extensions))

    def _write(self, files: DataFrame, facts: DataFrame, records: DataFrame) -> dict:
        version = f"v-{uuid.uuid4().hex[:12]}"
        for name, rows in zip(TABLES, (files, facts, records), strict=True):
            loaders.save(rows, str(Path(self.at) / version / name))
        read = lambda name: self.spark.read.parquet(str(Path(self.at) / version / name))
        manifest = {"version": version, "created": now_iso(), "git_head": git_head(self.root), "embedder": overview.fingerprint("localhash", self.dims), **stats(read("files"), read("facts"), read("records"))}
        waiting = self.pointer.with_suffix(".new")
        waiting.write_text(json.dumps(manifest))
        waiting.replace(self.pointer)
        return manifest

    def build(self) -> dict:
        files = self._files()
        return self._write(files, code.facts(files), overview.build_records(files, self.dims))

    def update(self) -> dict:
        """Fresh rows for new and changed files only; all anew if there is no index or its vectors are of another kind."""
        found = self.manifest()
        if found is None or found["embedder"] != overview.fingerprint("localhash", self.dims):
            return self.build()
        files = self._files()
        changes = code.fingerprint_diff(loaders.fingerprints(self.table("files")), loaders.fingerprints(files))
        touched = files.join(changes.filter("change in ('new', 'changed')").select("path"), "path", "left_semi")
        facts = code.update_records(self.table("facts"), changes, code.facts(touched))
        records = code.update_records(self.table("records"), changes, overview.build_records(touched, self.dims))
        return self._write(files, facts, records)

    def is_stale(self) -> bool:
        """Whether the tree stands at another commit than the index."""
        found, head = self.manifest(), git_head(self.root)
        return bool(found and head and found["git_head"] and found["git_head"] != head)

    def fresh(self) -> SourceIndex:
        """The index, built or brought up to date first if need be."""
        if self.manifest() is None:
            self.build()
        elif self.is_stale():
            self.update()
        return self

    def search(self, query: str, top_k: int = 20, hops: int = 1) -> DataFrame:
        files, facts = self.table("files"), self.table("facts")
        return code.graph_search(query, code.symbols(facts), files, code.import_edges(facts, files), top_k, hops)

    def similar(self, query: str, top_k: int = 20, min_score: float = 0.0) -> DataFrame:
        return overview.search_records(self.table("records"), query, top_k, min_score, dims=self.dims)

    def overview(self, query: str, top_k: int = 20) -> dict:
        files, facts = self.table("files"), self.table("facts")
        return overview.project_overview(query, self.table("records"), files, code.symbols(facts), code.import_edges(facts, files), top_k, self.dims)

    def write_calls(self, path: str) -> None:
        """Call edges as JSON lines, with a manifest of their number beside them."""
        calls = code.call_edges(self.table("facts"))
        calls.write.mode("overwrite").json(path)
        Path(path + ".manifest.json").write_text(json.dumps({"edges": calls.count(), "created": now_iso(), "git_head": git_head(self.root)}))


def stats(files: DataFrame, facts: DataFrame, records: DataFrame) -> dict:
    """How much an index holds."""
    kinds = {r["fact"]: r["count"] for r in facts.groupBy("fact").count().collect()}  # three kinds
    edges = code.import_edges(facts, files).count()
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    return {"files": total["n"], "bytes": total["b"], "symbols": kinds.get("symbol", 0), "imports": edges, "calls": kinds.get("call", 0), "chunks": records.count()}
