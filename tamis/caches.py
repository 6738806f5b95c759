"""Caches that live in files: vectors by text, answers by question with a time to live, and how often they served."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path


def key_of(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]


@dataclass
class FileCache:
    """Values by key; read from its file at the start, written back by `save`."""

    path: str | None = None
    ttl_seconds: float | None = None
    clock: Callable[[], float] = time.time
    entries: dict = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    def __post_init__(self):
        if self.path and Path(self.path).is_file():
            self.entries = json.loads(Path(self.path).read_text())

    def get(self, *parts: str):
        found = self.entries.get(key_of(*parts))
        if found is not None and self.ttl_seconds is not None and self.clock() - found["at"] > self.ttl_seconds:
            del self.entries[key_of(*parts)]
            found = None
        self.hits, self.misses = self.hits + (found is not None), self.misses + (found is None)
        return None if found is None else found["value"]

    def put(self, value, *parts: str) -> None:
        self.entries[key_of(*parts)] = {"value": value, "at": self.clock()}

    def save(self) -> None:
        if self.path:
            Path(self.path).parent.mkdir(parents=True, exist_ok=True)
            Path(self.path).write_text(json.dumps(self.entries))

    def clear(self) -> None:
        self.entries.clear()

    @property
    def size(self) -> int:
        return len(self.entries)

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class CachedEmbedder:
    """An embedder that asks only for texts it has no vector of, and keeps what it got."""

    def __init__(self, embed: Callable[[Sequence[str]], list[list[float]]], cache: FileCache, fingerprint: str = ""):
        self.embed, self.cache, self.fingerprint = embed, cache, fingerprint

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        known = {x: self.cache.get(self.fingerprint, x) for x in dict.fromkeys(texts)}
        missing = [x for x, v in known.items() if v is None]
        if missing:
            for x, v in zip(missing, self.embed(missing), strict=True):
                known[x] = [float(y) for y in v]
                self.cache.put(known[x], self.fingerprint, x)
        return [known[x] for x in texts]
