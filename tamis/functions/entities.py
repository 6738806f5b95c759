"""Entities by pattern: extraction in category order, and which of them protect a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.lexicon import ENTITIES, ID_LIKE
from tamis.functions.text import strip

MAX_ENTITIES = 50


def matches(text: Column, kind: str) -> Column:
    if kind == "id_like":
        return F.regexp_extract_all(text, F.lit(ID_LIKE), F.lit(1))
    pattern = ENTITIES[kind]
    # Unicode classes and borders, as for text in any script
    pattern = pattern.replace("(?i)", "(?iuU)", 1) if pattern.startswith("(?i)") else "(?U)" + pattern
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def extract(text: Column, kinds: tuple[str, ...] = tuple(ENTITIES), max_entities: int = MAX_ENTITIES) -> Column:
    """Values by category and place, trimmed, each once, at most max_entities."""
    found = F.concat(*[matches(text, k) for k in (*kinds, "id_like")])
    return F.slice(F.array_distinct(F.filter(F.transform(found, strip), lambda v: v != "")), 1, max_entities)


def keep_worthy(value: Column) -> Column:
    """Context entities that protect a chunk: no addresses, links or bare decimals."""
    s = strip(value)
    return (s != "") & ~F.contains(s, F.lit("@")) & ~F.lower(s).rlike("^https?://") & ~s.rlike(r"^(?=.*\d)\d*\.\d*$")
