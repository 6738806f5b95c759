"""Words, stems and n-grams of `text` in Python, for code that runs in Arrow batches; tests hold both to the same results."""

from __future__ import annotations

import re
from functools import lru_cache

from tamis.functions.lexicon import DERIVED, ENDINGS, STOP_WORDS

_WORD = re.compile("[a-z0-9]+")
_VOWEL = re.compile("[aeiou]")
_CHANGE = re.compile("[aeiou][^aeiou]")
_CLOSED = re.compile("[^aeiou][aeiou][^aeiou]$")
_DERIVED = re.compile("(" + "|".join(a for a, _ in DERIVED) + ")$")
_ENDING = re.compile("(" + "|".join(ENDINGS) + ")$")
_TOUCHED = re.compile(r"(?:s|ed|ing|y|e|([^aeiou])\1|" + "|".join([a for a, _ in DERIVED] + ENDINGS) + ")$")
_TO = dict(DERIVED)
_STOP = frozenset(STOP_WORDS)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def is_content(word: str) -> bool:
    return len(word) > 1 and word not in _STOP


def measure(w: str) -> int:
    return (len(w) - len(_CHANGE.sub("", w))) // 2


def _head(w: str, cut: int) -> str:
    return w[: max(0, len(w) - cut)]


def _twin(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and not _VOWEL.match(w[-1])


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The steps of `text.stem`."""
    w = word.lower().strip(" ")
    if len(w) <= 2 or not _TOUCHED.search(w):
        return w
    if w.endswith("sses") or (w.endswith("ies") and len(w) > 4):
        w = _head(w, 2)
    elif w.endswith("s") and not w.endswith(("ss", "us")):
        w = _head(w, 1)
    if w.endswith("eed"):
        w = _head(w, 1) if measure(_head(w, 3)) > 0 else w
    elif (cut := 2 if w.endswith("ed") and _VOWEL.search(_head(w, 2)) else 3 if w.endswith("ing") and _VOWEL.search(_head(w, 3)) else 0) > 0:
        w = _head(w, cut)
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _twin(w) and w[-1] not in "lsz":
            w = _head(w, 1)
        elif measure(w) == 1 and _CLOSED.search(w):
            w += "e"
    if w.endswith("y") and len(w) > 2 and _VOWEL.search(_head(w, 1)):
        w = _head(w, 1) + "i"
    if (found := _DERIVED.search(w)) and measure(base := w[: found.start()]) > 0:
        w = base + _TO[found[1]]
    if (found := _ENDING.search(w)) and measure(base := w[: found.start()]) > 1:
        w = base
    if w.endswith("e"):
        m = measure(_head(w, 1))
        if m > 1 or (m == 1 and not _CLOSED.search(_head(w, 1))):
            w = _head(w, 1)
    return _head(w, 1) if _twin(w) and w[-1] not in "lsz" and measure(_head(w, 1)) > 1 else w


@lru_cache(maxsize=200_000)
def grams(word: str, n: int = 3) -> frozenset[str]:
    return frozenset([word] if len(word) < n else [word[i : i + n] for i in range(len(word) - n + 1)])


@lru_cache(maxsize=200_000)
def has_content_stem(word: str) -> bool:
    return is_content(stem(word))
