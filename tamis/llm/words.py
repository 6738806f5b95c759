"""Vectorised tokenisation of UTF-8 text columns, shared by the operators of this package.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  The separators are ASCII, so
working on bytes gives the same words as working on code points.  Word identity is a 64-bit
polynomial hash over random byte values; positions never leave numpy.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 700_000  # documents are handled in groups of about this many bytes

_SEP = np.ones(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = False  # True: belongs to a word
_ALNUM = np.zeros(256, bool)  # letters, digits and every byte of a non-ASCII character
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, CHUNK_BYTES), base, np.uint64))])
        if n <= 2 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def trim() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """Some whole documents laid end to end: bytes, and the offsets of each document."""

    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a Texts: byte start and end, owning document, hash; first[i] is the first word of document i."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    heads: list[np.ndarray]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The column's buffers without copying; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_null(column.type):
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(buf[off[0] : off[-1]], off - off[0])


def texts_from(items: list[str | bytes | None]) -> Texts:
    raw = [b"" if x is None else x.encode() if isinstance(x, str) else x for x in items]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def chunks(texts: Texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of documents of about limit bytes; a longer document stands alone and stays whole."""
    a = 0
    while a < texts.n:
        b = int(np.searchsorted(texts.off, texts.off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), texts.n)
        yield a, b, Texts(texts.buf[texts.off[a] : texts.off[b]], texts.off[a : b + 1] - texts.off[a])
        a = b


def words_of(texts: Texts, lower: bool = True, hashes: bool = True, alnum: bool = False, heads_of: tuple[int, ...] = ()) -> Words:
    """alnum: words hold letters and digits only. heads_of: also hashes of each word's first so many bytes."""
    buf, off = texts.buf, texts.off
    n = len(buf)
    inside = (_ALNUM if alnum else _SEP)[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    heads = off[:-1][np.diff(off) > 0]
    begin[heads] = inside[heads]
    tails = off[1:][np.diff(off) > 0] - 1
    finish[tails] = inside[tails]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(finish) + 1
    first = np.searchsorted(start, off).astype(np.int64)
    doc = np.repeat(np.arange(texts.n), np.diff(first))
    h, parts = np.zeros(0, np.uint64), []
    if hashes:
        with np.errstate(over="ignore"):
            acc = np.zeros(n + 1, np.uint64)
            np.cumsum(_RANDOM[LOWER[buf] if lower else buf] * _power("p", _P, n), out=acc[1:])
            back = _power("i", _PINV, n + 1)[start]
            h = mix((acc[end] - acc[start]) * back)
            for k in heads_of:
                parts.append(np.where(end - start > k, mix((acc[np.minimum(start + k, end)] - acc[start]) * back + np.uint64(k)), np.uint64(0)))
    return Words(start, end, doc, h, first, parts)


_Q = np.uint64(0xD6E8FEB86659FD93)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every run of `size` words inside one document."""
    n = len(words.hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words.hash[: n - size + 1].copy()
        for j in range(1, size):
            h *= _Q
            h += words.hash[j : n - size + 1 + j]
    ok = words.doc[: n - size + 1] == words.doc[size - 1 :]
    at = np.flatnonzero(ok)
    return at, mix(h[at])


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets (empty ranges give 0)."""
    acc = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return acc[off[1:]] - acc[off[:-1]]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span, as it stands (no folding)."""
    with np.errstate(over="ignore"):
        acc = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_RANDOM[buf] * _power("p", _P, len(buf)), out=acc[1:])
        return mix((acc[end] - acc[start]) * _power("i", _PINV, len(buf) + 1)[start] + (end - start).astype(np.uint64))


def repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(comes again in its document, came before in its document) for hashes in document order."""
    with np.errstate(over="ignore"):
        key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again, before = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[:-1]] = same
    before[order[1:]] = same
    return again, before


def split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(order by key, the keys that occur, the bounds of each in that order)."""
    order = np.argsort(key, kind="stable")
    some, first = np.unique(key[order], return_index=True)
    return order, some, list(zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True)) if len(some) else []
