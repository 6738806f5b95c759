"""Exact removal of repeated substrings by longest-previous-factor arrays.

A byte goes if some `length`-byte string that covers it also starts earlier (smaller id, or same id and an
earlier start).  That holds for a string starting at s iff its longest previous factor is at least `length` long.
The factor at a suffix is its larger common prefix with two others: in suffix order, the nearest before and the
nearest after that stand at a smaller position (`factors`; common prefixes are cut off at `length`).  The suffix
order is needed only among strings that can be equal, so the texts are cut up by content first:

1. Anchors.  Each window of `length` bytes has one anchor, the leftmost least of its GRAM-byte hashes.  Equal
   windows have equal anchors at equal places, wherever they stand.  Blocks of documents send their anchor
   hashes, each once, to buckets, and get back those that come twice or more.
2. Contexts.  Each occurrence of such an anchor sends the bytes of the windows it owns (at most
   2 * length - GRAM bytes) to the bucket of the anchor; anchors with over CROWD occurrences are salted by block.
3. In a bucket, a context that equals an earlier one byte for byte is covered whole.  The different contexts of
   the bucket get one suffix order by prefix doubling, previous and next smaller positions and the factors, and
   windows whose factor reaches `length` are covered.  Of a salted anchor the windows that are first in their salt
   meet once more by 128-bit hash, spread over all buckets, so that no anchor has to fit in one task.
4. Removed ranges go back to the blocks, which return the bytes that are kept and the removed spans.

A text equal to one of a smaller id is removed whole (if long enough) and takes no part in steps 2 and 3.
Blocks and buckets are sized by the input, a block's rows for the buckets never outnumber its anchors, every row
of a shuffle is a batch of arrays, and nothing is dropped.  Matches are judged on the input and never cross
documents.  Null texts are empty.  A repeated row stands at one place with its first and removes nothing from it;
different texts under one id are different documents, in a fixed order; null ids come before all others and are
spread by their texts.  Texts are handled whole: a task holds a block of about BLOCK_BYTES, or one longer text,
at some twenty times its size.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm import words as w
from tamis.llm.common import checkpointed, hot_join, partitions_for, runs
from tamis.llm.words import Texts, chunks, mix, span_hashes, split, texts_of, trim

GRAM_SHARE = 63  # windows choose among 64 grams
BLOCK_BYTES = 3_000_000
CROWD = 4000
NULL_ID = -(2**63)


def anchors(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first window, number of windows) of every anchor; windows are byte positions in the buffer."""
    gram = length - GRAM_SHARE
    buf, off = texts.buf, texts.off
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(w._RANDOM[buf] * w._power("p", w._P, n), out=acc[1:])
        h = mix((acc[gram:] - acc[:-gram]) * w._power("i", w._PINV, n + 1)[: n - gram + 1])
    least, at = h, np.arange(len(h), dtype=np.int64 if n > 2**31 - 1 else np.int32)
    step = 1
    while step <= GRAM_SHARE:
        less = least[step:] < least[:-step]
        at = np.where(less, at[step:], at[:-step])
        least = np.where(less, least[step:], least[:-step])
        step *= 2
    s = np.arange(n - length + 1)
    doc = np.repeat(np.arange(texts.n), np.diff(off))[: len(s)]
    inside = s + length <= off[doc + 1]
    s, doc, at = s[inside], doc[inside], at[s][inside]
    if not len(s):
        return np.zeros(0, np.uint64), none, none, none
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]))
    return h[at[cut]], doc[cut], s[cut], np.diff(np.append(cut, len(s)))


def suffix_ranks(buf: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """[(n, rank of the n-byte string at every position of buf)] for n = 8, 16, .. and `length`, by prefix doubling;
    equal strings share a rank, and zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(length + 8, np.uint8)])
    n = len(buf)
    first = np.zeros(n, np.uint64)
    for j in range(8):
        first = first << np.uint64(8) | padded[j : j + n].astype(np.uint64)
    rank = np.unique(first, return_inverse=True)[1].astype(np.uint32)
    out = [(8, rank)]
    have = 8
    while have < length:
        step = min(have, length - have)
        behind = np.concatenate([rank[step:], np.zeros(min(step, n), np.uint32)])[:n]
        rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | behind, return_inverse=True)[1].astype(np.uint32)
        have += step
        out.append((have, rank))
    return out


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1.

    All places jump at once: what lies between a place and its candidate is never smaller, so a candidate that is
    not smaller hands over its own candidate."""
    out = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(out >= 0)
    while len(todo):
        todo = todo[values[out[todo]] >= values[todo]]
        out[todo] = out[out[todo]]
        todo = todo[out[todo] >= 0]
    return out


def common_prefix(buf: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, cut off at length: whole equal stretches by rank, then bytes."""
    got = np.zeros(len(a), np.int64)
    n = len(buf)
    for size, rank in reversed(ranks):
        x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        fits = (got + size <= length) & (a + got < n) & (b + got < n) & (rank[x] == rank[y])
        got[fits] += size
    going = got < length
    for _ in range(8):
        x, y = a + got, b + got
        going = going & (got < length) & (x < n) & (y < n)
        going &= buf[np.minimum(x, n - 1)] == buf[np.minimum(y, n - 1)]
        got[going] += 1
    return got


def factors(buf: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor, cut off at length, of the suffix at each start: its longest common prefix with a
    suffix of smaller position. At least `length` bytes follow every start."""
    ranks = suffix_ranks(buf, length)
    order = np.lexsort((position, ranks[-1][1][starts]))
    at, place = starts[order], position[order]
    before = previous_smaller(place)
    after = len(place) - 1 - previous_smaller(place[::-1])[::-1]
    out = np.zeros(len(order), np.int64)
    for near, has in ((before, before >= 0), (after, after < len(place))):
        i = np.flatnonzero(has)
        out[i] = np.maximum(out[i], common_prefix(buf, ranks, at[i], at[near[i]], length))
    result = np.empty_like(out)
    result[order] = out
    return result


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _send_anchors(length: int, buckets: int):
    """Block -> (bucket, block, sorted distinct hashes, counts)."""

    def body(key: tuple, docs: pa.Table) -> pa.Table:
        trim()
        found = [anchors(part, length)[0] for _, _, part in chunks(texts_of(docs.column("text")))]
        h, n = np.unique(np.concatenate(found), return_counts=True)
        order, some, cut = split((h % np.uint64(buckets)).astype(np.int64))
        h, n = h[order], n[order].astype(np.uint32)
        return pa.table(
            {
                "bucket": pa.array(some, pa.int64()),
                "block": pa.array(np.full(len(some), key[0].as_py()), pa.int64()),
                "h": pa.array([h[a:b].tobytes() for a, b in cut], pa.binary()),
                "n": pa.array([n[a:b].tobytes() for a, b in cut], pa.binary()),
            }
        )

    return body


def _answer_anchors(batches):
    """Bucket -> for each block its hashes that come twice or more anywhere, with their counts."""
    for table in runs(batches, "bucket"):
        trim()
        hs = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
        h = np.concatenate(hs)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32)
        uniq, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, n).astype(np.int64)[inverse]
        lens = np.cumsum([0] + [len(x) for x in hs])
        rows = []
        for block, a, b in zip(table.column("block").to_pylist(), lens[:-1], lens[1:], strict=True):
            twice = total[a:b] > 1
            if twice.any():
                rows.append((block, *_pack(h[a:b][twice], np.minimum(total[a:b][twice], 2**32 - 1).astype(np.uint32))))
        if rows:
            block, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.nulls(len(rows), pa.binary())], ["block", "a", "b", "c"])


def _places(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(rows by id and text hash, ids, text hashes, number of each row's place): repeated rows share a place."""
    ids = docs.column("doc_id").fill_null(NULL_ID).to_numpy()
    hashes = docs.column("th").to_numpy()
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    fresh = np.ones(len(ids), np.int64)
    fresh[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    return docs.take(pa.array(order)), ids, hashes, np.cumsum(fresh) - 1


def _is_copy(ids: np.ndarray, hashes: np.ndarray, known: pa.Table) -> np.ndarray:
    copies = known.filter(pc.is_valid(known.column("copy")))
    key = lambda i, h: mix(mix(i.view(np.uint64)) ^ h.view(np.uint64))
    return np.isin(key(ids, hashes), key(copies.column("copy").to_numpy(), copies.column("th").to_numpy()))


_CONTEXTS = {"bucket": pa.int64(), "block": pa.int64()} | {k: pa.binary() for k in ("h", "id", "row", "s", "n", "text")}


def _send_contexts(length: int, buckets: int):
    """Block and its answers -> (bucket, block, tagged anchors, ids, places, window starts, window counts, bytes)."""

    def body(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        empty = pa.table({k: pa.array([], t) for k, t in _CONTEXTS.items()})
        if not answers.num_rows or not docs.num_rows:
            return empty
        block = key[0].as_py()
        known = answers.filter(pc.is_valid(answers.column("a")))
        h = np.frombuffer(b"".join(known.column("a").to_pylist()), np.uint64)
        total = np.frombuffer(b"".join(known.column("b").to_pylist()), np.uint32)
        order = np.argsort(h)
        h, total = h[order], total[order]
        docs, ids, hashes, row = _places(docs)
        copy = _is_copy(ids, hashes, answers)
        if not len(h):
            return empty
        out: list = []
        for a, _, part in chunks(texts_of(docs.column("text"))):
            key_h, doc, s, n = anchors(part, length)
            at = np.minimum(np.searchsorted(h, key_h), len(h) - 1)
            use = (h[at] == key_h) & ~copy[a + doc]
            key_h, doc, s, n, at = key_h[use], doc[use], s[use], n[use], at[use]
            out.append((key_h, total[at], ids[a + doc], row[a + doc], s - part.off[doc], n, *_cut(part.buf, s, s + n + length - 1)))
        key_h, total, ids_, row_, s, n = (np.concatenate([x[i] for x in out]) for i in range(6))
        text = np.concatenate([x[6] for x in out])
        off = np.concatenate([[0], np.cumsum(n + length - 1)])
        salts = -(-total.astype(np.int64) // CROWD)
        with np.errstate(over="ignore"):
            salted = np.where(salts > 1, 1 + block % np.maximum(salts, 1), 0)
            bucket = (mix(key_h + salted.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        order, some, cut = split(bucket)
        cols: list[list] = [[] for _ in range(6)]
        for x, y in cut:
            own = order[x:y]
            tagged = key_h[own] & ~np.uint64(1) | (salted[own] > 0).astype(np.uint64)
            packed = _pack(tagged, ids_[own], row_[own].astype(np.int32), s[own].astype(np.int64), n[own].astype(np.uint8), _cut(text, off[own], off[own + 1])[0])
            for c, v in zip(cols, packed, strict=True):
                c.append(v)
        return pa.table(dict(zip(empty.column_names, [pa.array(some, pa.int64()), pa.array(np.full(len(some), block), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], strict=True)))

    return body


def _cut(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray]:
    """The bytes of the spans, end to end."""
    n = end - start
    if not len(n):
        return (np.zeros(0, np.uint8),)
    to = np.concatenate([[0], np.cumsum(n)])
    return (buf[np.repeat(start - to[:-1], n) + np.arange(to[-1])],)


_FOUND = ["bucket", "block", "row", "s", "e", "id", "h1", "h2"]


def _ranges(block: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Removed ranges as a row for each block; its bucket is negative."""
    order, blocks, cut = split(block)
    cols = [pa.array([np.ascontiguousarray(x[order[a:b]]).tobytes() for a, b in cut], pa.binary()) for x in (row.astype(np.int32), start, end)]
    nothing = pa.nulls(len(blocks), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(-1 - blocks, pa.int64()), pa.array(blocks, pa.int64()), *cols, nothing, nothing, nothing], _FOUND)


def _position(ids: np.ndarray, block: np.ndarray, row: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rank of each place in the order of the whole table: by id, then place, then start; equal places share one."""
    order = np.lexsort((s, row, block, ids))
    step = np.ones(len(order), np.int64)
    step[1:] = reduce(np.logical_or, [x[order[1:]] != x[order[:-1]] for x in (ids, block, row, s)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def _same_bytes(text: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans a and b, equal in length, hold the same bytes."""
    n = off[a + 1] - off[a]
    if not len(n):
        return np.zeros(0, bool)
    first = np.cumsum(n) - n
    inner = np.arange(int(n.sum())) - np.repeat(first, n)
    differ = text[np.repeat(off[a], n) + inner] != text[np.repeat(off[b], n) + inner]
    return np.add.reduceat(differ, first) == 0


def _factors(length: int, buckets: int):
    """Bucket of contexts -> removed ranges (bucket below 0), and firsts of salted anchors (bucket 0..)."""

    def body(batches):
        for table in runs(batches, "bucket"):
            trim()
            get = lambda k, t: np.frombuffer(b"".join(table.column(k).to_pylist()), t)
            tag, ids, row, s, n, text = get("h", np.uint64), get("id", np.int64), get("row", np.int32), get("s", np.int64), get("n", np.uint8).astype(np.int64), get("text", np.uint8)
            lens = [len(x) // 8 for x in table.column("h").to_pylist()]
            block = np.repeat(table.column("block").to_numpy(), lens)
            off = np.concatenate([[0], np.cumsum(n + length - 1)])
            salted = tag & np.uint64(1) == 1
            # contexts with the bytes of an earlier one are covered whole; the others enter the suffix order
            place = _position(ids, block, row, s)
            order = np.lexsort((place, n, span_hashes(text, off[:-1], off[1:])))
            same = span_hashes(text, off[order], off[order + 1])
            fresh = np.ones(len(order), bool)
            fresh[1:] = (same[1:] != same[:-1]) | (n[order[1:]] != n[order[:-1]])
            lead = order[fresh][np.cumsum(fresh) - 1]  # the first occurrence of each row's context
            equal = _same_bytes(text, off, order, lead)
            gone = order[equal & (place[order] != place[lead])]
            if len(gone):
                yield _ranges(block[gone], row[gone], s[gone], s[gone] + n[gone] + length - 1)
            firsts = np.concatenate([order[fresh], order[~equal]])
            # an anchor's only context in this bucket repeats nothing here
            _, inverse, count = np.unique(tag[firsts], return_inverse=True, return_counts=True)
            several = firsts[count[inverse] > 1]
            covered = np.zeros(0, bool)
            win_row = np.repeat(several, n[several])
            inner = np.arange(len(win_row)) - np.repeat(np.cumsum(n[several]) - n[several], n[several])
            if len(several):
                small = _cut(text, off[several], off[several + 1])[0]
                base = np.concatenate([[0], np.cumsum(n[several] + length - 1)])[:-1]
                position = _position(ids[win_row], block[win_row], row[win_row], s[win_row] + inner)
                covered = factors(small, np.repeat(base, n[several]) + inner, position, length) >= length
                yield from _spans(block, row, s, win_row, inner, covered, length)
            # windows that are first here but whose anchor is salted
            lone = firsts[(count[inverse] == 1) & salted[firsts]]
            more = np.repeat(lone, n[lone])
            more_in = np.arange(len(more)) - np.repeat(np.cumsum(n[lone]) - n[lone], n[lone])
            keep = ~covered & salted[win_row]
            win, inn = np.concatenate([win_row[keep], more]), np.concatenate([inner[keep], more_in])
            if len(win):
                at = off[win] + inn
                h1 = span_hashes(text, at, at + length)
                h2 = mix(span_hashes(text, at, at + length // 2) + mix(span_hashes(text, at + length // 2, at + length) ^ np.uint64(77)))
                order, some, cut = split((h1 % np.uint64(buckets)).astype(np.int64))
                cols: list[list] = [[] for _ in range(6)]
                for a, b in cut:
                    own = order[a:b]
                    for c, v in zip(cols, _pack(row[win[own]], (s[win] + inn)[own], block[win[own]], ids[win[own]], h1[own], h2[own]), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), -1), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], _FOUND)

    return body


def _spans(block, row, s, win_row, inner, covered, length):
    """Runs of covered windows of one context, as removed ranges."""
    hit = np.flatnonzero(covered)
    if len(hit):
        cut = np.flatnonzero(np.concatenate([[True], (win_row[hit[1:]] != win_row[hit[:-1]]) | (inner[hit[1:]] != inner[hit[:-1]] + 1)]))
        last = np.append(cut[1:], len(hit)) - 1
        r = win_row[hit[cut]]
        yield _ranges(block[r], row[r], s[r] + inner[hit[cut]], s[r] + inner[hit[last]] + length)


def _meet_firsts(length: int):
    """Bucket of single windows -> removed ranges of all but the first of equal windows."""

    def body(batches):
        for table in runs(batches, "bucket"):
            if table.column("bucket")[0].as_py() < 0:  # ranges pass
                yield from table.to_batches()
                continue
            get = lambda k, t: np.frombuffer(b"".join(table.column(k).to_pylist()), t)
            row, s, block, ids, h1, h2 = get("row", np.int32), get("s", np.int64), get("e", np.int64), get("id", np.int64), get("h1", np.uint64), get("h2", np.uint64)
            place = _position(ids, block, row, s)
            order = np.lexsort((place, h2, h1))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
            lead = order[fresh][np.cumsum(fresh) - 1]
            gone = order[place[order] != place[lead]]
            if len(gone):
                yield _ranges(block[gone], row[gone], s[gone], s[gone] + length)

    return body


def _finish(length: int):
    """Block and its removed ranges -> (doc_id, n_bytes, starts, ends, kept)."""

    def body(key: tuple, docs: pa.Table, gone: pa.Table) -> pa.Table:
        trim()
        docs, ids, hashes, row = _places(docs)
        texts = texts_of(docs.column("text"))
        ranges = gone.filter(pc.is_valid(gone.column("row"))) if gone.num_rows else gone
        g, gs, ge = (np.frombuffer(b"".join(ranges.column(k).to_pylist()), t) for k, t in (("row", np.int32), ("s", np.int64), ("e", np.int64)))
        order = np.lexsort((gs, g))
        g, gs, ge = g[order], gs[order], ge[order]
        copy = _is_copy(ids, hashes, gone)
        lo, hi = np.searchsorted(g, row, "left"), np.searchsorted(g, row, "right")
        starts, ends, kept = [], [], []
        for i in range(texts.n):
            text = texts.buf[texts.off[i] : texts.off[i + 1]]
            n = len(text)
            if copy[i] and n >= length:
                a, b = [0], [n]
            elif hi[i] > lo[i]:
                ends_so_far = np.maximum.accumulate(ge[lo[i] : hi[i]])
                begin = gs[lo[i] : hi[i]]
                cut = np.flatnonzero(np.concatenate([[True], begin[1:] > ends_so_far[:-1]]))
                a, b = begin[cut].tolist(), ends_so_far[np.append(cut[1:], len(begin)) - 1].tolist()
            else:
                a, b = [], []
            edges = [0, *(x for pair in zip(a, b, strict=True) for x in pair), n]
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            starts.append(a)
            ends.append(b)
        longs = pa.list_(pa.int64())
        return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(texts.off), pa.int64()), "starts": pa.array(starts, longs), "ends": pa.array(ends, longs), "kept": pa.array(kept, pa.binary())})

    return body


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): removed spans in bytes, maximal and ordered, and the bytes left."""
    if length <= GRAM_SHARE + 8:
        raise ValueError("length is too short for the anchors")
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    total = docs.select(F.sum(F.octet_length(docs[text_col]).cast("bigint")).alias("n")).first()["n"] or 0
    parts = partitions_for(spark, total)
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(1, total // 4_000_000)  # of anchors: about 1 MB of hashes each
    rooms = max(1, total // 1_000_000)  # of contexts
    placed = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "th"), F.lit(blocks)))
    by_block = placed.repartition(parts, "block").groupBy("block")

    sent = by_block.applyInArrow(_send_anchors(length, buckets), "bucket bigint, block bigint, h binary, n binary")
    answers = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer_anchors, "block bigint, a binary, b binary, c binary").drop("c")

    heads = checkpointed(placed.filter("doc_id is not null").select("doc_id", "th", "block", F.md5("text").alias("key")))
    classes = heads.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("other"), F.count("*").alias("n")).filter("head <> other")
    copies = hot_join(heads, checkpointed(classes), ["key"], "n").filter("doc_id <> head").select("block", F.col("doc_id").alias("copy"), "th")

    known = answers.unionByName(copies, allowMissingColumns=True).repartition(parts, "block")
    contexts = by_block.cogroup(known.groupBy("block")).applyInArrow(_send_contexts(length, rooms), "bucket bigint, block bigint, h binary, id binary, row binary, s binary, n binary, text binary")
    found = "bucket bigint, block bigint, row binary, s binary, e binary, id binary, h1 binary, h2 binary"
    ranges = contexts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_factors(length, rooms), found)
    met = ranges.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet_firsts(length), found)
    gone = met.select("block", "row", "s", "e").unionByName(copies, allowMissingColumns=True).repartition(parts, "block")
    return by_block.cogroup(gone.groupBy("block")).applyInArrow(_finish(length), "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")
