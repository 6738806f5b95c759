"""Benchmark decontamination: rare n-gram seeds join passages to test items, local alignment scores them.

Words are runs of letters and digits, lower-cased.  The n-grams of an item are its seeds; an item shorter than n
words is one seed.  A seed is rare if it stands in few different surroundings (the word before and the word after)
over all documents: copies of one passage count once, however many documents hold it, so a leaked passage never
makes its own seeds common.  Documents are joined with the items on seeds.  Seeds of one item on diagonals of a
document that one alignment could still connect make one passage; it goes on if it holds a rare seed, or two
different seeds.  What is left out holds a single common seed.  A passage is also left out where no alignment can
reach the threshold: a matched word of the document is a word of the item and adds 2, any other word inside the
alignment costs 1, so the best run of such sums bounds the score.

Smith-Waterman alignment over words (match 2, other -1) between the item and the passage, widened by SLACK words,
gives the score: the best local score over that of the item with itself, of STRETCH words of it for a longer item,
so that a long stretch of a long item counts as a copy; 1 at most.  An edited copy loses 1.5 words for each changed
word.  Pairs from `threshold` on are reported.

The items are broadcast in slices of at most MAX_GRAMS n-grams.  One slice meets the documents directly.  Of several
slices a bitmap of all seeds (BITMAP bits, whatever the benchmark) first picks the documents that hold any, in one
pass; these few are written to the checkpoint folder and meet one slice after the other, each freed after its use.

Null and empty texts or items match nothing, repeated items give repeated pairs, repeated documents are matched one
by one, ties go to the first place, null ids are carried, extra columns are ignored, empty tables give empty
results.  Texts are handled whole: a task holds a batch of rows at some thirty times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import checkpointed
from tamis.llm.words import Texts, chunks, mix, texts_from, texts_of, words_of

N = 3
SLACK = 8
MAX_GRAMS = 2_000_000
BITMAP = 1 << 26
PAIRS = 1_000_000  # postings, and words of passages, held at once
STRETCH = 100
THRESHOLD = 0.5
RARE, SHARE = 50, 20_000  # a seed is rare in up to RARE surroundings, or one for SHARE documents if that is more


def _grams(hash_: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every n-gram of words inside one text."""
    if len(hash_) < N:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = hash_[: len(hash_) - N + 1].copy()
        for j in range(1, N):
            h = h * np.uint64(0xD6E8FEB86659FD93) + hash_[j : len(hash_) - N + 1 + j]
    at = np.flatnonzero(doc[: len(h)] == doc[N - 1 :])
    return at, mix(h[at])


def _member(word: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Key of a word in an item."""
    with np.errstate(over="ignore"):
        return mix(word + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Items:
    """A slice of the test items: ids, words end to end, and gram postings (gram, item, offset) sorted by gram."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    member: np.ndarray  # keys of (item, word), sorted
    rare: np.ndarray  # of each posting

    @property
    def whole(self) -> np.ndarray:
        """Words whose full match is a score of 1, for each item."""
        return np.minimum(np.diff(self.first), STRETCH)

    @staticmethod
    def of(rows: list[tuple], common: np.ndarray) -> Items:
        """rows: (id, text); common: the sorted hashes of common grams."""
        w = words_of(texts_from([t for _, t in rows]), alnum=True)
        at, h = _grams(w.hash, w.doc)
        item, offset = w.doc[at], at - w.first[w.doc[at]]
        counts = w.counts
        short = np.flatnonzero((counts > 0) & (counts < N))  # items of one or two words are found by their first word
        gram = np.concatenate([h, mix(w.hash[w.first[short]])])
        item, offset = np.concatenate([item, short]), np.concatenate([offset, np.zeros(len(short), np.int64)])
        order = np.argsort(gram, kind="stable")
        return Items([i for i, _ in rows], w.hash, w.first, gram[order], item[order], offset[order], np.unique(_member(w.hash, w.doc)), ~_lookup(common, gram[order]))


def _doc_grams(part: Texts):
    """Words, and the grams and single words of a group of documents, with positions."""
    w = words_of(part, alnum=True)
    at, h = _grams(w.hash, w.doc)
    return w, at, h


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted keys."""
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def align(items: np.ndarray, item_len: np.ndarray, docs: np.ndarray, doc_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman for many pairs at once, along anti-diagonals: match 2, mismatch -1, gap -1.

    items [p, m] and docs [p, k] hold word hashes, padded. Returns the best score and the start and end in docs."""
    p, m = items.shape
    k = docs.shape[1]
    # cell (i, j) lies on diagonal i + j; arrays are indexed by i; a path's first doc position travels with it
    one, two = np.zeros((p, m + 1), np.int32), np.zeros((p, m + 1), np.int32)
    from_one, from_two = np.zeros((p, m + 1), np.int32), np.zeros((p, m + 1), np.int32)
    best, start, end = np.zeros(p, np.int32), np.zeros(p, np.int32), np.zeros(p, np.int32)
    rows = np.arange(p)
    i = np.arange(1, m + 1)
    for d in range(2, m + k + 1):
        j = d - i
        ok = (j >= 1) & (j <= k)
        if not ok.any():
            continue
        jj = np.clip(j, 1, k)
        same = (items == docs[:, jj - 1]) & ok & (i <= item_len[:, None]) & (jj <= doc_len[:, None])
        options = np.stack([two[:, :-1] + np.where(same, 2, -1), one[:, :-1] - 1, one[:, 1:] - 1])
        origin = np.stack([np.where(two[:, :-1] > 0, from_two[:, :-1], jj - 1), from_one[:, :-1], from_one[:, 1:]])
        pick = options.argmax(0)
        value = np.take_along_axis(options, pick[None], 0)[0]
        begin = np.take_along_axis(origin, pick[None], 0)[0]
        dead = (value <= 0) | ~ok
        value[dead] = 0
        now, now_from = np.zeros_like(one), np.zeros_like(one)
        now[:, 1:], now_from[:, 1:] = value, begin
        top = value.argmax(1)
        better = value[rows, top] > best
        best[better] = value[rows, top][better]
        start[better] = begin[rows, top][better]
        end[better] = jj[top][better]
        two, from_two, one, from_one = one, from_one, now, now_from
    return best, start, end


def _bound(items: Items, item: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """No alignment of item[i] with words[begin[i] : begin[i] + size[i]] scores more than this."""
    out = np.zeros(len(item), np.int64)
    ends = np.cumsum(size)
    a = 0
    while a < len(item):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + PAIRS, "right")))
        n = size[a:b]
        first = np.cumsum(n) - n
        group = np.repeat(np.arange(b - a), n)
        word = words[np.arange(len(group)) + (begin[a:b] - first)[group]]
        value = np.where(_lookup(items.member, _member(word, item[a:b][group])), 2, -1)
        after = np.cumsum(value) - group * (4 * len(group))  # each group lies below the ones before
        gain = after - np.minimum.accumulate(after - value)
        out[a:b] = np.maximum.reduceat(gain, first)
        a = b
    return out


def _hits(w, at: np.ndarray, h: np.ndarray, items: Items):
    """(place, item, diagonal, rare) of all seeds, some whole documents at a time, sorted by document, item, diagonal."""
    lo, hi = np.searchsorted(items.gram, h, "left"), np.searchsorted(items.gram, h, "right")
    ends = np.cumsum(hi - lo)
    heads = np.flatnonzero(np.concatenate([[True], w.doc[at[1:]] != w.doc[at[:-1]]]))
    limits = np.append(heads[1:], len(at))
    x = 0
    while x < len(heads):
        before = ends[heads[x] - 1] if heads[x] else 0
        y = max(x + 1, int(np.searchsorted(ends[limits - 1], before + PAIRS, "right")))
        own = slice(heads[x], limits[y - 1])
        x = y
        n = (hi - lo)[own]
        place = np.repeat(at[own], n)
        post = np.repeat(lo[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = items.item[post], place - items.offset[post]
        order = np.lexsort((diagonal, item, w.doc[place]))
        yield place[order], item[order], diagonal[order], items.rare[post[order]]


def _find(part: Texts, items: Items, threshold: float):
    """(document, item, score, start word, end word) of the passages in some documents."""
    w, at, h = _doc_grams(part)
    short = np.diff(items.first)[items.item] < N if len(items.item) else np.zeros(0, bool)
    at, h = np.concatenate([at, np.arange(len(w.hash))]) if short.any() else at, np.concatenate([h, mix(w.hash)]) if short.any() else h
    hit = _lookup(items.gram, h)
    at, h = at[hit], h[hit]
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    return [x for found in _hits(w, at[order], h[order], items) for x in _passages(w, items, threshold, *found)]


def _passages(w, items: Items, threshold: float, place: np.ndarray, item: np.ndarray, diagonal: np.ndarray, rare: np.ndarray):
    doc, length, needed = w.doc[place], np.diff(items.first), threshold * 2.0 * items.whole
    # a gap that costs more than the item can spare is in no alignment that counts
    spare = np.maximum(2 * length - needed, SLACK)
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > spare[item[1:]])]))
    last = np.append(cut[1:], len(place)) - 1
    offset = place - diagonal
    enough = np.logical_or.reduceat(rare, cut) | (np.minimum.reduceat(offset, cut) < np.maximum.reduceat(offset, cut))
    cut, last = cut[enough], last[enough]
    doc, item, low, high = doc[cut], item[cut], diagonal[cut], diagonal[last]
    begin = np.maximum(low - SLACK, w.first[doc])
    stop = np.minimum(high + length[item] + SLACK, w.first[doc + 1])
    if len(doc):
        keep = _bound(items, item, w.hash, begin, np.maximum(stop - begin, 1)) >= needed[item]
        doc, item, begin, stop = doc[keep], item[keep], begin[keep], stop[keep]
    out = []
    size = np.maximum(stop - begin, 1)
    by_size = np.argsort(size * 1000 + length[item], kind="stable")
    a = 0
    while a < len(by_size):
        # alignments of like size together, under a bound of cells
        b = a + 1
        while b < len(by_size) and b - a < 4096 and (b + 1 - a) * int(size[by_size[b]]) <= 400_000:
            b += 1
        own = by_size[a:b]
        a = b
        m, k = int(length[item[own]].max()), int(size[own].max())
        grid = np.arange(m)
        it = np.where(grid < length[item[own]][:, None], items.words[np.minimum(items.first[item[own]][:, None] + grid, len(items.words) - 1)], np.uint64(1))
        grid = np.arange(k)
        dc = np.where(grid < size[own][:, None], w.hash[np.minimum(begin[own][:, None] + grid, len(w.hash) - 1)], np.uint64(2))
        best, s, e = align(it, length[item[own]], dc, size[own])
        score = np.minimum(best / (2.0 * items.whole[item[own]]), 1.0)
        for x in np.flatnonzero(score >= threshold).tolist():
            d = int(doc[own[x]])
            base = int(begin[own[x]] - w.first[d])
            out.append((d, int(item[own[x]]), float(score[x]), base + int(s[x]), base + int(e[x])))
    return out


def item_slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items in slices of at most MAX_GRAMS words, each a list of (id, text); one slice is held at a time."""
    rows, grams = [], 0
    for r in benchmark.select(benchmark[id_col].alias("i"), benchmark[text_col].alias("t")).filter("t is not null").orderBy("i", "t").toLocalIterator():
        rows.append((r["i"], r["t"]))
        grams += len(r["t"]) // 2
        if grams >= MAX_GRAMS:
            yield rows
            rows, grams = [], 0
    if rows:
        yield rows


@dataclass
class Seeds:
    """Which hashes may be seeds of some item: a bitmap, and whether there is more than one slice of items."""

    bits: np.ndarray
    several: bool

    @staticmethod
    def of(slices: Iterator[list[tuple]]) -> Seeds:
        bits, n = np.zeros(BITMAP // 8, np.uint8), 0
        for rows in slices:
            n += 1
            at = (Items.of(rows, np.zeros(0, np.uint64)).gram % np.uint64(BITMAP)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return Seeds(bits, n > 1)

    def hold(self, h: np.ndarray) -> np.ndarray:
        at = (h % np.uint64(BITMAP)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def common_grams(texts: DataFrame, seeds: Seeds) -> np.ndarray:
    """Sorted hashes of the seeds that are not rare: counts of distinct surroundings over all documents. texts: (text)."""
    limit = max(RARE, texts.count() // SHARE)
    shared = texts.sparkSession.sparkContext.broadcast(seeds)

    def body(batches):
        own = shared.value
        for batch in batches:
            for _, _, part in chunks(texts_of(batch.column(0))):
                w, at, h = _doc_grams(part)
                hit = own.hold(h)
                at, h = at[hit], h[hit]
                if not len(at):
                    continue
                inside = lambda i: np.where((i >= w.first[w.doc[at]]) & (i < w.first[w.doc[at] + 1]), w.hash[np.clip(i, 0, len(w.hash) - 1)], np.uint64(0))  # noqa: B023, E731
                with np.errstate(over="ignore"):
                    around = mix(inside(at - 1) * np.uint64(3) + inside(at + N))
                order = np.lexsort((around, h))
                h, around = h[order], around[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[fresh].view(np.int64)), pa.array(around[fresh].view(np.int64))], ["gram", "around"])

    found = texts.mapInArrow(body, "gram bigint, around bigint").distinct().groupBy("gram").count().filter(F.col("count") > limit).select("gram")
    return np.sort(found.toArrow().column("gram").to_numpy().view(np.uint64))  # some of the benchmark's n-grams


def _with_seeds(docs: DataFrame, at: int, seeds: Seeds, want: bool) -> DataFrame:
    """Rows of docs that may hold a seed (or may not)."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def body(batches):
        own = shared.value
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for a, _, part in chunks(texts_of(batch.column(at))):
                w, place, h = _doc_grams(part)
                hit[a + np.concatenate([w.doc[place[own.hold(h)]], w.doc[own.hold(mix(w.hash))]])] = True
            yield batch.filter(pa.array(hit == want))

    return docs.mapInArrow(body, docs.schema)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of every passage that scores the threshold."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint"
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    seeds = Seeds.of(item_slices(benchmark, item_id_col, item_text_col))
    common = common_grams(rows.select("text"), seeds)
    if seeds.several:
        rows = checkpointed(_with_seeds(rows, 1, seeds, True))
    parts = []
    for piece in item_slices(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(Items.of(piece, common))

        def body(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for a, _, part in chunks(texts_of(batch.column(1))):
                    found = _find(part, items, threshold)
                    if found:
                        d, i, s, b, e = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([a + x for x in d])), pa.array([items.ids[x] for x in i], pa.int64()), pa.array(s, pa.float64()), pa.array(b, pa.int64()), pa.array(e, pa.int64())],
                            ["doc_id", "item_id", "score", "start_word", "end_word"],
                        )

        part = rows.mapInArrow(body, schema)
        if seeds.several:
            part = checkpointed(part)
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of the benchmark."""
    at = docs.columns.index(text_col)
    seeds = Seeds.of(item_slices(benchmark, item_id_col, item_text_col))
    common = common_grams(docs.select(docs[text_col].alias("text")), seeds)
    clear = _with_seeds(docs, at, seeds, False) if seeds.several else None
    if seeds.several:
        docs = checkpointed(_with_seeds(docs, at, seeds, True))
    for piece in item_slices(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(piece, common))

        def body(batches, shared=shared):
            items = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, part in chunks(texts_of(batch.column(at))):
                    clean[[a + x[0] for x in _find(part, items, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(body, docs.schema)
        if seeds.several:
            docs = checkpointed(docs)
            shared.destroy()
    return docs if clear is None else clear.unionByName(docs)
