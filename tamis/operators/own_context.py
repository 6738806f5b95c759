"""Scores of questions that have contexts of their own: one pass over a context's chunks, in Arrow batches.

The rows come by context, its questions first; a context may go on over any number of batches. Of a chunk only its length and its hits stay until
the context ends, never its text."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa

from tamis.functions import lexicon as lex
from tamis.functions import plain

CUES = ["numeric", "method", "related", "method_damping", "related_damping"]
FLAGS = ["wants_numbers", "wants_method", "wants_related"]
MAX_MEMO = 500_000
OUT_ROWS = 10_000


class Question:
    """What a question asks for, and its hits in the chunks of its context so far."""

    def __init__(self, query_id, text, flags, synonyms, w):
        self.query_id, self.flags, self.w = query_id, flags, w
        words = plain.words(text)
        terms = Counter(s for s in map(plain.stem, words) if plain.is_content(s))
        if flags[1] or flags[2]:  # an intent makes terms unique and adds its own
            extra = [*(lex.METHOD_EXTRA if flags[1] else []), *(lex.RELATED_EXTRA if flags[2] else [])]
            terms = dict.fromkeys([*terms, *map(plain.stem, extra)], 1)
        self.times = dict(sorted(terms.items()))
        self.asked = Counter(filter(plain.is_content, words))
        self.sizes, self.by_gram = {}, {}
        for a in self.asked:
            grams = plain.grams(a, w.ngram_n)
            self.sizes[a] = len(grams)
            for g in grams:
                self.by_gram.setdefault(g, []).append(a)
        self.synonyms = sorted(set(synonyms or ()))
        self.by_stem = {}
        for s in self.synonyms:
            self.by_stem.setdefault(plain.stem(s), []).append(s)
        self.memo, self.df, self.hits = {}, Counter(), []

    def alike(self, word: str) -> list[tuple[str, float]]:
        """Words of the question with n-gram Jaccard of the threshold or more."""
        grams = plain.grams(word, self.w.ngram_n)
        nb, at = len(grams), self.w.ngram_threshold
        both: dict[str, int] = {}
        for g in grams:
            for a in self.by_gram.get(g, ()):
                both[a] = both.get(a, 0) + 1
        found = ((a, n, self.sizes[a]) for a, n in both.items())
        return [(a, n / (na + nb - n)) for a, n, na in found if na >= at * nb and nb >= at * na and n / (na + nb - n) >= at]

    def effect(self, word: str):
        """(term, words alike, synonyms) of a word of a chunk; None if it has none."""
        stem = plain.stem(word)
        raw, by_stem = plain.is_content(word), plain.has_content_stem(word)
        term = stem if by_stem and stem in self.times else None
        alike = self.alike(word) if raw else []
        synonyms = [*([word] if raw and word in self.synonyms else []), *(self.by_stem.get(stem, ()) if by_stem else ())]
        return (term, alike, synonyms) if term is not None or alike or synonyms else None

    def add(self, counts: dict[str, int], max_memo: int) -> None:
        tf, best, synonyms = {}, {}, set()
        for word, n in counts.items():
            if word not in self.memo:
                if len(self.memo) >= max_memo:
                    self.memo.clear()
                self.memo[word] = self.effect(word)
            if (found := self.memo[word]) is None:
                continue
            if found[0] is not None:
                tf[found[0]] = tf.get(found[0], 0) + n
            for a, similarity in found[1]:
                best[a] = max(best.get(a, 0.0), similarity)
            synonyms.update(found[2])
        self.df.update(tf.keys())
        ngram = sum(best[a] * self.asked[a] for a in sorted(best)) / self.asked.total() if best else 0.0
        self.hits.append((tf, ngram, len(synonyms) / len(self.synonyms) if synonyms else 0.0))

    def scores(self, chunks: list, avg_dl: float):
        """(bm25, ngram, synonym, numeric, method, related, score) for each chunk; chunks: (chunk_idx, dl, cues)."""
        w, n_docs, (numbers, method, related) = self.w, len(chunks), self.flags
        idf = {t: math.log((n_docs - df + 0.5) / (df + 0.5) + 1.0) for t, df in self.df.items()}
        rows = []
        for (_, dl, cues), (tf, ngram, synonym) in zip(chunks, self.hits, strict=True):
            bm25 = 0.0
            for term in sorted(tf):
                down = tf[term] + w.k1 * (1.0 - w.b + w.b * (dl / avg_dl)) if avg_dl > 0 else tf[term] + w.k1
                bm25 += self.times[term] * (idf[term] * (tf[term] * (w.k1 + 1.0) / down))
            bm25 = bm25 * (cues[3] if method else 1.0) * (cues[4] if related else 1.0)
            rows.append((bm25, ngram, synonym, cues[0] if numbers else 0.0, cues[1] if method else 0.0, cues[2] if related else 0.0))
        tops = [m if m > 0 else 1.0 for m in map(max, zip(*rows, strict=True))]
        for row in rows:
            share = [v / top for v, top in zip(row, tops, strict=True)]
            score = w.bm25 * share[0] + w.ngram * share[1] + w.synonym * share[2]
            for flag, s, weight in zip(self.flags, share[3:], (w.numeric, w.method, w.related), strict=True):
                if flag and weight > 0:
                    score = min(1.0, max(0.0, score + weight * s))
            yield *row, score


def scored_batches(w):
    """For mapInArrow: rows (context_id, is_chunk, query_id, text, flags, synonyms, chunk_idx, cues) to scores."""

    def body(batches):
        context, questions, chunks, out, types = None, [], [], [], None

        def ended():
            avg_dl = sum(dl for _, dl, _ in chunks) / len(chunks) if chunks else 0.0
            for q in questions if chunks else ():
                out.extend((q.query_id, context, c[0], *s) for c, s in zip(chunks, q.scores(chunks, avg_dl), strict=True))

        def packed():
            columns = zip(*out, strict=True)
            names = ["query_id", "context_id", "chunk_idx", "bm25", "ngram", "synonym", "numeric", "method", "related", "score"]
            return pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.float64())) for n, v in zip(names, columns, strict=True)], names=names)

        for batch in batches:
            types = types or {n: batch.schema.field(n).type for n in ("query_id", "context_id", "chunk_idx")}
            columns = [batch.column(n).to_pylist() for n in ("context_id", "is_chunk", "query_id", "text", "synonyms", "chunk_idx")]
            extra = [list(zip(*(batch.column(n).to_pylist() for n in names), strict=True)) for names in (FLAGS, CUES)]
            for own, is_chunk, query_id, text, synonyms, chunk_idx, flags, cues in zip(*columns, *extra, strict=True):
                if own != context:
                    ended()
                    context, questions, chunks = own, [], []
                    if len(out) >= OUT_ROWS:
                        yield packed()
                        out.clear()
                if not is_chunk:
                    questions.append(Question(query_id, text, flags, synonyms, w))
                elif questions:
                    counts = Counter(plain.words(text))
                    chunks.append((chunk_idx, sum(n for word, n in counts.items() if plain.has_content_stem(word)), cues))
                    for q in questions:
                        q.add(counts, max(1000, MAX_MEMO // len(questions)))
        ended()
        if out:
            yield packed()

    return body
