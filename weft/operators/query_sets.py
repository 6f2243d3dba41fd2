"""Very many sets of words against blocks of documents, in Arrow and numpy inside a task.

A block's texts are cut into words over their bytes, and only words of the sets are counted. Sets meet the block's postings all together: those that lack a word there, or whose best possible score
there is too low, fall out first, then the rarest word's documents are looked up under the other words.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a block, about, and candidates that are looked up at once.
BLOCK_BYTES, CANDIDATES = 8 << 20, 2_000_000


class Scoring(NamedTuple):
    """Fixed values of a score: the mean number of a document's words, the weights of label and body, and BM25's two."""

    mean: float
    label: float
    body: float
    k1: float
    b: float


class Sets(NamedTuple):
    """Sets of words: the words and what each scores by its rarity, the sets' ids, and their words' numbers, rarest first, from ``start`` on."""

    words: pa.Array
    idf: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    terms: np.ndarray


def arrange(ids: np.ndarray, words: pa.ListArray, vocabulary: pa.Array, df: np.ndarray, idf: np.ndarray) -> Sets:
    """The sets that can be found: those with a word that no document holds, by ``df`` of the sorted ``vocabulary``, fall out. No set is empty."""
    owner = np.repeat(np.arange(len(ids)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    term = pc.fill_null(pc.index_in(words.flatten(), vocabulary), -1).to_numpy()
    held = (term >= 0) & (np.append(df, 0)[term] > 0)
    whole = np.bincount(owner[~held], minlength=len(ids)) == 0
    owner, term = owner[whole[owner]], term[whole[owner]]
    order = np.lexsort((term, df[term], owner))
    size = np.bincount(owner, minlength=len(ids))[whole]
    return Sets(vocabulary, idf, ids[whole], np.append(0, np.cumsum(size)), term[order])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [a-z0-9]+ of lower-cased texts in turn, and the number of words of each text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = (data - ord("a") < 26) | (data - ord("0") < 10)  # bytes below either wrap around to large ones
    # A word begins where none goes on; none goes on from one text to the next.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]
    letters = data[inside]
    starts = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(letters))
    return words, np.diff(np.searchsorted(np.flatnonzero(begins), ends))


def postings(labels: pa.Array, bodies: pa.Array, known: pa.Array, stops: int) -> tuple[np.ndarray, ...]:
    """(term, document, times in label, times in body), by term and document, of words of ``known`` but the first ``stops``, and how many words but those each document has."""
    each = [split_words(texts) for texts in (labels, bodies)]
    docs = len(labels)
    doc = np.concatenate([np.repeat(np.arange(docs), n) for _, n in each])
    found = pc.fill_null(pc.index_in(pa.concat_arrays([words for words, _ in each]), known), len(known)).to_numpy().astype(np.int64)
    size = np.bincount(doc[found >= stops], minlength=docs)
    key = ((found - stops) * docs + doc) * 2
    key[len(each[0][0]) :] += 1
    key = np.sort(key[(found >= stops) & (found < len(known))])
    pair = key >> 1
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(key) else np.zeros(0, np.int64)
    body = np.add.reduceat(key & 1, at) if len(key) else at
    label = np.diff(at, append=len(key)) - body
    return *np.divmod(pair[at], max(docs, 1)), label, body, size


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, ...]]:
    """The batches' columns (doc_url, label, body) in blocks of about ``BLOCK_BYTES`` of text, and of one document at least."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch[n]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("label", "body")))
        start = 0
        while start < len(ends):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + (not held), int(np.searchsorted(ends, done + BLOCK_BYTES - size, "right")))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - done
            if stop < len(ends):
                yield _joined(held)
                held, size = [], 0
            start = stop
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, ...]:
    return tuple(pa.concat_arrays([batch[n] for batch in held]) for n in ("doc_url", "label", "body"))


def count(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, stop_words: pa.Array) -> Iterator[pa.RecordBatch]:
    """(term, df, n): how many documents hold each word of ``vocabulary``; at term -1, how many documents there are, and their words."""
    known, df, docs, words = pa.concat_arrays([stop_words, vocabulary]), np.zeros(len(vocabulary), np.int64), 0, 0
    for _, label, body in blocks(batches):
        term, *_, size = postings(label, body, known, len(stop_words))
        df += np.bincount(term, minlength=len(df))
        docs, words = docs + len(size), words + int(size.sum())
    term = np.flatnonzero(df)
    columns = np.append(term, -1).astype(np.int32), np.append(df[term], docs), np.append(np.zeros(len(term), np.int64), words)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["term", "df", "n"])


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores to six decimals as Spark rounds them: half up, by their decimal digits."""
    scaled = score * 1e6
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5 + scaled * 1e-15):
        whole[i] = float(Decimal(repr(float(score[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return whole / 1e6


def _places(url: pa.Array) -> np.ndarray:
    """Each url's place among them; a null one comes first."""
    return pc.rank(url, "ascending", null_placement="at_start", tiebreaker="first").to_numpy()


def _first(of: np.ndarray, rank: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` best of each set are, by set, falling rank and the urls' places."""
    order = np.lexsort((place, -rank, of))
    return order[_nth(of[order]) < k]


def _nth(of: np.ndarray) -> np.ndarray:
    """The place from 0 of each row among those of equal ``of``, which lie together."""
    first = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
    return np.arange(len(of)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(of) else np.zeros(0, np.int64)


class _Best:
    """The ``k`` best documents of each set so far, and what a set's next one must score at least."""

    def __init__(self, sets: int, k: int):
        self.k, self.least = k, np.full(sets, -np.inf)
        self.of, self.rank, self.url = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string())
        self.more: list[tuple] = []

    def add(self, of: np.ndarray, rank: np.ndarray, url: pa.Array) -> None:
        self.more.append((of, rank, url))
        if sum(len(m[0]) for m in self.more) > 20_000 + len(self.of) // 2:
            self.settle()

    def settle(self) -> None:
        of, rank, url = zip((self.of, self.rank, self.url), *self.more, strict=True)
        of, rank, url, self.more = np.concatenate(of), np.concatenate(rank), pa.concat_arrays(url), []
        kept = _first(of, rank, _places(url), self.k)
        self.of, self.rank, self.url = of[kept], rank[kept], url.take(pa.array(kept))
        full = np.flatnonzero(_nth(self.of) == self.k - 1)
        self.least[self.of[full]] = self.rank[full]


def _matches(sets: Sets, chosen: np.ndarray, start: np.ndarray, doc: np.ndarray, pair: np.ndarray, part: np.ndarray, docs: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(set, document, score) of documents of a block that hold all words of a set, of the sets ``chosen``; a term's postings lie from ``start`` on."""
    first, size = sets.terms[sets.start[chosen]], np.diff(sets.start)
    n = start[first + 1] - start[first]
    of = np.repeat(chosen, n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[first], n)
    held, score, nth = doc[at], part[at], 1
    while len(of):
        done = size[of] == nth
        if done.any():
            yield of[done], held[done], score[done]
            of, held, score = of[~done], held[~done], score[~done]
        key = sets.terms[sets.start[of] + nth] * docs + held
        at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        there = pair[at] == key
        of, held, score = of[there], held[there], score[there] + part[at[there]]
        nth += 1


def best(batches: Iterator[pa.RecordBatch], sets: Sets, stop_words: pa.Array, scoring: Scoring, k: int) -> Iterator[pa.RecordBatch]:
    """(set, doc_url, rank) of the ``k`` best documents of these batches for each set."""
    known, kept, ends = pa.concat_arrays([stop_words, sets.words]), _Best(len(sets.ids), k), sets.start[1:]
    for url, labels, bodies in blocks(batches):
        term, doc, label, body, size = postings(labels, bodies, known, len(stop_words))
        if not len(term) or not len(ends):
            continue
        tf = scoring.label * label + scoring.body * body
        longer = scoring.k1 * (1 - scoring.b + scoring.b * size / (scoring.mean or 1.0))
        part = sets.idf[term] * tf * (scoring.k1 + 1) / (tf + longer[doc])
        n = np.bincount(term, minlength=len(sets.words))
        start = np.append(0, np.cumsum(n))
        # The best that any document of this block could score for a set. Ranks are rounded, so it must be lower by more than that for the set to be passed over.
        most = np.full(len(n), -np.inf)
        most[n > 0] = np.maximum.reduceat(part, start[:-1][n > 0])
        bound = np.add.reduceat(most[sets.terms], sets.start[:-1])
        chosen = np.flatnonzero((bound > -np.inf) & (bound >= kept.least - 1e-5))
        place = _places(url)
        pieces = np.cumsum(n[sets.terms[sets.start[chosen]]]) // CANDIDATES
        for some in np.split(chosen, np.flatnonzero(np.diff(pieces)) + 1):
            for of, held, score in _matches(sets, some, start, doc, term * len(size) + doc, part, len(size)):
                near = score >= kept.least[of] - 1e-5
                of, held, rank = of[near], held[near], rounded(score[near])
                near = rank >= kept.least[of]
                of, held, rank = of[near], held[near], rank[near]
                if len(of):
                    first = _first(of, rank, place[held], k)
                    kept.add(of[first], rank[first], url.take(pa.array(held[first])))
    kept.settle()
    for at in range(0, len(kept.of), 50_000):
        cut = slice(at, at + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(sets.ids[kept.of[cut]]), kept.url[cut], pa.array(kept.rank[cut])], ["set", "doc_url", "rank"])
