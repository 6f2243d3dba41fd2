"""Language identification by unigram pieces over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the sum over
all its segmentations into pieces, by the forward algorithm, and a text's the product over its words. The pieces'
probabilities are learned by expectation-maximisation: expected counts over all segmentations of a language's words, by the forward and backward algorithms.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Recent, cut, held, release, small_batches, with_struct

#: Labelled rows of a language that are learned from: all, or a share by hash that leaves this number to twice as many.
TRAINING_ROWS = 5_000
#: More values of a language column are an error.
MOST_LANGUAGES = 1_000
#: Rounds of expectation-maximisation.
ROUNDS = 3
#: Added to each piece's expected count.
SMOOTHING = 0.1
#: Letters of a word; a longer run of letters is several words.
WORD_LETTERS = 48
#: Words that a worker process remembers.
KNOWN_WORDS = 300_000
#: Bytes of text whose distinct words are looked up together, about.
SLICE_BYTES = 1 << 20
#: Expected counts are summed as whole numbers of this part of one, so that their order does not matter.
UNIT = 1 << 16
#: A log probability below all that can be.
LOW = -1e30

KIND = "struct<lang:string,score:double>"
_START = ord("▁")
_PRIME = np.uint64(0x100000001B3)


class Model(NamedTuple):
    """Learned languages in order, the log of their shares, and log probabilities (piece, language)."""

    languages: list[str]
    prior: np.ndarray
    pieces: np.ndarray


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a piece model that can be part of a lower-case word: letters and marks, with or without the sign of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    kinds = letter_kinds()
    found = []
    for n in range(model.get_piece_size()):
        piece = model.id_to_piece(n)
        body = piece[1:] if piece.startswith("▁") else piece
        if not (model.is_byte(n) or model.is_control(n) or model.is_unknown(n)) and piece == piece.lower() and all(kinds[ord(c)] for c in body):
            found.append(piece)
    return found


@lru_cache(maxsize=1)
def letter_kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a mark, 0 neither."""
    first = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)), np.uint8)
    return np.select([first == ord("L"), first == ord("M")], [1, 2]).astype(np.uint8)


class Pieces:
    """The vocabulary as tables by length. Ids from 0 are pieces, then follow 256 bytes, of which characters outside the vocabulary are made."""

    def __init__(self, pieces: list[str]):
        self.n_pieces, self.size = len(pieces), len(pieces) + 256
        self.tables = []
        for length in range(1, max(map(len, pieces), default=0) + 1):
            own = [n for n, p in enumerate(pieces) if len(p) == length]
            points = np.array([[ord(c) for c in pieces[n]] for n in own], np.uint64).reshape(-1, length)
            hashes = np.zeros(len(own), np.uint64)
            for k in range(length):
                hashes = (hashes + points[:, k] + np.uint64(1)) * _PRIME
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two pieces share a hash")
            self.tables.append((hashes[order], np.array(own, np.int64)[order]))

    def lattice(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(ids, sizes, characters): piece ids[k, w, i] is the k + 1 letters of word w from i on, -1 where there is none; numbers from
        ``size`` on stand for characters outside the vocabulary. ``sizes`` count the sign of a word's start."""
        sizes = np.array([len(w) + 1 for w in words])
        most = int(sizes.max())
        points = np.zeros((len(words), most), np.uint64)
        points[:, 0] = _START
        for n, w in enumerate(words):
            points[n, 1 : len(w) + 1] = w
        ids = np.full((min(len(self.tables), most), len(words), most), -1, np.int64)
        hashes = np.zeros_like(points)
        place = np.arange(most)
        for k in range(len(ids)):
            keys, own = self.tables[k]
            hashes[:, : most - k] = (hashes[:, : most - k] + points[:, k:] + np.uint64(1)) * _PRIME
            inside = (place + k)[None, :] < sizes[:, None]
            if len(keys):
                asked = hashes[inside]
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                ids[k][inside] = np.where(keys[at] == asked, own[at], -1)
        unknown = (ids[0] < 0) & (place[None, :] < sizes[:, None])
        others, number = np.unique(points[unknown], return_inverse=True)
        ids[0][unknown] = self.size + number
        return ids, sizes, [chr(int(c)).encode("utf-8", "surrogatepass") for c in others]

    def rows(self, log_p: np.ndarray, others: list[bytes]) -> np.ndarray:
        """Log probabilities by the ids of a lattice; the last row is for -1."""
        made = [log_p[self.n_pieces + np.frombuffer(c, np.uint8).astype(np.int64)].sum(0) for c in others]
        return np.concatenate([log_p, np.array(made).reshape(-1, log_p.shape[1]), np.full((1, log_p.shape[1]), LOW)])


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(0)
    return most + np.log(np.exp(x - most).sum(0))


def forward(ids: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of the first j letters of each word, at [j]."""
    longest, n, size = ids.shape
    out = np.full((size + 1, n, log_p.shape[1]), LOW)
    out[0] = 0
    for j in range(1, size + 1):
        out[j] = _log_sum(np.stack([out[j - k] + log_p[ids[k - 1, :, j - k]] for k in range(1, min(j, longest) + 1)]))
    return np.maximum(out, LOW)


def backward(ids: np.ndarray, sizes: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of the letters from j on."""
    longest, n, size = ids.shape
    out = np.full((size + 1, n, log_p.shape[1]), LOW)
    for j in range(size, -1, -1):
        if j < size:
            out[j] = np.maximum(_log_sum(np.stack([out[j + k] + log_p[ids[k - 1, :, j]] for k in range(1, min(size - j, longest) + 1)])), LOW)
        out[j, sizes == j] = 0
    return out


def _groups(words: list[bytes], most: int = 1 << 17) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Words of like length together, as (their places, their code points)."""
    order = sorted(range(len(words)), key=lambda n: len(words[n]))
    at = 0
    while at < len(order):
        shortest, end = len(words[order[at]]), at
        while end < len(order) and len(words[order[end]]) <= shortest * 3 // 2 + 8 and (end - at) * (len(words[order[end]]) // 4 + 1) <= most:
            end += 1
        part = order[at : max(end, at + 1)]
        yield part, [np.frombuffer(words[n], np.uint32) for n in part]
        at += len(part)


def words_of(texts: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: (first row, distinct words as code points, place of each word among them, first, has a letter).

    Words are runs of letters and marks of the lower-cased text, in blocks of WORD_LETTERS; those of text t are from ``first[t]`` to ``first[t + 1]``.
    """
    kinds = letter_kinds()
    for at, part in tb.slices(texts, SLICE_BYTES):
        lower = [t.lower() for t in part.to_pylist()]
        data = "".join(lower).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(data, np.uint32)
        first = np.cumsum([0, *map(len, lower)])
        kind = kinds[points]
        inside = kind > 0
        edge = np.zeros(len(points) + 1, bool)
        edge[first] = True
        new, last = inside.copy(), inside.copy()
        new[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
        blocks = (ends - starts + WORD_LETTERS - 1) // WORD_LETTERS
        if len(blocks) and int(blocks.max()) > 1:
            place = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts, ends = np.repeat(starts, blocks) + place * WORD_LETTERS, np.repeat(ends, blocks)
            ends = np.minimum(ends, starts + WORD_LETTERS)
        words, word = tb.encode_words(np.frombuffer(data, np.uint8), starts * 4, ends * 4)
        letters = np.concatenate([[0], np.cumsum(kind == 1)])[first]
        yield at, words, word, np.searchsorted(starts, first), np.diff(letters) > 0


class Scorer:
    """Log probabilities of words in each language, in one worker process."""

    def __init__(self, pieces: list[str], model: Model):
        self.pieces, self.model = Pieces(pieces), model
        self.known = Recent(KNOWN_WORDS)

    def learn(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        for places, part in _groups(words, (1 << 17) // max(1, len(self.model.languages) // 4)):
            ids, sizes, others = self.pieces.lattice(part)
            found = forward(ids, self.pieces.rows(self.model.pieces, others))[sizes, np.arange(len(part))]
            for n, row in zip(places, found):
                out[n] = row.tobytes()
        return out

    def __call__(self, texts: pa.Array) -> list[dict]:
        out = []
        languages = self.model.languages
        for _, words, word, first, lettered in words_of(texts):
            sums = np.zeros((len(lettered), len(languages)))
            if languages and len(word):
                rows = np.frombuffer(b"".join(self.known.get_all(words, self.learn)), float).reshape(-1, len(languages))
                some = np.flatnonzero(np.diff(first))
                for k in range(len(languages)):
                    sums[some, k] = np.add.reduceat(rows[word, k], first[some])
            for n, told in enumerate(lettered.tolist()):
                if not told or not languages:
                    out.append({"lang": "und", "score": 0.0})
                    continue
                logit = sums[n] + self.model.prior
                best = int(np.argmax(logit))
                out.append({"lang": languages[best], "score": round(float(1 / np.exp(logit - logit[best]).sum()), 9)})
        return out


def _count_words(column: str, texts: str):
    """(lang, word, n) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index(column)).to_numpy()
            for at, words, word, first, _ in words_of(batch.column(batch.schema.get_field_index(texts))):
                own = np.repeat(numbers[at : at + len(first) - 1], np.diff(first)).astype(np.int64)
                key, n = np.unique(own << 32 | word, return_counts=True)
                told = [words[k].decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").decode() for k in key & 0xFFFFFFFF]
                yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(told, pa.string()), pa.array(n)], names=["language", "word", "n"])

    return lambda batches: release(run(batches))


def _expect(pieces: list[str], log_p: np.ndarray):
    """(language, piece, expected count in units) of each batch of (language, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held("language pieces", hashlib.sha256("\n".join(pieces).encode()).hexdigest(), lambda: Pieces(pieces))
        for batch in batches:
            language, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            words = [w.encode("utf-32-le") for w in batch.column(1).to_pylist()]
            for k in np.unique(language):
                mine = np.flatnonzero(language == k)
                total = np.zeros(own.size)
                for places, part in _groups([words[i] for i in mine]):
                    ids, sizes, others = own.lattice(part)
                    p = own.rows(log_p[:, [k]], others)
                    up, down, many = forward(ids, p), backward(ids, sizes, p), n[mine[places]]
                    whole = up[sizes, np.arange(len(part)), 0]
                    for length in range(len(ids)):
                        w, i = np.nonzero(ids[length] >= 0)
                        piece = ids[length][w, i]
                        share = np.exp(up[i, w, 0] + p[piece, 0] + down[i + length + 1, w, 0] - whole[w])
                        units = np.rint(share * many[w] * UNIT)
                        known = piece < own.size
                        total += np.bincount(piece[known], units[known], own.size)
                        for at, amount in zip(piece[~known] - own.size, units[~known]):
                            for byte in others[at]:
                                total[own.n_pieces + byte] += amount
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], names=["language", "piece", "units"]
                )

    return run


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", by: str = "doc_id", path: str | None = None, most: int = TRAINING_ROWS, rounds: int = ROUNDS) -> Model:
    """A model of the values of ``lang`` among ``docs``, from about ``most`` to twice as many rows of each, chosen by hash of ``by``; fewer rows are all used.

    Rows of null text or language, and rows without a letter, teach nothing. The driver gets a row for each language and piece at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = vocabulary(path)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("__lang"), F.col(text).alias("__text"), F.xxhash64(by).alias("__hash"))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("__lang").count().limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Model([], np.zeros(0), np.zeros((len(pieces) + 256, 0)))
    shares = spark.createDataFrame([(name, k, max(1, n // most)) for k, (name, n) in enumerate(counts)], "__lang string, language int, share long")
    chosen = rows.join(F.broadcast(shares), "__lang").filter(F.pmod("__hash", "share") == 0).select("language", F.col("__text").alias("text"))
    words = chosen.mapInArrow(_count_words("language", "text"), "language int, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))
    words = cut(words.select("language", "word", "n"))
    size = len(pieces) + 256
    log_p = np.full((size, len(counts)), -np.log(size))
    for _ in range(rounds):
        found = words.mapInArrow(_expect(pieces, log_p), "language int, piece int, units long").groupBy("language", "piece").agg(F.sum("units").alias("units"))
        weight = np.full((size, len(counts)), SMOOTHING)
        for row in found.collect():
            weight[row.piece, row.language] += row.units / UNIT
        log_p = np.log(weight / weight.sum(0))
    n = np.array([c for _, c in counts], float)
    return Model([name for name, _ in counts], np.log(n / n.sum()), log_p)


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language", path: str | None = None) -> DataFrame:
    """``docs`` with a struct ``into``: lang, the likeliest language of each whole text, and score, its probability among the model's languages.

    Null texts, texts without a letter and a model without languages give `und` and 0. Repeated rows are told alike; of equal probabilities the first language by name is given. A
    column named ``into`` is replaced. The model is broadcast; its size is that of the vocabulary times the languages. Nothing is shuffled.
    """
    pieces = vocabulary(path)
    key = hashlib.sha256(repr((pieces, model.languages)).encode() + model.prior.tobytes() + model.pieces.tobytes()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((pieces, model))
    return with_struct(docs, text, into, KIND, lambda: held("languages", key, lambda: Scorer(*shared.value)))


def held_out(doc_id: Column) -> Column:
    """Is a row kept from learning? A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op13(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs`` (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    told = identify(rows.select("doc_id", "text", "held_out"), fit(rows.filter("NOT held_out")))
    return told.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
