"""Alignment of the tokens that two tokenizers give for the same text.

Both sides' tokens tile the bytes of a blank and the text. Within a batch, ``merge_asof`` keyed by document finds for each token's start
the token of the other side that covers it; the union of both directions are the overlaps. Offsets where tokens of both sides end
cut the tokens into groups, and all pairs of tokens of a group are linked.

Neither tokenizer joins anything across a blank between two visible characters, so words are encoded once each, and a long text is taken in parts cut at such blanks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .byte_bpe import split_words
from .common import Recent, cut, held, release, small_batches, with_struct

#: Words of each side that a worker process remembers.
KNOWN_WORDS = 300_000
#: Bytes of text that are aligned together, about; a longer text is cut into parts of at least this size.
PART_BYTES = 1 << 18
#: Linked id pairs of documents, counted once for each document, that make a block of documents, about.
BLOCK_PAIRS = 1 << 21

_BLANK = re.compile(rb"[!-~] [!-~]")
KIND = "struct<a_ids:array<int>,b_ids:array<int>,n_a:array<int>,n_b:array<int>>"


class Aligned(NamedTuple):
    """Aligned parts of texts. Part p is of row ``rows[p]``; its groups are those from ``first[p]`` to ``first[p + 1]``. Group g has the next ``n_a[g]`` ids of ``a`` and
    ``n_b[g]`` of ``b``. The overlaps are pairs (place in ``a``, place in ``b``)."""

    rows: np.ndarray
    first: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray]


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: visible Latin-1 characters are their own byte, the others follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Side:
    """One tokenizer: ids of words, which are remembered, and the bytes of ids."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.pieces = pieces
        self.piece_first, self.piece_data = np.concatenate([[0], np.cumsum(self.sizes)]), np.frombuffer(b"".join(pieces), np.uint8)
        self.known = Recent(KNOWN_WORDS)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self, words: list[bytes]) -> list[bytes | None]:
        """Ids as 32-bit numbers; one impossible id where they don't give the word's bytes back."""
        found = self.encode(words)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(first[-1]))
        up, given = tb.gather(self.piece_first, self.piece_data, ids)
        given, numbers, wrong = given.tobytes(), ids.tobytes(), np.array([-1], np.int32).tobytes()
        at, own = up[first].tolist(), (4 * first).tolist()
        return [numbers[x:y] if given[i:j] == word else wrong for word, i, j, x, y in zip(words, at, at[1:], own, own[1:])]

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids) of words that tile ``data``: the ids of word w are from ``first[w]`` to ``first[w + 1]``."""
        words, word = tb.encode_words(data, starts, ends)
        ids = self.known.get_all(words, self.learn)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return tb.gather(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(ids), np.int32), word)


class ByteLevel(Side):
    """A byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters, special = byte_letters(), {str(t) for t in self.model.get_added_tokens_decoder().values()}
        pieces = [b""] * self.model.get_vocab_size()
        for token, n in self.model.get_vocab().items():
            pieces[n] = token.encode() if token in special else bytes(letters[c] for c in token)
        super().__init__(pieces)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def words(self, data: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the words of texts laid end to end."""
        raw = np.frombuffer(data, np.uint8)
        char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        starts = char[split_words(points, np.searchsorted(char, first))]
        return starts, np.append(starts[1:], len(raw))


class Pieces(Side):
    """A model file of the ``sentencepiece`` library that puts a blank before a text and joins nothing to the left of a blank."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for n in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(n)
            pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(n) else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError("the model joins words")
        super().__init__(pieces)
        self.blank = self.model.piece_to_id("▁")

    def encode(self, words: list[bytes]) -> list[list[int]]:
        found = self.model.encode([w[1:].decode() for w in words], num_threads=1)
        return [[self.blank] if w == b" " else ids for w, ids in zip(words, found)]

    def words(self, data: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        blank = raw == 32
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[first[:-1]] = True
        starts = np.flatnonzero(new)
        return starts, np.append(starts[1:], len(raw))


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(rows, bytes, first): parts of texts, each with a blank before it, laid end to end; empty and null texts have none."""
    rows, held_back, size = [], [], 0

    def put():
        return np.array(rows), b"".join(held_back), np.cumsum([0, *map(len, held_back)])

    for n, text in enumerate(texts):
        raw = b" " + text.as_buffer().to_pybytes() if text.is_valid and len(text.as_buffer()) else b""
        at = 0
        while at < len(raw):
            near = _BLANK.search(raw, at + PART_BYTES)
            end = near.start() + 1 if near else len(raw)
            if size and size + end - at > PART_BYTES:
                yield put()
                rows, held_back, size = [], [], 0
            rows.append(n)
            held_back.append(raw[at:end])
            size += end - at
            at = end
    if size:
        yield put()


class Aligner:
    """Aligner of a worker process."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.width = len(b.pieces)
        most = max(len(a.pieces), self.width)
        digits = [b"%d," % n for n in range(most)]
        self.digit_first, self.digits = np.cumsum([0, *map(len, digits)]), np.frombuffer(b"".join(digits), np.uint8)

    def align(self, texts: pa.Array) -> Iterator[tuple[set[int], Aligned]]:
        """(rows found to differ from their tokens' bytes, aligned parts) until all texts are through."""
        bad: set[int] = set()
        for rows, data, first in _parts(texts):
            now = set(rows.tolist()) & bad
            while True:
                keep = ~np.isin(rows, list(now)) if now else np.ones(len(rows), bool)
                if not keep.all():
                    data = b"".join(data[x:y] for x, y, k in zip(first, first[1:], keep) if k)
                    first = np.concatenate([[0], np.cumsum(np.diff(first)[keep])])
                    rows = rows[keep]
                raw = np.frombuffer(data, np.uint8)
                sides, now = [], set()
                for side in (self.a, self.b):
                    starts, ends = side.words(data, first) if len(rows) else (np.zeros(0, np.int64),) * 2
                    own, ids = side.tokens(raw, starts, ends) if len(rows) else (np.zeros(1, np.int64), np.zeros(0, np.int32))
                    if len(wrong := np.flatnonzero(ids < 0)):
                        at = starts[np.searchsorted(own, wrong, "right") - 1]
                        now |= set(rows[np.searchsorted(first, at, "right") - 1].tolist())
                    sides.append(ids)
                bad |= now
                if not now:
                    break
            if len(rows):
                yield bad, self._aligned(rows, first, *sides)
        yield bad, None

    def _aligned(self, rows: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> Aligned:
        ends = [np.cumsum(side.sizes[ids]) for side, ids in ((self.a, a), (self.b, b))]
        starts = [end - side.sizes[ids] for end, side, ids in zip(ends, (self.a, self.b), (a, b))]
        frames = [
            pd.DataFrame({"at": start, "part": np.searchsorted(first, start, "right"), "token": np.arange(len(start))}) for start in starts
        ]
        cover = [pd.merge_asof(frames[k], frames[1 - k], on="at", by="part", suffixes=("", "_over"))["token_over"].to_numpy() for k in (0, 1)]
        fresh = starts[0][cover[1]] < starts[1]
        overlaps = np.concatenate([frames[0]["token"], cover[1][fresh]]), np.concatenate([cover[0], frames[1]["token"][fresh]])
        both = np.intersect1d(*ends, assume_unique=True)
        n_a, n_b = (np.diff(np.searchsorted(end, both, "right"), prepend=0) for end in ends)
        return Aligned(rows, np.searchsorted(both, first, "right"), a, b, n_a, n_b, overlaps)

    def pairs(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, pairs, links): the linked id pairs of each part, as a * width + b in order, and how many links each is."""
        part = np.repeat(np.arange(len(x.rows)), np.diff(x.first))
        group = np.arange(len(x.n_a))
        plain = (x.n_a == 1) | (x.n_b == 1)
        of_a, of_b = np.repeat(group, x.n_a), np.repeat(group, x.n_b)
        i, j = x.overlaps
        own = plain[of_a[i]]
        i, j = i[own], j[own]
        keys, owners, counts = [x.a[i].astype(np.int64) * self.width + x.b[j]], [part[of_a[i]]], [np.ones(len(i), np.int64)]
        if not plain.all():
            # In a group of several tokens on both sides, each id with its number of tokens is joined with each id of the other side.
            told = []
            for ids, of in ((x.a, of_a), (x.b, of_b)):
                some = ~plain[of]
                told.append(np.unique(of[some] * (1 << 32) + ids[some], return_counts=True))
            (ka, ca), (kb, cb) = told
            low, high = (np.searchsorted(kb >> 32, ka >> 32, side) for side in ("left", "right"))
            many = high - low
            left = np.repeat(np.arange(len(ka)), many)
            right = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            keys.append((ka[left] & 0xFFFFFFFF) * self.width + (kb[right] & 0xFFFFFFFF))
            owners.append(part[ka[left] >> 32])
            counts.append(ca[left] * cb[right])
        return summed(np.concatenate(owners), np.concatenate(keys), np.concatenate(counts), len(x.rows))

    def listing(self, x: Aligned) -> list[bytes]:
        """For each part, its groups as `a1,a2|b1;a3|b2,b3`."""
        up_a, up_b = (np.concatenate([[0], np.cumsum(n)]) for n in (x.n_a, x.n_b))
        ids = np.empty(len(x.a) + len(x.b), np.int64)
        ids[np.arange(len(x.a)) + np.repeat(up_b[:-1], x.n_a)] = x.a
        ids[np.arange(len(x.b)) + np.repeat(up_a[1:], x.n_b)] = x.b
        first, text = tb.gather(self.digit_first, self.digits, ids)
        ends = first[1:] - 1
        text[ends[up_a[1:] + up_b[:-1] - 1]] = ord("|")
        text[ends[up_a[1:] + up_b[1:] - 1]] = ord(";")
        at = first[(up_a + up_b)[x.first]]
        return [text[i : j - 1].tobytes() for i, j in zip(at, at[1:])]


def summed(owner: np.ndarray, key: np.ndarray, count: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, keys, counts): distinct keys of each owner in order with their summed counts."""
    # Owners and keys are small enough to be one number together.
    order = np.argsort(owner.astype(np.int64) * (int(key.max(initial=0)) + 1) + key)
    owner, key, count = owner[order], key[order], count[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))[: len(key)]
    at = np.flatnonzero(new)
    return np.searchsorted(owner[at], np.arange(owners + 1)), key[at], np.add.reduceat(count, at) if len(at) else count


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _aligner(paths: tuple[str, str] | None):
    a, b = paths or default_paths()
    return lambda: held("aligner", (a, b), lambda: Aligner(ByteLevel(a), Pieces(b)))


def align(docs: DataFrame, text: str = "text", into: str = "aligned", paths: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with a struct ``into``: the token ids of both sides for a blank and each whole text, and how many of each make up each group.

    ``paths`` are a byte-level BPE file and a piece model that the workers can read. Null and empty texts, and those that a side's tokens don't give back byte for byte, have no
    tokens. Repeated rows are aligned alike. A column named ``into`` is replaced. Nothing is shuffled.
    """
    make = _aligner(paths)

    def work():
        own = make()

        def run(texts: pa.Array) -> list[dict]:
            parts: dict[int, list[list[np.ndarray]]] = {}
            for bad, x in own.align(texts):
                if x is None:
                    break
                up_a, up_b = (np.concatenate([[0], np.cumsum(n)]) for n in (x.n_a, x.n_b))
                for row, i, j in zip(x.rows.tolist(), x.first, x.first[1:]):
                    parts.setdefault(row, []).append([x.a[up_a[i] : up_a[j]], x.b[up_b[i] : up_b[j]], x.n_a[i:j], x.n_b[i:j]])
            names = "a_ids", "b_ids", "n_a", "n_b"
            none = [[np.zeros(0, np.int32)] * 4]
            return [dict(zip(names, map(np.concatenate, zip(*(none if n in bad else parts.get(n, none)))))) for n in range(len(texts))]

        return run

    return with_struct(docs, text, into, KIND, work)


#: Rows of documents, and of blocks: the pairs of a block with the number of its documents that hold each. Numbers are packed as compressed 64-bit differences.
_DOCS = "block long, is_block boolean, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, size long, pairs binary, links binary"


def pack(numbers: np.ndarray) -> bytes:
    steps = numbers.astype(np.int64)
    steps[1:] -= numbers[:-1]
    return pa.compress(steps, "zstd", asbytes=True)


def unpack(blob: bytes, size: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(blob, 8 * size, "zstd", asbytes=True), np.int64)) if size else np.zeros(0, np.int64)


def _documents(make, schema: pa.Schema):
    """Aligned documents in blocks, each block's rows before the block's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        block, seen, size = TaskContext.get().partitionId() << 32, [], 0

        def block_row():
            _, pairs, docs = summed(np.zeros(sum(map(len, seen)), np.int64), np.concatenate(seen), np.ones(sum(map(len, seen)), np.int64), 1)
            row = {"block": block, "is_block": True, "size": len(pairs), "pairs": pack(pairs), "links": pack(docs)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            out = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "hash": None, "parts": []} for _ in ids]
            for bad, x in own.align(texts):
                if x is None:
                    break
                first, pairs, links = own.pairs(x)
                totals = [np.concatenate([[0], np.cumsum(n)]) for n in (x.n_a, x.n_b, x.n_a * x.n_b)]
                for p, (row, listing) in enumerate(zip(x.rows.tolist(), own.listing(x))):
                    told, i, j = out[row], x.first[p], x.first[p + 1]
                    for name, up in zip(("n_a", "n_b", "n_links"), totals):
                        told[name] += int(up[j] - up[i])
                    told["n_groups"] += int(j - i)
                    if told["hash"]:
                        told["hash"].update(b";")
                    else:
                        told["hash"] = hashlib.sha256()
                    told["hash"].update(listing)
                    told["parts"].append((pairs[first[p] : first[p + 1]], links[first[p] : first[p + 1]]))
            rows = []
            for n, (doc_id, told) in enumerate(zip(ids, out)):
                if n in bad or not told["parts"]:
                    told = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "hash": None, "parts": []}
                    pairs = links = np.zeros(0, np.int64)
                elif len(told["parts"]) == 1:
                    pairs, links = told["parts"][0]
                else:
                    pairs, links = (np.concatenate(c) for c in zip(*told["parts"]))
                    _, pairs, links = summed(np.zeros(len(pairs), np.int64), pairs, links, 1)
                rows.append(
                    {"block": block, "is_block": False, "doc_id": doc_id, **{k: told[k] for k in ("n_a", "n_b", "n_groups", "n_links")}}
                    | {"groups_sha256": told["hash"].hexdigest() if told["hash"] else "", "size": len(pairs), "pairs": pack(pairs), "links": pack(links)}
                )
                if len(pairs):
                    seen.append(pairs)
                    size += len(pairs)
                if size >= BLOCK_PAIRS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    yield block_row()
                    rows, block, seen, size = [], block + 1, [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if seen:
            yield block_row()

    return lambda batches: release(run(batches))


def _block_pairs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, size, pairs, docs in zip(*(batch.column(n).to_pylist() for n in ("block", "size", "pairs", "links"))):
                pairs, docs = unpack(pairs, size), unpack(docs, size)
                for at in range(0, size, 1 << 16):
                    some, n = pairs[at : at + (1 << 16)], docs[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), block)), pa.array((some // width).astype(np.int32)), pa.array((some % width).astype(np.int32)), pa.array(n)],
                        names=["block", "a", "b", "docs"],
                    )

    return run


def _count_links(width: int, schema: pa.Schema):
    """Documents of a block, with their links looked up among the block's pairs."""

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        key = pairs["a"].to_numpy().astype(np.int64) * width + pairs["b"].to_numpy()
        order = np.argsort(key)
        key, n, best = key[order], pairs["n"].to_numpy()[order], pairs["best"].to_numpy()[order].astype(np.int64)
        n_best, sums = [], []
        for size, own, links in zip(*(docs[c].to_pylist() for c in ("size", "pairs", "links"))):
            at, links = np.searchsorted(key, unpack(own, size)), unpack(links, size)
            n_best.append(int((links * best[at]).sum()))
            sums.append(int((links * n[at]).sum()))
        done = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        done = done.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
        return done.append_column("groups_sha256", docs["groups_sha256"]).cast(schema)

    return run


def link_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(documents in blocks, (block, a, b, n, best) of each block's pairs, number of B ids): n documents of all hold ids a and b linked, best where no other b has more.

    Pairs are counted once for each document within its block first, so only a block's distinct pairs are shuffled. All pairs of an id a meet in one task: at most as many for each
    block as there are B ids.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    kind = _DOCS.format(id=docs.schema["doc_id"].dataType.simpleString())
    made = _aligner(paths)
    width = made().width
    blocks = cut(docs.select("doc_id", "text").mapInArrow(_documents(made, to_arrow_schema(StructType.fromDDL(kind))), kind))
    pairs = blocks.filter("is_block").select("block", "size", "pairs", "links").mapInArrow(_block_pairs(width), "block long, a int, b int, docs long")
    dealt = pairs.repartition("a").withColumn("n", F.sum("docs").over(Window.partitionBy("a", "b")))
    counted = dealt.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    return blocks.filter("NOT is_block"), counted.select("block", "a", "b", "n", "best"), width


def op12(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs`` (doc_id, text). Repeated rows count as documents of their own."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows, pairs, width = link_counts(docs)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    count = _count_links(width, to_arrow_schema(StructType.fromDDL(kind)))
    return rows.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(count, kind)
