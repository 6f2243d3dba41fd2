"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of consecutive words of the benchmark items. A block is a
pair of neighbouring words. For each block the shift table says how far the search may jump
without missing an occurrence; most blocks of a clean text are in no pattern, so the
search jumps a whole window less one block at a time. Where the shift is zero, a pattern may end: the bucket of the
hashes of its suffix block and of its words names the patterns to test, and a comparison of the words
themselves confirms or refutes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import cut, with_struct

WINDOW = 10
#: Words of benchmark text searched for in one pass; a larger benchmark takes several passes.
WORDS_PER_PASS = 1_000_000

_U64 = np.uint64
_TABLE_BITS = 20
_LEFT, _RIGHT = _U64(0xD6E8FEB86659FD93), _U64(0xA0761D6478BD642F)

_RANGES = "array<struct<start:long,end:long>>"
KIND = f"struct<n_words:long,hits:{_RANGES},spans:{_RANGES},item_ids:array<string>>"


def _block_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    if size == 1 or not len(hashes):
        return hashes
    out = hashes * _RIGHT
    out[1:] += hashes[:-1] * _LEFT
    return tb.mix(out)


def _keys(hashes: np.ndarray, blocks: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the ``length`` words up to word ``ends[i]``: from the hash of the suffix block and those of all words."""
    out = blocks[ends] * _LEFT
    for k in range(length):
        out += hashes[ends - k] * _U64((0x9E3779B97F4A7C15 * (2 * k + 3)) & ((1 << 64) - 1) | 1)
    return tb.mix(out)


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of words laid out anew with one blank between them."""
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 32, np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + inner] = data[np.repeat(starts, sizes) + inner]
    return out, to, to + sizes


class Patterns:
    """Shift table and buckets of the patterns of one length: pattern p has the bytes ``text[at[p]:end[p]]`` and stands in item ``item[p]``;
    patterns are sorted by their bucket ``key``."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift = np.full(1 << _TABLE_BITS, min(255, length - self.block + 1), np.uint8)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, w: tb.Words, words: np.ndarray, item: np.ndarray) -> None:
        """Add all windows of runs of words: ``words`` are their places in ``w``, ``item`` the item of each, of as many words as a window or more."""
        hashes = w.hashes[words]
        blocks = _block_hashes(hashes, self.block)
        ends = np.flatnonzero(np.append(np.zeros(self.length - 1, bool), item[self.length - 1 :] == item[: len(item) - self.length + 1]))
        for k in range(self.block - 1, self.length):
            back = self.length - 1 - k
            np.minimum.at(self.shift, (blocks[ends - back] & _U64((1 << _TABLE_BITS) - 1)).astype(np.int64), np.uint8(min(back, 255)))
        text, starts, stops = _spaced(w.data, w.starts[words], w.ends[words])
        keys = _keys(hashes, blocks, ends, self.length)
        self.parts.append((keys, starts[ends - self.length + 1] + self.size, stops[ends] + self.size, item[ends].astype(np.int32), text))
        self.size += len(text)

    def close(self) -> Patterns:
        self.key, self.at, self.end, self.item, self.text = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(self.key, kind="stable")
        self.key, self.at, self.end, self.item = (x[order] for x in (self.key, self.at, self.end, self.item))
        self.parts = []
        return self


def build(items: list[tuple[str | None, str]], window: int = WINDOW) -> tuple[list[Patterns], list[str | None]]:
    """Search tables of (item id, text) pairs."""
    by_length: dict[int, Patterns] = {}
    for at, part in tb.slices(pa.array([text for _, text in items], pa.large_string())):
        w = tb.words(part, tb.ALNUM)
        counts = np.diff(w.first)
        item = np.repeat(np.arange(len(part)), counts)
        lengths = np.minimum(counts, window)[item]
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            by_length.setdefault(length, Patterns(length)).add(w, own, item[own] + at)
    return [by_length[n].close() for n in sorted(by_length)], [i for i, _ in items]


def _ends(shift: bytes, first: int, last: int) -> list[int]:
    """Words at which a pattern may end, the first words skipped by the shift table."""
    out, at = [], first
    while at < last:
        jump = shift[at]
        if jump:
            at += jump
        else:
            out.append(at)
            at += 1
    return out


def search(tables: tuple[list[Patterns], list[str | None]], texts: pa.Array) -> list[dict]:
    """For each text: its number of words, hit word ranges, their code point spans and the items found."""
    classes, ids = tables
    out = []
    for _, part in tb.slices(texts):
        w = tb.words(part, tb.ALNUM)
        found: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for p in classes:
            blocks = _block_hashes(w.hashes, p.block)
            shift = p.shift[(blocks & _U64((1 << _TABLE_BITS) - 1)).astype(np.int64)].tobytes()
            ends = [e for t in range(len(part)) for e in _ends(shift, int(w.first[t]) + p.length - 1, int(w.first[t + 1]))]
            if not ends:
                continue
            ends = np.array(ends)
            keys = _keys(w.hashes, blocks, ends, p.length)
            low, high = np.searchsorted(p.key, keys, "left"), np.searchsorted(p.key, keys, "right")
            for n in np.flatnonzero(low < high).tolist():
                end, start = int(ends[n]), int(ends[n]) - p.length + 1
                own = b" ".join(w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(start, end + 1))
                same = [q for q in range(low[n], high[n]) if p.text[p.at[q] : p.end[q]].tobytes() == own]
                if same:
                    text = int(np.searchsorted(w.first, start, "right")) - 1
                    found.setdefault(text, []).append((start, end + 1))
                    items.setdefault(text, set()).update(p.item[same].tolist())
        code_points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)]) if found else None
        text_at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        for t in range(len(part)):
            a = int(w.first[t])
            merged: list[list[int]] = []
            for start, end in sorted(found.get(t, ())):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            zero = code_points[text_at[t] - text_at[0]] if merged else 0
            out.append(
                {
                    "n_words": int(w.first[t + 1]) - a,
                    "hits": [{"start": s - a, "end": e - a} for s, e in merged],
                    "spans": [{"start": int(code_points[w.starts[s]] - zero), "end": int(code_points[w.ends[e - 1]] - zero)} for s, e in merged],
                    "item_ids": sorted({ids[i] for i in items.get(t, ()) if ids[i] is not None}),
                }
            )
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    words_per_pass: int = WORDS_PER_PASS,
    into: str = "leaks",
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, hits (word ranges inside occurrences of benchmark
    windows, merged, end exclusive), spans (the same as code points of the text) and item_ids
    (items with an occurring window, sorted as strings).

    Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. An item of
    fewer than ``window`` words, but not none, is one window. Null and empty texts have no words and
    no hits; a null item text has no windows; an item with a null id marks words but is not listed;
    items with equal texts are all listed. Repeated rows each get their own result. A column named
    ``into`` is replaced; all others stay.

    The benchmark is cut by item into parts of at most about ``words_per_pass`` words, whatever its size. One part's tables, some 30 bytes a word, are built
    and broadcast at a time; with several parts each pass is written out before the next, so neither the driver nor a task holds more
    than one. Documents are never shuffled.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = F.coalesce(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = -(-total // words_per_pass) or 1
    spark = docs.sparkSession
    found = None
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        tables = spark.sparkContext.broadcast(build([(r.id, r.text or "") for r in part.collect()], window))
        name = into if parts == 1 else f"__{into}_{k}"
        docs = with_struct(docs, text, name, KIND, lambda t=tables: lambda texts: search(t.value, texts))
        found = [*(found or []), name]
        if parts > 1:
            docs = cut(docs)
            tables.destroy()
    if parts > 1:
        merged = F.struct(
            F.col(found[0])["n_words"].alias("n_words"),
            *[_merge_ranges(F.flatten(F.array(*[F.col(n)[f] for n in found]))).alias(f) for f in ("hits", "spans")],
            F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(n)["item_ids"] for n in found])))).alias("item_ids"),
        )
        docs = docs.withColumn(into, merged).drop(*found)
    return docs


def _merge_ranges(ranges):
    """Union of [start, end) ranges; touching ranges of words are one."""
    return F.aggregate(
        F.array_sort(ranges),
        F.array().cast(_RANGES),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= r["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], r["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest columns of the contract from :func:`find_leaks`."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("leaks.hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        F.col("leaks.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("leaks.item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "leaks.item_ids"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
  FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS u(i)
  WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM windows), places AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS t
  FROM d, lengths, unnest(generate_series(1, len(w) - m + 1)) AS u(i)
  WHERE len(w) >= m
), hits AS (SELECT p.r, p.i, p.m, x.item_id FROM places p JOIN windows x ON p.m = x.m AND p.t = x.t
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit
  FROM (SELECT DISTINCT r, i, m FROM hits), unnest(generate_series(i, i + m - 1)) AS u(j) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN items ON d.r = items.r
"""
