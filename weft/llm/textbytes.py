"""Vectorised word and shingle hashing over Arrow string columns.

Works on the UTF-8 bytes of a batch with numpy, so the cost is a few passes over the
bytes rather than a Python call for each word. Every hash is 64 bits wide and depends on
the word's bytes alone, never on the process, so results agree between executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are taken in slices of about this many bytes; a longer text is a slice by itself.
SLICE_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+` after lower-casing A-Z.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

class Words(NamedTuple):
    """Words of a slice of texts. Word i is ``data[starts[i]:ends[i]]`` with hash
    ``hashes[i]``; the words of text t are those from ``first[t]`` to ``first[t + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) so that each slice holds about ``size`` bytes of text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, column.slice(at, end - at)
        at = end


def words(texts: pa.Array, is_word: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """Split non-null large_string texts, with A-Z lower-cased or as they are, into maximal runs of the bytes in ``is_word``; without hashes on demand."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if high == low:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    data = _LOWER[data] if lower else data
    offsets = offsets - low
    inside = is_word[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = range_hashes(data, starts, ends) if hashed else np.zeros(0, U64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``data[starts[i]:ends[i]]`` for each i.

    Each block of eight bytes is mixed with its place in two ways; a hash mixes both sums over its blocks and the number of bytes.
    """
    if not len(starts):
        return np.zeros(0, U64)
    sizes = ends - starts
    blocks = np.maximum((sizes + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    values = np.ndarray(len(data) + 1, U64, padded, strides=(1,))[at]
    left = np.repeat(sizes, blocks) - 8 * place
    short = left < 8
    values[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
    key = place.astype(U64) * U64(0x9E3779B97F4A7C15)
    low = np.add.reduceat(mix(values ^ (key + U64(0x243F6A8885A308D3))), first)
    high = np.add.reduceat(mix((values + U64(0x13198A2E03707344)) * U64(0xC2B2AE3D27D4EB4F) ^ ~key), first)
    return mix(low ^ mix(high + sizes.astype(U64)))


def encode_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, place of each word among them) of the words ``data[starts[i]:ends[i]]``, told apart by their bytes."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    offsets = np.column_stack([starts, ends]).ravel()
    tiled = bool((starts[1:] == ends[:-1]).all())
    if tiled:
        offsets = np.append(starts, ends[-1])
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    coded = (column if tiled else column.take(pa.array(np.arange(0, len(column), 2)))).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def gather(first: np.ndarray, values: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``pick`` of lists laid end to end (list p is ``values[first[p]:first[p + 1]]``), laid out alike."""
    sizes = first[pick + 1] - first[pick]
    out_first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(first[pick] - out_first[:-1], sizes) + np.arange(out_first[-1])
    return out_first, values[at]


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, a shorter text's whole sequence as one.

    Returns (shingle hashes in text order, first): those of text t are from ``first[t]`` to
    ``first[t + 1]``; repeats are kept.
    """
    counts = np.diff(first)
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, U64), out_first
    text = np.repeat(np.arange(len(counts)), per_text)
    at = first[:-1][text] + (np.arange(total) - out_first[:-1][text])
    out = np.zeros(total, U64)
    left = first[1:][text] - at
    for k in range(width):
        factor = U64((0x9E3779B97F4A7C15 * (2 * k + 3)) & ((1 << 64) - 1) | 1)
        if int(left.min()) > k:
            out += hashes[at + k] * factor
        else:
            has = left > k
            out[has] += hashes[at[has] + k] * factor
    out += np.minimum(counts[text], width).astype(U64)
    return mix(out), out_first


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, laid out like the input."""
    if not len(hashes):
        return hashes, first
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[keep], text[keep]
    return hashes, np.searchsorted(text, np.arange(len(first)))
