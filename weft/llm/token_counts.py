"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A node's failure link leads to the node of what remains after the
greedy longest pieces are popped from the node's string, and the node knows how many pieces that pops. A word is then counted in one
pass over its bytes, without going back and without building a piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .byte_bpe import default_path, read_ranks
from .common import Recent, held, with_struct

#: Words that a worker process remembers.
KNOWN_WORDS = 400_000
#: Words of more bytes are walked one by one, shorter ones all at once.
LONG_WORD = 256

KIND = "struct<n_words:long,n_tokens:long>"


class Automaton:
    """Trie of a vocabulary with failure links and popped counts.

    Every byte that a word can hold must be a piece by itself, as in a byte-level vocabulary, so that each word has a greedy split.
    """

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        piece = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                below = children[node].get(byte)
                if below is None:
                    below = len(children)
                    children[node][byte] = below
                    children.append({})
                    piece.append(False)
                node = below
            piece[node] = True
        if set(range(256)) - {b for b, node in children[0].items() if piece[node]}:
            raise ValueError("the vocabulary lacks single bytes")
        self.children = children
        self.fail, self.popped = [0] * len(children), [0] * len(children)
        layer = [0]
        while layer:
            below = []
            for parent in layer:
                for byte, node in children[parent].items():
                    below.append(node)
                    if piece[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    at, count = self.fail[parent], self.popped[parent]
                    while byte not in children[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    self.fail[node], self.popped[node] = children[at][byte], count
            layer = below
        edges = sorted((node << 8 | byte, to) for node, own in enumerate(children) for byte, to in own.items())
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.fails, self.pops = np.array(self.fail, np.int64), np.array(self.popped, np.int64)

    def count(self, word: bytes) -> int:
        """Pieces of one word."""
        node = total = 0
        for byte in word:
            while (below := self.children[node].get(byte)) is None:
                total += self.popped[node]
                node = self.fail[node]
            node = below
        while node:
            total += self.popped[node]
            node = self.fail[node]
        return total

    def count_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: int) -> np.ndarray:
        """Pieces of each word ``prefix`` + ``data[start:end]``, all words advancing together byte by byte."""
        order = np.argsort(starts - ends, kind="stable")  # the longest first, so those still going are a head of the arrays
        starts, lengths = starts[order], (ends - starts)[order]
        node = np.full(len(starts), self._step(np.zeros(1, np.int64), np.array([prefix]))[0][0], np.int64)
        total = np.zeros(len(starts), np.int64)
        for at in range(int(lengths[0]) if len(lengths) else 0):
            going = int(np.searchsorted(-lengths, -at, "left"))
            node[:going], more = self._step(node[:going], data[starts[:going] + at])
            total[:going] += more
        while node.any():
            total += self.pops[node]
            node = self.fails[node]
        out = np.empty_like(total)
        out[order] = total
        return out

    def _step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, popped = node.copy(), np.zeros(len(node), np.int64)
        todo = np.arange(len(node))
        while len(todo):
            key = node[todo] << 8 | byte[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            node[todo[found]] = self.to[at[found]]
            todo = todo[~found]
            popped[todo] += self.pops[node[todo]]
            node[todo] = self.fails[node[todo]]
        return node, popped


class Counter:
    """Counts of a worker process; words are told apart by their bytes, and a word that is remembered is not counted anew."""

    def __init__(self, automaton: Automaton, prefix: bytes):
        self.automaton, self.prefix = automaton, prefix
        self.known = Recent(KNOWN_WORDS)

    def learn(self, words: list[bytes]) -> list[int]:
        """Pieces of each word."""
        sizes = np.array([len(w) for w in words])
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
        long = sizes > LONG_WORD
        counts = np.zeros(len(words), np.int64)
        counts[~long] = self.automaton.count_all(data, (ends - sizes)[~long], ends[~long], self.prefix[0])
        for n in np.flatnonzero(long):
            counts[n] = self.automaton.count(self.prefix + words[n])
        return counts.tolist()

    def __call__(self, texts: pa.Array) -> list[dict]:
        out = []
        for _, part in tb.slices(texts):
            w = tb.words(part, tb.SPACED, lower=False, hashed=False)
            words, word = tb.encode_words(w.data, w.starts, w.ends)
            counts = np.array(self.known.get_all(words, self.learn), np.int64)[word]
            running = np.concatenate([[0], np.cumsum(counts)])
            totals = running[w.first[1:]] - running[w.first[:-1]]
            out += [{"n_words": int(n), "n_tokens": int(t)} for n, t in zip(np.diff(w.first), totals)]
        return out


def count_tokens(docs: DataFrame, text: str = "text", into: str = "tokens", path: str | None = None) -> DataFrame:
    """``docs`` with a struct ``into``: n_words and n_tokens of each whole text.

    Words are runs of characters other than ASCII white space; a word is split as a blank and its bytes, greedily
    into the longest pieces of the vocabulary of the rank file at ``path``. Null and empty texts have no words. Repeated rows count alike; a
    column named ``into`` is replaced. The vocabulary is read by the driver and broadcast; nothing is shuffled.
    """
    vocabulary = list(read_ranks(path or default_path()))
    key = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return with_struct(docs, text, into, KIND, lambda: held("tokens", key, lambda: Counter(Automaton(shared.value), b" ")))


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""
    return count_tokens(docs.select("doc_id", "text")).select(
        "doc_id", F.col("tokens.n_words").alias("n_words"), F.col("tokens.n_tokens").alias("n_tokens")
    )
