"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database for each task.

The words of a partition (matches of the pre-tokenising pattern) become rows of token positions. A
recursive query joins neighbouring positions with the merge table and contracts each word's
leftmost pair of minimum rank, again and again until no pair of any word is in the table. The positions
in order give the ids, and ordered aggregation over the ids' bytes the decoded text. Words are told apart by their bytes; a worker
process keeps its database and the words it has met last for its later tasks.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Recent, held, with_struct

#: Words that a worker process remembers.
KNOWN_WORDS = 300_000
#: Bytes of words contracted by one recursive query, about.
BYTES_PER_QUERY = 1 << 16
#: Bytes of text whose distinct words are looked up together, about.
SLICE_BYTES = 1 << 18
#: Words of more bytes are contracted by a query that takes several of a word's pairs in one step.
LONG_WORD = 400

#: State rows: step n, k = word << 32 | position, token id, and the id after it (-1 at a word's end). Positions of a word stay gapless.
CONTRACT = """
WITH RECURSIVE state(n, k, id, next) AS (
  SELECT 0, k, id, next FROM positions
  UNION ALL
  (WITH best AS (
    SELECT k >> 32 AS w, min((rank << 32) | (k & 4294967295)) AS pick FROM state JOIN merges ON pair = (id << 32) | next GROUP BY k >> 32
  ),
  pick AS (
    SELECT w, pick >> 32 AS rank, pick & 4294967295 AS p, next AS beyond
    FROM best JOIN state ON k = (w << 32) + (pick & 4294967295) + 1
  )
  SELECT n + 1, k - CAST((k & 4294967295) > p AS BIGINT),
         CASE WHEN (k & 4294967295) = p THEN rank ELSE id END,
         CASE WHEN (k & 4294967295) = p THEN beyond WHEN (k & 4294967295) = p - 1 THEN rank ELSE next END
  FROM state JOIN pick ON k >> 32 = w
  WHERE n < {steps} AND (k & 4294967295) <> p + 1)
)
"""

#: The same contraction with several steps in one, so that a long word takes about as many as it has ranks, not pairs. When the leftmost pair of minimum
#: rank has become one token, the next leftmost pair of that rank is next, unless the new token makes a pair of lower rank with a neighbour. So the pairs
#: of the minimum rank are taken from the left, every other one in a run of overlapping pairs, up to the first whose token does.
CONTRACT_LONG = """
WITH RECURSIVE state(n, k, id, next, after, pair, before, beyond) AS (
  SELECT 0, k, id, lead(k) OVER w, lead(k, 2) OVER w, (id << 32) | lead(id) OVER w, lag(id) OVER w, lead(id, 2) OVER w
  FROM positions WINDOW w AS (PARTITION BY k >> 32 ORDER BY k)
  UNION ALL
  (WITH found AS (SELECT state.*, rank FROM state JOIN merges USING (pair) WHERE n < {steps}),
  least AS (SELECT k >> 32 AS w, min(rank) AS rank FROM found GROUP BY k >> 32),
  ties AS (
    SELECT found.*, row_number() OVER o AS place, lag(next) OVER o IS NOT DISTINCT FROM k AS follows
    FROM found JOIN least ON k >> 32 = w AND found.rank = least.rank WINDOW o AS (PARTITION BY k >> 32 ORDER BY k)
  ),
  runs AS (SELECT *, max(CASE WHEN follows THEN 0 ELSE place END) OVER (PARTITION BY k >> 32 ORDER BY k) AS head FROM ties),
  every AS (
    SELECT *, CASE WHEN lag(after) OVER (PARTITION BY k >> 32 ORDER BY k) IS NOT DISTINCT FROM k THEN rank ELSE before END AS left_id
    FROM runs WHERE (place - head) % 2 = 0
  ),
  judged AS (
    SELECT every.k, every.next, every.rank,
           max(CASE WHEN a.rank < every.rank OR b.rank < every.rank THEN 1 ELSE 0 END)
             OVER (PARTITION BY every.k >> 32 ORDER BY every.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop
    FROM every LEFT JOIN merges a ON a.pair = (left_id << 32) | every.rank LEFT JOIN merges b ON b.pair = (every.rank << 32) | beyond
  ),
  taken AS (SELECT k, next, rank FROM judged WHERE coalesce(stop, 0) = 0),
  moved AS (
    SELECT n + 1 AS n, state.k, coalesce(taken.rank, id) AS id
    FROM state JOIN least ON state.k >> 32 = w LEFT JOIN taken ON state.k = taken.k ANTI JOIN taken AS gone ON state.k = gone.next
  )
  SELECT n, k, id, lead(k) OVER w, lead(k, 2) OVER w, (id << 32) | lead(id) OVER w, lag(id) OVER w, lead(id, 2) OVER w
  FROM moved WINDOW w AS (PARTITION BY k >> 32 ORDER BY k))
)
"""

#: Rows (w, k, id, n) of each word's last step, in order.
LAST = """
CREATE OR REPLACE TEMP TABLE tokens AS {contract}
SELECT k >> 32 AS w, k, id, done.n FROM state
JOIN (SELECT k >> 32 AS w, max(n) AS n FROM state GROUP BY k >> 32) AS done ON state.k >> 32 = done.w AND state.n = done.n ORDER BY k
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    category = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)), np.uint8)
    kinds[category == ord("L")], kinds[category == ord("N")] = _LETTER, _NUMBER
    kinds[WHITE_SPACE] = _SPACE
    return kinds


def split_words(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the matches of the default pattern in texts laid end to end; they tile each text.

    points: code points; text t is ``points[first[t]:first[t + 1]]``. A match is a run of letters,
    numbers, other characters or white space, and for the rest: a run takes one blank before it along; white space
    before a run ends one character early; an English contraction that starts a match is one by itself.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[first] = True
    new = head[:-1].copy()
    new[1:] |= kinds[1:] != kinds[:-1]
    last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~head[1:-1])
    new[last] = True
    new[last[points[last] == 32] + 1] = False
    quotes = np.flatnonzero((points == 39) & new)
    if len(quotes):
        ends = first[np.searchsorted(first, quotes, "right")]
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        one = np.where(quotes + 1 < ends, pad[quotes + 1], 0)
        two = np.where(quotes + 2 < ends, pad[quotes + 2], 0)
        r, v, l, e = map(ord, "rvle")  # noqa: E741
        long = ((one == r) | (one == v)) & (two == e) | (one == l) & (two == l)
        short = np.isin(one, [ord(c) for c in "stmd"])
        new[quotes[long | short] + 1] = False
        new[quotes[long] + 2] = False
        after = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        new[after[after < n]] = True
    return np.flatnonzero(new)


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb

        self.ranks, self.pattern = ranks, pattern
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "100MB"})
        pair, rank_of = array("q"), array("q")
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pair.append(left << 32 | right)
                    rank_of.append(rank)
        self._load("merges", pa.table({"pair": np.frombuffer(pair, np.int64), "rank": np.frombuffer(rank_of, np.int64)}))
        self._load(
            "vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int64()), "digits": [token.hex() for token in ranks]})
        )
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        self.known = Recent(KNOWN_WORDS)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming").fetchall()
        self.db.unregister("incoming")

    def _contract(self, words: list[bytes], long: bool) -> list[tuple[bytes, bytes]]:
        """(ids as 32-bit numbers, decoded bytes) of each word."""
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words)), sizes)
        k, ids = (w << 32) | (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)), self.single[data]
        # The steps of one query are bounded, so that their rows are; words that need more go on from where they are.
        steps = int(min(max(8, (1 << 21) // len(data)), 1 << 12))
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(words)
        while len(k):
            next_id = np.where(np.append(k[1:] >> 32, -1) == k >> 32, np.append(ids[1:], -1), -1)
            self._load("positions", pa.table({"k": k, "id": ids, "next": next_id}))
            self.db.execute(LAST.format(contract=(CONTRACT_LONG if long else CONTRACT).format(steps=steps))).fetchall()
            blob = bytes.fromhex(self.db.execute(f"SELECT string_agg(digits, '' ORDER BY k) FROM tokens JOIN vocabulary USING (id) WHERE n < {steps}").fetchall()[0][0] or "")
            done = self.db.sql(f"SELECT w, id FROM tokens WHERE n < {steps} ORDER BY k").to_arrow_table()
            w, ids = (done[c].to_numpy() for c in ("w", "id"))
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else w
            last = np.append(first[1:], len(w))
            ends = np.cumsum(self.sizes[ids])
            packed = ids.astype(np.int32)
            for n, a, b in zip(w[first].tolist(), first.tolist(), last.tolist()):
                out[n] = packed[a:b].tobytes(), blob[ends[a] - self.sizes[ids[a]] : ends[b - 1]]
            rest = self.db.sql(f"SELECT w, row_number() OVER (PARTITION BY w ORDER BY k) - 1 AS place, id FROM tokens WHERE n = {steps} ORDER BY k").to_arrow_table()
            k, ids = (rest["w"].to_numpy() << 32) | rest["place"].to_numpy(), rest["id"].to_numpy()
        return out

    def learn(self, words: list[bytes]) -> list[bytes | tuple[bytes, bytes]]:
        """Ids as 32-bit numbers of distinct words; with the decoded bytes where these are not the word itself."""
        out: list[bytes | tuple[bytes, bytes]] = [b""] * len(words)
        hard = []
        for n, raw in enumerate(words):
            rank = self.ranks.get(raw)
            if rank is not None:
                out[n] = np.int32(rank).tobytes()
            else:
                hard.append((len(raw), n))
        hard.sort()
        at = 0
        while at < len(hard):
            # Words of like length share a query; a very long one has its own.
            long, end, size = hard[at][0] > LONG_WORD, at, 0
            while end < len(hard) and (hard[end][0] > LONG_WORD) == long and (end == at or size + hard[end][0] <= BYTES_PER_QUERY):
                size += hard[end][0]
                end += 1
            part = [n for _, n in hard[at:end]]
            for n, (ids, decoded) in zip(part, self._contract([words[n] for n in part], long), strict=True):
                out[n] = ids if decoded == words[n] else (ids, decoded)
            at = end
        return out

    def _tokens(self, data: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first) of the pattern's matches in texts laid end to end, in bytes."""
        raw = np.frombuffer(data, np.uint8)
        char = np.flatnonzero((raw & 0xC0) != 0x80)
        first_point = np.searchsorted(char, first)
        if self.pattern == default_pattern():
            points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
            starts = split_words(points, first_point)
            ends = np.append(starts[1:], len(points))[: len(starts)]
        else:
            import regex

            find = regex.compile(self.pattern).finditer
            spans = [
                (low + m.start(), low + m.end())
                for low, a, b in zip(first_point, first, first[1:])
                for m in find(data[a:b].decode())
            ]
            starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
        own = np.searchsorted(starts, first_point)
        char = np.append(char, len(raw))
        return char[starts], char[ends], own

    def round_trip(self, texts: pa.Array) -> pa.Array:
        """Ids and decoded bytes of each text."""
        parts = []
        for _, part in tb.slices(texts, SLICE_BYTES):
            first = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            data = part.buffers()[2].slice(int(first[0]), int(first[-1] - first[0])).to_pybytes() if first[-1] > first[0] else b""
            starts, ends, own = self._tokens(data, first - first[0])
            words, word = tb.encode_words(np.frombuffer(data, np.uint8), starts, ends)
            found = self.known.get_all(words, self.learn)
            ids = [x if isinstance(x, bytes) else x[0] for x in found]
            decoded = [w if isinstance(x, bytes) else x[1] for w, x in zip(words, found)]
            offsets = lambda x: np.concatenate([[0], np.cumsum(np.fromiter(map(len, x), np.int64, len(x)))])
            first_id, ids = tb.gather(offsets(ids) // 4, np.frombuffer(b"".join(ids), np.int32), word)
            first_byte, decoded = tb.gather(offsets(decoded), np.frombuffer(b"".join(decoded), np.uint8), word)
            lists = pa.ListArray.from_arrays(pa.array(first_id[own], pa.int32()), pa.array(ids, pa.int32()))
            blobs = pa.Array.from_buffers(
                pa.binary(), len(part), [None, pa.py_buffer(first_byte[own].astype(np.int32)), pa.py_buffer(decoded)]
            )
            parts.append(pa.StructArray.from_arrays([lists, blobs], names=["ids", "decoded"]))
        return pa.concat_arrays(parts)

    def decode(self, lists: list[list[int] | None]) -> list[bytes | None]:
        """Bytes of each list of ids by ordered aggregation; null for null."""
        sizes = np.array([len(x) if x else 0 for x in lists])
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists if x] or [np.zeros(0, np.int64)])
        self._load("listed", pa.table({"row": np.repeat(np.arange(len(lists)), sizes), "place": np.arange(len(flat)), "id": flat}))
        found = dict(
            self.db.execute(
                'SELECT "row", string_agg(digits, \'\' ORDER BY place) FROM listed JOIN vocabulary USING (id) GROUP BY "row"'
            ).fetchall()
        )
        return [None if x is None else bytes.fromhex(found.get(n, "")) for n, x in enumerate(lists)]


def _codec(spark, path: str | None, pattern: str | None):
    """A function that gives a worker process its codec."""
    given = read_ranks(path or default_path()), pattern or default_pattern()
    key = hashlib.sha256(repr((sorted(given[0].items()), given[1])).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(given)
    return lambda: held("bpe", key, lambda: Codec(*shared.value))


def encode(
    docs: DataFrame, text: str = "text", into: str = "bpe", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``docs`` with a struct ``into``: ids of each whole text, without special tokens, and their decoded bytes.

    Null and empty texts have no ids. Repeated rows are encoded alike. A column named ``into`` is replaced.
    The rank file is read by the driver and broadcast; its size does not depend on the documents.
    """
    codec = _codec(docs.sparkSession, path, pattern)

    return with_struct(docs, text, into, "struct<ids:array<int>,decoded:binary>", lambda: codec().round_trip)


def decode(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with a struct ``into`` with the bytes of an id list; null gives null, an id outside the vocabulary nothing."""
    codec = _codec(rows.sparkSession, path, None)

    def work():
        own = codec()
        return lambda column: [{"bytes": x} for x in own.decode(column.to_pylist())]

    return with_struct(rows, ids, into, "struct<bytes:binary>", work)


def op9(docs: DataFrame) -> DataFrame:
    """Digest columns of the contract from :func:`encode`."""
    done = encode(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )
