"""The prefix trie of rebuilt conversations, from composable fingerprints of turns.

A conversation is rebuilt from the head of its base conversation and its own turns after that head. A turn is an invertible map
x -> a x + b of 64-bit numbers, in two lanes, made from a hash of its role and text; a sequence of turns is the product of
its maps, and its fingerprint their value at 0. Products compose, so the fingerprint of every rebuilt prefix
comes from a prefix product of the own conversation and one number of the conversation, namely the base head's value taken back through the own
turns that it replaces. No rebuilt text is made.

Prefixes of equal depth and fingerprint are a node. That they are equal is verified: all turns of one hash are
compared by text, and all members of a node must have the same last turn and the same parent; by induction from the root their
sequences are then the same. Should a check fail, everything is done again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import cut, release

U64 = np.uint64
#: Depths, or conversation ids, that are summed or joined in one group.
CHUNK_BITS = 12
#: At most this many parents have so many hanging paths that they are broadcast to them.
HOT_PARENTS = 1000
#: Attempts with other hashes before a failed check is an error.
SEEDS = 4

KEY = ["depth", "k1", "k2"]
_NUMBERS = ["a1", "b1", "a2", "b2"]
_SCANNED = "conv_id long, part int, total boolean, edge boolean, pos long, a1 long, b1 long, a2 long, b2 long, t1 long, t2 long, words long"
_ROW = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, t1 long, t2 long, words long, last boolean"


def base_of(conv_id: Column) -> Column:
    """The conversation that a conversation's head comes from."""
    return conv_id - conv_id % 20


def head_of(conv_id: Column) -> Column:
    """How many turns of the base make the head; at most three."""
    return F.crc32(conv_id.cast("string")) % 4


def _maps(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of turns with hashes ``t``; a is odd, so the map can be undone."""
    t = t.astype(np.int64, copy=False).view(U64)
    return tb.mix(t ^ U64(0x9E3779B97F4A7C15)) | U64(1), tb.mix(t + U64(0xD1B54A32D192ED03))


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverses of odd numbers modulo 2 ** 64; each step doubles the bits that are right."""
    x = a.copy()
    for _ in range(5):
        x = x * (U64(2) - a * x)
    return x


def _scan(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> None:
    """Replace each map by the product from its run's start up to it; run members reach back to row ``start``."""
    place = np.arange(len(a))
    step, longest = 1, int((place - start).max(initial=0))
    while step <= longest:
        to = np.flatnonzero(place - step >= start)
        b[to] = a[to] * b[to - step] + b[to]
        a[to] = a[to] * a[to - step]
        step *= 2


def _signed(x) -> np.ndarray:
    return np.asarray(x, U64).view(np.int64)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix products within this partition's part of each conversation, a total of each part after its rows."""
    part = TaskContext.get().partitionId()
    conv, count, product, first = None, 0, [U64(1), U64(0), U64(1), U64(0)], True
    zero = lambda n: np.zeros(n, np.int64)

    def out(ids, total, edge, pos, products, t1, t2, words):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids, np.full(n, part, np.int32), np.full(n, total), edge, pos, *map(_signed, products), t1, t2, words)],
            names=[x.split()[0] for x in _SCANNED.split(", ")],
        )

    for batch in batches:
        ids, t1, t2, words = (batch.column(n).to_numpy() for n in ("conv_id", "t1", "t2", "words"))
        if not len(ids):
            continue
        new = np.append(True, ids[1:] != ids[:-1])
        heads = np.flatnonzero(new)
        start = heads[np.cumsum(new) - 1]
        lanes = []
        carried = conv is not None and ids[0] == conv
        for t, own in ((t1, product[:2]), (t2, product[2:])):
            a, b = _maps(t)
            if carried:
                b[:1], a[:1] = a[:1] * own[1] + b[:1], a[:1] * own[0]
            _scan(a, b, start)
            lanes.append((a, b))
        pos = np.arange(len(ids)) - start + 1
        if carried:
            pos[start == 0] += count
        before = []
        for (a, b), own in zip(lanes, (product[:2], product[2:])):
            for x, one, kept in ((a, U64(1), own[0]), (b, U64(0), own[1])):
                shifted = np.append(one, x[:-1])
                shifted[heads] = one
                if carried:
                    shifted[0] = kept
                before.append(shifted)
        ends = np.append(heads[1:] - 1, len(ids) - 1)
        done = ends[:-1]
        if conv is not None and not carried:
            yield out(np.array([conv]), True, np.array([first]), np.array([count]), [np.array([x]) for x in product], zero(1), zero(1), zero(1))
            first = False
        if len(done):
            edge = np.zeros(len(done), bool)
            edge[0], first = first, False
            totals = [x[done] for lane in lanes for x in lane]
            yield out(ids[done], True, edge, pos[done], totals, zero(len(done)), zero(len(done)), zero(len(done)))
        yield out(ids, False, np.zeros(len(ids), bool), pos, before, t1, t2, words)
        conv, count, product = int(ids[-1]), int(pos[-1]), [lane[k][-1] for lane in lanes for k in (0, 1)]
    if conv is not None:
        yield out(np.array([conv]), True, np.array([True]), np.array([count]), [np.array([x]) for x in product], zero(1), zero(1), zero(1))


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return turns.withColumns({f"t{k + 1}": F.xxhash64(F.lit(2 * seed + k), "role", "text") for k in (0, 1)})


def _same_texts(turns: DataFrame) -> bool:
    """Do turns of one hash have one role and text?"""
    told = turns.groupBy("t1", "t2").agg(F.min(F.struct("role", "text")).alias("low"), F.max(F.struct("role", "text")).alias("high"))
    return told.filter("low != high").isEmpty()


def _scanned(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns and totals with products within their part, carries (conv_id, part, pos and product before the part)).

    Turns are dealt by ranges of (conv_id, turn, role, text), so a conversation of any length is in neighbouring parts. Only the first
    and last conversation of a part can go on elsewhere, so the driver sees two rows of a part at most.
    """
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    order = ["conv_id", "turn", "role", "text", "nth"]
    dealt = turns.withColumns({"words": words, "nth": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = cut(dealt.select("conv_id", "t1", "t2", "words").mapInArrow(_local, _SCANNED))
    edges = scanned.filter("total AND edge").select("conv_id", "part", "pos", *_NUMBERS).collect()
    carries, last = [], None
    for row in sorted(edges, key=lambda r: (r.conv_id, r.part)):
        number = [v % (1 << 64) for v in row[3:]]
        if last and last[0] == row.conv_id:
            carries.append((row.conv_id, row.part, last[1], *(v - (v >> 63 << 64) for v in last[2])))
            n, (a1, b1, a2, b2) = last[1] + row.pos, last[2]
            number = [x % (1 << 64) for x in (number[0] * a1, number[0] * b1 + number[1], number[2] * a2, number[2] * b2 + number[3])]
        else:
            n = row.pos
        last = row.conv_id, n, number
    kind = "conv_id long, part int, gone long, " + ", ".join(f"c{x} long" for x in _NUMBERS)
    return scanned, dealt.sparkSession.createDataFrame(carries, kind)


def _conversations(placed: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column]) -> DataFrame:
    """A row of each conversation: n turns, h to be replaced, and the first three turns of it and of its base."""
    turn = F.when(~F.col("total"), F.struct("at", "t1", "t2", "words"))
    own = (
        placed.filter("total OR at <= 3").groupBy("conv_id")
        .agg(F.sum(F.when(F.col("total"), F.col("pos"))).alias("n"), F.sort_array(F.collect_list(turn)).alias("own"))
    )
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("theirs"))
    return own.withColumns({"base": base(F.col("conv_id")), "h": head(F.col("conv_id"))}).join(bases, "base", "left")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation: hl, the number that its own products start from, and its head's rows with the root's."""
    for batch in batches:
        rows = batch.to_pylist()
        if not rows:
            continue
        out = []
        for row in rows:
            head = (row["theirs"] or [])[: row["h"]]
            length = len(head) + max(row["n"] - row["h"], 0)
            value, last = np.zeros(2, U64), (0, 0)
            nodes = [{"depth": 0, "k1": 0, "k2": 0, "p1": None, "p2": None, "t1": None, "t2": None, "words": 0, "last": length == 0}]
            for depth, turn in enumerate(head, 1):
                a, b = _maps(np.array([turn["t1"], turn["t2"]]))
                value = a * value + b
                key = tuple(_signed(value).tolist())
                nodes.append({"depth": depth, "k1": key[0], "k2": key[1], "p1": last[0], "p2": last[1], "t1": turn["t1"], "t2": turn["t2"], "words": turn["words"], "last": length == depth})
                last = key
            for turn in reversed(row["own"][: row["h"]]):
                a, b = _maps(np.array([turn["t1"], turn["t2"]]))
                value = (value - b) * _inverse(a)
            g1, g2 = _signed(value).tolist()
            out.append({"conv_id": row["conv_id"], "h": row["h"], "hl": len(head), "length": length, "g1": g1, "g2": g2, "nodes": nodes})
        yield pa.RecordBatch.from_pylist(out, _HEADS_ARROW)


_NODE = [(n, pa.int64()) for n in ("depth", "k1", "k2", "p1", "p2", "t1", "t2", "words")] + [("last", pa.bool_())]
_HEADS_ARROW = pa.schema([(n, pa.int64()) for n in ("conv_id", "h", "hl", "length", "g1", "g2")] + [("nodes", pa.list_(pa.struct(_NODE)))])
_HEADS = "conv_id long, h long, hl long, length long, g1 long, g2 long, nodes array<struct<" + ",".join(f"{n}:{'boolean' if n == 'last' else 'long'}" for n, _ in _NODE) + ">>"


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rebuilt prefixes that end with an own turn, and of their parents."""
    for batch in batches:
        c = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        u = lambda n: c[n].view(U64)  # noqa: B023, E731
        keys, parents = [], []
        for k in "12":
            start = u(f"ca{k}") * u(f"g{k}") + u(f"cb{k}")
            parent = u(f"a{k}") * start + u(f"b{k}")
            a, b = _maps(c[f"t{k}"])
            parents.append(_signed(parent))
            keys.append(_signed(a * parent + b))
        depth = c["at"] - c["h"] + c["hl"]
        columns = [c["conv_id"], depth, *keys, *parents, c["t1"], c["t2"], c["words"], depth == c["length"]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in _ROW.split(", ")])


def _rows(turns: DataFrame, base, head) -> DataFrame:
    """A row for each conversation and each depth of its rebuilt form, the root too."""
    scanned, carries = _scanned(turns)
    placed = scanned.join(F.broadcast(carries), ["conv_id", "part"], "left").withColumn("at", F.col("pos") + F.coalesce("gone", F.lit(0)))
    whole = cut(_conversations(placed, base, head).select("conv_id", "n", "h", "own", "theirs").mapInArrow(lambda b: release(_heads(b)), _HEADS))
    parts = placed.filter("total").select("conv_id", "part").join(whole.drop("nodes"), "conv_id")
    ids = {f"c{x}": F.coalesce(f"c{x}", F.lit(int(x[0] == "a"))) for x in _NUMBERS}
    own = (
        placed.filter("NOT total").join(parts, ["conv_id", "part"]).filter("at > h").withColumns(ids)
        .select("conv_id", "at", "h", "hl", "length", "g1", "g2", "t1", "t2", "words", *_NUMBERS, *ids)
    )
    return whole.select("conv_id", F.inline("nodes")).unionByName(own.mapInArrow(lambda b: release(_own_rows(b)), _ROW))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces of text, which come in order, one piece at a time."""
    key, digest = None, None
    for batch in batches:
        found = []
        for row in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids"))):
            if row[:3] == key:
                digest.update(b"," + row[3].encode())
            else:
                if key:
                    found.append((*key, digest.hexdigest()))
                key, digest = row[:3], hashlib.sha256(row[3].encode())
        yield _ends_batch(found)
    if key:
        yield _ends_batch([(*key, digest.hexdigest())])


def _ends_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [(n, pa.int64()) for n in KEY] + [("ends_sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes where conversations end. Ids are joined in groups of neighbours first, and groups hashed in order, so a
    node of very many ends is never held whole."""
    group = F.shiftright("conv_id", CHUNK_BITS).alias("group")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = rows.filter("last").groupBy(*KEY, group).agg(ids.alias("ids"))
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "group").select(*KEY, "ids")
    return ordered.mapInArrow(_hash_ends, "depth long, k1 long, k2 long, ends_sha256 string")


def _nodes(rows: DataFrame) -> DataFrame:
    both = [f(c).alias(f"{n}_{c}") for c in ("p1", "p2", "t1", "t2") for n, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *both)


def _verified(nodes: DataFrame) -> bool:
    """Have all members of each node one parent and one last turn?"""
    return nodes.filter(" OR ".join(f"low_{c} != high_{c}" for c in ("p1", "p2", "t1", "t2"))).isEmpty()


def trie(conversations: DataFrame, base: Callable[[Column], Column] = base_of, head: Callable[[Column], Column] = head_of, mask: int = -1) -> DataFrame:
    """Nodes of the prefix trie of ``conversations`` (conv_id, turn, role, text): KEY, parent's p1 and p2, conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, then role and text; null role or text is empty. Rows without a conv_id belong to no conversation; a
    repeated row is a turn again. Other columns are ignored. An empty table has no root. ``mask`` weakens the hashes of the first attempt, for tests.

    Nodes are summed by their smallest member, whose nodes are one run of depths: a node's subtree is its own run from its depth on, and the whole runs of its other members.
    """
    for seed in range(SEEDS):
        turns = _turns(conversations, seed)
        if mask != -1 and not seed:
            turns = turns.withColumns({t: F.col(t).bitwiseAND(F.lit(mask)) for t in ("t1", "t2")})
        if not _same_texts(turns):
            continue
        rows = cut(_rows(turns, base, head))
        nodes = cut(_nodes(rows))
        if _verified(nodes):
            return _summed(rows, nodes)
    raise RuntimeError("turns of different texts share all their hashes")


def _summed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    chunk = F.shiftright("depth", CHUNK_BITS).alias("chunk")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    own = nodes.select(*KEY, F.col("low_p1").alias("p1"), F.col("low_p2").alias("p2"), "conv_id", "n_convs", saved, chunk)
    whole, later = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        own.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("part"), F.min("depth").alias("low"), F.max("depth").alias("high"))
        .select("conv_id", "chunk", F.coalesce(F.sum("part").over(later), F.lit(0)).alias("after"), F.sum("part").over(whole).alias("whole"), F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"))
    )
    below = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth"))
    own = cut(own.join(runs, ["conv_id", "chunk"]).withColumn("own_saved", F.sum("saved").over(below) + F.col("after")))
    tops = own.filter("depth = low AND depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("conv_id").alias("top"))
    counted = own.join(tops.groupBy(*KEY).agg(F.count("*").alias("n_tops")), KEY, "left").withColumn("n_tops", F.coalesce("n_tops", F.lit(0)))
    counted = counted.withColumn("n_children", F.col("n_tops") + (F.col("depth") < F.col("high")).cast("long"))
    leaf = (F.col("n_children") == 0).cast("long")
    counted = cut(counted.withColumn("leaf", leaf))

    # A conversation's whole run, and whether it owns a leaf, at each chunk of the depths it passes.
    mine = counted.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.max("leaf").alias("leaf"), F.max("high").alias("high")).filter("whole > 0 OR leaf > 0")
    mine = mine.select("conv_id", "whole", "leaf", F.explode(F.sequence(F.lit(0), F.shiftright("high", CHUNK_BITS))).alias("chunk"))
    members = rows.select(*KEY, "conv_id", chunk).join(mine, ["conv_id", "chunk"]).groupBy(*KEY).agg(F.sum("whole").alias("all_whole"), F.sum("leaf").alias("n_leaves"))

    total = tops.count()
    parents = counted.filter("n_tops > 0").select(*KEY, F.col("conv_id").alias("parent"), "n_tops")
    hot = parents.filter(F.col("n_tops") * HOT_PARENTS > total).drop("n_tops")
    known = tops.join(F.broadcast(hot), KEY, "left")
    few = known.filter("parent IS NULL").drop("parent").join(parents.drop("n_tops"), KEY)
    above = known.filter("parent IS NOT NULL").unionByName(few).select((F.col("depth") + 1).alias("top_depth"), "top", "parent")

    done = counted.join(members, KEY, "left").join(_ends(rows), KEY, "left")
    # A top is told by its conversation and depth.
    done = done.join(above, (F.col("conv_id") == F.col("top")) & (F.col("depth") == F.col("top_depth")), "left")
    return done.select(
        *KEY, "p1", "p2", "conv_id",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.col("own_saved") - F.col("whole") + F.coalesce("all_whole", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11(conversations: DataFrame) -> DataFrame:
    """The contract's columns of every node."""
    return trie(conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of a decimal number by its bits, a byte at every eighth.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)))"""

OP11_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
heads AS (SELECT c, turns, {_CRC} % 4 AS h FROM own),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 20
),
paths AS (SELECT c, d, turns[1:d] AS path, len(turns) = d AS ends FROM rebuilt, range(0, len(turns) + 1) AS r(d)),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM paths GROUP BY path, d
),
parents AS (
  SELECT n.*, p.conv_id AS parent_conv_id, count(k.d) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1] LEFT JOIN nodes k ON k.d = n.d + 1 AND k.path[1:n.d] = n.path
  GROUP BY ALL
),
ancestors AS (SELECT n.path[1:a] AS path, a AS d, n.saved, n.n_children FROM parents n, range(0, n.d + 1) AS r(a)),
subtrees AS (SELECT path, d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM ancestors GROUP BY path, d)
SELECT conv_id, n.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM parents n JOIN subtrees s ON s.d = n.d AND s.path = n.path
"""
