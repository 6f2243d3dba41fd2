"""Near-duplicate classes: MinHash bands, odd sketches and full comparison.

1. A text's set is its distinct word shingles. MinHash samples of the set are cut into bands for
   candidates, and folded into an odd sketch, a bitmap in which each sample flips one bit. The
   population count of two sketches' XOR estimates a high similarity closely.
2. Sets that share a band are candidates. The smallest set of a band is its hub; most bands of a group of copies have the same few hubs. Each set is
   first compared with one, that whose sketch is nearest, so a large group of copies is joined at about its own cost.
3. Where the sets around a hub are still several components, those of different ones are compared: sketches first, in blocks, and what they
   do not dismiss by the full sets. Sets that share no band are never compared, also if others connect them.

Links and components stay distributed; components are found by alternating stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import BROADCAST_ROWS, cut, release, small_batches

WIDTH = 5
#: Hundredths of the union that two sets must share.
CONTRACT_PERCENT, PIPELINE_PERCENT = 85, 80
BAND_ROWS = 5
#: Chance that a pair right at the threshold shares no band.
MISS = 1e-7
SKETCH_BITS = 1024
#: Edges in a partition of the rounds that find components, about.
EDGES_PER_PART = 20_000
#: Sets around a hub that one block holds, about, when sketches and when full sets are compared, and the shingles of these.
SKETCH_BLOCK, SET_BLOCK, SHINGLES = 1024, 512, 1 << 19

_U64 = np.uint64


class Plan(NamedTuple):
    percent: int
    bands: int
    most_bits: int  # XOR population count above which a pair is dismissed


def plan(percent: int) -> Plan:
    """Bands and the sketch bound for a threshold; the bound lies six standard deviations out."""
    t = percent / 100
    bands = math.ceil(math.log(MISS) / math.log(1 - t**BAND_ROWS))
    samples = bands * BAND_ROWS
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * samples * (1 - t)))
    spread = math.sqrt(4 * samples * t * (1 - t) + mean)
    return Plan(percent, bands, math.ceil(mean + 6 * spread))


def _samples(hashes: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """MinHash samples (texts x count) of non-empty sets laid end to end."""
    random = np.random.default_rng(20240229)
    factors = random.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    masks = random.integers(0, 1 << 32, count, dtype=np.uint32)
    short = (hashes >> _U64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, count), np.uint32)
    for j in range(count):
        out[:, j] = np.minimum.reduceat((short ^ masks[j]) * factors[j], first[:-1])
    return out


def _bands(samples: np.ndarray) -> np.ndarray:
    cubed = samples.reshape(len(samples), -1, BAND_ROWS).astype(_U64)
    weights = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], _U64)
    return tb.mix((cubed * weights).sum(axis=2) + np.arange(cubed.shape[1], dtype=_U64) * _U64(0xD6E8FEB86659FD93))


def _odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Bitmaps (texts x bytes) in which each sample flips a bit."""
    out = np.empty((len(samples), SKETCH_BITS // 8), np.uint8)
    number = np.arange(samples.shape[1], dtype=_U64) << _U64(32)
    for at in range(0, len(samples), 512):
        part = samples[at : at + 512]
        place = (tb.mix(part.astype(_U64) + number) % _U64(SKETCH_BITS)).astype(np.int64)
        flat = (place + np.arange(len(part))[:, None] * SKETCH_BITS).ravel()
        flips = np.bincount(flat, minlength=len(part) * SKETCH_BITS).reshape(len(part), SKETCH_BITS)
        out[at : at + 512] = np.packbits((flips & 1).astype(np.uint8), axis=1)
    return out


def _blobs(rows: np.ndarray) -> pa.Array:
    """Binary array from a (rows x bytes) matrix."""
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _sets(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = tb.words(part, tb.SPACED)
    return tb.distinct(*tb.shingles(w.hashes, w.first, WIDTH))


def _set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each non-empty set, the same for equal sets."""
    low = np.add.reduceat(tb.mix(hashes + _U64(0x632BE59BD9B4E019)), first[:-1])
    high = np.add.reduceat(tb.mix(hashes ^ _U64(0xE220A8397B1DCDAF)), first[:-1])
    return np.column_stack([tb.mix(low + np.diff(first).astype(_U64)), tb.mix(high)])


def _rows_of(block: pa.Table, name: str) -> np.ndarray:
    """Matrix of a column of lists of equal length."""
    lists = block[name].combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _signatures(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for at, part in tb.slices(text):
                hashes, first = _sets(part)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                own = np.append(first[:-1][full], len(hashes))
                ids = np.zeros((len(part), 2), _U64)
                keys, sketches = np.zeros((0, bands), _U64), np.zeros((0, SKETCH_BITS // 64), _U64)
                if len(full):
                    samples = _samples(hashes, own, bands * BAND_ROWS)
                    keys, sketches, ids[full] = _bands(samples), _odd_sketches(samples).view(_U64), _set_ids(hashes, own)
                lists = lambda x: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, x.shape[1], 0))]), pa.int32()), pa.array(x.ravel().view(np.int64))
                )
                rows = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index("doc_id")),
                        rows.column(rows.schema.get_field_index("text_hash")),
                        pa.array(sizes, pa.int64()),
                        _blobs(ids),
                        pa.array(ids[:, 0].view(np.int64)),
                        lists(keys),
                        lists(sketches),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "sid", "s", "bands", "sketch"],
                )

    return lambda batches: release(run(batches))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tb.slices(batch.column(batch.schema.get_field_index("text"))):
                hashes, first = _sets(part)
                full = np.flatnonzero(np.diff(first))
                own = np.append(first[:-1][full], len(hashes))
                if not len(full):
                    continue
                rows = batch.slice(at, len(part)).take(pa.array(full))
                ids = _blobs(_set_ids(hashes, own))
                lists = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(hashes.view(np.int64)))
                columns = [rows.column(rows.schema.get_field_index(c)) for c in ("c", "sid")]
                yield pa.RecordBatch.from_arrays([*columns, ids, lists], names=["c", "sid", "found", "shingles"])

    return release(run())


def _near(block: pa.Table, how: Plan) -> np.ndarray:
    """Symmetric matrix of the pairs of a block that share a band and whose sketches are near, and which this block has to compare: of different
    components, and of different sides where there are two."""
    bits, bands = _rows_of(block, "sketch").view(_U64), _rows_of(block, "bands")
    sizes, side, label = (block[c].to_numpy() for c in ("n_shingles", "side", "label"))
    allowed = np.not_equal.outer(label, label) & (100 * np.minimum.outer(sizes, sizes) >= how.percent * np.maximum.outer(sizes, sizes))
    if side.min() != side.max():
        allowed &= np.not_equal.outer(side, side)
    share = np.zeros_like(allowed)
    for k in range(bands.shape[1]):
        share |= np.equal.outer(bands[:, k], bands[:, k])
    allowed &= share
    for i in np.flatnonzero(allowed.any(axis=1)):
        others = np.flatnonzero(allowed[i, i:]) + i
        near = np.bitwise_count(bits[i] ^ bits[others]).sum(axis=1) <= how.most_bits
        allowed[i, others] = allowed[others, i] = near
    return allowed


def _unlike(how: Plan):
    """Members of one block that have a near one, by their sketches."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        return block.select(["hub", "c"]).filter(pa.array(_near(block, how).any(axis=1)))

    return run


def _linked(near: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Those of the pairs ``near``, a symmetric matrix, whose full sets are similar enough."""
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return near
    sizes = np.array([len(sets[i]) for i in rows])
    hashes = np.concatenate([sets[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, uses = np.unique(hashes, return_inverse=True, return_counts=True)
    common = uses[column] > 1
    column, owner = column[common], owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.append(False, column[1:] != column[:-1])) if len(column) else column
    shared = np.zeros((len(rows), len(rows)), np.float32)  # counts far below 2^24
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(rows), width), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        shared += has @ has.T
    near = near.copy()
    near[np.ix_(rows, rows)] &= 100 * shared >= percent * (np.add.outer(sizes, sizes) - shared)
    return near


def _compare(how: Plan):
    """Links of one block as (a, b): each member of a component with its best-connected one."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids, lists = block["c"].to_numpy(), block["shingles"].combine_chunks()
        first, hashes = lists.offsets.to_numpy(), lists.values.to_numpy()
        links = _linked(_near(block, how), [hashes[x:y] for x, y in zip(first, first[1:])], how.percent)
        degree, open_ = links.sum(axis=1), np.ones(len(ids), bool)
        pairs: list[tuple[int, int]] = []
        for hub in np.argsort(-degree, kind="stable"):
            if not degree[hub]:
                break
            if not open_[hub]:
                continue
            group = np.zeros(len(ids), bool)
            group[hub] = True
            edge = group.copy()
            while edge.any():
                edge = links[edge].any(axis=0) & ~group
                group |= edge
            open_ &= ~group
            pairs += [(ids[i], ids[hub]) for i in np.flatnonzero(group) if i != hub]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Alternating large and small stars; a node's neighbours are reduced to their minimum by a partial aggregation
    and joined back, so hubs are no single task's group. Null ends and loops are ignored.
    """
    edges = cut(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    # The rounds keep no more partitions than the edges, which never grow in number, can fill.
    parts = -(-edges.count() // EDGES_PER_PART) or 1
    edges, before = edges.coalesce(parts), None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least).distinct().coalesce(parts))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select("a", F.col("b").alias("root")).union(edges.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
        before = state


def _blocks(members: DataFrame, size: int, shingles: int) -> DataFrame:
    """``members`` (hub, c, label, n_shingles) in the blocks (hub, block, other) that compare those of different labels.

    Up to ``size`` members of up to ``shingles`` in all are one block. In a larger group the members outside its largest label are compared with all others, in
    blocks of two sides of about that much each, or of one that is compared with itself.
    """
    counts = members.groupBy("hub", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t"))
    sums = counts.groupBy("hub").agg(
        F.max(F.struct("n", "t", "label")).alias("main"), F.sum("n").alias("n"), F.sum("t").alias("t")
    )
    blocks = lambda n, t: F.greatest(F.ceil(n / size), F.ceil(t / shingles)).cast("int")
    to = sums.filter("n > main.n").select(
        "hub",
        F.col("main.label").alias("main"),
        blocks(F.col("n"), F.col("t")).alias("all"),
        blocks(F.col("main.n"), F.col("main.t")).alias("inners"),
        blocks(F.col("n") - F.col("main.n"), F.col("t") - F.col("main.t")).alias("outers"),
    )
    outer = F.col("label") != F.col("main")
    own = F.pmod(F.xxhash64("c"), F.when(outer, F.col("outers")).otherwise(F.col("inners"))).cast("int")
    place = lambda block, other, side: F.struct(block.alias("block"), other.alias("other"), side.alias("side"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    with_outer = lambda k: place(F.least("own", k), F.col("inners") + F.greatest("own", k), F.when(F.col("own") <= k, 0).otherwise(1))
    places = (
        F.when(F.col("all") <= 1, F.array(place(F.lit(0), F.lit(0), F.lit(0))))
        .when(outer, F.concat(each("inners", lambda j: place(F.col("own"), j, F.lit(0))), each("outers", with_outer)))
        .otherwise(each("outers", lambda i: place(i, F.col("own"), F.lit(1))))
    )
    dealt = members.join(to, "hub").withColumn("own", own).select("hub", "c", "label", F.explode(places).alias("at"))
    return dealt.select("hub", "c", "label", "at.*")


def near_duplicates(docs: DataFrame, percent: int = PIPELINE_PERCENT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text_hash (xxhash64 of the text), sid (equal for
    equal sets, null for an empty one), n_shingles and component_id.

    Two texts are linked if 100 times their sets' intersection is at least ``percent`` times their union, and
    component_id is the smallest doc_id reachable over links, the row's own included. Null and blank texts have an empty set and
    are linked with nothing. Rows with equal sets are linked, also repeated rows; null doc_ids are never smallest, and a
    component of null doc_ids only has a null component_id. An empty table gives no rows.
    """
    how = plan(percent)
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = source.withColumn("text_hash", F.xxhash64("text"))
    kind = dict(source.dtypes)["doc_id"]
    rows = cut(
        hashed.mapInArrow(
            _signatures(how.bands),
            f"doc_id {kind}, text_hash long, n_shingles long, sid binary, s long, bands array<long>, sketch array<long>",
        )
    )
    full = rows.filter("n_shingles > 0")
    classes, groups = _classes(full)
    links = cut(_verified(_nearest(classes, groups, how), classes, hashed, percent))
    links = links.union(_across(groups, links, classes, hashed, how))
    roots = cut(components(links).select(F.col("a").alias("c"), "root").join(classes.select("c", "sid"), "c").select("sid", "root"))
    firsts = full.groupBy("sid").agg(F.min("doc_id").alias("first_id"))
    least = cut(roots.join(firsts, "sid").groupBy("root").agg(F.min("first_id").alias("least_id")))
    roots = roots.join(_small(least), "root").select("sid", "least_id")
    # Cut, so that the join below shuffles both sides and adaptive execution can split a class of very many rows.
    known = cut(firsts.join(roots, "sid", "left").select("sid", F.coalesce("least_id", "first_id").alias("component")))
    own = F.when(F.col("n_shingles") > 0, F.col("sid")).alias("sid")
    return (
        rows.select("doc_id", "text_hash", own, "n_shingles")
        .join(_small(known), "sid", "left")
        .select(
            "doc_id",
            "text_hash",
            "sid",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct sets that share a band with another, each with a number c and a row that has it; (hub, c) for each set and the smallest sets of its bands)."""
    keyed = rows.select(F.explode("bands").alias("band"), "s")
    buckets = keyed.groupBy("band").agg(F.min("s").alias("low"), F.max("s").alias("high")).filter("low != high").select("band")
    buckets = _small(cut(buckets))
    touched = cut(keyed.join(buckets, "band").select("s").distinct())
    one = [F.first(x).alias(x) for x in ("n_shingles", "bands", "sketch")]
    distinct = rows.join(_small(touched), "s").groupBy("sid").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), *one)
    classes = cut(distinct.withColumn("c", F.monotonically_increasing_id()))
    members = classes.select(F.explode("bands").alias("band"), "c").join(buckets, "band")
    hubs = members.groupBy("band").agg(F.min("c").alias("hub"))
    return classes, cut(members.join(hubs, "band").select("hub", "c").distinct())


def _nearest(classes: DataFrame, groups: DataFrame, how: Plan) -> DataFrame:
    """(a, b): each set with that of its hubs whose sketch is nearest; none where none is near."""
    pairs = groups.filter("c != hub").select(F.col("c").alias("a"), F.col("hub").alias("b"))
    side = lambda x: classes.select(F.col("c").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    alike = 100 * F.least("n_a", "n_b") >= how.percent * F.greatest("n_a", "n_b")
    near = both.filter(alike).select("a", "b", bits.alias("bits")).filter(F.col("bits") <= how.most_bits)
    return near.groupBy("a").agg(F.min(F.struct("bits", "b"))["b"].alias("b"))


def _sets_of(wanted: DataFrame, classes: DataFrame, hashed: DataFrame) -> DataFrame:
    """(c, shingles) of the sets ``wanted`` (c), made from their rows' texts."""
    found = cut(wanted.join(classes.select("c", "sid", "row.*"), "c").withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"}))
    same = (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    texts = hashed.join(_small(found), same).select("c", "sid", "text")
    sets = texts.mapInArrow(_full_sets, "c long, sid binary, found binary, shingles array<long>")
    return cut(sets.filter("sid = found").select("c", "shingles").dropDuplicates(["c"]))


def _verified(pairs: DataFrame, classes: DataFrame, hashed: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    pairs = cut(pairs)
    sets = _sets_of(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), classes, hashed)
    side = lambda x: sets.select(F.col("c").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("n"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return shared.filter(F.col("n") * (100 + percent) >= F.col("sizes") * percent).select("a", "b")


def _across(groups: DataFrame, links: DataFrame, classes: DataFrame, hashed: DataFrame, how: Plan) -> DataFrame:
    """Links between sets that have a hub in common and are in different components of ``links``."""
    labels = components(links).select(F.col("a").alias("c"), F.col("root").alias("label"))
    labelled = groups.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    several = labelled.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    signs = classes.select("c", "n_shingles", "bands", "sketch")
    open_ = cut(labelled.join(several.select("hub"), "hub").join(classes.select("c", "n_shingles"), "c"))
    key = ["hub", "block", "other"]
    near = _blocks(open_, SKETCH_BLOCK, 1 << 60).join(signs, "c").groupBy(*key).applyInArrow(_unlike(how), "hub long, c long")
    near = cut(open_.join(near.distinct(), ["hub", "c"]))
    sets = _sets_of(near.select("c").distinct(), classes, hashed)
    blocks = _blocks(near, SET_BLOCK, SHINGLES).join(signs, "c").join(sets, "c")
    return _packed(blocks.groupBy(*key).applyInArrow(_compare(how), "a long, b long"))


def _packed(links: DataFrame) -> DataFrame:
    """``links`` materialised, in as few partitions as they fill."""
    links = cut(links)
    return links.coalesce(-(-links.count() // EDGES_PER_PART) or 1)


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are few; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keep_one(docs: DataFrame, percent: int = PIPELINE_PERCENT) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest doc_id.

    Rows of equal doc_id and text keep one, whichever; of several texts under the smallest doc_id the one of smallest hash stays. Blank
    and null texts are all kept. Columns and their values do not change.
    """
    found = near_duplicates(docs, percent).filter("n_shingles > 0")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"))
    marked = cut(
        found.withColumn("c", F.coalesce(F.col("component_id").cast("string"), F.lit("")))
        .join(best.withColumn("c", F.coalesce(F.col("component_id").cast("string"), F.lit(""))).drop("component_id"), "c")
        .withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
        .groupBy("doc_id", "text_hash")
        .agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
        .filter("NOT stays OR n > 1")
        .select(F.col("doc_id").alias("x_id"), F.col("text_hash").alias("x_hash"), "stays")
    )
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (F.col("__hash") == F.col("x_hash")) & F.col("doc_id").eqNullSafe(F.col("x_id"))
    rest = hashed.join(_small(marked), same, "left_anti")
    repeats = hashed.join(_small(marked.filter("stays")), same, "left_semi").dropDuplicates(["doc_id", "__hash"])
    return rest.unionByName(repeats).drop("__hash")


def op5(docs: DataFrame) -> DataFrame:
    """Contract columns from :func:`near_duplicates`."""
    return near_duplicates(docs, CONTRACT_PERCENT).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))) END AS x
  FROM d
), e AS (SELECT doc_id, len(x) AS n, unnest(x) AS t FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, m AS component_id, s.doc_id = m AS kept
FROM s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON s.doc_id = r.a
"""
