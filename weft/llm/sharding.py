"""Sharding by longest-processing-time scheduling.

Groups that must stay together (rows with equal texts) are scheduled by size, the largest
first, each to the least-loaded shard, which a heap gives. Groups of one size are dealt as a counted run: the heap's
choices repeat in rounds there, so the driver sees sizes and their counts, and returns for each size in which order its groups take
the shards. Every group gets the shard that scheduling all groups one by one would give it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut

SHARDS = 8
#: Rows that one task numbers, about.
ROWS_PER_PART = 20_000


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Longest-processing-time first over classes (size, number of groups), sizes falling: runs (size, first, end, order).

    The groups of a size that are number ``first`` to ``end - 1`` among them take the shards in ``order`` in turn. Ties in load go by shard.

    With groups of one size every shard's load climbs in steps of it, and the heap gives the shards by load: in each round each shard once, those only that the
    round's loads have reached. A run ends where another shard is reached. Whole rounds are added at once, the last ones go through the heap.
    """
    heap = [(0, shard) for shard in range(shards)]
    for size, count in classes:
        low = heap[0][0]
        ahead = {shard: divmod(load - low, size) for load, shard in heap}  # rounds that a shard waits, place in a round
        first, at = 0, 0
        reached: list[int] = []
        waits = sorted({wait for wait, _ in ahead.values()})
        for n, wait in enumerate(waits):
            reached = sorted((s for s in ahead if ahead[s][0] <= wait), key=lambda s: (ahead[s][1], s))
            rounds = waits[n + 1] - wait if n + 1 < len(waits) else count
            end = min(count, first + rounds * len(reached))
            yield size, first, end, reached[: end - first]
            at = wait + (end - first) // len(reached)
            first = end
            if end == count:
                break
        loads = {shard: load + max(0, at - ahead[shard][0]) * size for load, shard in heap}
        left = count - sum(max(0, at - wait) for wait, _ in ahead.values())
        heap = [(load, shard) for shard, load in loads.items()]
        heapq.heapify(heap)
        for _ in range(left):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def assign_shards(docs: DataFrame, group: str, size: str, shards: int = SHARDS, into: str = "shard") -> DataFrame:
    """``docs`` with int column ``into``, 0 to ``shards - 1``: sums of ``size`` are near equal and rows with
    equal ``group`` share a shard. ``group`` is a string key; a null group is one group like any other, and
    a null size counts 0, as a negative one does; groups of size 0 are in shard 0. An empty table gives no rows. A group larger than an even shard
    stays whole. Groups of one size are taken in the order of a hash of their key.

    The driver holds a row for each distinct size, never groups; groups of a size are numbered in parts of about ROWS_PER_PART.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(group), F.lit(""))
    weight = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    groups = cut(docs.groupBy(key.alias("__g")).agg(F.sum(weight).alias("__size")))
    classes = cut(groups.filter("__size > 0").groupBy("__size").agg(F.count("*").alias("n")))
    falling = classes.orderBy(F.desc("__size")).toLocalIterator(prefetchPartitions=True)
    runs = list(schedule(((r["__size"], r["n"]) for r in falling), shards))
    lookup = _few(cut(spark.createDataFrame(runs or [(0, 0, 0, [0])], "__s long, __first long, __end long, __order array<int>")))
    # A part is a range of the hash, so that parts in order are the groups in order.
    share = F.shiftrightunsigned(F.xxhash64("__g"), 11) / F.lit(float(1 << 53))
    parts = F.ceil(F.col("n") / ROWS_PER_PART)
    dealt = groups.join(_few(classes), "__size").withColumn("__part", F.floor(share * parts).cast("int")).drop("n")
    counts = dealt.groupBy("__size", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("__size", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__size", "__part").orderBy(F.shiftrightunsigned(F.xxhash64("__g"), 11), "__g"))
    ranked = dealt.withColumn("__own", own).join(firsts, ["__size", "__part"]).withColumn("__n", F.col("__before") + F.col("__own") - 1)
    inside = (F.col("__size") == F.col("__s")) & (F.col("__n") >= F.col("__first")) & (F.col("__n") < F.col("__end"))
    turn = F.element_at("__order", ((F.col("__n") - F.col("__first")) % F.size("__order") + 1).cast("int"))
    placed = ranked.join(lookup, inside).select("__g", turn.alias("__shard"))
    # Cut, so that the join below shuffles both sides and adaptive execution can split a group of very many rows.
    placed = cut(placed)
    joined = docs.drop(into).withColumn("__key", key).join(placed, F.col("__key") == F.col("__g"), "left")
    return joined.withColumn(into, F.coalesce("__shard", F.lit(0))).drop("__key", "__g", "__shard")


def number_slots(rows: DataFrame, shard: str, order: list[str], count: int, into: str = "slot") -> DataFrame:
    """``rows`` with long column ``into``: 0, 1, 2 ... within each ``shard``, without a gap.

    A shard is cut by hash of the order columns into parts that single tasks number; the parts' counts,
    a few values a part, give each part's first slot. A part that equal rows have made large is cut again by the rows' places in the table. Rows equal in all of
    ``order`` get different slots in either order.
    """
    parts = max(1, min(1 << 16, -(-count // ROWS_PER_PART)))
    rows = cut(rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")).withColumn("__row", F.monotonically_increasing_id()))
    large = cut(rows.groupBy(shard, "__part").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * ROWS_PER_PART))
    pieces = large.select(F.col(shard).alias("__s"), F.col("__part").alias("__p"), F.ceil(F.col("n") / ROWS_PER_PART).alias("__pieces"))
    piece = F.when(F.col("__pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("__row"), F.col("__pieces")).cast("int"))
    same = (F.col(shard) == F.col("__s")) & (F.col("__part") == F.col("__p"))
    rows = rows.join(_few(pieces), same, "left").withColumn("__piece", piece).drop("__s", "__p", "__pieces")
    keys = [shard, "__part", "__piece"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("__part", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(k).alias(f"__of{n}") for n, k in enumerate(keys)], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "__row")) - 1
    on = [F.col(k) == F.col(f"__of{n}") for n, k in enumerate(keys)]
    joined = rows.withColumn("__n", own).join(first, on).withColumn(into, (F.col("__first") + F.col("__n")).cast("long"))
    return joined.drop("__part", "__piece", "__row", "__first", "__n", *[f"__of{n}" for n in range(len(keys))])


def op3(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) in shards of near equal bytes; rows with equal texts, and
    null with empty ones, stay together. Repeated rows each get a slot."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("group"),
        )
    )
    placed = assign_shards(rows, "group", "size", shards)
    out = number_slots(placed, "shard", ["doc_id", "text_crc32", "size"], rows.count())
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
