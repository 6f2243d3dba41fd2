"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles of five words. Sketches of
parts merge into the sketch of the whole; two sketches estimate resemblance and containment, and one
the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from .common import spaced_words

WIDTH = 5
K = 256
#: Rows that one bucket of neighbouring doc_ids holds, about.
ROWS_PER_BUCKET = 2_000
_RANGE = float(2**64)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the runs of ``width`` words; a shorter text's whole sequence is one; no words give none."""
    words = F.transform(spaced_words(text), lambda w: F.xxhash64(w))

    def runs(w: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(width)])
        )
        one = F.array(F.aggregate(w, F.lit(7).cast("long"), lambda h, x: F.xxhash64(h, x)))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<long>"))

    # An array of one element binds the words, so that they are computed once.
    return F.flatten(F.transform(F.array(words), runs))


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Bottom-k sketch of a text; null and texts without words have the empty sketch."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in the union, 0 to 1; equal sketches give 1, also two empty ones."""
    union = merge(a, b, k)
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.transform(F.array(union), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))[0]
    )


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    width = F.element_at(a, -1).cast("double") + _RANGE / 2
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * _RANGE / width)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """Fingerprint as a string: base64 of the hashes, eight bytes each, ascending."""
    digits = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.regexp_replace(F.base64(F.unhex(digits)), "\\s", "")


def fingerprint(docs: DataFrame, text: str = "text", into: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """``docs`` with the sketch of each whole text in column ``into``, which is replaced if it exists."""
    return docs.withColumn(into, sketch(F.col(text), k, width))


def merge_parts(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each ``key`` from the sketches of its parts: (key, column).

    A part's hashes beyond the k-th of its key never matter, so a first round keeps k for each key and salt,
    and no task sees more than a salt's share of a hot key.
    """
    hashes = parts.select(key, F.explode(column).alias("h")).distinct()
    salted = Window.partitionBy(key, F.pmod("h", F.lit(64))).orderBy("h")
    own = Window.partitionBy(key).orderBy("h")
    few = hashes.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k).drop("n")
    kept = few.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k)
    return parts.select(key).distinct().join(
        kept.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column)), key, "left"
    ).withColumn(column, F.coalesce(column, F.array().cast("array<long>")))


def with_next(docs: DataFrame, order: str, columns: dict[str, str], tie: Column, prepare=None) -> DataFrame:
    """``docs`` with the next row's values by ascending ``order``, ties by ``tie``; the first row follows the last.

    columns: {existing column: name for the next row's value}. ``tie`` is a long, a hash. Rows go by one shuffle to buckets of neighbouring
    keys; each bucket also gets a copy of the first row of the next, so no order over all rows in
    one task is needed. A key of very many rows is cut into buckets by ranges of ``tie``. prepare(df) may add columns after the shuffle. Null keys come first.
    """
    count = docs.count()
    buckets = max(1, min(1 << 16, -(-count // ROWS_PER_BUCKET)))
    even = max(ROWS_PER_BUCKET, -(-count // buckets))
    large = {r[0]: -(-r["n"] // even) for r in docs.groupBy(order).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * even).collect()}
    # A large key, of which there are fewer than buckets, is a cut and so the last of its bucket.
    cuts = sorted({*_cuts(docs, order, buckets, count), *(k for k in large if k is not None)})
    docs = docs.withColumn("__bucket", _bucket(F.col(order), cuts))
    kind = docs.schema[order].dataType.simpleString()
    sizes = docs.sparkSession.createDataFrame(list(large.items()), f"__large {kind}, __pieces long")
    share = (F.shiftright(tie, 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))
    piece = F.when(F.col("__pieces").isNull(), 0).otherwise(1 + F.least(F.floor(share * F.col("__pieces")), F.col("__pieces") - 1))
    docs = docs.join(F.broadcast(sizes), F.col(order).eqNullSafe(F.col("__large")), "left")
    docs = docs.withColumn("__bucket", F.col("__bucket") * F.lit(1 << 32) + piece).drop("__large", "__pieces")
    heads = docs.groupBy("__bucket").agg(F.min(F.struct(F.col(order).isNotNull(), F.col(order), tie)).alias("head"))
    known = sorted((r["__bucket"], *r["head"][1:]) for r in heads.collect())  # one row for each bucket
    spark = docs.sparkSession
    to = {b: known[i - 1][0] for i, (b, *_) in enumerate(known)}
    rows = [(b, to[b], k, t) for b, k, t in known]
    kinds = dict(docs.select(F.col(order).alias("key"), tie.alias("tie")).dtypes)
    head = spark.createDataFrame(rows, f"__bucket long, __to long, __key {kinds['key']}, __tie {kinds['tie']}")
    marked = docs.withColumn("__tie_of", tie).join(F.broadcast(head), "__bucket", "left")
    first = F.col(order).eqNullSafe(F.col("__key")) & F.col("__tie_of").eqNullSafe(F.col("__tie"))
    places = F.when(
        first, F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("copy")), F.struct(F.col("__to").alias("b"), F.lit(1).alias("copy")))
    ).otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("copy"))))
    dealt = (
        marked.withColumn("__place", F.explode(places))
        .withColumn("__bucket", F.col("__place.b"))
        .withColumn("__copy", F.col("__place.copy"))
        .drop("__place", "__to", "__key", "__tie")
        .repartition("__bucket")
    )
    if prepare:
        dealt = prepare(dealt)
    near = Window.partitionBy("__bucket").orderBy("__copy", F.col(order).asc_nulls_first(), "__tie_of")
    for a, b in columns.items():
        dealt = dealt.withColumn(b, F.lead(a).over(near))
    return dealt.filter("__copy = 0").drop("__bucket", "__copy", "__tie_of")


def _cuts(docs: DataFrame, order: str, buckets: int, count: int) -> list:
    """Ascending keys between buckets of about even rows; any keys would do."""
    if buckets < 2:
        return []
    if isinstance(docs.schema[order].dataType, NumericType):
        found = docs.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.2 / buckets)
        return sorted({int(c) for c in found})
    some = sorted(r[0] for r in docs.select(order).dropna().sample(min(1.0, 20 * buckets / count), seed=1).collect())
    return sorted({some[len(some) * i // buckets] for i in range(1, buckets)}) if some else []


def _bucket(key: Column, cuts: list, block: int = 256) -> Column:
    """1 and the number of cuts below the key: first the block of cuts, then the place in it. Null keys are in bucket 0."""
    if not cuts:
        return F.when(key.isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
    blocks = [cuts[i : i + block] for i in range(0, len(cuts), block)]
    below = lambda marks: F.size(F.filter(marks, lambda c: c < key))
    at = below(F.lit([b[-1] for b in blocks]))
    inner = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.least(at, F.lit(len(blocks) - 1)) + 1)
    place = F.when(at == len(blocks), F.lit(len(cuts))).otherwise(at * block + below(inner))
    return F.when(key.isNull(), F.lit(0)).otherwise(place + 1).cast("long")


def op2(docs: DataFrame) -> DataFrame:
    """Contract columns for every row of ``docs`` (doc_id, text). A null text is empty. Rows that repeat a
    doc_id are ordered by their text's hash; a single row is its own next. Equal sketches count as likeness 1."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prepare = lambda df: fingerprint(df)
    near = with_next(rows, "doc_id", {"text": "next_text", "sketch": "next_sketch"}, F.xxhash64("text"), prepare)
    n = F.char_length("text")
    moved = F.floor(n / 4).cast("int")
    edited = near.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next_text", F.lit(1), moved))
    )
    done = edited.withColumn("edited_sketch", sketch(F.col("edited")))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles_estimate"),
    )
