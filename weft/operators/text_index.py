"""A stored index of weighted words, read by its buckets and skipped by its blocks.

Postings are written once, in folders by a hash of the term. Documents are dealt into slices by a hash of their url, and a block holds the postings of one term in
one slice with the greatest part that a document of it can add to a score. A query reads the folders of its terms, finds from the blocks' heads alone in which slices all its
terms occur and how good a document there can be at most, and opens only blocks of slices that can matter.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from weft.operators.gates import small
from weft.operators.search import B, BODY_WEIGHT, K1, LABEL_WEIGHT, query_terms, terms, top
from weft.operators.tables import checkpoint_dir, cut

#: Documents of a slice and words of a folder, about.
SLICE_DOCS, BUCKET_WORDS = 1024, 6_000_000
#: Slices that one task indexes, and slices whose blocks of one folder one task writes.
TASK_SLICES, GROUP_SLICES = 2, 512
#: Fewer folders than this are not made.
LEAST_BUCKETS = 16
#: Up to this many terms are asked for by name, so that the scan itself skips the others.
NAMED_TERMS = 1_000
#: Blocks of a query that are opened first, by their bound, to find what the last of its best documents scores at least.
FIRST_SLICES = 4


_MADE = "term string, slice int, n long, most double, plain double, doc_url array<string>, label_tf array<int>, body_tf array<int>, words array<int>"
_BLOCKS = f"{_MADE}, bucket int"
_POSTINGS = ["doc_url", "label_tf", "body_tf", "words"]


class TextIndex(NamedTuple):
    """A complete index in ``folder``: documents, their mean number of words, and the number of folders."""

    spark: SparkSession
    folder: str
    docs: int
    mean: float
    buckets: int

    def blocks(self, asked: DataFrame) -> DataFrame:
        """Blocks (term, slice, n, most, plain, and its postings' columns as arrays) of the terms ``asked`` (term)."""
        blocks = self.spark.read.schema(_BLOCKS).parquet(f"{self.folder}/blocks")
        wanted = asked.select("term").distinct()
        named = [r.term for r in wanted.limit(NAMED_TERMS + 1).collect()]
        if len(named) <= NAMED_TERMS:
            numbers = self.spark.createDataFrame([(t,) for t in named], "term string").select(_bucket(F.col("term"), self.buckets)).distinct().collect()
            return blocks.filter(F.col("bucket").isin([r[0] for r in numbers]) & F.col("term").isin(named)).drop("bucket")
        keys = wanted.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        return blocks.join(small(keys), ["bucket", "term"]).drop("bucket")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _part(label_weight: float, mean: float, label_tf, body_tf, words):
    """What a posting adds to a score, but for its term's rarity; of columns or of arrays."""
    tf = label_weight * label_tf + BODY_WEIGHT * body_tf
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * words / (mean or 1.0)))


def _slice_blocks(mean: float):
    """Blocks of the documents (slice, doc_url, words, label, body) of one slice, whose words are split already."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(_MADE))

    def run(docs: pa.Table) -> pa.Table:
        urls = docs["doc_url"].combine_chunks().dictionary_encode("encode")
        order = pc.sort_indices(urls.dictionary, null_placement="at_start")
        place = np.argsort(order.to_numpy())
        words = docs["words"].to_numpy().astype(np.int64)
        # Documents are numbered by url and words; rows that are equal in both are one.
        width = int(words.max()) + 1
        known, doc = np.unique(place[urls.indices.to_numpy()] * width + words, return_inverse=True)
        each = [docs[name].combine_chunks() for name in ("label", "body")]
        own = np.concatenate([np.repeat(doc, pc.list_value_length(a).to_numpy(zero_copy_only=False)) for a in each])
        flat = [a.flatten() for a in each]
        found = pa.concat_arrays(flat).dictionary_encode()
        if not len(found):
            return schema.empty_table()
        key = (found.indices.to_numpy().astype(np.int64) * len(known) + own) * 2
        key[len(flat[0]) :] += 1
        key.sort()
        pair = key >> 1
        at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        body = np.add.reduceat(key & 1, at)
        label = np.diff(at, append=len(key)) - body
        term, doc = np.divmod(pair[at], len(known))
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        size = known[doc] % width
        ends = pa.array(np.append(first, len(term)).astype(np.int32))
        most, plain = (np.maximum.reduceat(_part(weight, mean, label, body, size), first) for weight in (LABEL_WEIGHT, 0.0))
        named = urls.dictionary.take(order.take(pa.array(known // width))).take(pa.array(doc))
        lists = [pa.ListArray.from_arrays(ends, a) for a in (named, *(pa.array(n.astype(np.int32)) for n in (label, body, size)))]
        n = np.diff(first, append=len(term))
        columns = [found.dictionary, pa.array(np.full(len(n), docs["slice"][0].as_py(), np.int32)), pa.array(n), pa.array(most), pa.array(plain), *lists]
        return pa.Table.from_arrays(columns, schema.names).cast(schema)

    return run


def _split(docs: DataFrame) -> DataFrame:
    """``docs`` with label and body as arrays of their words, and how many ``words`` these are."""
    split = docs.withColumns({"label": terms(F.col("label")), "body": terms(F.col("body"))})
    return split.withColumn("words", F.size("label") + F.size("body"))


def _blocks_of(docs: DataFrame, slices: int, mean: float) -> DataFrame:
    """Blocks of documents (doc_url, label, body) in so many slices. Texts are dealt by their slice, and a slice's words are counted together: no word becomes a row of its own."""
    dealt = docs.select("doc_url", "label", "body", F.pmod(F.xxhash64("doc_url"), F.lit(slices)).cast("int").alias("slice"))
    # As many tasks as slices ask for: hashes of few slices would leave some tasks with several times as many as others.
    dealt = dealt.repartitionById(max(1, -(-slices // TASK_SLICES)), F.col("slice"))
    return _split(dealt).groupBy("slice").applyInArrow(_slice_blocks(mean), _MADE)


def build(docs: DataFrame, folder: str) -> TextIndex:
    """Index documents (doc_url, label, body) in ``folder``, replacing what is there. Rows that repeat a doc_url with as many words are one document.

    A first reading counts documents and words. In the second, texts are dealt by their slice, so that words are counted and blocks are made where the texts lie, and only finished
    blocks move on, by folder and group of slices. The head is written last, so an index that was not finished has none.
    """
    spark = docs.sparkSession
    each = _split(docs).select("doc_url", "words").distinct()
    whole, length = each.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean, buckets, slices = length / whole if whole else 0.0, max(LEAST_BUCKETS, -(-length // BUCKET_WORDS)), max(1, -(-whole // SLICE_DOCS))
    blocks = _blocks_of(docs, slices, mean).withColumn("bucket", _bucket(F.col("term"), buckets))
    placed = blocks.repartition(F.col("bucket"), F.floor(F.col("slice") / GROUP_SLICES)).sortWithinPartitions("bucket", "term", "slice")
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/blocks")
    spark.createDataFrame([(whole, mean, buckets)], "docs long, mean double, buckets long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/head")
    return TextIndex(spark, folder, whole, mean, buckets)


def stored(docs: DataFrame, version: str) -> TextIndex:
    """The index of ``docs``, kept in the shared folder for later queries and sessions, made anew when the files behind ``docs`` or ``version`` have changed."""
    spark = docs.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    told = [version]
    for name in sorted(docs.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    folder = f"{checkpoint_dir(spark)}/text-index-{hashlib.sha256('\n'.join(told).encode()).hexdigest()[:32]}"
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/head/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        return build(docs, folder)
    return TextIndex(spark, folder, *spark.read.parquet(f"{folder}/head").first())


def _asked(queries: DataFrame, index: TextIndex, label_weight: float) -> DataFrame:
    """(query_id, n_terms, term, slice, idf, bound, postings) of blocks in slices that hold all terms of a query; the postings are read only where they are asked for."""
    wanted = query_terms(queries)
    blocks = index.blocks(wanted)
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    # A weight between 0 and the stored one is bounded by the greater of both bounds.
    bound = F.col("plain") if label_weight == 0 else F.greatest("most", "plain") if label_weight <= LABEL_WEIGHT else F.lit(K1 + 1)
    heads = wanted.join(df.select("term", idf), "term").join(blocks.select("term", "slice", bound.alias("part")), "term")
    held = heads.groupBy("query_id", "n_terms", "slice").agg(F.count("*").alias("k"), F.sum(F.col("idf") * F.col("part")).alias("bound"), F.collect_list(F.struct("term", "idf")).alias("terms"))
    return held.filter("k = n_terms").drop("k")


def _scored(slices: DataFrame, blocks: DataFrame, index: TextIndex, label_weight: float, hidden: DataFrame | None) -> DataFrame:
    """(query_id, doc_url, rank) of documents of ``slices`` (query_id, n_terms, slice, terms) that hold all terms."""
    each = slices.select("query_id", "n_terms", "slice", F.inline("terms"))
    met = each.join(blocks.select("term", "slice", *_POSTINGS), ["term", "slice"]).select("query_id", "n_terms", "idf", F.inline(F.arrays_zip(*_POSTINGS)))
    if hidden is not None:
        met = met.join(small(hidden.select("doc_url").distinct()), "doc_url", "left_anti")
    score = F.col("idf") * _part(label_weight, index.mean, F.col("label_tf"), F.col("body_tf"), F.col("words"))
    kept = met.groupBy("query_id", "n_terms", "doc_url").agg(F.count("*").alias("k"), F.round(F.sum(score), 6).alias("rank"))
    return kept.filter("k = n_terms").select("query_id", "doc_url", "rank")


def rank(queries: DataFrame, index: TextIndex, label_weight: float = LABEL_WEIGHT, hidden: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_url, rank) as :func:`weft.operators.search.rank` gives for the same documents."""
    slices = _asked(queries, index, label_weight)
    return _scored(slices, index.blocks(query_terms(queries)), index, label_weight, hidden)


def match(queries: DataFrame, index: TextIndex, hidden: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_url) of documents that hold all terms."""
    return rank(queries, index, hidden=hidden).select("query_id", "doc_url")


def best(queries: DataFrame, index: TextIndex, k: int, label_weight: float = LABEL_WEIGHT, hidden: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_url, rank, place): the ``k`` best documents of each query, the same as of all ranked ones.

    The few slices of the highest bounds are opened first; a slice is then left closed if its bound is below the score that the query's k-th document there has.
    """
    blocks = index.blocks(query_terms(queries))
    slices = cut(_asked(queries, index, label_weight))
    first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "slice")
    slices = slices.withColumn("nth", F.row_number().over(first))
    early = _scored(slices.filter(F.col("nth") <= FIRST_SLICES), blocks, index, label_weight, hidden)
    least = top(early, k).filter(F.col("place") == k).select("query_id", F.col("rank").alias("least"))
    # Ranks are rounded, so a bound must be lower by more than that.
    open_ = slices.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5))
    return top(_scored(open_, blocks, index, label_weight, hidden), k)
