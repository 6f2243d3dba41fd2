"""Ranked text search over a weighted inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators import query_sets
from weft.operators.gates import small, unhidden
from weft.operators.tables import cut

#: English words that are not indexed.
STOP_WORDS = """a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so that the
their them then there these they this to was we were what when which who will with you your""".split()
LABEL_WEIGHT, BODY_WEIGHT = 10.0, 1.0
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-case [a-z0-9] words without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def _words_of(docs: DataFrame) -> DataFrame:
    """(doc_url, term, l, b) for each word of documents (doc_url, label, body)."""
    one = lambda column, l, b: F.transform(terms(F.col(column)), lambda w: F.struct(w.alias("term"), F.lit(l).alias("l"), F.lit(b).alias("b")))  # noqa: E731, E741
    return docs.select("doc_url", F.inline(F.concat(one("label", 1, 0), one("body", 0, 1))))


def _counted(words: DataFrame) -> DataFrame:
    return words.groupBy("term", "doc_url").agg(F.sum("l").alias("label_tf"), F.sum("b").alias("body_tf"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_url, label_tf, body_tf) of documents (doc_url, label, body), which are read once. Store it partitioned by a hash of the term."""
    return _counted(_words_of(docs))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_url, n): indexed words of each document."""
    return docs.select("doc_url", (F.size(terms(F.col("label"))) + F.size(terms(F.col("body")))).alias("n"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms) of queries (query_id, words): each distinct term once."""
    each = queries.select("query_id", F.array_distinct("words").alias("words"))
    return each.select("query_id", F.explode("words").alias("term"), F.size("words").alias("n_terms"))


def _met(queries: DataFrame, index: DataFrame, hidden: DataFrame | None) -> DataFrame:
    """Postings of the queries' terms, without those of documents ``hidden`` (doc_url)."""
    met = query_terms(queries).join(index, "term")
    return met.join(small(hidden.select("doc_url").distinct()), "doc_url", "left_anti") if hidden is not None else met


def match(queries: DataFrame, index: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_url) of documents that hold all of a query's terms and are not ``hidden`` (doc_url); a query without terms matches nothing."""
    found = _met(queries, index, hidden).groupBy("query_id", "n_terms", "doc_url").agg(F.count("*").alias("n"))
    return found.filter("n = n_terms").select("query_id", "doc_url")


def rank(queries: DataFrame, index: DataFrame, sizes: DataFrame, label_weight: float = LABEL_WEIGHT, hidden: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_url, rank): BM25 of weighted term counts, to six decimals, of documents that hold all terms and are not ``hidden``.

    A term's frequency is that in the whole index.
    """
    docs, mean = sizes.agg(F.count("*"), F.avg("n")).first()  # two numbers
    df = index.join(small(query_terms(queries).select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    met = _met(queries, index, hidden).join(df, "term").join(sizes, "doc_url")
    tf = label_weight * F.col("label_tf") + BODY_WEIGHT * F.col("body_tf")
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(mean or 1.0)))
    kept = met.groupBy("query_id", "n_terms", "doc_url").agg(F.count("*").alias("k"), F.round(F.sum(score), 6).alias("rank"))
    return kept.filter("k = n_terms").select("query_id", "doc_url", "rank")


def page(ranked: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """First ``size`` + 1 hits by falling rank, ties by url, after a cursor (rank, doc_url)."""
    if after:
        ranked = ranked.filter((F.col("rank") < after[0]) | ((F.col("rank") == after[0]) & (F.col("doc_url") > after[1])))
    return ranked.orderBy(F.desc("rank"), F.asc("doc_url")).limit(size + 1)


def top(ranked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), F.asc("doc_url"))
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


#: Sets of words that are broadcast at once.
SETS_AT_ONCE = 100_000


def bulk(queries: DataFrame, docs: DataFrame, k: int, label_weight: float = LABEL_WEIGHT, hidden: DataFrame | None = None, at_once: int = SETS_AT_ONCE) -> DataFrame:
    """(query_id, doc_url, rank, place): the ``k`` best of ``docs`` (doc_url, label, body; one row for a url) for each of very many queries, the same as :func:`top` of :func:`rank`.

    Queries of the same words are one set. Sets are broadcast, and a task matches all of them with a block of documents at once (:mod:`weft.operators.query_sets`), so neither texts nor postings
    are shuffled: only the sets' own words are counted, a block in which a set could not better its ``k`` best so far is passed over for it, and each task passes on its ``k`` best for a set.
    The documents are read twice for each ``at_once`` sets, first to count in how many of them each word is.
    """
    asked = cut(queries.select("query_id", F.array_sort(F.array_distinct("words")).alias("words")).filter("size(words) > 0"))
    sets = cut(asked.select("words").distinct().select("words", F.monotonically_increasing_id().alias("set"), F.xxhash64("words").alias("part")))
    texts = docs.select("doc_url", *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("label", "body")))
    shown = unhidden(texts, hidden) if hidden is not None else texts
    parts = max(1, -(-sets.count() // at_once))
    found = None
    for part in range(parts):
        scored = top(_best_of(sets.filter(F.pmod("part", F.lit(parts)) == part), texts, shown, k, label_weight), k)
        found = scored if found is None else found.union(scored)
    named = asked.join(sets.select("words", "set"), "words").select("query_id", "set")
    return named.join(found.withColumnRenamed("query_id", "set"), "set").select("query_id", "doc_url", "rank", "place")


def _best_of(sets: DataFrame, texts: DataFrame, shown: DataFrame, k: int, label_weight: float) -> DataFrame:
    """(query_id, doc_url, rank) of the ``k`` best in each task of ``shown`` for ``sets`` (set, words), whose words are counted in ``texts``; both lower-cased."""
    asked = sets.select("set", "words").toArrow()  # at most as many as are broadcast at once
    ids, words = asked["set"].to_numpy(), asked["words"].combine_chunks()
    stop_words, vocabulary = pa.array(STOP_WORDS), words.flatten().unique().drop_null()
    vocabulary = vocabulary.filter(pc.invert(pc.is_in(vocabulary, stop_words)))
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
    context = texts.sparkSession.sparkContext
    known = context.broadcast((vocabulary, stop_words))
    counted = texts.select("label", "body", F.lit(None).cast("string").alias("doc_url")).mapInArrow(lambda batches: query_sets.count(batches, *known.value), "term int, df long, n long")
    counts = cut(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")))
    number, length = counts.filter("term = -1").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()  # two numbers
    idf = F.log(1 + (number - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    rarity = counts.filter("term >= 0").select("term", "df", idf).toArrow()  # a row for each word of the vocabulary
    df, rare = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary))
    df[rarity["term"].to_numpy()], rare[rarity["term"].to_numpy()] = rarity["df"].to_numpy(), rarity["idf"].to_numpy()
    arranged = context.broadcast(query_sets.arrange(ids, words, vocabulary, df, rare))
    scoring = query_sets.Scoring(length / number if number else 1.0, label_weight, BODY_WEIGHT, K1, B)
    found = shown.mapInArrow(lambda batches: query_sets.best(batches, arranged.value, known.value[1], scoring, k), "set long, doc_url string, rank double")
    return found.withColumnRenamed("set", "query_id")
