"""Dataset statistics: totals, partitions, and their upkeep by deltas.

Statistics are counters (k, v): `triples`, `entities`, `p:<iri>` for each predicate and `c:<iri>` for each class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_KNOWS = "http://xmlns.com/foaf/0.1/knows"
COUNT_CAP = 10_000


def void_totals(triples: DataFrame) -> DataFrame:
    """One row: triples, entities, classes, properties, documents."""
    classes = F.count_distinct(F.when((F.col("p") == _TYPE) & F.col("o_is_iri"), F.col("o")))
    return triples.agg(
        F.count("*").alias("triples"),
        F.count_distinct("webid").alias("entities"),
        classes.alias("classes"),
        F.count_distinct("p").alias("properties"),
    ).withColumn("documents", F.col("entities"))


def property_partition(triples: DataFrame) -> DataFrame:
    """(p, n): triples of each predicate."""
    return triples.groupBy("p").agg(F.count("*").alias("n"))


def class_partition(triples: DataFrame) -> DataFrame:
    """(o, n): entities of each class, distinct within each person and then summed over people."""
    typed = triples.filter((F.col("p") == _TYPE) & F.col("o_is_iri")).select("webid", "s", "o").distinct()
    return typed.groupBy("o").agg(F.count("*").alias("n"))


def partition_rank(partition: DataFrame, key: str = "p") -> DataFrame:
    """A partition by count, largest first, ties by IRI."""
    return partition.orderBy(F.desc("n"), F.asc(key))


def contributions(triples: DataFrame) -> DataFrame:
    """(k, v) of the counters of ``triples``: the statistics computed from nothing.

    Rows are counted by predicate alone, people and typed subjects by their distinct members, so each aggregation reads and shuffles only the columns
    that it counts, and no triple is laid down more than once.
    """
    typed = triples.filter((F.col("p") == _TYPE) & F.col("o_is_iri"))
    by_predicate = triples.groupBy("p").agg(F.count("*").alias("v"))
    rows = by_predicate.select(F.inline(F.array(F.struct(F.concat(F.lit("p:"), "p").alias("k"), "v"), F.struct(F.lit("triples").alias("k"), "v")))).groupBy("k").agg(F.sum("v").alias("v"))
    people = triples.select("webid").distinct().filter("webid IS NOT NULL").agg(F.count("*").alias("v")).filter("v > 0").select(F.lit("entities").alias("k"), "v")
    classes = typed.select("o", "webid", "s").distinct().groupBy(F.concat(F.lit("c:"), "o").alias("k")).agg(F.count("*").alias("v"))
    return rows.union(people).union(classes)


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(k, v): change of each counter from ``old`` triples to ``new`` ones; what does not change is left out."""
    signed = contributions(new).union(contributions(old).select("k", (-F.col("v")).alias("v")))
    return signed.groupBy("k").agg(F.sum("v").alias("v")).filter("v != 0")


def apply(stats: DataFrame, change: DataFrame) -> DataFrame:
    """Statistics after a change, never below 0; counters at 0 stay and are hidden on reading."""
    moved = change.select("k", F.col("v").alias("d"))
    return stats.join(moved, "k", "full_outer").select(
        "k", F.greatest(F.lit(0), F.coalesce("v", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("v")
    )


def visible(stats: DataFrame) -> DataFrame:
    return stats.filter("v > 0")


def predicate_cardinality(stats: DataFrame, predicates: DataFrame) -> DataFrame:
    """``predicates`` (p) with the counter n of each, 0 where there is none."""
    return predicates.join(stats, F.concat(F.lit("p:"), "p") == F.col("k"), "left").select("p", F.coalesce("v", F.lit(0)).alias("n"))


def bounded_count(rows: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """One row: n, the number of rows, counted up to ``cap``. The scan stops there, as the limit is the feature."""
    return rows.limit(cap).agg(F.count("*").alias("n"))


def linkset_size(partition: DataFrame) -> DataFrame:
    """One row: number of links between people."""
    return partition.filter(F.col("p") == _KNOWS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


def health(totals: DataFrame, queued: DataFrame) -> DataFrame:
    """One row: entries, triples, queue depth and status."""
    both = totals.select(F.lit(1).alias("one"), "entities", "triples").join(queued.select(F.lit(1).alias("one"), "n"), "one")
    status = F.when(F.col("entities") > 0, F.lit("ok")).otherwise(F.lit("empty"))
    return both.select(F.col("entities").alias("entries"), "triples", F.col("n").alias("queued"), status.alias("status"))
