"""Tombstone gates: what belongs to erased people is hidden everywhere.

A person has two keys, the WebID and the document url. A gate on both is two equi-joins; one join on either key
would be a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.tables import cut

#: Keys are broadcast up to this many rows and bytes; beyond either the joins shuffle.
BROADCAST_KEYS, BROADCAST_BYTES = 100_000, 16 << 20
#: Hashes of keys are broadcast up to this many.
BROADCAST_HASHES = 1_000_000


def gate_keys(tombstones: DataFrame, docs: DataFrame) -> DataFrame:
    """(webid, doc_url) of permanent tombstones and of documents in tombstone state, each once."""
    return tombstones.select("webid", "doc_url").union(docs.filter("state = 'tombstone'").select("webid", "doc_url")).distinct()


def small(keys: DataFrame, most: int = BROADCAST_KEYS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Narrow rows of strings with a broadcast hint if they are few and short enough; otherwise Spark joins by shuffle."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns), F.lit(16))
    n, total = keys.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(keys) if n <= most and total <= most_bytes else keys


def _people(gate: DataFrame) -> DataFrame:
    return small(gate.select("webid").distinct())


def _without_subjects(triples: DataFrame, people: DataFrame) -> DataFrame:
    return triples.join(people, "webid", "left_anti")


def _without_objects(triples: DataFrame, people: DataFrame) -> DataFrame:
    keys = people.select(F.col("webid").alias("gated"))
    return triples.join(keys, (F.col("o") == F.col("gated")) & F.col("o_is_iri"), "left_anti")


def gate_subject(triples: DataFrame, gate: DataFrame) -> DataFrame:
    """Triples whose owner is not gated; a null owner passes."""
    return _without_subjects(triples, _people(gate))


def gate_object(triples: DataFrame, gate: DataFrame) -> DataFrame:
    """Triples whose IRI object is no gated person; literals pass."""
    return _without_objects(triples, _people(gate))


def served(triples: DataFrame, gate: DataFrame) -> DataFrame:
    """Triples that may be shown. The gated people are written once, as they are asked for twice."""
    people = small(cut(gate.select("webid").distinct()))
    return _without_objects(_without_subjects(triples, people), people)


def gate_variant_key(people: DataFrame, gate: DataFrame) -> DataFrame:
    """``people`` (webid, doc_url, ...) with flag ``gated``: is either key gated?"""
    by_webid = gate.select("webid", F.lit(True).alias("g1")).filter("webid IS NOT NULL").distinct()
    by_doc = gate.select("doc_url", F.lit(True).alias("g2")).filter("doc_url IS NOT NULL").distinct()
    both = people.join(small(by_webid), "webid", "left").join(small(by_doc), "doc_url", "left")
    return both.withColumn("gated", F.coalesce("g1", "g2", F.lit(False))).drop("g1", "g2")


def open_only(people: DataFrame, gate: DataFrame) -> DataFrame:
    """``people`` without those gated by either key."""
    kept = people.join(small(gate.select("webid").filter("webid IS NOT NULL").distinct()), "webid", "left_anti")
    return kept.join(small(gate.select("doc_url").filter("doc_url IS NOT NULL").distinct()), "doc_url", "left_anti")


def tombstoned_subset(people: DataFrame, gate: DataFrame) -> DataFrame:
    """Those of ``people`` (webid) that are gated."""
    return people.join(small(gate.select("webid").distinct()), "webid", "left_semi")


def _hash(key: str) -> Column:
    return F.xxhash64(key)


def unhidden(docs: DataFrame, hidden: DataFrame) -> DataFrame:
    """Wide rows ``docs`` (doc_url, ...) whose url is not among ``hidden`` (doc_url); a null url passes.

    More urls than are broadcast as they are become 64-bit hashes, so that up to ``BROADCAST_HASHES`` of them move no row of ``docs``. A hash that some other url of ``docs`` has too is not used:
    its urls are compared themselves.
    """
    urls = cut(hidden.select("doc_url").filter("doc_url IS NOT NULL").distinct())
    if urls.count() <= BROADCAST_KEYS:
        return docs.join(small(urls), "doc_url", "left_anti")
    most = {"most": BROADCAST_HASHES, "most_bytes": BROADCAST_HASHES * 36}  # a hash has up to 20 characters, and small() counts 16 bytes more
    hashed = urls.select("doc_url", _hash("doc_url").alias("__hash"))
    same = docs.select("doc_url", _hash("doc_url").alias("__hash")).join(small(hashed.select("__hash").distinct(), **most), "__hash", "left_semi")
    shared = small(cut(same.join(urls, "doc_url", "left_anti").select("__hash").distinct()))
    own = small(cut(hashed.join(shared, "__hash", "left_anti").select("__hash").distinct()), **most)
    kept = docs.withColumn("__hash", _hash("doc_url")).join(own, "__hash", "left_anti").drop("__hash")
    return kept.join(small(hashed.join(shared, "__hash", "left_semi").select("doc_url")), "doc_url", "left_anti")
