"""Filling in what older snapshots lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.urls import slug
from weft.operators.triples import from_ntriples, indexable


def backfill(docs: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, rejected lines) of served documents (doc_url, webid, state, body) that have no triples yet.

    A line that is no statement goes to the rejects and does not stop the rest of its document.
    """
    lacking = docs.filter("state = 'done'").join(triples.select("webid").distinct(), "webid", "left_anti")
    parsed = from_ntriples(lacking.select("doc_url", "webid", "body"))
    rejected = parsed.filter("p IS NULL").select("doc_url", "line")
    return indexable(parsed).select("s", "p", "o", "o_is_iri", "webid", "doc_url"), rejected


def backfill_slugs(people: DataFrame) -> DataFrame:
    """``people`` (webid, slug, ...) with the missing slugs filled in."""
    return people.withColumn("slug", F.coalesce("slug", slug(F.col("webid"))))
