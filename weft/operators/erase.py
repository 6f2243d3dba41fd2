"""Erasure: challenges, tombstones, and the removal of people from every surface."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators import stats
from weft.operators.gates import small
from weft.operators.tables import Snapshots

DAY = 86_400_000


class Index(NamedTuple):
    """All tables of one snapshot. An erasure gives a new one, which a writer switches to at once."""

    docs: DataFrame
    triples: DataFrame
    stats: DataFrame
    tombstones: DataFrame
    inbox: DataFrame
    inbox_objects: DataFrame


def nonce_latest(events: DataFrame) -> DataFrame:
    """(webid, nonce_id, at_ms) of the newest challenge of each person (webid, event_id, at_ms, action)."""
    issued = events.filter("action = 'issue'")
    return issued.groupBy("webid").agg(F.max(F.struct("at_ms", "event_id")).alias("m")).select("webid", F.col("m.event_id").alias("nonce_id"), "m.at_ms")


def nonce_consume(events: DataFrame, ttl: int = DAY) -> DataFrame:
    """(event_id, webid, confirmed) of each confirmation: it counts if the newest challenge before it is not expired, and is the first to use it."""
    order = Window.partitionBy("webid").orderBy("at_ms", "event_id")
    issue = F.when(F.col("action") == "issue", F.struct("event_id", "at_ms"))
    last = F.last(issue, ignorenulls=True).over(order)
    seen = events.withColumn("issue", last).filter("action = 'confirm'")
    live = F.col("issue").isNotNull() & (F.col("at_ms") < F.col("issue.at_ms") + ttl)
    first = Window.partitionBy("webid", "issue.event_id").orderBy("at_ms", "event_id")
    return seen.withColumn("n", F.row_number().over(first)).select(
        "event_id", "webid", F.coalesce(live & (F.col("n") == 1), F.lit(False)).alias("confirmed")
    )


def challenge_confirm(nonces: DataFrame, triples: DataFrame, predicate: str) -> DataFrame:
    """Challenges (webid, nonce) whose person publishes the nonce as a literal of ``predicate``."""
    published = triples.filter((F.col("p") == predicate) & ~F.col("o_is_iri")).select(F.col("s").alias("webid"), F.col("o").alias("nonce"))
    return nonces.join(published, ["webid", "nonce"], "left_semi")


def tombstone_merge(existing: DataFrame, more: DataFrame) -> DataFrame:
    """Tombstones after repeated erasures: the first reason and proof stay, the document url is the latest."""
    columns = ["webid", "doc_url", "reason", "created_at", "proof"]
    both = existing.select(*columns).unionByName(more.select(*columns))
    return both.groupBy("webid").agg(
        F.max_by("doc_url", "created_at").alias("doc_url"),
        F.min_by("reason", "created_at").alias("reason"),
        F.min("created_at").alias("created_at"),
        F.min_by("proof", "created_at").alias("proof"),
    )


def projection_clear(triples: DataFrame, counters: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, statistics) without the projections of ``people`` (webid)."""
    names = small(people.select("webid").distinct())
    gone = triples.join(names, "webid", "left_semi")
    return triples.join(names, "webid", "left_anti"), stats.apply(counters, stats.delta(gone, gone.limit(0)))


def redact_docs(docs: DataFrame, people: DataFrame) -> DataFrame:
    """``docs`` with the documents of ``people`` (webid, doc_url), by either key, reduced to tombstones with key and slug; missing ones are added."""
    by_webid = people.select("webid", F.lit(True).alias("a")).distinct()
    by_doc = people.select("doc_url", F.lit(True).alias("b")).distinct()
    marked = docs.join(small(by_webid), "webid", "left").join(small(by_doc), "doc_url", "left")
    hit = F.coalesce("a", "b", F.lit(False))
    keep = {"doc_url", "slug", "state"}
    columns = [F.when(hit, F.lit("tombstone")).otherwise(F.col("state")).alias("state") if c == "state" else F.col(c) if c in keep
               else F.when(~hit, F.col(c)).alias(c) for c in docs.columns]
    missing = people.select("doc_url").distinct().join(docs.select("doc_url"), "doc_url", "left_anti").withColumn("state", F.lit("tombstone"))
    return marked.select(*columns).unionByName(missing, allowMissingColumns=True)


def inbox_redact(inbox: DataFrame, objects: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notifications, objects): bodies of notifications (id, body) that name one of ``people`` blanked, and those objects (id, object) dropped."""
    keys = small(people.select(F.col("webid").alias("object")).union(people.select("doc_url")).distinct())
    named = objects.join(keys, "object", "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    blank = inbox.join(named, "id", "left").withColumn("body", F.when(F.col("hit"), F.lit("")).otherwise(F.col("body")))
    return blank.withColumn("redacted", F.coalesce("hit", F.lit(False))).drop("hit"), objects.join(keys, "object", "left_anti")


def erase(index: Index, people: DataFrame) -> Index:
    """The index after ``people`` (webid, doc_url, reason, created_at, proof) are erased for good from every table. Doing it twice changes nothing.

    Whoever else is projected from their documents loses those triples too, but has no tombstone.
    """
    others = projected_from(index.triples, people)
    kept, counters = projection_clear(index.triples, index.stats, people.select("webid").union(others))
    inbox, objects = inbox_redact(index.inbox, index.inbox_objects, people)
    return Index(redact_docs(index.docs, people), kept, counters, tombstone_merge(index.tombstones, people), inbox, objects)


def erase_stored(snapshots: Snapshots, people: DataFrame) -> Index:
    """Erase ``people`` from the newest snapshot of an index: all six tables change at once for its readers, or none does."""
    version = snapshots.version()
    after = erase(Index(**snapshots.read(version)), people)
    return Index(**snapshots.read(snapshots.commit(after._asdict(), version)))


def projected_from(triples: DataFrame, urls: DataFrame) -> DataFrame:
    """(webid) of the people with triples from documents ``urls`` (doc_url)."""
    return triples.join(small(urls.select("doc_url").distinct()), "doc_url", "left_semi").select("webid").filter("webid IS NOT NULL").distinct()


def tombstone_doc(docs: DataFrame, triples: DataFrame, counters: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, triples, statistics) after documents (doc_url) are tombstoned: all people projected from them are cleared."""
    kept, after = projection_clear(triples, counters, projected_from(triples, urls))
    people = urls.select("doc_url", F.lit(None).cast("string").alias("webid"))
    return redact_docs(docs, people), kept, after
