"""The crawl frontier: claims, politeness, completions and summaries. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.crawl import ENDED, HOST_DELAY, LEASE, RECRAWL_DEFAULT
from weft.functions.urls import slug
from weft.operators.tables import ROWS_PER_RANGE, cut, number_groups


def frontier_depth(docs: DataFrame) -> DataFrame:
    """One row: n documents that wait or are being fetched."""
    return docs.filter(F.col("state").isin("pending", "claimed")).agg(F.count("*").alias("n"))


def eligible(docs: DataFrame, now: int) -> DataFrame:
    """Documents that may be claimed: due and at rest, or with an expired lease; never those that refuse indexing."""
    due = F.col("state").isin("pending", "done", "failed") & (F.col("next_eligible_at") <= now)
    expired = (F.col("state") == "claimed") & (F.col("claimed_at") <= now - LEASE)
    return docs.filter((due | expired) & ~F.coalesce("noindex", F.lit(False)))


def claim(docs: DataFrame, now: int, size: int, token: str) -> DataFrame:
    """The next ``size`` documents by depth, due time and url, marked as claimed under ``token``."""
    batch = eligible(docs, now).orderBy("depth", "next_eligible_at", "doc_url").limit(size)
    return batch.withColumns(
        {"state": F.lit("claimed"), "claimed_at": F.lit(now), "attempts": F.col("attempts") + 1, "claim_token": F.lit(token)}
    )


def claim_partition(docs: DataFrame, workers: int) -> DataFrame:
    """``docs`` with the worker that each belongs to, from the url's digest: disjoint, complete, and the same for any program."""
    return docs.withColumn("worker", (F.conv(F.substring(F.sha2("doc_url", 256), 1, 8), 16, 10).cast("long") % workers).cast("int"))


def host_gate(due: DataFrame, hosts: DataFrame, now: int) -> DataFrame:
    """``due`` documents (doc_url, host, ...) with wait_until: the time their host may be asked again, null if at once."""
    known = hosts.select("host", "next_allowed_at")
    wait = F.when(F.col("next_allowed_at") > now, F.col("next_allowed_at"))
    return due.join(known, "host", "left").withColumn("wait_until", wait).drop("next_allowed_at")


def host_schedule(due: DataFrame, hosts: DataFrame, now: int, delay: int = HOST_DELAY, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``due`` documents with fetch_at: those of one host follow each other at the crawl delay. A host of any number of documents is numbered by ranges, not in one task."""
    first = F.greatest(F.lit(now), F.coalesce("next_allowed_at", F.lit(0)))
    placed = number_groups(due, ["host"], ["depth", "next_eligible_at", "doc_url"], "__place", per_range)
    timed = placed.join(hosts.select("host", "next_allowed_at"), "host", "left")
    return timed.withColumn("fetch_at", first + F.col("__place") * delay).drop("next_allowed_at", "__place")


def lease_fence(completions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded) completions (doc_url, claim_token, ...): kept if their token is the document's current one."""
    current = docs.select("doc_url", "claim_token")
    return completions.join(current, ["doc_url", "claim_token"], "left_semi"), completions.join(current, ["doc_url", "claim_token"], "left_anti")


def lease_history(events: DataFrame, lease: int, horizon: int) -> DataFrame:
    """(doc_url, at_ms, event) of claims and completions (doc_url, event_id, at_ms, kind) up to a time, with the ends of leases and due times between them.

    Kinds are `claim`, and `done` or `failed` with the time of the next fetch after a colon. A completion counts only if the event before it is a claim whose
    lease lasts. A lease is over, or a document due, where no claim has come before; that is told up to ``horizon``, or up to the document's last event if that is later.
    """
    doc = Window.partitionBy("doc_url")
    order = doc.orderBy("at_ms", "event_id")
    claim = F.col("kind") == "claim"
    after = order.rowsBetween(1, Window.unboundedFollowing)
    seen = events.select(
        "doc_url", "at_ms", "kind",
        F.coalesce((F.lag("kind").over(order) == "claim") & (F.col("at_ms") < F.lag("at_ms").over(order) + lease), F.lit(False)).alias("counts"),
        F.lead("at_ms").over(order).alias("next"),
        F.min(F.when(claim, F.col("at_ms"))).over(after).alias("next_claim"),
        F.max("at_ms").over(doc).alias("last"),
    )
    outcome = F.substring_index("kind", ":", 1)
    told = F.when(claim, "claimed").when(F.col("counts"), outcome).otherwise("late")
    due = F.greatest(F.substring_index("kind", ":", -1).try_cast("long"), F.col("at_ms") + 1)
    until = F.when(claim, F.col("at_ms") + lease).when(F.col("counts"), due)
    free = F.when(claim, F.col("next").isNull() | (F.col("next") >= until)).otherwise(F.col("next_claim").isNull() | (F.col("next_claim") >= until))
    ends = seen.filter(free & (until <= F.greatest(F.lit(horizon), "last")))
    return seen.select("doc_url", "at_ms", told.alias("event")).unionByName(
        ends.select("doc_url", until.alias("at_ms"), F.when(claim, "lease over").otherwise("due").alias("event"))
    )


#: Columns of a document that a completion replaces, and those that it replaces only where it has a value.
SET = {"http_status": "int", "fail_class": "string", "error": "string", "next_eligible_at": "long"}
FILLED = {
    "etag": "string", "last_modified": "string", "content_hash": "string", "body": "string", "is_solid": "boolean", "webid": "string", "slug": "string"
}


def mark_done(docs: DataFrame, completions: DataFrame, gate: DataFrame) -> DataFrame:
    """``docs``, whole rows, after completions (doc_url, claim_token, next_state, fetched_at, event_id, and any of SET and FILLED).

    Completions of superseded leases and for gated documents are dropped; of several for one document the latest
    counts. It ends the lease, replaces the columns SET, and of FILLED those for which it has a value; without a next time the document is due again
    two weeks after the fetch, and with a webid its slug is that webid's; terminal_at is set when a document ends and else
    stays. Documents without a completion stay as they are. Columns that ``docs`` lacks are added.
    """
    from weft.operators.gates import open_only

    kept, _ = lease_fence(completions, docs)
    last = Window.partitionBy("doc_url").orderBy(F.desc("fetched_at"), F.desc("event_id"))
    kept = kept.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
    allowed = open_only(docs.select("doc_url", "webid"), gate).select("doc_url")
    due = F.col("next_eligible_at") if "next_eligible_at" in completions.columns else F.lit(None)
    kept = kept.withColumn("next_eligible_at", F.coalesce(due, F.col("fetched_at") + RECRAWL_DEFAULT).cast("long"))
    if "webid" in completions.columns:
        kept = kept.withColumn("slug", slug(F.col("webid")))
    given = [c for c in (*SET, *FILLED) if c in kept.columns]
    state = F.when(F.col("next_state") == "parse", F.lit("done")).otherwise(F.col("next_state"))
    new = kept.join(allowed, "doc_url", "left_semi").select(
        "doc_url", state.alias("new_state"), F.col("fetched_at").alias("new_at"), *[F.col(c).alias(f"new_{c}") for c in given]
    )
    wanted = {"state": "string", **SET, **FILLED, "last_crawled": "long", "terminal_at": "long", "claim_token": "string", "claimed_at": "long"}
    missing = {c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in docs.columns}
    both = docs.withColumns(missing).join(new, "doc_url", "left")
    hit = F.col("new_state").isNotNull()
    changes = {"state": F.col("new_state"), "last_crawled": F.col("new_at"), "claim_token": F.lit(None), "claimed_at": F.lit(None)}
    changes |= {c: F.col(f"new_{c}") for c in SET if c in given} | {c: F.coalesce(f"new_{c}", c) for c in FILLED if c in given}
    changes["terminal_at"] = F.when(F.col("new_state").isin(ENDED), F.col("new_at")).otherwise(F.col("terminal_at"))
    return both.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in [*docs.columns, *missing]])


def complete(docs: DataFrame, completions: DataFrame, gate: DataFrame, triples: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, triples, statistics) after completions as of :func:`mark_done`: what a document that ends as a tombstone has projected is cleared with it, if the completion
    names a webid; that is the webid's triples, from wherever they are, and those of all others projected from the document."""
    from weft.operators.erase import projected_from, projection_clear

    after = cut(mark_done(docs, completions, gate))
    was = docs.select("doc_url", F.col("state").alias("__was"), F.col("claim_token").alias("__token"))
    ended = after.filter("state = 'tombstone'").join(was, "doc_url").filter("__was != 'tombstone' AND __token IS NOT NULL AND claim_token IS NULL").select("doc_url")
    # Both are few columns of few rows, and each is asked for several times.
    named = cut(completions.filter("next_state = 'tombstone' AND webid IS NOT NULL").select("doc_url", "webid").join(ended, "doc_url", "left_semi"))
    people = cut(named.select("webid").union(projected_from(triples, named.select("doc_url"))).distinct())
    return after, *projection_clear(triples, counters, people)


def host_update(results: DataFrame, hosts: DataFrame, delay: int = HOST_DELAY) -> DataFrame:
    """(host, next_allowed_at, consecutive_errors) after a batch of results (host, fetched_at, event_id, fail_class, retry_ms).

    A host may be asked again after the latest delay; errors count the transient failures since the last other result.
    """
    transient = F.coalesce(F.col("fail_class") == "transient", F.lit(False))
    wait = F.when(transient & F.col("retry_ms").isNotNull(), F.col("retry_ms")).otherwise(F.lit(delay))
    stamp = F.struct("fetched_at", "event_id")
    healthy = results.groupBy("host").agg(F.max(F.when(~transient, stamp)).alias("healthy"), F.max(F.col("fetched_at") + wait).alias("next_allowed_at"))
    joined = results.join(healthy, "host")
    later = F.col("healthy").isNull() | (stamp > F.col("healthy"))
    counted = joined.groupBy("host", "next_allowed_at").agg(
        F.count(F.when(transient & later, F.lit(1))).alias("errors"), F.bool_or(F.col("healthy").isNotNull()).alias("reset")
    )
    old = hosts.select("host", F.col("consecutive_errors").alias("old"))
    total = F.col("errors") + F.when(F.col("reset"), F.lit(0)).otherwise(F.coalesce("old", F.lit(0)))
    return counted.join(old, "host", "left").select("host", "next_allowed_at", total.cast("long").alias("consecutive_errors"))


def batch_summary(results: DataFrame, remaining: DataFrame, enqueued: DataFrame, budget: int) -> DataFrame:
    """One row on a batch of results (status, error_kind, next_state, fail_class, type_ok): claimed, fetched, added, errors, budget_hit and remaining.

    Fetched are those with a response whose media type was not refused; documents that are gone count as errors too. added is the number of
    documents newly ``enqueued``.
    """
    refused: Column = ~F.coalesce("type_ok", F.lit(True)) & ~F.coalesce(F.col("status").isin(204, 205, 304) | (F.col("status") >= 400), F.lit(False))
    sums = results.agg(
        F.count("*").alias("claimed"),
        F.count(F.when(F.col("error_kind").isNull() & ~refused, F.lit(1))).alias("fetched"),
        F.count(F.when(F.col("fail_class").isNotNull() | F.col("error_kind").isNull() & (F.col("status") == 410), F.lit(1))).alias("errors"),
    ).withColumn("budget_hit", F.col("claimed") >= budget)
    one = F.lit(1).alias("one")
    counts = sums.select("*", one).join(enqueued.agg(F.count("*").alias("added")).select(one, "added"), "one")
    return counts.join(remaining.select(one, F.col("n").alias("remaining")), "one").drop("one")
