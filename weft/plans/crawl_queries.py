"""Queries of the crawl frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import crawl as rules
from weft.operators import crawl, graph, stats
from weft.plans.graph_queries import _EDGES
from weft.plans.scalar_queries import _OUTCOME, _RETRY, SLUG_SQL, outcomes
from weft.plans.triple_queries import _GATE, gate
from weft.plans.views import NOW
from weft.registry import query

_ELIGIBLE = f"(state IN ('pending', 'done', 'failed') AND next_eligible_at <= {NOW} OR state = 'claimed' AND claimed_at <= {NOW} - 360000) AND NOT noindex"
_HOSTS = f"hosts AS (SELECT host, {NOW} + (c_custkey % 5 - 2) * 60000 AS next_allowed_at, c_custkey % 3 AS consecutive_errors FROM v_doc WHERE c_custkey % 4 > 0)"


def hosts(v):
    return v.doc.filter("c_custkey % 4 > 0").select(
        "host", (F.lit(NOW) + (F.col("c_custkey") % 5 - 2) * 60000).alias("next_allowed_at"), (F.col("c_custkey") % 3).alias("consecutive_errors")
    )


@query(f"SELECT doc_url, 'claimed' AS state, {NOW} AS claimed_at, attempts + 1 AS attempts, 'run1' AS claim_token FROM (SELECT * FROM v_doc WHERE {_ELIGIBLE} ORDER BY depth, next_eligible_at, doc_url LIMIT 8)")
def claim_batch(v):
    return crawl.claim(v.doc, NOW, 8, "run1").select("doc_url", "state", "claimed_at", "attempts", "claim_token")


@query(f"SELECT doc_url, CAST(CAST(concat('0x', substr(sha256(doc_url), 1, 8)) AS BIGINT) % 4 AS INT) AS worker FROM v_doc WHERE {_ELIGIBLE}")
def claim_partition(v):
    return crawl.claim_partition(crawl.eligible(v.doc, NOW), 4).select("doc_url", "worker")


@query(f"WITH {_HOSTS} SELECT d.doc_url, CASE WHEN h.next_allowed_at > {NOW} THEN h.next_allowed_at END AS wait_until FROM v_doc d LEFT JOIN hosts h USING (host) WHERE {_ELIGIBLE}")
def host_gate(v):
    return crawl.host_gate(crawl.eligible(v.doc, NOW), hosts(v), NOW).select("doc_url", "wait_until")


@query(f"""WITH h AS (SELECT concat('g', c_custkey % 9) AS host, max({NOW} + (c_custkey % 5 - 2) * 60000) AS next_allowed_at FROM v_doc WHERE c_custkey % 9 < 6 AND c_custkey < 20 GROUP BY 1),
d AS (SELECT *, concat('g', c_custkey % 9) AS g FROM v_doc WHERE {_ELIGIBLE})
SELECT doc_url, greatest({NOW}, coalesce(next_allowed_at, 0)) + (row_number() OVER (PARTITION BY g ORDER BY depth, next_eligible_at, doc_url) - 1) * 1000 AS fetch_at
FROM d LEFT JOIN h ON d.g = h.host""")
def host_schedule(v):
    group = F.concat(F.lit("g"), F.col("c_custkey") % 9)
    allowed = (F.lit(NOW) + (F.col("c_custkey") % 5 - 2) * 60000).alias("next_allowed_at")
    known = v.doc.filter("c_custkey % 9 < 6 AND c_custkey < 20").select(group.alias("host"), allowed).groupBy("host").agg(F.max("next_allowed_at").alias("next_allowed_at"))
    due = crawl.eligible(v.doc, NOW).withColumn("host", group)
    return crawl.host_schedule(due, known, NOW).select("doc_url", "fetch_at")


@query("SELECT f.event_id, d.doc_url IS NOT NULL AS kept FROM v_fetch f LEFT JOIN v_doc d ON f.doc_url = d.doc_url AND f.claim_token = d.claim_token")
def lease_fence(v):
    kept, dropped = crawl.lease_fence(v.fetch, v.doc)
    return kept.select("event_id", F.lit(True).alias("kept")).union(dropped.select("event_id", F.lit(False)))


@query(f"""{_OUTCOME}, {_GATE}, latest AS (SELECT o.* FROM o JOIN v_doc d ON o.doc_url = d.doc_url AND o.claim_token = d.claim_token
  WHERE d.webid NOT IN (SELECT webid FROM gate) AND d.doc_url NOT IN (SELECT doc_url FROM gate) QUALIFY row_number() OVER (PARTITION BY o.doc_url ORDER BY fetched_at DESC, event_id DESC) = 1),
docs AS (SELECT *, CAST(200 + c_custkey % 3 * 100 AS INT) AS http_status, CASE WHEN c_custkey % 4 = 0 THEN 1690000000000 + c_custkey END AS terminal_at FROM v_doc)
SELECT d.doc_url, d.c_custkey, CASE WHEN l.next_state = 'parse' THEN concat(d.webid, 2) ELSE d.webid END AS webid, CASE WHEN l.next_state = 'parse' THEN {SLUG_SQL.format("concat(d.webid, 2)")} END AS slug, d.host, d.depth, d.attempts, d.noindex, d.label, d.root_seed, d.is_solid, CASE WHEN l.next_state = 'parse' THEN 'done' ELSE coalesce(l.next_state, d.state) END AS state,
  coalesce(l.etag, d.etag) AS etag, CASE WHEN l.next_state = 'parse' THEN concat('n', l.event_id) ELSE d.content_hash END AS content_hash,
  CASE WHEN l.doc_url IS NULL THEN d.http_status ELSE CAST(l.status AS INT) END AS http_status, l.fail_class, CASE WHEN l.fail_class IS NOT NULL THEN concat('HTTP ', l.status) END AS error,
  CASE WHEN l.doc_url IS NULL THEN d.next_eligible_at WHEN l.event_id % 3 = 0 THEN l.fetched_at + 1209600000 ELSE l.fetched_at + 1000 END AS next_eligible_at, l.fetched_at AS last_crawled,
  CASE WHEN l.next_state IN ('parse', 'done', 'tombstone', 'skipped') THEN l.fetched_at ELSE d.terminal_at END AS terminal_at,
  CASE WHEN l.doc_url IS NULL THEN d.claim_token END AS claim_token, CASE WHEN l.doc_url IS NULL THEN d.claimed_at END AS claimed_at FROM docs d LEFT JOIN latest l ON l.doc_url = d.doc_url""")
def mark_done(v):
    old = F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") + 1690000000000)
    docs = v.doc.withColumns({"http_status": (200 + F.col("c_custkey") % 3 * 100).cast("int"), "terminal_at": old})
    done = outcomes(v).select(
        "doc_url", "claim_token", "next_state", "etag", "fetched_at", "event_id", "fail_class", F.col("status").cast("int").alias("http_status"),
        F.when(F.col("fail_class").isNotNull(), F.concat(F.lit("HTTP "), "status")).alias("error"), F.when(F.col("event_id") % 3 != 0, F.col("fetched_at") + 1000).alias("next_eligible_at"),
        F.when(F.col("next_state") == "parse", F.concat(F.lit("n"), "event_id")).alias("content_hash"),
        F.when(F.col("next_state") == "parse", F.concat("doc_url", F.lit("#me2"))).alias("webid"),
    )
    return crawl.mark_done(docs, done, gate(v)).drop("last_modified", "body")


@query(f"""{_OUTCOME}, {_GATE}, latest AS (SELECT o.*, d.webid, d.state AS was FROM o JOIN v_doc d ON o.doc_url = d.doc_url AND o.claim_token = d.claim_token
  WHERE d.webid NOT IN (SELECT webid FROM gate) AND d.doc_url NOT IN (SELECT doc_url FROM gate) QUALIFY row_number() OVER (PARTITION BY o.doc_url ORDER BY fetched_at DESC, event_id DESC) = 1),
gone AS (SELECT doc_url, webid FROM latest WHERE next_state = 'tombstone' AND was <> 'tombstone')
SELECT s, p, o, o_is_iri, webid, doc_url FROM v_triple WHERE webid NOT IN (SELECT webid FROM gone) AND doc_url NOT IN (SELECT doc_url FROM gone)""")
def complete(v):
    """Triples that stay when documents end as tombstones."""
    done = outcomes(v).select("doc_url", "claim_token", "next_state", "fetched_at", "event_id", F.concat("doc_url", F.lit("#me")).alias("webid"))
    return crawl.complete(v.doc, done, gate(v), v.triple, stats.contributions(v.triple))[1].select("s", "p", "o", "o_is_iri", "webid", "doc_url")


@query(f"""{_OUTCOME}, {_HOSTS}, r AS (SELECT *, {_RETRY} AS retry_ms, coalesce(fail_class = 'transient', false) AS bad FROM o),
healthy AS (SELECT host, max(CASE WHEN NOT bad THEN (fetched_at, event_id) END) AS at, CAST(max(fetched_at + CASE WHEN bad AND retry_ms IS NOT NULL THEN retry_ms ELSE 1000 END) AS BIGINT) AS next_allowed_at FROM r GROUP BY host)
SELECT r.host, any_value(h.next_allowed_at) AS next_allowed_at, CAST(count(*) FILTER (WHERE bad AND (h.at IS NULL OR (fetched_at, event_id) > h.at)) + CASE WHEN any_value(h.at) IS NULL THEN coalesce(any_value(x.consecutive_errors), 0) ELSE 0 END AS BIGINT) AS consecutive_errors
FROM r JOIN healthy h USING (host) LEFT JOIN hosts x ON r.host = x.host GROUP BY r.host""")
def host_update(v):
    results = outcomes(v).withColumn("retry_ms", rules.retry_after_ms(F.col("retry_after"), F.col("fetched_at")))
    return crawl.host_update(results, hosts(v))


@query(f"""{_OUTCOME}, {_EDGES} SELECT count(*) AS claimed, count(*) FILTER (WHERE error_kind IS NULL AND type_ok) AS fetched,
  (SELECT count(DISTINCT dst) FROM edges WHERE dst NOT IN (SELECT doc_url FROM v_doc WHERE c_custkey % 3 = 0)) AS added,
  count(*) FILTER (WHERE fail_class IS NOT NULL OR error_kind IS NULL AND status = 410) AS errors, count(*) >= 5000 AS budget_hit,
  (SELECT count(*) FROM v_doc WHERE state IN ('pending', 'claimed')) AS remaining FROM o""")
def batch_summary(v):
    enqueued = graph.new_links(graph.knows_edges(v.triple), v.doc.filter("c_custkey % 3 = 0"))
    return crawl.batch_summary(outcomes(v), crawl.frontier_depth(v.doc), enqueued, 5000)
