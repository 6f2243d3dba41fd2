"""Queries that run streams over the landed events to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import crawl as rules
from weft.plans import people_queries  # noqa: F401
from weft.operators import stats
from weft.plans.scalar_queries import _OUTCOME
from weft.plans.triple_queries import _contribution
from weft.plans.views import NOW, Views
from weft.registry import ORACLE_SQL, query
from weft.streaming import run, streams

_DAY = 86_400_000
_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def _events(v):
    return run.landed(v.spark, v.sf_dir, "events").withColumn("at_ms", F.expr(_MS))


@query(sql=ORACLE_SQL["rate_limit"])
def rate_stream(v):
    hits = _events(v).select(F.concat(F.lit("ip:"), "user_id").alias("key"), "at_ms", F.col("event_id").alias("id"))
    return run.rows_of(streams.rate_stream(hits, _DAY, 2))


@query(sql=ORACLE_SQL["nonce_consume"])
def nonce_stream(v):
    events = _events(v).filter("event_type IN ('signup', 'purchase')")
    action = F.when(F.col("event_type") == "signup", "issue").otherwise("confirm").alias("action")
    rows = events.select("event_id", F.concat(F.lit("https://c"), "user_id", F.lit(".example/card#me")).alias("webid"), "at_ms", action)
    return run.rows_of(streams.nonce_stream(rows, _DAY))


def _fetches(v):
    """``v_fetch`` over the stream of events, with outcomes."""
    people_count = v.table("customer").count()
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    e = _events(v).withColumn("k", k)
    status = (
        F.when(F.col("event_type") == "view", F.when(F.col("k") % 6 == 5, 204).otherwise(200)).when(F.col("event_type") == "click", 304).when(F.col("event_type") == "purchase", 503)
        .when(F.col("event_type") == "signup", 429).when(F.col("k") % 2 == 0, 410).otherwise(404)
    )
    header = F.element_at(F.lit(["noindex", "", "all, nofollow", "bot: noindex", "bot: nofollow", "odd", None, None, None]), (F.col("k") % 9 + 1).cast("int"))
    media = F.element_at(F.lit(["text/turtle; charset=utf-8", "application/ld+json", "Text/N3", "text/html"]), (F.col("k") % 4 + 1).cast("int"))
    m = F.col("k") % 11
    f = e.select(
        "event_id",
        F.concat(F.lit("https://c"), F.col("user_id") % people_count, F.lit(".example/card")).alias("doc_url"),
        F.concat(F.lit("t"), F.col("k") % 3).alias("claim_token"),
        F.col("at_ms").alias("fetched_at"),
        F.when(m == 0, "timeout").when(m == 1, "network").when(m == 2, "too-large").when(m == 3, "unheard-of").alias("error_kind"),
        status.alias("status"),
        rules.noindex_header(header).alias("noindex"),
        media.alias("media"),
    )
    ok = rules.content_type_ok(F.col("media"), F.col("status"), F.col("noindex"))
    return f.withColumn("o", rules.fetch_outcome(F.col("status"), F.col("error_kind"), F.col("noindex"), ok)).select(
        "event_id", "doc_url", "claim_token", "fetched_at", "o.next_state", "o.fail_class"
    )


@query(_OUTCOME + """, s AS (SELECT *, coalesce(fail_class = 'transient', false) AS bad FROM o),
r AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY doc_url ORDER BY fetched_at, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s),
n AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY doc_url, run ORDER BY fetched_at, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM r)
SELECT event_id, doc_url, CASE WHEN bad AND failures >= 5 THEN 'failed' WHEN next_state = 'parse' THEN 'done' ELSE next_state END AS state, CASE WHEN bad THEN failures ELSE 0 END AS failures FROM n""")
def crawl_state_stream(v):
    rows = _fetches(v).select("doc_url", "event_id", "fetched_at", "next_state", "fail_class")
    return run.rows_of(streams.crawl_state_stream(rows))


@query("SELECT f.event_id, d.doc_url IS NOT NULL AS kept FROM v_fetch f LEFT JOIN v_doc d ON f.doc_url = d.doc_url AND f.claim_token = d.claim_token")
def late_discard(v):
    return run.rows_of(streams.late_discard(_fetches(v).select("event_id", "doc_url", "claim_token"), v.doc).select("event_id", "kept"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('signup', 'view', 'purchase')),
seen AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ms END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM e)
SELECT event_id, concat('u', user_id) AS key, coalesce(ms < ended + {_DAY}, false) AS rests FROM seen WHERE event_type <> 'purchase'""")
def cooldown_stream(v):
    kind = F.when(F.col("event_type") == "purchase", "ended").otherwise("suggested").alias("kind")
    events = _events(v).filter("event_type IN ('signup', 'view', 'purchase')")
    return run.rows_of(streams.cooldown_stream(events.select(F.concat(F.lit("u"), "user_id").alias("key"), "event_id", "at_ms", kind), _DAY))


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('signup', 'view')")
def repeat_stream(v):
    """The events span less than the time within which a repeat is dropped."""
    moments = _events(v).filter("event_type IN ('signup', 'view')").withColumn("at", F.timestamp_millis("at_ms"))
    return run.rows_of(streams.once_within(moments, "at", ["user_id"]))


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 1000 AS ms FROM events)
SELECT event_type, (ms // 3600000) * 3600000 AS start_ms, count(*) AS n FROM e GROUP BY 1, 2""")
def activity_windows(v):
    """All windows; an end mark closes those that the watermark has not passed."""
    events = _events(v).select("event_type", F.timestamp_millis("at_ms").alias("at"))
    counts = lambda rows: streams.tumbling(rows, "at", "event_type").select("event_type", F.unix_millis("window.start").alias("start_ms"), "n")
    return run.rows_to_end(events, "at", counts)


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events),
marked AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < 1800000 THEN 0 ELSE 1 END AS fresh FROM e),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS session FROM marked)
SELECT user_id, min(ms) AS start_ms, count(*) AS n FROM numbered GROUP BY user_id, session""")
def activity_sessions(v):
    """All sessions; an end mark closes those that the watermark has not passed."""
    events = _events(v).select("user_id", F.timestamp_millis("at_ms").alias("at"))
    counts = lambda rows: streams.sessions(rows, "at", "user_id").select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "n")
    return run.rows_to_end(events, "at", counts)


_LEASE = 6 * 3_600_000


@query(f"""WITH e AS (SELECT concat('https://c', user_id, '.example/card') AS doc_url, event_id, event_type, epoch_us(ts) // 1000 AS t FROM events WHERE event_type IN ('view', 'click', 'purchase')),
s AS (SELECT *, event_type = 'view' AS claim, lag(event_type) OVER w AS before, lag(t) OVER w AS before_at, lead(t) OVER w AS next, max(t) OVER (PARTITION BY doc_url) AS last,
    min(CASE WHEN event_type = 'view' THEN t END) OVER (PARTITION BY doc_url ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_claim,
    (SELECT max(t) - 3600000 FROM e) AS horizon
  FROM e WINDOW w AS (PARTITION BY doc_url ORDER BY t, event_id)),
c AS (SELECT *, NOT claim AND coalesce(before = 'view' AND t < before_at + {_LEASE}, false) AS counts FROM s),
u AS (SELECT *, CASE WHEN claim THEN t + {_LEASE} WHEN counts THEN t + CASE event_type WHEN 'click' THEN 86400000 ELSE 3600000 END END AS until FROM c)
SELECT doc_url, t AS at_ms, CASE WHEN claim THEN 'claimed' WHEN NOT counts THEN 'late' WHEN event_type = 'click' THEN 'done' ELSE 'failed' END AS event FROM u
UNION ALL SELECT doc_url, until, CASE WHEN claim THEN 'lease over' ELSE 'due' END FROM u
WHERE until <= greatest(horizon, last) AND coalesce(CASE WHEN claim THEN next ELSE next_claim END >= until, true)""")
def lease_stream(v):
    """A view claims a document, a click completes it until the next day, a purchase fails it for an hour."""
    due = lambda name, wait: F.concat(F.lit(name + ":"), (F.col("at_ms") + wait).cast("string"))
    kind = F.when(F.col("event_type") == "view", F.lit("claim")).when(F.col("event_type") == "click", due("done", _DAY)).otherwise(due("failed", 3_600_000))
    events = _events(v).filter("event_type IN ('view', 'click', 'purchase')")
    rows = events.select(F.concat(F.lit("https://c"), "user_id", F.lit(".example/card")).alias("doc_url"), "event_id", "at_ms", kind.alias("kind"))
    return run.rows_of(streams.lease_stream(rows, _LEASE))


@query(_contribution("v_new"))
def stats_stream(v):
    """People are projected anew as they land: their triples of ``v_old`` give way to those of ``v_new``."""
    counters = streams.RunningStats(v.spark, run.shared_folder(v.spark), stats.contributions(v.old))

    def each(batch, batch_id):
        own = Views(batch.sparkSession, v.sf_dir)
        people = batch.select(F.concat(F.lit("https://c"), "c_custkey", F.lit(".example/card#me")).alias("webid"))
        counters(own.old.join(people, "webid", "left_semi"), own.new.join(people, "webid", "left_semi"), batch_id)

    run.drain(run.landed(v.spark, v.sf_dir, "customer", files=1), each=each)
    return counters.read()


_INTAKE = f"""
WITH RECURSIVE good AS (SELECT * FROM v_suggest WHERE type IN ('Announce', 'Offer', 'Add') AND n_objects BETWEEN 1 AND 10),
hits AS MATERIALIZED (SELECT concat('ip:', user_id) AS key, at_ms, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS r FROM good),
fold(key, at_ms, id, r, start, n) AS (SELECT key, at_ms, id, r, at_ms, 1 FROM hits WHERE r = 1 UNION ALL
  SELECT h.key, h.at_ms, h.id, h.r, CASE WHEN f.start + {_DAY} <= h.at_ms THEN h.at_ms ELSE f.start END, CASE WHEN f.start + {_DAY} <= h.at_ms THEN 1 ELSE f.n + 1 END
  FROM fold f JOIN hits h ON h.key = f.key AND h.r = f.r + 1),
granted AS (SELECT id, row_number() OVER (PARTITION BY at_ms // {_DAY} ORDER BY at_ms, id) <= 20 AS admitted FROM fold WHERE n <= 2),
level AS (SELECT webid, doc_url, CASE WHEN state = 'tombstone' THEN 3 WHEN state IN ('done', 'skipped', 'failed', 'blocked') AND {NOW} - (c_custkey % 14) * {_DAY} > {NOW} - 7 * {_DAY} THEN 2 ELSE 1 END AS level FROM v_doc WHERE c_custkey % 5 > 0
  UNION ALL SELECT webid, doc_url, 3 FROM v_tombstone),
top AS (SELECT webid, max(level) AS level FROM level GROUP BY webid),
cand AS (SELECT g.id, g.admitted, o.i % 4 = 3 AS http, coalesce(t.level, 0) AS level FROM granted g JOIN v_suggest_object o ON o.event_id = g.id LEFT JOIN top t ON t.webid = o.object),
sums AS (SELECT id, count(*) FILTER (WHERE NOT http AND level = 0 AND admitted) AS a, count(*) FILTER (WHERE NOT http AND level = 0 AND NOT admitted) AS d,
  count(*) FILTER (WHERE NOT http AND level = 3) AS t, count(*) FILTER (WHERE NOT http AND level IN (1, 2)) AS k FROM cand GROUP BY id)
SELECT event_id AS id, CASE WHEN a > 0 THEN 'accepted' WHEN d > 0 THEN 'deferred' WHEN t > 0 AND sums.k = 0 THEN 'refused' WHEN sums.k > 0 THEN 'already' WHEN a = 0 THEN 'invalid'
  WHEN event_id IN (SELECT id FROM hits) THEN 'rate-limited' ELSE 'invalid' END AS decision FROM v_suggest LEFT JOIN sums ON event_id = sums.id"""


@query(_INTAKE)
def intake_stream(v):
    """Some candidates are spelt otherwise than their keys, and some are not https."""
    docs = v.doc.filter("c_custkey % 5 > 0").withColumn("terminal_at", F.lit(NOW) - (F.col("c_custkey") % 14) * _DAY)
    take = streams.Intake(v.spark, run.shared_folder(v.spark), docs, v.tombstone, NOW, 20, (_DAY, 2))

    def each(batch, batch_id):
        own = Views(batch.sparkSession, v.sf_dir)
        own._made["events"] = batch.drop("at_ms")
        raw = F.when(F.col("i") % 4 == 3, F.replace("object", F.lit("https:"), F.lit("http:"))).when(F.col("i") % 4 == 2, F.replace("object", F.lit(".example/"), F.lit(".Example:443/x/../")))
        take(own.suggest, own.suggest_object.select(F.col("event_id").alias("id"), F.coalesce(raw, "object").alias("webid")), batch_id)

    run.drain(_events(v), each=each)
    return take.read()
