"""Queries of intake, erasure and entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import crawl as rules
from weft.functions.urls import slug
from weft.operators import entries, erase, intake, stats, tables
from weft.plans.scalar_queries import SLUG_SQL
from weft.plans.triple_queries import _GATE, _SERVED, _contribution, gate, served
from weft.plans.views import ISSUER, KNOWS, NAME, NOW, STORAGE
from weft.registry import query
from weft.streaming import run

_DAY = 86_400_000

# Intake.


@query("""SELECT event_id AS id, [type] AS types, list_sort(list(DISTINCT object)) AS objects, concat('u', any_value(user_id)) AS actor
FROM v_suggest_object JOIN v_suggest USING (event_id, type) WHERE type IN ('Announce', 'Offer', 'Add') GROUP BY event_id, type
UNION ALL SELECT event_id, [type], [], concat('u', user_id) FROM v_suggest WHERE n_objects = 0 AND type IN ('Announce', 'Offer', 'Add')""")
def activity_extract(v):
    subject = F.lit("urn:activity")
    row = lambda df, p, value: df.select(F.col("event_id").alias("id"), subject.alias("subject"), F.lit(p).alias("predicate"), value.alias("value"))
    stray = v.suggest.select(F.col("event_id").alias("id"), F.lit("urn:other").alias("subject"), F.lit("object").alias("predicate"), F.lit("urn:stray").alias("value"))
    triples = (
        row(v.suggest.filter("type != ''"), "type", F.col("type"))
        .union(row(v.suggest, "actor", F.concat(F.lit("u"), "user_id")))
        .union(row(v.suggest_object, "object", F.col("object")))
        .union(stray)
    )
    return intake.activity_extract(triples)


@query("SELECT event_id, n_objects BETWEEN 1 AND 10 AS in_bounds FROM v_suggest")
def candidate_bounds(v):
    objects = F.slice(F.sequence(F.lit(0), F.lit(10)), 1, F.col("n_objects").cast("int"))
    return intake.candidate_bounds(v.suggest.select("event_id", objects.alias("objects"))).select("event_id", "in_bounds")


_TERMINAL = f"{NOW} - (c_custkey % 14) * {_DAY}"
_STATUS = f"""
level AS (SELECT webid, doc_url, CASE WHEN state = 'tombstone' THEN 3 WHEN state IN ('done', 'skipped', 'failed', 'blocked') AND {_TERMINAL} > {NOW} - 7 * {_DAY} THEN 2 ELSE 1 END AS level FROM v_doc WHERE c_custkey % 5 > 0
  UNION ALL SELECT webid, doc_url, 3 FROM v_tombstone),
cand AS (SELECT event_id, i, object AS webid, CASE WHEN i % 2 = 0 THEN regexp_replace(object, '#.*', '') ELSE 'https://elsewhere.example/' END AS doc_url FROM v_suggest_object),
status AS (SELECT event_id, i, ['unknown', 'live', 'cooldown', 'tombstoned'][1 + greatest(coalesce((SELECT max(level) FROM level l WHERE l.webid = c.webid), 0), coalesce((SELECT max(level) FROM level l WHERE l.doc_url = c.doc_url), 0))] AS status FROM cand c)"""


def _status(v):
    docs = v.doc.filter("c_custkey % 5 > 0").withColumn("terminal_at", F.lit(NOW) - (F.col("c_custkey") % 14) * _DAY)
    url = F.when(F.col("i") % 2 == 0, F.regexp_replace("object", "#.*", "")).otherwise(F.lit("https://elsewhere.example/"))
    candidates = v.suggest_object.select("event_id", "i", F.col("object").alias("webid"), url.alias("doc_url"))
    return intake.suggestion_status(candidates, docs, v.tombstone, NOW).select("event_id", "i", "status")


@query(f"WITH {_STATUS} SELECT * FROM status")
def suggestion_status(v):
    return _status(v)


@query(f"""WITH {_STATUS}, sums AS (SELECT event_id AS id, count(*) FILTER (WHERE status = 'unknown' AND i % 3 > 0) AS a, count(*) FILTER (WHERE status = 'unknown' AND i % 3 = 0) AS d,
  count(*) FILTER (WHERE status = 'tombstoned') AS t, count(*) FILTER (WHERE status IN ('live', 'cooldown')) AS k FROM status GROUP BY event_id)
SELECT id, CASE WHEN a > 0 THEN 'accepted' WHEN d > 0 THEN 'deferred' WHEN t > 0 AND k = 0 THEN 'refused' WHEN k > 0 THEN 'already' ELSE 'invalid' END AS decision FROM sums""")
def intake_decision(v):
    return intake.intake_decision(_status(v).select(F.col("event_id").alias("id"), "status", (F.col("i") % 3 > 0).alias("admitted")))


@query(f"""
WITH hits AS MATERIALIZED (SELECT key, at_ms, id, row_number() OVER (PARTITION BY key ORDER BY at_ms, id) AS r FROM v_hit),
fold(key, at_ms, id, r, start, n) AS (SELECT key, at_ms, id, r, at_ms, 1 FROM hits WHERE r = 1 UNION ALL
  SELECT h.key, h.at_ms, h.id, h.r, CASE WHEN f.start + {_DAY} <= h.at_ms THEN h.at_ms ELSE f.start END, CASE WHEN f.start + {_DAY} <= h.at_ms THEN 1 ELSE f.n + 1 END
  FROM fold f JOIN hits h ON h.key = f.key AND h.r = f.r + 1)
SELECT key, at_ms, id, CAST(n AS BIGINT) AS n, n <= 2 AS granted FROM fold""")
def rate_limit(v):
    return intake.rate_limit(v.hit, _DAY, 2)


@query(f"SELECT id, row_number() OVER (PARTITION BY at_ms // {_DAY} ORDER BY at_ms, id) <= 20 AS admitted FROM v_hit")
def daily_admission(v):
    return intake.daily_admission(v.hit, 20).select("id", "admitted")


@query("SELECT event_id, at_ms FROM v_suggest WHERE (at_ms, event_id) < (1704400000000, 7000) ORDER BY at_ms DESC, event_id DESC LIMIT 51")
def inbox_page(v):
    return tables.newest_page(v.suggest.select("event_id", "at_ms"), "at_ms", "event_id", 50, (1704400000000, 7000))


@query("SELECT count(*) AS total FROM v_suggest")
def inbox_total(v):
    return v.suggest.agg(F.count("*").alias("total"))


@query("SELECT event_id AS id, type, user_id, type IS NOT NULL AS found FROM events LEFT JOIN v_suggest USING (event_id, user_id)")
def notification_get(v):
    own = v.suggest.select(F.col("event_id").alias("id"), "type")
    asked = v.table("events").select(F.col("event_id").alias("id"), "user_id")
    return asked.join(own, "id", "left").withColumn("found", F.col("type").isNotNull())


@query("SELECT event_id AS id, at_ms FROM v_suggest WHERE NOT processed ORDER BY at_ms, event_id LIMIT 500")
def deferred_drain(v):
    rows = v.suggest.select(F.col("event_id").alias("id"), "at_ms", "processed")
    return intake.drain(rows, 500).select("id", "at_ms")


@query("SELECT concat('urn:inbox:', event_id) AS iri, type, strftime(make_timestamp(at_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created FROM v_suggest")
def inbox_members(v):
    return entries.inbox_members(v.suggest.select(F.col("event_id").cast("string").alias("id"), "type", "at_ms"))


# Erasure.


@query("SELECT webid, max(event_id) AS nonce_id, max(at_ms) AS at_ms FROM v_nonce WHERE action = 'issue' GROUP BY webid")
def nonce_latest(v):
    return erase.nonce_latest(v.nonce)


_CONFIRMED = f"""WITH seen AS (SELECT *, max(CASE WHEN action = 'issue' THEN event_id END) OVER w AS issue, max(CASE WHEN action = 'issue' THEN at_ms END) OVER w AS issued
  FROM v_nonce WINDOW w AS (PARTITION BY webid ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING)),
confirms AS (SELECT *, row_number() OVER (PARTITION BY webid, issue ORDER BY at_ms, event_id) AS n FROM seen WHERE action = 'confirm')
SELECT event_id, webid, issue IS NOT NULL AND at_ms < issued + {_DAY} AND n = 1 AS confirmed FROM confirms"""


@query(_CONFIRMED)
def nonce_consume(v):
    return erase.nonce_consume(v.nonce)


@query("SELECT webid, concat('n', max(event_id)) AS nonce FROM v_nonce WHERE action = 'issue' GROUP BY webid HAVING max(event_id) % 2 = 0")
def challenge_confirm(v):
    predicate = entries.IDX + "optOutToken"
    nonces = erase.nonce_latest(v.nonce).select("webid", F.concat(F.lit("n"), "nonce_id").alias("nonce"))
    published = v.nonce.filter("event_id % 2 = 0").select(
        F.col("webid").alias("s"), F.lit(predicate).alias("p"), F.concat(F.lit("n"), "event_id").alias("o"), F.lit(False).alias("o_is_iri")
    )
    return erase.challenge_confirm(nonces, published, predicate)


_ERASED = f"""erased AS (SELECT webid, doc_url, 'erasure' AS reason, {NOW} AS created_at, 'asked' AS proof FROM v_person WHERE c_custkey % 10 = 7)"""


def _erased(v):
    people = v.person.filter("c_custkey % 10 = 7").select("webid", "doc_url")
    return people.withColumns({"reason": F.lit("erasure"), "created_at": F.lit(NOW), "proof": F.lit("asked")})


_MERGED = f"WITH {_ERASED}, both_ AS (SELECT webid, doc_url, reason, created_at, proof FROM v_tombstone UNION ALL SELECT * FROM erased) SELECT webid, arg_max(doc_url, created_at) AS doc_url, arg_min(reason, created_at) AS reason, min(created_at) AS created_at, arg_min(proof, created_at) AS proof FROM both_ GROUP BY webid"


@query(_MERGED)
def tombstone_merge(v):
    return erase.tombstone_merge(v.tombstone, _erased(v))


@query(f"WITH kept AS (SELECT * FROM v_triple WHERE webid NOT IN (SELECT webid FROM v_person WHERE c_custkey % 10 = 7)) {_contribution('kept')}")
def projection_clear(v):
    _, counters = erase.projection_clear(v.triple, stats.contributions(v.triple), _erased(v))
    return stats.visible(counters)


_REDACTED = f"""SELECT doc_url, CASE WHEN c_custkey % 10 = 7 THEN 'tombstone' ELSE state END AS state, CASE WHEN c_custkey % 10 <> 7 THEN webid END AS webid,
  CASE WHEN c_custkey % 10 <> 7 THEN label END AS label FROM v_doc WHERE c_custkey % 20 <> 7 UNION ALL SELECT doc_url, 'tombstone', NULL, NULL FROM v_doc WHERE c_custkey % 20 = 7"""


@query(_REDACTED)
def redact_docs(v):
    docs = v.doc.filter("c_custkey % 20 != 7").select("doc_url", "state", "webid", "label")
    return erase.redact_docs(docs, _erased(v))


_INBOX = f"""WITH {_ERASED}, named AS (SELECT DISTINCT event_id FROM v_suggest_object WHERE object IN (SELECT webid FROM erased))
SELECT event_id AS id, CASE WHEN event_id IN (SELECT event_id FROM named) THEN '' ELSE concat('body', event_id) END AS body, event_id IN (SELECT event_id FROM named) AS redacted FROM v_suggest"""


def _inbox(v):
    inbox = v.suggest.select(F.col("event_id").alias("id"), F.concat(F.lit("body"), "event_id").alias("body"))
    return inbox, v.suggest_object.select(F.col("event_id").alias("id"), "object")


@query(_INBOX)
def inbox_redact(v):
    inbox, objects = _inbox(v)
    return erase.inbox_redact(inbox, objects, _erased(v))[0]


#: Others are projected from documents of the erased, and of people who stay.
_KEPT = """SELECT * FROM v_triple WHERE webid NOT IN (SELECT webid FROM v_person WHERE c_custkey % 10 = 7)
  UNION ALL SELECT s, p, o, o_is_iri, webid, doc_url FROM v_variant WHERE c_custkey % 10 = 3"""


def _projected(v):
    return v.triple.unionByName(v.variant.drop("c_custkey"))


@query(f"""SELECT 'doc' AS surface, doc_url AS key, state AS value FROM ({_REDACTED}) UNION ALL
SELECT 'triple', webid, CAST(count(*) AS VARCHAR) FROM ({_KEPT}) GROUP BY webid UNION ALL
SELECT 'tombstone', webid, reason FROM ({_MERGED}) UNION ALL SELECT 'inbox', CAST(id AS VARCHAR), body FROM ({_INBOX}) UNION ALL
SELECT 'object', CAST(event_id AS VARCHAR), object FROM v_suggest_object WHERE object NOT IN (SELECT webid FROM v_person WHERE c_custkey % 10 = 7) UNION ALL
SELECT 'stats', k, CAST(v AS VARCHAR) FROM (WITH kept AS ({_KEPT}) {_contribution('kept')})""", name="erase")
def erase_people(v):
    """The index is written as a snapshot, and what is left is read from the snapshot that the erasure commits."""
    inbox, objects = _inbox(v)
    docs = v.doc.filter("c_custkey % 20 != 7").select("doc_url", "state", "webid", "label")
    snapshots = tables.Snapshots(v.spark, run.shared_folder(v.spark))
    snapshots.commit(erase.Index(docs, _projected(v), stats.contributions(_projected(v)), v.tombstone, inbox, objects)._asdict(), 0)
    after = erase.erase_stored(snapshots, _erased(v))
    row = lambda df, name, key, value: df.select(F.lit(name).alias("surface"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    return (
        row(after.docs, "doc", "doc_url", "state")
        .union(row(after.triples.groupBy("webid").count(), "triple", "webid", "count"))
        .union(row(after.tombstones, "tombstone", "webid", "reason"))
        .union(row(after.inbox, "inbox", "id", "body"))
        .union(row(after.inbox_objects, "object", "id", "object"))
        .union(row(stats.visible(after.stats), "stats", "k", "v"))
    )


@query(f"SELECT webid, count(*) AS n FROM ({_KEPT}) GROUP BY webid")
def tombstone_doc(v):
    triples = _projected(v)
    _, kept, _ = erase.tombstone_doc(v.doc.select("doc_url", "state", "webid", "label"), triples, stats.contributions(triples), _erased(v).select("doc_url"))
    return kept.groupBy("webid").agg(F.count("*").alias("n"))


# Entries and lookups.

_PROFILE = f"""SELECT webid, min(CASE WHEN p = '{NAME}' THEN o END) AS name, CAST(NULL AS VARCHAR) AS photo, coalesce(list_sort(list(DISTINCT o) FILTER (WHERE p = '{ISSUER}')), []) AS issuers,
  coalesce(list_sort(list(DISTINCT o) FILTER (WHERE p = '{STORAGE}')), []) AS storages, coalesce(list_sort(list(DISTINCT o) FILTER (WHERE p = '{KNOWS}'))[1:9], []) AS knows FROM v_triple GROUP BY webid"""


@query(_PROFILE)
def profile_rollup(v):
    return entries.profile_rollup(v.triple, 9)


@query(f"WITH {_GATE} SELECT webid, list_filter(knows, lambda k: k NOT IN (SELECT webid FROM gate)) AS knows FROM ({_PROFILE})".replace("list_filter(knows, lambda k: k NOT IN (SELECT webid FROM gate))", "coalesce((SELECT list(k ORDER BY k) FROM unnest(knows) AS u(k) WHERE k NOT IN (SELECT webid FROM gate)), [])"))
def knows_visible(v):
    return entries.knows_visible(entries.profile_rollup(v.triple, 9).select("webid", "knows"), gate(v))


_LOOKUP_DOCS = f"docs AS (SELECT {SLUG_SQL.format('webid')} AS slug, webid, state FROM v_doc WHERE c_custkey % 4 > 0)"


def _docs(v):
    return v.doc.withColumn("slug", slug(F.col("webid")))


@query(f"""WITH {_LOOKUP_DOCS}, asked AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN concat('bad', c_custkey) ELSE {SLUG_SQL.format('webid')} END AS slug FROM v_person)
SELECT a.slug, CASE WHEN state IS NULL THEN 404 WHEN state = 'tombstone' THEN 410 ELSE 200 END AS status, CASE WHEN state <> 'tombstone' THEN webid END AS webid FROM asked a LEFT JOIN docs USING (slug)""")
def lookup_by_slug(v):
    asked = v.person.select(F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("bad"), "c_custkey")).otherwise(slug(F.col("webid"))).alias("slug"))
    return entries.lookup_by_slug(asked, _docs(v).filter("c_custkey % 4 > 0"))


@query(f"""SELECT p.c_custkey AS id, p.c_custkey % 6 = 0 AS bad, d.webid IS NOT NULL AS indexed, CASE WHEN d.webid IS NOT NULL THEN {SLUG_SQL.format("coalesce(d.webid, '')")} END AS slug
FROM v_person p LEFT JOIN v_doc d ON d.webid = p.webid AND d.state <> 'tombstone' AND p.c_custkey % 6 > 0""")
def lookup_by_webid(v):
    raw = F.when(F.col("c_custkey") % 6 == 0, F.lit("not a url")).otherwise(F.concat(F.lit("HTTPS://C"), "c_custkey", F.lit(".Example:443/card#me")))
    return entries.lookup_by_webid(v.person.select(F.col("c_custkey").alias("id"), raw.alias("url")), _docs(v))


_IRI = {"FOAF": entries.FOAF, "DCT": entries.DCT, "IDX": entries.IDX, "SOLID": entries.SOLID}


@query(
    f"""WITH {_GATE}, prof AS ({_PROFILE}), people AS (SELECT d.*, {SLUG_SQL.format('d.webid')} AS slug, prof.name, issuers, storages, knows, CASE WHEN state <> 'done' THEN 'Unreachable' WHEN next_eligible_at > 0 AND next_eligible_at <= {NOW} THEN 'Stale' ELSE 'Live' END AS freshness
  FROM v_doc d JOIN prof USING (webid) WHERE d.webid NOT IN (SELECT webid FROM gate) AND d.state = 'done')
SELECT concat('urn:entry:', slug) AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{entries.IDX}Entry' AS o, 'iri' AS kind FROM people UNION ALL
SELECT concat('urn:entry:', slug), 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{entries.FOAF}PersonalProfileDocument', 'iri' FROM people UNION ALL
SELECT concat('urn:entry:', slug), unnest(['{entries.FOAF}primaryTopic', '{entries.FOAF}topic']), webid, 'iri' FROM people UNION ALL
SELECT concat('urn:entry:', slug), '{entries.PROV}wasDerivedFrom', doc_url, 'iri' FROM people UNION ALL
SELECT concat('urn:entry:', slug), '{entries.PROV}generatedAtTime', CAST(claimed_at AS VARCHAR), 'literal' FROM people UNION ALL
SELECT concat('urn:entry:', slug), '{entries.VOID}inDataset', 'urn:dataset', 'iri' FROM people UNION ALL
SELECT webid, '{entries.FOAF}isPrimaryTopicOf', concat('urn:entry:', slug), 'iri' FROM people UNION ALL
SELECT webid, '{entries.RDFS}seeAlso', doc_url, 'iri' FROM people UNION ALL
SELECT webid, '{STORAGE}', unnest(storages), 'iri' FROM people UNION ALL
SELECT concat('urn:entry:', slug), '{entries.DCT}source', doc_url, 'iri' FROM people UNION ALL
SELECT concat('urn:entry:', slug), '{entries.DCT}modified', CAST(claimed_at AS VARCHAR), 'literal' FROM people UNION ALL
SELECT concat('urn:entry:', slug), '{entries.IDX}crawlState', concat('{entries.IDX}', freshness), 'iri' FROM people UNION ALL
SELECT webid, '{entries.FOAF}name', name, 'literal' FROM people UNION ALL
SELECT webid, '{ISSUER}', unnest(issuers), 'iri' FROM people UNION ALL
SELECT webid, '{KNOWS}', k, 'iri' FROM people, unnest(knows) AS u(k) WHERE k NOT IN (SELECT webid FROM gate)"""
)
def entry_triples(v):
    profiles = entries.knows_visible(entries.profile_rollup(v.triple, 9), gate(v))
    docs = _docs(v).filter("state = 'done'").join(gate(v).select("webid").distinct(), "webid", "left_anti")
    fresh = rules.freshness(F.col("state"), F.col("next_eligible_at"), F.lit(NOW)).alias("freshness")
    rows = docs.select("webid", "doc_url", "slug", fresh, F.col("claimed_at").alias("modified")).join(profiles, "webid")
    return entries.entry_triples(rows.withColumn("photo", rules.https_photo(F.col("photo"))))


_VOID = entries.VOID


@query(
    _SERVED
    + f""", c AS ({_contribution('served')}), x AS (SELECT *, concat('_:', regexp_replace(k, '[^A-Za-z0-9]', '_', 'g')) AS label, substr(k, 3) AS iri FROM c)
SELECT 'urn:dataset' AS s, concat('{_VOID}', k) AS p, CAST(v AS VARCHAR) AS o FROM x WHERE k IN ('triples', 'entities') UNION ALL
SELECT 'urn:dataset', '{_VOID}propertyPartition', label FROM x WHERE k LIKE 'p:%' UNION ALL SELECT label, '{_VOID}property', iri FROM x WHERE k LIKE 'p:%' UNION ALL
SELECT label, '{_VOID}triples', CAST(v AS VARCHAR) FROM x WHERE k LIKE 'p:%' UNION ALL SELECT 'urn:dataset', '{_VOID}classPartition', label FROM x WHERE k LIKE 'c:%' UNION ALL
SELECT label, '{_VOID}class', iri FROM x WHERE k LIKE 'c:%' UNION ALL SELECT label, '{_VOID}entities', CAST(v AS VARCHAR) FROM x WHERE k LIKE 'c:%'"""
)
def void_triples(v):
    return entries.void_triples(stats.contributions(served(v)))


@query("SELECT coalesce(CASE WHEN c_custkey % 3 > 0 THEN webid END, f.doc_url) AS member, label AS name, claimed_at AS modified FROM v_fetch f LEFT JOIN v_doc d ON f.doc_url = d.doc_url".replace("CASE WHEN c_custkey", "CASE WHEN d.c_custkey"))
def member_rows(v):
    docs = v.doc.select("doc_url", F.when(F.col("c_custkey") % 3 > 0, F.col("webid")).alias("webid"), "label", F.col("claimed_at").alias("modified"))
    return entries.member_rows(v.fetch.select("doc_url"), docs)


@query(f"SELECT s AS member, min(CASE WHEN p = '{NAME}' THEN o END) AS name, CAST(NULL AS VARCHAR) AS photo, CAST(NULL AS VARCHAR) AS modified FROM v_triple GROUP BY s")
def collection_project(v):
    return entries.collection_project(v.triple)
