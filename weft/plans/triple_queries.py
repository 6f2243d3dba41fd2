"""Queries of the triple table, gates, statistics and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import gates, stats, tables, triples
from weft.plans.views import KNOWS, NAME, NOW, PERSON, RDF_TYPE
from weft.registry import query
from weft.streaming import run

_GATE = "gate AS (SELECT webid, doc_url FROM v_tombstone UNION SELECT webid, doc_url FROM v_doc WHERE state = 'tombstone')"
_SERVED = f"""WITH {_GATE}, served AS (SELECT * FROM v_triple t WHERE NOT EXISTS (SELECT 1 FROM gate g WHERE g.webid = t.webid)
  AND NOT EXISTS (SELECT 1 FROM gate g WHERE t.o_is_iri AND g.webid = t.o))
"""


def gate(v):
    return gates.gate_keys(v.tombstone, v.doc)


def served(v):
    return gates.served(v.triple, gate(v))


@query(f"WITH {_GATE} SELECT * FROM gate")
def gate_keys(v):
    return gate(v)


@query(f"WITH {_GATE} SELECT * FROM v_triple t WHERE webid NOT IN (SELECT webid FROM gate)")
def gate_subject(v):
    return gates.gate_subject(v.triple, gate(v))


@query(f"WITH {_GATE} SELECT * FROM v_triple t WHERE NOT (o_is_iri AND o IN (SELECT webid FROM gate))")
def gate_object(v):
    return gates.gate_object(v.triple, gate(v))


@query(f"WITH {_GATE} SELECT c_custkey, webid, doc_url, webid IN (SELECT webid FROM gate) OR doc_url IN (SELECT doc_url FROM gate) AS gated FROM v_person")
def gate_variant_key(v):
    return gates.gate_variant_key(v.person.select("c_custkey", "webid", "doc_url"), gate(v))


@query(f"WITH {_GATE} SELECT webid FROM v_person WHERE c_custkey % 3 = 1 AND webid IN (SELECT webid FROM gate)")
def tombstoned_subset(v):
    return gates.tombstoned_subset(v.person.filter("c_custkey % 3 = 1").select("webid"), gate(v))


@query(_SERVED + "SELECT p, count(*) AS n FROM served GROUP BY p")
def partition_rank(v):
    return stats.partition_rank(stats.property_partition(served(v)))


@query(_SERVED + "SELECT p, count(*) AS n FROM served GROUP BY p")
def property_partition(v):
    return stats.property_partition(served(v))


@query(_SERVED + f"SELECT o, count(*) AS n FROM (SELECT DISTINCT webid, s, o FROM served WHERE p = '{RDF_TYPE}' AND o_is_iri) GROUP BY o")
def class_partition(v):
    return stats.class_partition(served(v))


@query(
    _SERVED
    + f"""SELECT count(*) AS triples, count(DISTINCT webid) AS entities, count(DISTINCT CASE WHEN p = '{RDF_TYPE}' AND o_is_iri THEN o END) AS classes,
  count(DISTINCT p) AS properties, count(DISTINCT webid) AS documents FROM served"""
)
def void_totals(v):
    return stats.void_totals(served(v))


def _contribution(table):
    return f"""SELECT 'triples' AS k, count(*) AS v FROM {table} UNION ALL SELECT 'entities', count(DISTINCT webid) FROM {table}
UNION ALL SELECT concat('p:', p), count(*) FROM {table} GROUP BY p
UNION ALL SELECT concat('c:', o), count(*) FROM (SELECT DISTINCT webid, s, o FROM {table} WHERE p = '{RDF_TYPE}' AND o_is_iri) AS x GROUP BY o"""


_DELTA = f"SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM ({_contribution('v_new')}) UNION ALL SELECT k, -v FROM ({_contribution('v_old')})) GROUP BY k HAVING sum(v) <> 0"


@query(_SERVED + _contribution("served"))
def void_stats_onepass(v):
    return stats.contributions(served(v))


@query(_DELTA)
def stats_delta(v):
    return stats.delta(v.old, v.new)


@query(_contribution("v_new"))
def stats_apply(v):
    return stats.visible(stats.apply(stats.contributions(v.old), stats.delta(v.old, v.new)))


@query(_contribution("v_big_triple"))
def big_triple_stats(v):
    """Statistics of a large triple table, five triples for each line item."""
    return stats.contributions(v.big_triple)


@query(f"SELECT u.p, (SELECT count(*) FROM v_triple t WHERE t.p = u.p) AS n FROM (SELECT DISTINCT p FROM v_triple UNION ALL SELECT 'urn:absent') AS u")
def predicate_cardinality(v):
    names = v.triple.select("p").distinct().union(v.spark.createDataFrame([("urn:absent",)], "p string"))
    return stats.predicate_cardinality(stats.contributions(v.triple), names)


@query(f"SELECT least(count(*), 10000) AS n FROM v_triple WHERE p = '{KNOWS}'")
def bounded_count(v):
    return stats.bounded_count(triples.pattern(v.triple, p=KNOWS))


@query(f"""SELECT 'all' AS shape, count(*) AS n FROM v_triple UNION ALL SELECT 'predicate', count(*) FROM v_triple WHERE p = '{NAME}'
UNION ALL SELECT 'object', least(count(*), 10000) FROM v_triple WHERE p = '{RDF_TYPE}' AND o = '{PERSON}'""")
def pattern_estimate(v):
    counters = stats.contributions(v.triple)
    known = counters.filter(F.col("k").isin("triples", "p:" + NAME))
    known = known.select(F.when(F.col("k") == "triples", F.lit("all")).otherwise(F.lit("predicate")).alias("shape"), F.col("v").alias("n"))
    counted = stats.bounded_count(triples.pattern(v.triple, p=RDF_TYPE, o=PERSON)).select(F.lit("object").alias("shape"), "n")
    return known.union(counted)


@query(_SERVED + f"SELECT count(*) AS links FROM served WHERE p = '{KNOWS}'")
def linkset_size(v):
    return stats.linkset_size(stats.property_partition(served(v)))


@query("SELECT count(*) AS n FROM v_doc WHERE state IN ('pending', 'claimed')")
def frontier_depth(v):
    from weft.operators.crawl import frontier_depth as depth

    return depth(v.doc)


@query(_SERVED + "SELECT count(DISTINCT webid) AS entries, count(*) AS triples, (SELECT count(*) FROM v_doc WHERE state IN ('pending', 'claimed')) AS queued, 'ok' AS status FROM served")
def health_snapshot(v):
    from weft.operators.crawl import frontier_depth as depth

    return stats.health(stats.void_totals(served(v)), depth(v.doc))


@query(_SERVED + "SELECT s, p, o, o_is_iri FROM (SELECT DISTINCT s, p, o, o_is_iri FROM served) WHERE (s, p, o, o_is_iri) > ('https://c11.example/card#me', 'http://xmlns.com/foaf/0.1/name', '', false) ORDER BY ALL LIMIT 101")
def tpf_page(v):
    return triples.page(served(v), 100, ("https://c11.example/card#me", NAME, "", False))


@query(_SERVED + "SELECT *, CAST((row_number() OVER (ORDER BY s, p, o, o_is_iri) - 1) // 100 AS BIGINT) AS page_no, CAST((row_number() OVER (ORDER BY s, p, o, o_is_iri) - 1) % 100 AS BIGINT) AS place FROM (SELECT DISTINCT s, p, o, o_is_iri FROM served)")
def page_all(v):
    return triples.number_pages(served(v).select(*triples.TERMS).distinct(), triples.TERMS, 100)


@query(
    _SERVED
    + """, n AS (SELECT *, (row_number() OVER (ORDER BY s, p, o, o_is_iri) - 1) // 1000 AS page_no FROM (SELECT DISTINCT s, p, o, o_is_iri FROM served))
SELECT CAST(page_no AS BIGINT) AS page_no, count(*) AS n, min(s) AS first_s, max(s) AS last_s, CASE WHEN page_no < (SELECT max(page_no) FROM n) THEN CAST(page_no + 1 AS BIGINT) END AS next_page FROM n GROUP BY page_no"""
)
def paged_dump(v):
    from weft.sources.dump import manifest

    return manifest(triples.number_pages(served(v).select(*triples.TERMS).distinct(), triples.TERMS, 1000))


@query(_SERVED + "SELECT DISTINCT concat('<', s, '> <', p, '> ', CASE WHEN o_is_iri THEN concat('<', o, '>') ELSE concat('\"', o, '\"') END, ' .') AS value FROM served")
def dump_files(v):
    """What a dump in files holds, read back from them."""
    from weft.sources import dump

    folder = run.shared_folder(v.spark)
    dump.write_dump(served(v), folder, 1000)
    return dump.read_dump(v.spark, folder).select("value")


@query(f"""
WITH pats AS (SELECT c_custkey AS pattern_id, CASE WHEN c_custkey % 3 < 2 THEN webid END AS s, CASE WHEN c_custkey % 3 > 0 THEN '{KNOWS}' END AS p,
  CASE WHEN c_custkey % 3 <> 1 THEN concat('https://c', c_custkey + 1, '.example/card#me') END AS o FROM v_person)
SELECT DISTINCT pattern_id, t.s, t.p, t.o, t.o_is_iri FROM pats JOIN v_triple t ON (pats.s IS NULL OR pats.s = t.s) AND (pats.p IS NULL OR pats.p = t.p) AND (pats.o IS NULL OR pats.o = t.o)""")
def bulk_patterns(v):
    k = F.col("c_custkey") % 3
    patterns = v.person.select(
        F.col("c_custkey").alias("pattern_id"),
        F.when(k < 2, F.col("webid")).alias("s"),
        F.when(k > 0, F.lit(KNOWS)).alias("p"),
        F.when(k != 1, F.concat(F.lit("https://c"), F.col("c_custkey") + 1, F.lit(".example/card#me"))).alias("o"),
    )
    return triples.bulk_patterns(patterns, v.triple)


@query(f"""
WITH {_GATE}, touched AS (SELECT webid FROM v_person WHERE c_custkey % 2 = 0)
SELECT s, p, o, o_is_iri, webid, doc_url FROM v_old WHERE webid NOT IN (SELECT webid FROM touched) UNION ALL
SELECT s, p, o, o_is_iri, webid, doc_url FROM v_new WHERE webid IN (SELECT webid FROM touched) AND webid NOT IN (SELECT webid FROM gate)""")
def triples_replace(v):
    return triples.replace(v.old, v.new, v.person.filter("c_custkey % 2 = 0"), gate(v))


@query("SELECT webid, doc_url FROM v_person WHERE c_custkey % 4 = 0")
def stale_projection(v):
    now = F.when(F.col("c_custkey") % 4 == 0, F.concat("doc_url", F.lit("#new"))).otherwise(F.col("webid"))
    return triples.stale_projections(v.triple, v.person.select("doc_url", now.alias("webid")))


@query("SELECT DISTINCT s, p, o, o_is_iri FROM v_triple")
def ntriples_ingest(v):
    lines = triples.to_ntriples(v.triple)
    return triples.indexable(triples.from_ntriples(lines, "value"))


@query("SELECT DISTINCT concat('<', s, '> <', p, '> ', CASE WHEN o_is_iri THEN concat('<', o, '>') ELSE concat('\"', o, '\"') END, ' .') AS value FROM v_triple")
def ntriples_export(v):
    return triples.to_ntriples(v.triple)


@query("""
WITH nodes AS (SELECT DISTINCT s, p, CASE WHEN o_is_iri THEN concat('{"@id":"', o, '"}') ELSE concat('{"@value":"', o, '"}') END AS node FROM v_triple),
members AS (SELECT s, concat('"', p, '":[', string_agg(node, ',' ORDER BY node), ']') AS member FROM nodes GROUP BY s, p)
SELECT s, concat('{"@id":"', s, '",', string_agg(member, ',' ORDER BY member), '}') AS value FROM members GROUP BY s""")
def jsonld_expanded_export(v):
    return triples.expanded_json(v.triple)


@query("""SELECT d.doc_url, t.n FROM (SELECT doc_url, webid FROM v_doc WHERE state = 'done' AND c_custkey % 2 = 0) d
JOIN (SELECT webid, count(*) AS n FROM (SELECT DISTINCT webid, s, p, o, o_is_iri FROM v_triple) AS x GROUP BY webid) t ON d.webid = t.webid""")
def backfill_triples(v):
    from weft.sources.backfill import backfill

    bodies = v.triple.groupBy("doc_url").agg(
        F.array_join(F.array_sort(F.collect_set(triples.line(*[F.col(c) for c in triples.TERMS]))), "\n").alias("body")
    )
    docs = v.doc.join(bodies, "doc_url").select("doc_url", "webid", "state", F.concat("body", F.lit("\nnot a statement")).alias("body"))
    have = v.triple.join(v.person.filter("c_custkey % 2 = 1").select("webid"), "webid", "left_semi")
    good, _ = backfill(docs, have)
    return good.groupBy("doc_url").agg(F.count("*").alias("n"))


# Table maintenance.


@query("SELECT f.event_id, f.doc_url, d.label FROM v_fetch f LEFT JOIN v_doc d ON f.doc_url = d.doc_url AND d.state <> 'tombstone'")
def doc_get(v):
    return tables.lookup(v.fetch.select("event_id", "doc_url"), v.doc, ["label"])


@query("SELECT f.event_id, f.doc_url, d.doc_url IS NOT NULL AS present FROM v_fetch f LEFT JOIN v_doc d ON f.doc_url = d.doc_url AND d.state <> 'tombstone'")
def doc_exists(v):
    return tables.exists(v.fetch.select("event_id", "doc_url"), v.doc)


_CHANGES = "changes AS (SELECT event_id, doc_url, fetched_at, concat('label', event_id) AS label FROM v_fetch WHERE k % 2 = 0)"


@query(f"""WITH {_CHANGES}, latest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY doc_url ORDER BY fetched_at DESC, event_id DESC) = 1)
SELECT doc_url, label, fetched_at FROM latest UNION ALL SELECT doc_url, label, NULL FROM v_doc WHERE doc_url NOT IN (SELECT doc_url FROM latest)""")
def doc_upsert(v):
    changes = v.fetch.filter("k % 2 = 0").select("doc_url", "fetched_at", F.concat(F.lit("label"), "event_id").alias("label"))
    existing = v.doc.select("doc_url", "label", F.lit(None).cast("long").alias("fetched_at"))
    return tables.upsert(existing, changes, "doc_url", "fetched_at")


@query(f"""WITH {_CHANGES}, latest AS (SELECT * FROM changes WHERE fetched_at % 10 = 0 QUALIFY row_number() OVER (PARTITION BY doc_url ORDER BY fetched_at DESC, event_id DESC) = 1)
SELECT doc_url, label, fetched_at FROM latest UNION ALL SELECT doc_url, label, NULL FROM v_doc WHERE doc_url NOT IN (SELECT doc_url FROM latest)""")
def stored_upsert(v):
    """As ``doc_upsert`` with fewer changes, in a stored table of which only the parts with a changed document are written."""
    folder = run.shared_folder(v.spark)
    tables.store_parts(v.doc.select("doc_url", "label", F.lit(None).cast("long").alias("fetched_at")), folder, "doc_url", 32)
    changes = v.fetch.filter("k % 2 = 0 AND fetched_at % 10 = 0").select("doc_url", "fetched_at", F.concat(F.lit("label"), "event_id").alias("label"))
    tables.upsert_parts(folder, changes, "doc_url", "fetched_at")
    return tables.stored_parts(v.spark, folder)


@query("SELECT s, p, o, o_is_iri FROM v_triple WHERE o = 'https://c7.example/card#me' UNION ALL SELECT s, p, o, o_is_iri FROM v_triple WHERE s = 'https://c7.example/card#me'")
def stored_lookup(v):
    """Triples kept in order of s with filters on o: what names a person, and what a person names."""
    folder = run.shared_folder(v.spark)
    tables.store_sorted(v.triple.select(*triples.TERMS), folder, triples.TERMS, {"o": 100_000})
    kept, who = v.spark.read.parquet(folder), "https://c7.example/card#me"
    return kept.filter(F.col("o") == who).union(kept.filter(F.col("s") == who))


@query("SELECT DISTINCT concat(doc_url, k % 3) AS doc_url FROM v_fetch WHERE k % 3 > 0 UNION SELECT doc_url FROM v_fetch WHERE k % 3 = 0 AND doc_url NOT IN (SELECT doc_url FROM v_doc)")
def insert_if_absent(v):
    url = F.when(F.col("k") % 3 > 0, F.concat("doc_url", F.col("k") % 3)).otherwise(F.col("doc_url"))
    return tables.insert_if_absent(v.doc, v.fetch.select(url.alias("doc_url"), "event_id"), "doc_url", "event_id").select("doc_url")


@query("SELECT doc_url, label, CAST(NULL AS VARCHAR) AS robots, CAST(NULL AS BIGINT) AS seen FROM v_doc")
def schema_evolve(v):
    more = v.spark.createDataFrame([], "doc_url string, robots string, seen long")
    return tables.evolve(tables.evolve(v.doc.select("doc_url", "label"), more), more)


@query("SELECT event_id, doc_url, status, retry_after, fetched_at FROM v_fetch")
def fetch_log_source(v):
    """JSON lines land as files and come back as a stream."""
    from weft.sources.logs import read_fetch_stream

    folder = run.shared_folder(v.spark)
    v.fetch.select(F.to_json(F.struct("event_id", "doc_url", "status", "retry_after", "fetched_at")).alias("value")).write.text(folder)
    return run.rows_of(read_fetch_stream(v.spark, folder, "event_id long, doc_url string, status int, retry_after string, fetched_at long"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'media-type' WHEN event_id % 7 = 0 THEN 'json' END AS reject,
  event_id % 5 > 0 AND event_id % 7 > 0 AND type IN ('Announce', 'Offer', 'Add') AS accepted, CASE WHEN event_id % 7 = 0 THEN 0 ELSE n_objects END AS n_objects FROM v_suggest""")
def suggestion_source(v):
    """Notifications land as files and come back as a stream; every seventh body is cut short, every fifth of another media type."""
    from weft.sources.logs import read_suggestion_stream

    objects = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.concat(F.lit("https://c"), F.col("event_id") + i))
    body = F.to_json(F.struct(F.col("type"), F.slice(objects, 1, F.col("n_objects").cast("int")).alias("object")))
    body = F.when(F.col("event_id") % 7 == 0, F.substring(body, 1, 9)).otherwise(body)
    media = F.when(F.col("event_id") % 5 == 0, F.lit("text/html")).otherwise(F.lit("Application/Activity+JSON; charset=utf-8"))
    folder = run.shared_folder(v.spark)
    v.suggest.select("event_id", "at_ms", media.alias("content_type"), body.alias("body")).write.parquet(folder)
    rows = run.rows_of(read_suggestion_stream(v.spark, folder))
    return rows.select("event_id", "reject", (F.col("reject").isNull() & F.col("accepted")).alias("accepted"), F.size("objects").cast("long").alias("n_objects"))


from weft.plans.scalar_queries import SLUG_SQL  # noqa: E402


@query(f"SELECT webid, CASE WHEN c_custkey % 2 = 0 THEN {SLUG_SQL.format('webid')} ELSE 'known' END AS slug FROM v_person")
def backfill_slugs(v):
    from weft.sources.backfill import backfill_slugs as fill

    half = v.person.select("webid", F.when(F.col("c_custkey") % 2 == 1, F.lit("known")).alias("slug"))
    return fill(half)


@query("SELECT doc_url, label FROM v_doc WHERE state = 'done'")
def served_list_source(v):
    return v.doc.filter("state = 'done'").select("doc_url", "label")


@query("SELECT doc_url, state FROM v_doc WHERE doc_url > 'https://c11.example/card' AND state = 'done' ORDER BY doc_url LIMIT 21")
def doc_page(v):
    return tables.key_page(v.doc.filter("state = 'done'").select("doc_url", "state"), "doc_url", 20, "https://c11.example/card")
