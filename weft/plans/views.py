"""Representative linked-data tables derived from the star schema, written once in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
FOAF = "http://xmlns.com/foaf/0.1/"
PERSON, AGENT, NAME, KNOWS = FOAF + "Person", FOAF + "Agent", FOAF + "name", FOAF + "knows"
ISSUER = "http://www.w3.org/ns/solid/terms#oidcIssuer"
STORAGE = "http://www.w3.org/ns/pim/space#storage"
#: "Now" of every query: 2024-01-07T04:00:00Z, inside the events' range.
NOW = 1704600000000
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: View name -> SQL; ``{ms}`` is the epoch milliseconds of ``ts``.
VIEWS = {
    "v_person": """
SELECT c_custkey, concat('https://c', c_custkey, '.example/card#me') AS webid, concat('https://c', c_custkey, '.example/card') AS doc_url,
       c_name AS name, c_acctbal > 0 AS solid, c_nationkey FROM customer""",
    "v_triple": f"""
SELECT webid AS s, '{RDF_TYPE}' AS p, '{PERSON}' AS o, true AS o_is_iri, webid, doc_url FROM v_person
UNION ALL SELECT webid, '{NAME}', name, false, webid, doc_url FROM v_person
UNION ALL SELECT webid, '{ISSUER}', concat('https://idp', c_nationkey, '.example'), true, webid, doc_url FROM v_person WHERE solid
UNION ALL SELECT webid, '{STORAGE}', concat('https://s', c_custkey, '.example/'), true, webid, doc_url FROM v_person WHERE solid AND c_custkey % 3 > 0
UNION ALL SELECT webid, '{KNOWS}', concat('https://c', o_orderkey % (SELECT count(*) FROM customer), '.example/card#me'), true, webid, doc_url
FROM orders JOIN v_person ON o_custkey = c_custkey""",
    "v_variant": f"""
SELECT concat(webid, '-old') AS s, '{NAME}' AS p, name AS o, false AS o_is_iri, concat(webid, '-old') AS webid, doc_url, c_custkey FROM v_person WHERE c_custkey % 10 IN (3, 7)""",
    "v_tombstone": """
SELECT concat('https://c', c_custkey, '.example/card#me') AS webid, concat('https://c', c_custkey, '.example/card') AS doc_url,
       CASE c_custkey % 4 WHEN 0 THEN 'opt-out' WHEN 1 THEN 'erasure' WHEN 2 THEN 'abuse' ELSE 'noindex' END AS reason,
       1700000000000 + c_custkey AS created_at, concat('proof', c_custkey) AS proof FROM customer WHERE c_custkey % 50 = 7""",
    "v_doc": """
SELECT c_custkey, doc_url, webid, concat('c', c_custkey, '.example') AS host,
       CASE c_custkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' WHEN 2 THEN 'done' WHEN 3 THEN 'failed'
                          WHEN 4 THEN 'tombstone' WHEN 5 THEN 'skipped' ELSE 'blocked' END AS state,
       c_custkey % 4 AS depth, 1700000000000 + (c_custkey * 7919 % 100000) * 100000 AS next_eligible_at,
       1704500000000 + c_custkey * 100000 AS claimed_at, c_custkey % 6 AS attempts, concat('t', c_custkey % 3) AS claim_token,
       concat('e', c_custkey % 3) AS etag, CASE WHEN c_custkey % 5 > 0 THEN concat('h', c_custkey % 4) END AS content_hash,
       solid AS is_solid, c_custkey % 13 = 0 AS noindex, name AS label,
       CASE WHEN c_custkey % 3 > 0 THEN concat('root', c_custkey % 20) END AS root_seed FROM v_person""",
    # ``plain`` is a form of ``url`` whose key can be read off it.
    "v_url": """
SELECT page_id, CASE page_id % 10 WHEN 1 THEN concat(scheme, upper(host), path, tail) WHEN 6 THEN concat(scheme, host, '/a/./b/../%2E%2e', path, tail)
         WHEN 7 THEN concat(scheme, host, path, '/ é', tail) WHEN 8 THEN concat(scheme, 'bücher.', host, path, tail)
         WHEN 9 THEN concat(' ', scheme, host, replace(path, '/', chr(92)), tail) ELSE plain END AS url, plain
FROM (SELECT *, CASE page_id % 10 WHEN 2 THEN concat(scheme, host, ':443', path, tail) WHEN 3 THEN concat(scheme, 'user@', host, path, tail)
         WHEN 4 THEN concat(scheme, host, path, '/', tail) WHEN 5 THEN concat(regexp_extract(url, '^([^#]*)', 1), '#me')
         WHEN 7 THEN concat(scheme, host, path, '/%20%C3%A9', tail) WHEN 8 THEN concat(scheme, 'xn--bcher-kva.', host, path, tail) ELSE url END AS plain
FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://)', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
             regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(.*)$', 1) AS tail FROM pages) AS parts) AS forms""",
    "v_text": """
SELECT doc_id, concat('https://d', doc_id, '.example/card') AS doc_url, regexp_extract(substr(text, 1, 60), '^([^.]*)', 1) AS label, text AS body,
       CASE WHEN doc_id % 17 = 3 THEN 'tombstone' ELSE 'done' END AS state FROM documents""",
    "v_fetch": """
SELECT event_id, user_id % (SELECT count(*) FROM customer) AS c_custkey, concat('https://c', user_id % (SELECT count(*) FROM customer), '.example/card') AS doc_url, k,
       concat('c', user_id % (SELECT count(*) FROM customer), '.example') AS host,
       CASE k % 11 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' WHEN 2 THEN 'too-large' WHEN 3 THEN 'unheard-of' END AS error_kind,
       CASE k % 4 WHEN 0 THEN 'text/turtle; charset=utf-8' WHEN 1 THEN 'application/ld+json' WHEN 2 THEN 'Text/N3' ELSE 'text/html' END AS content_type,
       concat('t', k % 3) AS claim_token, at_ms AS fetched_at,
       CASE event_type WHEN 'view' THEN CASE WHEN k % 6 = 5 THEN 204 ELSE 200 END WHEN 'click' THEN 304 WHEN 'purchase' THEN 503 WHEN 'signup' THEN 429
                       ELSE CASE WHEN k % 2 = 0 THEN 410 ELSE 404 END END AS status,
       CASE k % 9 WHEN 0 THEN 'noindex' WHEN 1 THEN '' WHEN 2 THEN 'all, nofollow' WHEN 3 THEN 'bot: noindex' WHEN 4 THEN 'bot: nofollow' WHEN 5 THEN 'odd' END AS robots_header,
       CASE k % 8 WHEN 0 THEN '120' WHEN 1 THEN 'Sun, 07 Jan 2024 05:00:00 GMT' WHEN 2 THEN 'soon' WHEN 3 THEN '-5' WHEN 4 THEN '1e30' WHEN 5 THEN 'Infinity' WHEN 6 THEN 'NaN' END AS retry_after,
       CASE WHEN k % 3 > 0 THEN concat('e', k % 3) END AS etag
FROM (SELECT event_id, user_id, event_type, {ms} AS at_ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) AS e""",
    "v_hit": "SELECT event_id AS id, concat('ip:', user_id) AS key, {ms} AS at_ms FROM events",
    "v_suggest": """
SELECT event_id, at_ms, user_id, CASE k % 5 WHEN 0 THEN 'Announce' WHEN 1 THEN 'Offer' WHEN 2 THEN 'Add' WHEN 3 THEN 'Like' ELSE '' END AS type, k,
       k % 12 AS n_objects, user_id % 2 = 0 AS redacted, k % 4 = 0 AS processed
FROM (SELECT event_id, user_id, event_type, {ms} AS at_ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) AS e
WHERE event_type IN ('signup', 'view')""",
    "v_suggest_object": """
SELECT event_id, at_ms, type, i, concat('https://c', (event_id + i) % (SELECT count(*) FROM customer), '.example/card#me') AS object
FROM v_suggest, (SELECT c_custkey AS i FROM customer WHERE c_custkey < 11) AS n WHERE i < n_objects""",
    "v_nonce": """
SELECT event_id, concat('https://c', user_id, '.example/card#me') AS webid, {ms} AS at_ms,
       CASE event_type WHEN 'signup' THEN 'issue' ELSE 'confirm' END AS action FROM events WHERE event_type IN ('signup', 'purchase')""",
    "v_old": "SELECT * FROM v_triple",
    "v_new": f"""
SELECT s, p, CASE WHEN p = '{RDF_TYPE}' AND c_custkey % 5 = 0 THEN '{AGENT}' ELSE o END AS o, o_is_iri, t.webid, t.doc_url
FROM v_triple AS t JOIN v_person AS u ON t.webid = u.webid WHERE NOT (p = '{KNOWS}' AND c_custkey % 3 = 0)""",
    "v_big_triple": f"""
SELECT s, p, o, o_is_iri, s AS webid, doc_url FROM (SELECT *, concat('https://l', l_orderkey, '-', l_linenumber, '.example/card') AS doc_url,
       concat('https://l', l_orderkey, '-', l_linenumber, '.example/card#me') AS s FROM lineitem) AS l,
  (SELECT n_nationkey AS n FROM nation WHERE n_nationkey < 5) AS five,
  LATERAL (SELECT CASE n WHEN 0 THEN '{RDF_TYPE}' WHEN 1 THEN '{NAME}' WHEN 2 THEN '{ISSUER}' ELSE '{KNOWS}' END AS p,
                  CASE n WHEN 0 THEN '{PERSON}' WHEN 1 THEN concat('Line ', l_orderkey) WHEN 2 THEN concat('https://idp', l_suppkey % 25, '.example')
                         WHEN 3 THEN concat('https://l', l_partkey, '-1.example/card#me') ELSE concat('https://l', l_suppkey, '-2.example/card#me') END AS o, n <> 1 AS o_is_iri) AS t""",
    "v_ip": """
SELECT event_id, event_id % 9 AS form, CASE event_id % 9 WHEN 0 THEN concat(a, '.', b, '.', c, '.', d) WHEN 1 THEN concat('', ((a * 256 + b) * 256 + c) * 256 + d)
         WHEN 2 THEN concat(a, '.', b * 65536 + c * 256 + d) WHEN 3 THEN concat(a, '.', b, '.', c * 256 + d) WHEN 4 THEN concat('h', a, '.example')
         WHEN 5 THEN concat('0x00', lower(hex(((a * 256 + b) * 256 + c) * 256 + d))) WHEN 6 THEN concat('0', CAST(floor(a / 64) AS INT), CAST(floor(a / 8) AS INT) % 8, a % 8, '.', b, '.', c, '.', d)
         WHEN 7 THEN concat('0xfffffffffffffffff', a) ELSE concat(a, '.', b, '.', c, '.', d, '.') END AS host,
       concat(a, '.', b, '.', c, '.', d) AS dotted
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 192 WHEN 1 THEN 172 ELSE event_id * 37 % 256 END AS a,
             CASE event_id % 3 WHEN 0 THEN 168 - event_id % 2 WHEN 1 THEN event_id % 40 ELSE event_id * 11 % 256 END AS b,
             event_id * 7 % 256 AS c, event_id * 13 % 256 AS d FROM events) AS x""",
    # ``inner``: public is what the address inside is.
    "v_ip6": """
SELECT event_id, form IN (0, 1, 7, 8) AS inner_v4, form = 9 AS known,
       CASE form WHEN 0 THEN concat('::ffff:', dotted) WHEN 1 THEN concat('0:0:0:0:0:FFFF:', high, ':', low) WHEN 2 THEN concat('::', dotted) WHEN 3 THEN concat('::', high, ':', low)
         WHEN 4 THEN '0::1' WHEN 5 THEN concat('fe80::', low) WHEN 6 THEN concat('fd00::', low) WHEN 7 THEN concat('2002:', high, ':', low, '::1')
         WHEN 8 THEN concat('64:ff9b::', dotted) ELSE concat('2606:4700::', low) END AS host
FROM (SELECT event_id, event_id % 10 AS form, dotted, lower(hex(a * 256 + b)) AS high, lower(hex(c * 256 + d)) AS low
      FROM (SELECT event_id, dotted, CAST(split_part(dotted, '.', 1) AS INT) AS a, CAST(split_part(dotted, '.', 2) AS INT) AS b,
                   CAST(split_part(dotted, '.', 3) AS INT) AS c, CAST(split_part(dotted, '.', 4) AS INT) AS d FROM v_ip) AS parts) AS x""",
}

_MS = {"spark": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "duckdb": "(epoch_us(ts) // 1000)"}


def _named(sql: str, names) -> list[str]:
    words = set(re.findall(r"\b\w+\b", sql))
    return [n for n in names if n in words]


class Views:
    """The views over one directory as DataFrames: ``Views(spark, sf_dir).triple`` is ``v_triple``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        view = "v_" + name
        if view not in VIEWS:
            raise AttributeError(name)
        if view not in self._made:
            sql = VIEWS[view].replace("{ms}", _MS["spark"])
            uses = {n: self.table(n) for n in _named(sql, TABLES)} | {n: getattr(self, n[2:]) for n in _named(sql, VIEWS)}
            for n in uses:
                sql = re.sub(rf"\b(FROM|JOIN|,) ?\b{n}\b", rf"\1 {{{n}}}", sql)
            self._made[view] = self.spark.sql(sql, **uses)
        return self._made[view]


def oracle(body: str) -> str:
    """DuckDB SQL of ``body`` with the views that it names before it."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in _named(sql, VIEWS):
            if name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    views = [f"{n} AS MATERIALIZED ({VIEWS[n].replace('{ms}', _MS['duckdb'])})" for n in order]
    body = body.strip()
    more = body[4:].lstrip() if body.upper().startswith("WITH") else ""
    more = more[len("RECURSIVE") :].lstrip() if more.upper().startswith("RECURSIVE") else more
    if not views:
        return body
    return "WITH RECURSIVE " + ",\n".join(views) + (",\n" + more if more else "\n" + body)
