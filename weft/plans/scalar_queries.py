"""Queries of keys, admission and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import crawl as c
from weft.functions import sql
from weft.functions import urls as u
from weft.plans.views import KNOWS, NOW
from weft.registry import query

_CANONICAL = r"""
WITH parts AS (
  SELECT page_id, url, regexp_extract(plain, '^([a-zA-Z]+)://', 1) AS scheme, regexp_extract(plain, '^[a-zA-Z]+://([^/?#]*)', 1) AS auth,
         regexp_extract(plain, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(plain, '^[^?#]*([?][^#]*)', 1) AS query,
         regexp_extract(plain, '(#.*)$', 1) AS frag FROM v_url
), keys AS (
  SELECT page_id, url, CASE WHEN lower(scheme) = 'https' AND NOT contains(auth, '@') THEN concat('https://', lower(regexp_replace(auth, ':443$', '')),
         CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/$', '') END, query) END AS doc_key, frag FROM parts
)"""


@query(_CANONICAL + "SELECT page_id, doc_key FROM keys")
def canonical_doc_url(v):
    return v.url.select("page_id", u.canonical_doc_url(F.col("url")).alias("doc_key"))


@query(_CANONICAL + "SELECT page_id, doc_key || frag AS webid FROM keys")
def canonical_webid(v):
    return v.url.select("page_id", u.canonical_webid(F.col("url")).alias("webid"))


@query("""SELECT event_id, concat('https://[::ffff:', lower(hex(CAST(split_part(dotted, '.', 1) AS INT) * 256 + CAST(split_part(dotted, '.', 2) AS INT))), ':',
  lower(hex(CAST(split_part(dotted, '.', 3) AS INT) * 256 + CAST(split_part(dotted, '.', 4) AS INT))), ']/card') AS doc_key FROM v_ip""")
def canonical_address(v):
    """An address in any of three spellings has one key."""
    tail = F.concat(F.lit(":"), "dotted", F.lit("]:443/card"))
    head = F.element_at(F.lit(["::FFFF", "0:0:0:0:0:ffff", "0000::0:fFfF"]), (F.col("event_id") % 3 + 1).cast("int"))
    return v.ip.select("event_id", u.canonical_doc_url(F.concat(F.lit("https://["), head, tail)).alias("doc_key"))


_BOTH = _CANONICAL.replace("FROM v_url", "FROM (SELECT page_id, url, plain FROM v_url UNION ALL SELECT page_id, url, url FROM pages)")


def _same(v, key):
    urls = v.url.select("page_id", "url").unionByName(v.table("pages").select("page_id", "url"))
    own = urls.select("page_id", key(F.col("url")).alias("k")).filter("k IS NOT NULL")
    groups = own.groupBy("k").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
    return groups.filter("n > 1")


@query(_BOTH + "SELECT doc_key AS k, count(*) AS n, min(page_id) AS first_page FROM keys WHERE doc_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def same_doc_pairs(v):
    return _same(v, u.canonical_doc_url)


@query(_BOTH + "SELECT doc_key || frag AS k, count(*) AS n, min(page_id) AS first_page FROM keys WHERE doc_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def same_webid_pairs(v):
    return _same(v, u.canonical_webid)


SLUG_SQL = "(SELECT string_agg(substr('abcdefghijklmnopqrstuvwxyz234567', 1 + CAST((CAST(concat('0x', substr(sha256({0}), 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1), '' ORDER BY i) FROM range(24) AS r(i))"


@query(f"SELECT webid, {SLUG_SQL.format('webid')} AS slug FROM v_person")
def slug(v):
    return v.person.select("webid", u.slug(F.col("webid")).alias("slug"))


@query("SELECT c_custkey, regexp_matches(candidate, '^[a-z2-7]{24}$') AS valid FROM (SELECT c_custkey, substr(sha256(webid), 1, 24) AS candidate FROM v_person)")
def slug_valid(v):
    return v.person.select("c_custkey", u.slug_valid(F.substring(F.sha2("webid", 256), 1, 24)).alias("valid"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(plain, '^[a-z]+://([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', '')) AS host FROM v_url")
def host_of(v):
    return v.url.select("page_id", u.host_of(F.col("url")).alias("host"))


_V4 = """(NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254)
  OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100)
  OR (a = 203 AND b = 0 AND c = 113)))"""
_OCTETS = "SELECT *, CAST(split_part(dotted, '.', 1) AS INT) AS a, CAST(split_part(dotted, '.', 2) AS INT) AS b, CAST(split_part(dotted, '.', 3) AS INT) AS c FROM v_ip"


@query(f"SELECT event_id, 4 AS family, {_V4} AS public FROM ({_OCTETS}) UNION ALL SELECT event_id, 6, CASE WHEN inner_v4 THEN {_V4} ELSE known END FROM ({_OCTETS}) JOIN v_ip6 USING (event_id)")
def ip_public(v):
    both = v.ip.select("event_id", F.lit(4).alias("family"), F.col("dotted").alias("host"))
    both = both.union(v.ip6.select("event_id", F.lit(6), "host"))
    return both.select("event_id", "family", u.ip_public(F.col("host")).alias("public"))


@query("SELECT event_id, starts_with(dotted, '127.') AS loopback FROM v_ip")
def ip_loopback(v):
    return v.ip.select("event_id", u.ip_loopback(F.col("dotted")).alias("loopback"))


@query("SELECT event_id, CASE WHEN form IN (4, 7) THEN host ELSE dotted END AS norm FROM v_ip")
def ip_normalise(v):
    return v.ip.select("event_id", u.ip_normalise(F.col("host")).alias("norm"))


@query("SELECT host, host = 'c7.example' OR ends_with(host, '7.example') AND contains(host, 'm.') OR regexp_matches(host, '(^|[.])tionsh[.]example[.]net$') AS denied FROM (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)")
def host_denied(v):
    hosts = v.table("pages").select(u.hostname(F.col("url")).alias("host")).distinct()
    return hosts.select("host", u.host_denied(F.col("host"), ["c7.example", ".tionsh.example.net"]).alias("denied"))


_ADMISSION = f"""
SELECT event_id, CASE WHEN form = 7 AND event_id % 7 <> 4 THEN 'parse' WHEN event_id % 7 = 1 THEN 'scheme' WHEN event_id % 7 = 2 THEN 'userinfo' WHEN event_id % 7 = 3 THEN 'port'
  WHEN event_id % 7 = 4 THEN 'denied' WHEN form <> 4 AND NOT {_V4} THEN 'address' END AS reason FROM ({_OCTETS})
UNION ALL SELECT event_id, CASE WHEN NOT CASE WHEN inner_v4 THEN {_V4} ELSE known END THEN 'address' END FROM ({_OCTETS}) JOIN v_ip6 USING (event_id)
UNION ALL SELECT event_id, 'parse' FROM v_ip"""


def _candidates(v):
    k = F.col("event_id") % 7
    url = (
        F.when(k == 1, F.concat(F.lit("http://"), "host", F.lit("/")))
        .when(k == 2, F.concat(F.lit("https://me@"), "host", F.lit("/")))
        .when(k == 3, F.concat(F.lit("https://"), "host", F.lit(":8443/")))
        .when(k == 4, F.concat(F.lit("https://"), "host", F.lit(".internal/")))
        .otherwise(F.concat(F.lit("https://"), "host", F.lit(":443/x?y#z")))
    )
    urls = v.ip.select("event_id", url.alias("url")).union(v.ip6.select("event_id", F.concat(F.lit("https://["), "host", F.lit("]/"))))
    # Hosts and ports that no parser takes.
    broken = ["x %s.example/", "x<%s/", "a%%00%s/", "x%s.example:65536/", "x%s.example:8a/", "[1:2:%s]/", "x^%s/", "a|%s/", "[::1%s/"]
    which = F.element_at(F.lit(broken), (F.col("event_id") % len(broken) + 1).cast("int"))
    return urls.union(v.ip.select("event_id", F.concat(F.lit("https://"), F.replace(F.replace(which, F.lit("%s"), F.col("event_id").cast("string")), F.lit("%%"), F.lit("%")))))


@query(_ADMISSION)
def admission_gate(v):
    # Urls are few bytes and much work: dealt anew, they keep all cores busy however few pieces the files have.
    return _candidates(v).repartition("event_id").select("event_id", u.admission_reason(F.col("url")).alias("reason"))


def _from_sql(v, names, text, **frames):
    """Rows of SQL that calls the session's functions ``names``."""
    sql.register(v.spark, names)
    return v.spark.sql(text, **frames)


@query(_CANONICAL + "SELECT page_id, doc_key, doc_key || frag AS webid FROM keys")
def sql_canonical(v):
    """Both keys by SQL functions."""
    text = "SELECT page_id, weft_canonical_doc_url(url) AS doc_key, weft_canonical_webid(url) AS webid FROM {u}"
    return _from_sql(v, ["canonical_doc_url", "canonical_webid"], text, u=v.url)


@query(f"SELECT {SLUG_SQL.format('webid')} AS slug, true AS valid, count(*) AS n FROM v_person GROUP BY webid")
def sql_slug(v):
    """Slugs as keys of a grouping in SQL."""
    text = "SELECT weft_slug(webid) AS slug, weft_slug_valid(weft_slug(webid)) AS valid, count(*) AS n FROM {p} GROUP BY 1, 2"
    return _from_sql(v, ["slug", "slug_valid"], text, p=v.person)


@query(_ADMISSION)
def sql_admission(v):
    return _from_sql(v, ["admission_reason"], "SELECT event_id, weft_admission_reason(url) AS reason FROM {c}", c=_candidates(v))


@query(f"SELECT event_id, {_V4} AS public FROM ({_OCTETS}) WHERE NOT starts_with(dotted, '127.')")
def sql_ip_public(v):
    """A rule in the filter and one in the output of SQL."""
    text = "SELECT event_id, weft_ip_public(dotted) AS public FROM {i} WHERE NOT weft_ip_loopback(dotted)"
    return _from_sql(v, ["ip_public", "ip_loopback"], text, i=v.ip)


@query(r"""
SELECT doc_id, nullif(array_to_string(list_slice(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(body), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), lambda w: substr(w, 1, 32)), 1, 8), ' '), '') AS terms
FROM v_text""")
def query_tokens(v):
    return v.text.select("doc_id", F.array_join(c.query_tokens(F.col("body")), " ").alias("terms"))


@query("SELECT event_id, CASE k % 9 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true ELSE false END AS noindex FROM v_fetch")
def noindex_header(v):
    return v.fetch.select("event_id", c.noindex_header(F.col("robots_header")).alias("noindex"))


_OUTCOME = """
WITH f AS (SELECT *, k % 9 IN (0, 1, 3, 5) AS noindex, k % 4 < 3 AS listed FROM v_fetch),
g AS (SELECT *, noindex OR status IN (204, 205, 304) OR status >= 400 OR listed AS type_ok FROM f),
h AS (SELECT *, CASE WHEN error_kind = 'too-large' THEN 'skipped' WHEN error_kind IS NOT NULL THEN 'pending' WHEN noindex AND status = 200 THEN 'tombstone' WHEN NOT type_ok THEN 'skipped'
  WHEN status = 304 THEN 'done' WHEN status IN (200, 204) THEN 'parse' WHEN status = 410 THEN 'tombstone' WHEN status IN (503, 429) THEN 'pending' ELSE 'skipped' END AS next_state FROM g),
o AS (SELECT *, CASE next_state WHEN 'pending' THEN 'transient' WHEN 'skipped' THEN 'deterministic' END AS fail_class FROM h)
"""


@query(_OUTCOME + "SELECT event_id, type_ok FROM o")
def content_type_ok(v):
    ok = c.content_type_ok(F.col("content_type"), F.col("status"), c.noindex_header(F.col("robots_header")))
    return v.fetch.select("event_id", ok.alias("type_ok"))


def outcomes(v):
    """Fetch results with noindex, type_ok, next_state and fail_class."""
    f = v.fetch.withColumn("noindex", c.noindex_header(F.col("robots_header")))
    ok = c.content_type_ok(F.col("content_type"), F.col("status"), F.col("noindex"))
    f = f.withColumn("type_ok", ok)
    found = f.withColumn("o", c.fetch_outcome(F.col("status"), F.col("error_kind"), F.col("noindex"), F.col("type_ok")))
    return found.withColumns({"next_state": F.col("o.next_state"), "fail_class": F.col("o.fail_class")}).drop("o")


@query(_OUTCOME + "SELECT event_id, next_state, fail_class FROM o")
def fetch_outcome(v):
    return outcomes(v).select("event_id", "next_state", "fail_class")


_SHORT = 20_000  # bytes; small tables too have longer texts


@query(f"""SELECT doc_id, strlen(body) AS bytes, strlen(body) <= 65536 AS inbox_fits, CASE WHEN strlen(body) > 262144 THEN 'too-large' WHEN n > 50000 THEN 'too-many-triples' END AS verdict,
  CASE WHEN strlen(body) > {_SHORT} THEN 'too-large' WHEN n > 500 THEN 'too-many-triples' END AS small_verdict
FROM (SELECT *, len(string_split(body, ' ')) AS n FROM v_text)""")
def size_caps(v):
    size, n = F.octet_length("body"), F.size(F.split("body", " "))
    return v.text.select(
        "doc_id",
        size.cast("long").alias("bytes"),
        c.size_verdict(size, c.INBOX_BYTES).isNull().alias("inbox_fits"),
        c.size_verdict(size, triples=n).alias("verdict"),
        c.size_verdict(size, _SHORT, n, 500).alias("small_verdict"),
    )


_RETRY = "CASE k % 8 WHEN 0 THEN 120000 WHEN 1 THEN greatest(0, 1704603600000 - fetched_at) WHEN 3 THEN 0 WHEN 4 THEN 3153600000000 END"


@query(f"SELECT event_id, CAST({_RETRY} AS BIGINT) AS delay FROM v_fetch")
def retry_after_ms(v):
    return v.fetch.select("event_id", c.retry_after_ms(F.col("retry_after"), F.col("fetched_at")).alias("delay"))


@query(f"""
SELECT event_id, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS state, CAST(CASE WHEN attempts >= 5 THEN 86400000
  WHEN {_RETRY} > 0 THEN {_RETRY} ELSE least(60000 * (1 << greatest(attempts - 1, 0)), 21600000) END AS BIGINT) AS delay
FROM (SELECT *, CAST(event_id % 7 AS INT) AS attempts FROM v_fetch)""")
def backoff_delay(v):
    asked = c.retry_after_ms(F.col("retry_after"), F.col("fetched_at"))
    b = c.backoff((F.col("event_id") % 7).cast("int"), asked)
    return v.fetch.select("event_id", b["state"].alias("state"), b["delay"].alias("delay"))


@query(f"SELECT doc_url, CASE WHEN state = 'done' THEN {NOW} + CASE WHEN is_solid THEN 1209600000 ELSE 2592000000 END WHEN state IN ('tombstone', 'skipped') THEN {NOW} + 31536000000 END AS at FROM v_doc")
def next_eligible(v):
    return v.doc.select("doc_url", c.next_eligible(F.col("state"), F.col("is_solid"), F.lit(NOW)).alias("at"))


@query(f"""
SELECT f.event_id, CASE WHEN d.doc_url IS NULL THEN true WHEN d.state IN ('tombstone', 'skipped', 'blocked') THEN false
  WHEN d.state IN ('done', 'failed') AND next_eligible_at <= {NOW} THEN true WHEN f.etag IS NOT NULL AND f.etag IS DISTINCT FROM d.etag THEN true ELSE false END AS needed
FROM v_fetch f LEFT JOIN v_doc d ON f.doc_url = d.doc_url AND d.c_custkey % 10 < 9""")
def needs_recrawl(v):
    known = v.doc.filter("c_custkey % 10 < 9").select("doc_url", "state", "next_eligible_at", F.col("etag").alias("old_etag"))
    due = F.col("state").isin("done", "failed") & (F.col("next_eligible_at") <= NOW)
    changed = F.col("etag").isNotNull() & ~F.col("etag").eqNullSafe(F.col("old_etag"))
    needed = F.when(F.col("state").isNull(), True).when(F.col("state").isin("tombstone", "skipped", "blocked"), False).otherwise(due | changed)
    return v.fetch.join(known, "doc_url", "left").select("event_id", needed.alias("needed"))


@query(f"SELECT doc_url, CASE WHEN state <> 'done' THEN 'Unreachable' WHEN next_eligible_at > 0 AND next_eligible_at <= {NOW} THEN 'Stale' ELSE 'Live' END AS freshness FROM v_doc")
def freshness(v):
    return v.doc.select("doc_url", c.freshness(F.col("state"), F.col("next_eligible_at"), F.lit(NOW)).alias("freshness"))


_LINES = "SELECT doc_url, concat('<', s, '> <', p, '> ', CASE WHEN o_is_iri THEN concat('<', o, '>') ELSE concat('\"', o, '\"') END, ' .') AS line FROM {0}"


@query(f"SELECT doc_url, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS hash FROM (SELECT DISTINCT * FROM ({_LINES.format('v_triple')})) GROUP BY doc_url")
def content_hash(v):
    from weft.operators.triples import content_hashes

    return content_hashes(v.triple)


@query(f"""
WITH a AS (SELECT doc_url, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS hash FROM (SELECT DISTINCT * FROM ({_LINES.format('v_old')})) GROUP BY doc_url),
b AS (SELECT doc_url, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS hash FROM (SELECT DISTINCT * FROM ({_LINES.format('v_new')})) GROUP BY doc_url)
SELECT b.doc_url, b.hash FROM b LEFT JOIN a USING (doc_url) WHERE a.hash IS DISTINCT FROM b.hash""")
def changed_docs(v):
    from weft.operators.triples import changed, content_hashes

    return changed(content_hashes(v.old), content_hashes(v.new))


@query("SELECT webid, bool_or(p = 'http://www.w3.org/ns/solid/terms#oidcIssuer') AS is_solid FROM v_triple GROUP BY webid")
def is_solid(v):
    from weft.operators.triples import solid

    return solid(v.triple)


@query("SELECT page_id, CASE WHEN starts_with(lower(url), 'https://') THEN url END AS photo FROM pages")
def https_photo(v):
    return v.table("pages").select("page_id", c.https_photo(F.col("url")).alias("photo"))


@query("SELECT s, o, CASE WHEN regexp_matches(o, '^(https?|urn):') THEN 'iri' ELSE 'literal' END AS kind FROM v_triple")
def object_kind(v):
    return v.triple.select("s", "o", c.object_kind(F.col("o")).alias("kind"))


@query("SELECT doc_id, concat('sha256-', substr(sha256(concat(body, chr(0), 'text/turtle', chr(0), '')), 1, 16)) AS etag FROM v_text")
def etag(v):
    return v.text.select("doc_id", c.etag(F.col("body"), F.lit("text/turtle"), F.lit(None).cast("string")).alias("etag"))


_CROCKFORD = "'0123456789ABCDEFGHJKMNPQRSTVWXYZ'"
NOTIFICATION_SQL = f"""concat((SELECT string_agg(substr({_CROCKFORD}, 1 + CAST((at_ms >> (45 - 5 * i)) & 31 AS INT), 1), '' ORDER BY i) FROM range(10) AS r(i)),
  (SELECT string_agg(substr({_CROCKFORD}, 1 + CAST((CAST(concat('0x', substr(sha256(concat('event', event_id)), 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1), '' ORDER BY i) FROM range(16) AS r(i)))"""


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('01HQ', lpad(CAST(event_id AS VARCHAR), 22, '0')) ELSE {NOTIFICATION_SQL} END AS id, true AS valid FROM v_suggest")
def notification_id(v):
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("01HQ"), F.lpad(F.col("event_id").cast("string"), 22, "0"))).when(F.col("event_id") % 3 == 1, F.lit("mine"))
    made = c.notification_key(given, F.col("at_ms").cast("long"), F.concat(F.lit("event"), "event_id"))
    return v.suggest.select("event_id", made.alias("id")).withColumn("valid", c.notification_id_valid(F.col("id")))


@query("SELECT id, strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d') AS day FROM v_hit")
def day_key(v):
    return v.hit.select("id", c.day_key(F.col("at_ms")).alias("day"))


@query("SELECT doc_id, CASE WHEN length(body) > 500 THEN concat(substr(body, 1, 500), '…') ELSE body END AS message FROM v_text")
def error_truncate(v):
    return v.text.select("doc_id", c.error_truncate(F.col("body")).alias("message"))


@query("""SELECT event_id, CASE WHEN s IN (201, 202) THEN 'submitted' WHEN s IN (200, 409) THEN 'already-indexed' WHEN s = 429 THEN 'rate-limited'
  WHEN s IN (400, 413, 415, 422) THEN 'invalid' ELSE 'error' END AS outcome
FROM (SELECT event_id, [200, 201, 202, 409, 429, 400, 413, 415, 422, 500][1 + event_id % 10] AS s FROM v_suggest)""")
def suggest_outcome(v):
    codes = F.lit([200, 201, 202, 409, 429, 400, 413, 415, 422, 500])
    return v.suggest.select("event_id", c.suggest_outcome(F.element_at(codes, (F.col("event_id") % 10 + 1).cast("int"))).alias("outcome"))


@query("SELECT event_id, event_type NOT IN ('view', 'click', 'error') AS rejected FROM events")
def enum_check(v):
    from weft.operators.tables import enum_rejected

    return v.table("events").select("event_id", enum_rejected({"event_type": ["view", "click", "error"]}).alias("rejected"))


@query(_CANONICAL + "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('https://known', page_id, '.example/#me') ELSE doc_key || '#me' END AS subject FROM keys")
def subject_default(v):
    known = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://known"), "page_id", F.lit(".example/#me")))
    return v.url.select("page_id", F.coalesce(known, F.concat(u.canonical_doc_url(F.col("url")), F.lit("#me"))).alias("subject"))


@query(f"SELECT s, p, o, o_is_iri FROM v_triple WHERE starts_with(s, 'https://') AND p <> '{KNOWS}'")
def indexable_terms(v):
    from weft.operators.triples import indexable

    blank = (F.col("p") == KNOWS).alias("blank")
    kinds = v.triple.select(
        F.when(blank, F.lit("blank")).otherwise(F.lit("iri")).alias("s_kind"), "s", F.lit("iri").alias("p_kind"), "p",
        F.when(F.col("o_is_iri"), F.lit("iri")).otherwise(F.lit("literal")).alias("o_kind"), "o",
    )
    return indexable(kinds)
