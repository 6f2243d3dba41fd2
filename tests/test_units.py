"""Operators on small literal fixtures, and the invariants of the index."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import crawl, urls
from weft.operators import entries, erase, gates, graph, intake, search, stats, tables, triples
from weft.operators import crawl as frontier
from weft.sources import backfill, dump, logs

FOAF = "http://xmlns.com/foaf/0.1/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TRIPLE = "s string, p string, o string, o_is_iri boolean, webid string, doc_url string"


def column(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r.x for r in rows.select("n", fn(F.col("v")).alias("x")).orderBy("n").collect()]


def person(name, *knows, kind="Person"):
    me, doc = f"https://{name}.example/card#me", f"https://{name}.example/card"
    rows = [(me, TYPE, FOAF + kind, True, me, doc), (me, FOAF + "name", name.title(), False, me, doc)]
    return rows + [(me, FOAF + "knows", f"https://{k}.example/card#me", True, me, doc) for k in knows]


def test_canonical_keys(spark):
    cases = {
        "https://Alice.Example:443/card/": ("https://alice.example/card", "https://alice.example/card"),
        "https://alice.example/card#me": ("https://alice.example/card", "https://alice.example/card#me"),
        "https://alice.example": ("https://alice.example/", "https://alice.example/"),
        "https://alice.example/a?b=/#c": ("https://alice.example/a?b=/", "https://alice.example/a?b=/#c"),
        "https://alice.example:8443/x": ("https://alice.example:8443/x", "https://alice.example:8443/x"),
        "http://alice.example/": (None, None), "https://me@alice.example/": (None, None), "not a url": (None, None), "": (None, None),
        "https://ä.example/": ("https://xn--4ca.example/", "https://xn--4ca.example/"), "HTTPS://A.example/B/": ("https://a.example/B", "https://a.example/B"),
    }
    docs, ids = column(spark, urls.canonical_doc_url, list(cases)), column(spark, urls.canonical_webid, list(cases))
    assert list(zip(docs, ids)) == list(cases.values())
    again = [d for d in docs if d]
    assert column(spark, urls.canonical_doc_url, again) == again
    assert column(spark, urls.canonical_doc_url, [None]) == [None]


def test_slug(spark):
    assert column(spark, urls.slug, ["https://alice.example/card#me", None]) == ["ru2i6daoh5cfw56lfl6zq3nn", None]
    assert column(spark, urls.slug_valid, ["ru2i6daoh5cfw56lfl6zq3nn", "RU2I", "1" * 24]) == [True, False, False]


PUBLIC = ["8.8.8.8", "172.15.0.1", "172.32.0.1", "100.128.0.1", "2001:4860:4860::8888", "::ffff:8.8.8.8", "2002:0808:0808::1", "64:ff9b::8.8.8.8"]
PRIVATE = """0.0.0.0 10.1.2.3 127.0.0.1 172.16.0.1 172.31.255.255 192.168.0.1 169.254.169.254 100.64.0.1 224.0.0.1 240.0.0.1 255.255.255.255 192.0.2.1
198.18.0.1 198.51.100.7 203.0.113.9 :: ::1 0:0:0:0:0:0:0:1 fe80::1 febf::1 fc00::1 fdff::1 ff02::1 ::ffff:10.0.0.1 0:0:0:0:0:ffff:0a00:0001 2002:0a00:0001::1
64:ff9b::10.0.0.1 1.2.3 1.2.3.4.5 1.2.3.256 example.com 1::2::3 :::: 12345::1""".split()


def test_addresses(spark):
    assert column(spark, urls.ip_public, PUBLIC) == [True] * len(PUBLIC)
    assert column(spark, urls.ip_public, PRIVATE) == [False] * len(PRIVATE)
    loop = ["127.0.0.1", "127.9.9.9", "::1", "::ffff:127.0.0.1", "128.0.0.1", "::2", "localhost"]
    assert column(spark, urls.ip_loopback, loop) == [True] * 4 + [False] * 3
    forms = {"2130706433": "127.0.0.1", "0x7f000001": "127.0.0.1", "0177.0.0.1": "127.0.0.1", "127.1": "127.0.0.1", "10.257": "10.0.1.1", "4294967296": "4294967296", "Host.Example": "host.example", "1.2.3.4": "1.2.3.4"}
    assert column(spark, urls.ip_normalise, list(forms)) == list(forms.values())


def test_admission(spark):
    cases = {
        "https://ok.example/": None, "nonsense": "parse", "http://ok.example/": "scheme", "https://u@ok.example/": "userinfo", "https://ok.example:8443/": "port",
        "https://a.internal/": "denied", "https://LOCALHOST/": "denied", "https://2130706433/": "address", "https://[::1]/": "address", "https://[2001:4860:4860::8888]/": None, "https://8.8.8.8/": None,
    }
    assert column(spark, urls.admission_reason, list(cases)) == list(cases.values())


HOSTILE = ["a & b | !c", "'; DROP TABLE doc; --", '"quoted" <-> x:*', "\x00\x01", "日本語", "a" * 500, " ".join(f"w{i}" for i in range(40)), "  ", ""]


def test_query_tokens(spark):
    found = column(spark, crawl.query_tokens, HOSTILE)
    assert found[0] == ["a", "b", "c"] and found[3] is None and found[4] is None and found[7] is None and found[8] is None
    assert found[5] == ["a" * 32] and len(found[6]) == 8
    again = column(spark, crawl.query_tokens, [" ".join(f) for f in found if f])
    assert again == [f for f in found if f]


def test_robots(spark):
    cases = {None: False, "": True, "noindex": True, "none": True, "nofollow": False, "bot: noindex": True, "bot: nofollow": False, "sparkly": True, " , ": True, "ALL, index": False}
    assert column(spark, crawl.noindex_header, list(cases)) == list(cases.values())


def test_ntriples(spark):
    text = "<urn:a> <urn:p> \"x \\\"q\\\" \\\\u0041 \\u00e9\\n\"@en .\n_:b <urn:p> <urn:c> .\n\n# comment\nbroken line\n<urn:a> <urn:q> <urn:c> ."
    parsed = triples.from_ntriples(spark.createDataFrame([("d", text)], "doc_url string, body string"))
    assert parsed.filter("p IS NULL").count() == 1
    good = triples.indexable(parsed).orderBy("p").collect()
    assert [(r.s, r.p, r.o, r.o_is_iri) for r in good] == [("urn:a", "urn:p", 'x "q" \\u0041 é\n', False), ("urn:a", "urn:q", "urn:c", True)]
    lines = triples.to_ntriples(triples.indexable(parsed))
    back = triples.indexable(triples.from_ntriples(lines, "value")).orderBy("p").collect()
    assert [(r.s, r.p, r.o) for r in back] == [(r.s, r.p, r.o) for r in good]


def test_expanded_json(spark):
    rows = spark.createDataFrame(person("alice", "bob"), TRIPLE)
    assert triples.expanded_json(rows).first().value == (
        '{"@id":"https://alice.example/card#me","http://www.w3.org/1999/02/22-rdf-syntax-ns#type":[{"@id":"http://xmlns.com/foaf/0.1/Person"}],'
        '"http://xmlns.com/foaf/0.1/knows":[{"@id":"https://bob.example/card#me"}],"http://xmlns.com/foaf/0.1/name":[{"@value":"Alice"}]}'
    )


def test_patterns_and_pages(spark):
    rows = spark.createDataFrame([t for n in range(5) for t in person(f"p{n}")], TRIPLE)
    assert triples.pattern(rows, p=FOAF + "name", o="P1", o_is_iri=False).count() == 1
    assert triples.pattern(rows, p=FOAF + "name", o="P1", o_is_iri=True).count() == 0
    names, seen, after = triples.pattern(rows, p=FOAF + "name"), [], None
    while True:
        got = [tuple(r) for r in triples.page(names, 2, after).collect()]
        seen.append(got[:2])
        if len(got) < 3:
            break
        after = got[1]
    assert [len(p) for p in seen] == [2, 2, 1] and len({t for p in seen for t in p}) == 5
    numbered = triples.number_pages(names.select(*triples.TERMS).distinct(), triples.TERMS, 2).orderBy("page_no", "place").collect()
    assert [(r.s, r.p, r.o, r.o_is_iri) for r in numbered] == [t for p in seen for t in p]


def test_all_variable_pattern(spark):
    rows = spark.createDataFrame(person("a", "b"), TRIPLE)
    asked = spark.createDataFrame([(1, None, None, None), (2, None, FOAF + "knows", None)], "pattern_id int, s string, p string, o string")
    found = triples.bulk_patterns(asked, rows).groupBy("pattern_id").count().collect()
    assert {r.pattern_id: r["count"] for r in found} == {1: 3, 2: 1}


def counters(df):
    return {r.k: r.v for r in stats.visible(df).collect()}


def test_statistics_by_deltas(spark):
    old = spark.createDataFrame(person("alice", "bob"), TRIPLE)
    new = spark.createDataFrame(person("alice", kind="Agent"), TRIPLE)
    first = stats.contributions(old)
    assert counters(first) == {"triples": 3, "entities": 1, "p:" + TYPE: 1, "p:" + FOAF + "name": 1, "p:" + FOAF + "knows": 1, "c:" + FOAF + "Person": 1}
    after = stats.apply(first, stats.delta(old, new))
    assert counters(after) == counters(stats.contributions(new))
    gone = stats.apply(after, stats.delta(new, new.limit(0)))
    assert counters(gone) == {} and counters(stats.apply(gone, stats.delta(new, new.limit(0)))) == {}


def test_erasure_on_every_surface(spark):
    people = [("alice", "bob"), ("bob",), ("friend", "alice", "bob")]
    rows = spark.createDataFrame([t for p in people for t in person(*p)], TRIPLE)
    docs = spark.createDataFrame([(f"https://{p[0]}.example/card", f"https://{p[0]}.example/card#me", "done", p[0], "slug-" + p[0]) for p in people], "doc_url string, webid string, state string, label string, slug string")
    inbox = spark.createDataFrame([(1, "about alice"), (2, "about bob")], "id long, body string")
    objects = spark.createDataFrame([(1, "https://alice.example/card"), (2, "https://bob.example/card#me")], "id long, object string")
    tombs = spark.createDataFrame([], "webid string, doc_url string, reason string, created_at long, proof string")
    gone = spark.createDataFrame([("https://alice.example/card#me", "https://alice.example/card", "erasure", 5, "p")], tombs.schema)
    index = erase.Index(docs, rows, stats.contributions(rows), tombs, inbox, objects)
    after = erase.erase(index, gone)
    gate = gates.gate_keys(after.tombstones, after.docs)
    served = gates.served(after.triples, gate).collect()
    assert not any("alice" in str(tuple(t)) for t in served) and len(served) == 5
    assert {(r.doc_url, r.state, r.webid, r.label) for r in after.docs.collect() if r.state == "tombstone"} == {("https://alice.example/card", "tombstone", None, None)}
    assert [(r.id, r.body) for r in after.inbox.orderBy("id").collect()] == [(1, ""), (2, "about bob")]
    assert [r.id for r in after.inbox_objects.collect()] == [2]
    assert counters(after.stats)["entities"] == 2
    twice = erase.erase(after, gone.withColumn("reason", F.lit("abuse")).withColumn("created_at", F.lit(9).cast("long")))
    assert counters(twice.stats) == counters(after.stats)
    assert [(r.reason, r.created_at) for r in twice.tombstones.collect()] == [("erasure", 5)]
    asked = spark.createDataFrame([("https://alice.example/card#me", "urn:x"), ("urn:y", "https://alice.example/card"), ("urn:z", "urn:z")], "webid string, doc_url string")
    status = intake.suggestion_status(asked, after.docs.withColumn("terminal_at", F.lit(0)), after.tombstones, 10)
    assert sorted(r.status for r in status.collect()) == ["tombstoned", "tombstoned", "unknown"]


def test_null_owner_passes_the_gate(spark):
    rows = spark.createDataFrame([("s", "p", "o", False, None, None), ("s", "p", "o", False, "w", "d")], TRIPLE)
    gate = spark.createDataFrame([("w", "d")], "webid string, doc_url string")
    assert [r.webid for r in gates.gate_subject(rows, gate).collect()] == [None]


def test_cycles_end_and_budget_is_shared(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a2"), ("b", "b2"), ("c", "c2")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "doc_url string")
    depths = {r.doc_url: r.depth for r in graph.expand(seeds, edges).collect()}
    assert depths == {"a": 0, "b": 1, "a2": 1, "c": 2, "b2": 2, "c2": 3}
    assert graph.expand_budgeted(seeds, edges, budget=4).count() == 5
    gate = spark.createDataFrame([("b",)], "doc_url string")
    assert {r.doc_url for r in graph.expand(seeds, edges, gate=gate).collect()} == {"a", "a2"}


def test_rate_limit_grants_exactly_n(spark):
    hits = spark.createDataFrame([("k", i, i) for i in range(15)] + [("k", 100 + i, 50 + i) for i in range(3)], "key string, at_ms long, id long")
    rows = intake.rate_limit(hits, 50, 3).orderBy("at_ms").collect()
    assert [r.granted for r in rows] == [True] * 3 + [False] * 12 + [True] * 3


def test_claims_are_disjoint_and_complete(spark):
    docs = spark.createDataFrame([(f"d{i}", "pending", i % 3, 0, 0, 0, False, "") for i in range(40)], "doc_url string, state string, depth int, next_eligible_at long, claimed_at long, attempts int, noindex boolean, claim_token string")
    parts = frontier.claim_partition(docs, 4).collect()
    assert len({r.doc_url for r in parts}) == 40 and {r.worker for r in parts} <= set(range(4))
    batch = frontier.claim(docs, 10, 5, "t").collect()
    assert [r.depth for r in batch] == [0] * 5 and all(r.attempts == 1 and r.state == "claimed" for r in batch)


def test_search(spark):
    docs = spark.createDataFrame([("a", "Alice", "likes tea"), ("b", "Bob", "knows alice and tea"), ("c", "Carol", "coffee"), ("d", None, None)], "doc_url string, label string, body string")
    ask = lambda *w: spark.createDataFrame([(1, list(w))], "query_id int, words array<string>")
    ranked = search.page(search.rank(ask("alice"), search.postings(docs), search.lengths(docs)), 5).collect()
    assert [r.doc_url for r in ranked] == ["a", "b"] and ranked[0]["rank"] > ranked[1]["rank"]
    assert search.match(ask("xylophone"), search.postings(docs)).count() == 0
    assert search.match(ask("alice", "tea"), search.postings(docs)).count() == 2


def test_activity(spark):
    rows = [(1, "x", "type", "Announce"), (1, "x", "object", "u1"), (1, "y", "object", "stray"), (2, "x", "object", "u1"), (3, "x", "type", "Like"), (3, "x", "object", "u1")]
    found = intake.activity_extract(spark.createDataFrame(rows, "id long, subject string, predicate string, value string")).collect()
    assert [(r.id, r.objects) for r in found] == [(1, ["u1"])]
    sizes = intake.candidate_bounds(spark.createDataFrame([([],), (["a"],), (["a"] * 11,)], "objects array<string>")).collect()
    assert [r.in_bounds for r in sizes] == [False, True, False]


def test_suggestions_keep_bad_rows(spark):
    rows = [(1, "application/ld+json; x=y", '{"type":"Announce","object":["u","u"]}'), (2, "application/json", "{broken"), (3, "text/html", "{}"), (4, "application/json", '{"type":"Like"}')]
    found = logs.parse_suggestions(spark.createDataFrame(rows, "event_id long, content_type string, body string")).orderBy("event_id").collect()
    assert [(r.reject, r.accepted, r.objects) for r in found] == [(None, True, ["u"]), ("json", False, []), ("media-type", False, []), (None, False, [])]


def test_backfill_sends_bad_lines_to_rejects(spark):
    docs = spark.createDataFrame([("d", "w", "done", "<urn:a> <urn:p> <urn:b> .\nbad")], "doc_url string, webid string, state string, body string")
    good, bad = backfill.backfill(docs, spark.createDataFrame([], TRIPLE))
    assert good.count() == 1 and [r.line for r in bad.collect()] == ["bad"]


def test_dump(spark, tmp_path):
    rows = spark.createDataFrame(person("alice", "bob"), TRIPLE)
    numbered = triples.number_pages(rows.select(*triples.TERMS), triples.TERMS, 2)
    pages = dump.manifest(numbered).orderBy("page_no").collect()
    assert [(r.page_no, r.n, r.next_page) for r in pages] == [(0, 2, 1), (1, 1, None)]


def test_dump_in_files_of_bounded_rows(spark, tmp_path):
    rows = spark.range(2_500).select(
        F.format_string("urn:s%04d", F.col("id") % 400).alias("s"), F.format_string("urn:p%02d", F.col("id") % 7).alias("p"), F.col("id").cast("string").alias("o"), (F.col("id") % 2 == 0).alias("o_is_iri")
    )
    dump.write_dump(rows.union(rows.limit(100)), f"{tmp_path}/dump", 300)
    pages = dump.written_manifest(spark, f"{tmp_path}/dump").orderBy("page_no").collect()
    assert sum(r.n for r in pages) == 2_500 and max(r.n for r in pages) <= 300 and len(pages) >= 9
    assert all(a.last < b.first and a.next_file == b.file for a, b in zip(pages, pages[1:])) and pages[-1].next_file is None
    assert {r.value for r in dump.read_dump(spark, f"{tmp_path}/dump").collect()} == {r.value for r in triples.to_ntriples(rows).collect()}


def test_lookup(spark):
    docs = spark.createDataFrame([("a" * 24, "https://a.example/#me", "done"), ("b" * 24, "https://b.example/#me", "tombstone")], "slug string, webid string, state string")
    asked = spark.createDataFrame([("a" * 24,), ("b" * 24,), ("c" * 24,), ("no",)], "slug string")
    assert {r.slug[0]: r.status for r in entries.lookup_by_slug(asked, docs).collect()} == {"a": 200, "b": 410, "c": 404, "n": 404}


def test_upsert_and_evolve(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v long, t string")
    new = spark.createDataFrame([("a", 3, "late"), ("a", 2, "early"), ("c", 1, "z")], old.schema)
    assert sorted(tuple(r) for r in tables.upsert(old, new, "k", "v").collect()) == [("a", 3, "late"), ("b", 1, "y"), ("c", 1, "z")]
    more = spark.createDataFrame([], "k string, extra int")
    assert tables.evolve(tables.evolve(old, more), more).columns == ["k", "v", "t", "extra"]


def test_retry_after(spark):
    values = ["120", "-5", "Sun, 07 Jan 2024 05:00:00 GMT", "soon", None]
    assert column(spark, lambda c: crawl.retry_after_ms(c, F.lit(1704600000000)), values) == [120000, 0, 3600000, None, None]


@pytest.mark.parametrize(("attempts", "delay"), [(1, 60_000), (3, 240_000), (4, 480_000)])
def test_backoff(spark, attempts, delay):
    r = spark.range(1).select(crawl.backoff(F.lit(attempts), F.lit(None).cast("long")).alias("b")).first().b
    assert (r.state, r.delay) == ("pending", delay)


def test_one_form_of_paths_and_hosts(spark):
    cases = {
        "https://x.org/a/../b": "https://x.org/b",
        "https://x.org/a/./b/..": "https://x.org/a",
        "https://x.org/%2e%2E/../b/.": "https://x.org/b",
        "https://x.org/../..": "https://x.org/",
        "https://x.org/a b?c d'#e f": "https://x.org/a%20b?c%20d%27",
        "https://x.org/é😀": "https://x.org/%C3%A9%F0%9F%98%80",
        " https:\\\\X.org\\a\t ": "https://x.org/a",
        "https://x.org:0443/a": "https://x.org/a",
        "https://x.org:70000/": None,
        "https://@x.org/": "https://x.org/",
        "https://0x7f.1/": "https://127.0.0.1/",
        "https://0xffffffffffffffff/": None,
        "https://1.2.3.4.5/": None,
        "https://x.org/a..b/.c/...": "https://x.org/a..b/.c/...",
    }
    assert column(spark, urls.canonical_doc_url, list(cases)) == list(cases.values())


def test_quick_keys_are_the_keys(spark):
    rng = random.Random(12)
    parts = ["/", "//", "a", "b.c", ".", "..", "...", "?", "?q=/", "x", "#", "#me", "%2e", "é", ":443", "0", "@"]
    some = ["https://x.org" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(600)]
    assert sum(column(spark, lambda c: c.rlike(urls._PLAIN), some)) > 100
    for own, whole in ((urls.canonical_doc_url, False), (urls.canonical_webid, True)):
        assert column(spark, own, some) == column(spark, lambda c, w=whole: urls._canonical(c, w), some)


def test_addresses_of_one_kind_inside_another(spark):
    private = ["::127.0.0.1", "::a00:1", "::7f00:1", "0::1", "::ffff:10.0.0.1", "0:0:0:0:0:ffff:a00:1", "64:ff9b::10.0.0.1", "2002:a00:1::", "fe80::1", "::"]
    public = ["::ffff:8.8.8.8", "64:ff9b::808:808", "2002:808:808::1", "2606:4700::1111"]
    assert column(spark, urls.ip_public, private + public) == [False] * len(private) + [True] * len(public)
    refused = [f"https://[{a}]/" for a in private] + ["https://0xffffffffffffffff/", "https://0777777777777777777777777777777/", "https://0x7f000001./"]
    assert None not in column(spark, urls.admission_reason, refused)
    assert column(spark, urls.admission_reason, [f"https://[{a}]/" for a in public]) == [None] * len(public)


def test_one_form_of_addresses(spark):
    forms = {
        "2001:db8:0:0:0:0:0:1": "2001:db8::1", "2001:DB8::1": "2001:db8::1", "2001:0db8:0:0:1:0:0:0": "2001:db8:0:0:1::", "2001:db8:0:1:1:1:1:1": "2001:db8:0:1:1:1:1:1",
        "0:0:0:0:0:0:0:0": "::", "1::": "1::", "::1": "::1", "1:0:0:2:0:0:3:4": "1::2:0:0:3:4", "fe80:0:0:0:10:0:0:0": "fe80::10:0:0:0", "::ffff:1.2.3.4": "::ffff:102:304",
    }
    assert column(spark, urls.canonical_doc_url, [f"https://[{a}]/c" for a in forms]) == [f"https://[{a}]/c" for a in forms.values()]
    assert column(spark, urls.canonical_doc_url, ["https://[1:2:3]/", "https://[1::2::3]/", "https://[zz::1]/", "https://a:b/"]) == [None] * 4


def test_broken_hosts_are_not_admitted(spark):
    broken = ["https://x y.org/", "https://x<y/", "https://a%00b/", "https://a^b/", "https://a|b/", "https://[::1/", "https://[1:2:3]/", "https://a.org:65536/", "https://a.org:9z/", "https://a%20b.org/"]
    assert column(spark, urls.admission_reason, broken) == ["parse"] * len(broken)
    fine = ["https://a.org/", "https://A.org:443/x", "https://a_b.example/", "https://8.8.8.8/", "https://[2606:4700::1]/", "https://bücher.example/"]
    assert column(spark, urls.admission_reason, fine) == [None] * len(fine)
    assert column(spark, urls.admission_reason, ["https://a.org:8443/", "http://a.org/", "https://u@a.org/", "https://[::1]/", "ftp://x/"]) == ["port", "scheme", "userinfo", "address", "scheme"]


def test_odd_retry_after(spark):
    asked = ["1e30", "Infinity", "NaN", "1d", "-1e30", "2.5", "", "0x10"]
    got = column(spark, lambda c: crawl.retry_after_ms(c, F.lit(0).cast("long")), asked)
    assert got == [crawl.LONGEST_DELAY, None, None, None, 0, 2500, None, None]


def test_errors_and_bodiless_responses(spark):
    rows = [("network", None, False), ("anything", None, False), ("address", None, False), (None, 204, True), (None, 205, True), (None, 200, True), (None, 304, True)]
    df = spark.createDataFrame(rows, "e string, s int, n boolean").select(crawl.fetch_outcome(F.col("s"), F.col("e"), F.col("n"), F.lit(True)).alias("o"))
    assert [r.o.next_state for r in df.collect()] == ["pending", "pending", "skipped", "parse", "parse", "tombstone", "done"]


def test_unescape_all_forms(spark):
    cases = {
        r"\uD83D\uDE00!": "😀!", r"\U0001F600": "😀", r"a\u0041\u0042c": "aABc", r"\uD83D": "\ufffd", r"x\uDE00\uD83D\u0041": "x\ufffd\ufffdA",
        r"\\u0041": r"\u0041", r"\b\f\n\r\t\"\'\\": "\b\f\n\r\t\"'\\", r"\UFFFFFFFF": "\ufffd", r"\U0000D800": "\ufffd", "plain": "plain", "": "",
        r"\\\u0041": "\\A", r"\u0000": "\0",
    }
    assert column(spark, triples.unescape, list(cases)) == list(cases.values())


def _windows(hits, window, limit):
    state, out = {}, []
    for key, at, i in sorted(hits):
        start, n = state.get(key, (None, 0))
        start, n = (at, 1) if start is None or start + window <= at else (start, n + 1)
        state[key] = start, n
        out.append((key, at, i, n, n <= limit))
    return out


@pytest.mark.parametrize("folded", [intake.FOLDED, 5])
def test_rate_limit_of_busy_keys(spark, folded, monkeypatch):
    monkeypatch.setattr(intake, "FOLDED", folded)
    rng = random.Random(3)
    hits = [(rng.choice("aaab"), rng.randrange(0, 3000), i) for i in range(400)] + [("gap", t, 1000 + t) for t in (0, 99, 100, 1000, 1100, 1101)]
    df = spark.createDataFrame(hits, "key string, at_ms long, id long")
    assert sorted(map(tuple, intake.rate_limit(df, 100, 3).collect())) == _windows(hits, 100, 3)
    half = sorted(hits, key=lambda h: h[1])
    early, late = [h for h in half if h[1] < 1550], [h for h in half if h[1] >= 1550]
    want = _windows(hits, 100, 3)
    first = {}
    for key, at, _, n, _ in want:
        if at < 1550:
            first[key] = (at, 1) if n == 1 else (first[key][0], n)
    carried = spark.createDataFrame([(k, *v) for k, v in first.items()], "key string, start long, n long")
    got = intake.rate_limit(spark.createDataFrame(early, df.schema), 100, 3).union(intake.rate_limit(spark.createDataFrame(late, df.schema), 100, 3, carried))
    assert sorted(map(tuple, got.collect())) == want


def test_windows_of_a_long_run_take_few_rounds(spark, monkeypatch):
    """Two thousand windows of one key are found in rounds of doubled pointers, not one by one."""
    rounds = []
    plain = intake.cut
    monkeypatch.setattr(intake, "cut", lambda df: rounds.append(1) or plain(df))
    monkeypatch.setattr(intake, "FOLDED", 10)
    rng = random.Random(6)
    hits, at = [], 0
    for i in range(6_000):
        at += rng.choice([0, 1, 30, 45, 99])
        hits.append(("a", at, i))
    got = intake.rate_limit(spark.createDataFrame(hits, "key string, at_ms long, id long"), 100, 3)
    assert sorted(map(tuple, got.collect())) == _windows(hits, 100, 3)
    assert len(rounds) <= 2 * 12 + 5


def test_intake_in_one_or_several_batches(spark, tmp_path):
    from weft.streaming import streams

    rng = random.Random(5)
    rows = [(i, 1000 * i, rng.randrange(6), rng.choice(["Announce", "Like"]), 1) for i in range(120)]
    objects = [(i, f"https://p{i % 40}.example/card#me" if i % 5 else f"http://p{i}.example/") for i, *_ in rows]
    docs = spark.createDataFrame([("https://p1.example/card#me", "https://p1.example/card", "done", 0)], "webid string, doc_url string, state string, terminal_at long")
    gone = spark.createDataFrame([("https://p2.example/card#me", "https://p2.example/card")], "webid string, doc_url string")
    found = []
    for cuts in ([0, 120], [0, 7, 40, 41, 90, 120]):
        take = streams.Intake(spark, f"{tmp_path}/{len(cuts)}", docs, gone, 0, 25, (30_000, 4))
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own = spark.createDataFrame(rows[a:b], "event_id long, at_ms long, user_id long, type string, n_objects int")
            take(own, spark.createDataFrame(objects[a:b], "id long, webid string"), n)
        found.append(sorted(map(tuple, take.read().collect())))
    assert found[0] == found[1]
    assert {d for _, d in found[0]} == {"accepted", "deferred", "refused", "already", "invalid", "rate-limited"}


def test_running_stats_survive_a_restart_and_a_replay(spark, tmp_path):
    from weft.streaming import streams

    kind = "s string, p string, o string, o_is_iri boolean, webid string, doc_url string"
    t = lambda who, p, o: (who, p, o, True, who, who)
    old = spark.createDataFrame([t("a", "knows", "b"), t("b", "knows", "a"), t("b", "name", "x")], kind)
    new = spark.createDataFrame([t("a", "name", "y"), t("c", "knows", "a")], kind)
    folder = f"{tmp_path}/stats"
    streams.RunningStats(spark, folder, stats.contributions(old))(old.filter("webid = 'a'"), new.filter("webid = 'a'"), 0)
    again = streams.RunningStats(spark, folder, stats.contributions(old))
    again(old.filter("webid = 'a'"), new.filter("webid = 'a'"), 0)
    again(old.filter("webid IN ('b', 'c')"), new.filter("webid IN ('b', 'c')"), 1)
    assert sorted(map(tuple, again.read().collect())) == sorted(map(tuple, stats.contributions(new).collect()))


def test_pages_of_one_large_subject(spark):
    rows = spark.range(2_000).select(F.lit("s").alias("s"), F.format_string("p%05d", (F.col("id") * 7919) % 2_000).alias("p"))
    got = triples.number_pages(rows, ["s", "p"], 100, per_range=150).collect()
    assert sorted((r.p, r.page_no, r.place) for r in got) == [(f"p{n:05d}", n // 100, n % 100) for n in range(2_000)]
