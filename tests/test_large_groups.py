"""Groups that are too large for one task: hosts, people, subjects and documents that hold much of a table."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import crawl, entries, tables, triples

TRIPLE = "s string, p string, o string, o_is_iri boolean, webid string, doc_url string"
KNOWS = "http://xmlns.com/foaf/0.1/knows"


@pytest.mark.parametrize("per_range", [tables.ROWS_PER_RANGE, 40])
def test_numbers_within_groups(spark, per_range):
    """A third of the rows in one group, groups of one row, and nulls."""
    random.seed(1)
    rows = [("hot" if n % 3 == 0 else None if n % 3 == 1 and n % 2 else f"g{n % 90}", random.randint(0, 9), n) for n in range(600)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    want, seen = set(), {}
    for g, a, b in sorted(rows, key=lambda r: r[1:]):
        want.add((g, a, b, seen.setdefault(g, 0)))
        seen[g] += 1
    assert {tuple(r) for r in tables.number_groups(df, ["g"], ["a", "b"], "n", per_range).collect()} == want
    assert tables.number_groups(df.limit(0), ["g"], ["a", "b"], "n", per_range).collect() == []


def test_schedule_of_one_busy_host(spark):
    rows = [(f"u{n:04}", "busy" if n % 2 else f"h{n % 8}", n % 3, n % 7) for n in range(500)]
    due = spark.createDataFrame(rows, "doc_url string, host string, depth int, next_eligible_at int")
    hosts = spark.createDataFrame([("busy", 5_000)], "host string, next_allowed_at long")
    plans = [crawl.host_schedule(due, hosts, 1_000, 10, per_range=size) for size in (50, 10_000)]
    few, one = ({r.doc_url: r.fetch_at for r in p.collect()} for p in plans)
    busy = sorted((r for r in rows if r[1] == "busy"), key=lambda r: (r[2], r[3], r[0]))
    assert few == one
    assert [few[r[0]] for r in busy] == [5_000 + 10 * n for n in range(len(busy))]


def test_people_known_are_bounded_before_they_are_gathered(spark):
    rows = [("me", KNOWS, f"p{n % 300:03}", True, "me", "d") for n in range(900)] + [("me", KNOWS, "a name", False, "me", "d"), ("you", "x", "y", True, "you", "d")]
    df = spark.createDataFrame(rows, TRIPLE)
    got = entries.profile_rollup(df, 5)
    assert {r.webid: r.knows for r in got.collect()} == {"me": [f"p{n:03}" for n in range(5)], "you": []}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_patterns_of_all_shapes(spark, monkeypatch):
    """Eight shapes, repeated patterns and triples, and patterns that ask for the whole table, in several scans."""
    monkeypatch.setattr(triples, "WHOLE_PER_SCAN", 2)
    random.seed(2)
    facts = [(f"s{random.randint(0, 5)}", f"p{random.randint(0, 2)}", f"o{random.randint(0, 5)}", random.random() < 0.5, "w", "d") for _ in range(120)]
    pick = lambda letter, most: random.choice([None, f"{letter}{random.randint(0, most)}"])
    asked = [(n, pick("s", 6), pick("p", 3), pick("o", 6)) for n in range(60)] + [(n, None, None, None) for n in range(60, 65)]
    asked += asked[:5]
    got = triples.bulk_patterns(spark.createDataFrame(asked, "pattern_id int, s string, p string, o string"), spark.createDataFrame(facts, TRIPLE))
    fits = lambda a, f: all(x is None or x == y for x, y in zip(a[1:], f))
    want = {(a[0], *f[:4]) for a in asked for f in facts if fits(a, f)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert triples.bulk_patterns(spark.createDataFrame([], "pattern_id int, s string, p string, o string"), spark.createDataFrame(facts, TRIPLE)).collect() == []


def test_hash_of_a_document_beyond_the_cap(spark):
    """It has none, and is not told as changed for that; a document at the cap has one."""
    rows = [(f"s{n}", "p", "o", True, "w", url) for url, most in (("big", 6), ("full", 5)) for n in range(most)]
    df = spark.createDataFrame(rows + rows[:3], TRIPLE)
    hashes = triples.content_hashes(df, 5)
    text = "".join(f"<s{n}> <p> <o> .\n" for n in range(5))
    assert {r.doc_url: r.hash for r in hashes.collect()} == {"big": None, "full": hashlib.sha256(text.encode()).hexdigest()}
    assert triples.changed(hashes, hashes).collect() == []
    grown = triples.content_hashes(df.filter("s != 's5'"), 5)
    assert [r.doc_url for r in triples.changed(hashes, grown).collect()] == ["big"]


def test_subject_of_many_values_is_several_nodes(spark):
    rows = [("hub", f"p{n % 3}", f"o{n}", n % 2 == 0, "w", "d") for n in range(50)] + [("leaf", "p0", "x", False, "w", "d")]
    df = spark.createDataFrame(rows + rows[:9], TRIPLE)
    nodes = [(r.s, json.loads(r.value)) for r in triples.expanded_json(df, 10).collect()]
    assert sum(s == "leaf" for s, _ in nodes) == 1 and 2 <= sum(s == "hub" for s, _ in nodes) <= 5
    values = sorted((s, p, json.dumps(v)) for s, node in nodes for p, many in node.items() if p != "@id" for v in many)
    whole = [(r.s, json.loads(r.value)) for r in triples.expanded_json(df).collect()]
    assert len(whole) == 2 and all(node["@id"] == s for s, node in nodes)
    assert values == sorted((s, p, json.dumps(v)) for s, node in whole for p, many in node.items() if p != "@id" for v in many)
