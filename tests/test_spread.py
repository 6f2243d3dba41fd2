"""Steps whose work is spread over tasks, or done once, whatever the rows are like."""

import pytest
from pyspark.sql import functions as F

from weft.operators import crawl, intake, stats
from weft.plans import all_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_urls_are_dealt_anew_before_they_are_judged(spark):
    assert "RepartitionByExpression" in plan(all_queries.QUERIES["admission_gate"](spark, SF))


def test_completions_are_not_read_again_with_the_triples(spark):
    docs = spark.createDataFrame([("d1", "w1", "claimed", "t"), ("d2", "w2", "claimed", "t")], "doc_url string, webid string, state string, claim_token string").withColumn("claimed_at", F.lit(1).cast("long"))
    done = spark.createDataFrame([("d1", "t", "tombstone", 5, 1, "w9")], "doc_url string, claim_token string, next_state string, fetched_at long, event_id long, webid string")
    triples = spark.createDataFrame([(f"w{n}", "p", "o", False, f"w{n}", f"d{n}") for n in (1, 2, 9)], "s string, p string, o string, o_is_iri boolean, webid string, doc_url string")
    gate = docs.select("webid", "doc_url").limit(0)
    kept = crawl.complete(docs, done, gate, triples, stats.contributions(triples))[1]
    assert [r.webid for r in kept.collect()] == ["w2"]
    assert "fetched_at" not in plan(kept) and "next_state" not in plan(kept)


@pytest.mark.parametrize("frequent", [10, 1000])
def test_a_frequent_key_is_many_tasks_work(spark, monkeypatch, frequent):
    monkeypatch.setattr(intake, "FREQUENT", frequent)
    keys = ["hot"] * 200 + ["none"] * 100 + [None] * 100 + [f"k{n}" for n in range(20)]
    rows = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], "id long, key string")
    known = spark.createDataFrame([("hot", 3), ("k1", 2), ("k2", 1)], "key string, level int")
    levels = {"hot": 3, "k1": 2, "k2": 1}
    got = intake._looked_up(rows, known, "key")
    assert sorted((r.id, r.key, r.level) for r in got.collect()) == [(n, k, levels.get(k)) for n, k in enumerate(keys)]
    assert ("__part" in plan(got)) == (frequent == 10)
