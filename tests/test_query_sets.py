"""Very many sets of words against blocks of documents."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.operators import gates, query_sets, search


def test_words_over_bytes_are_those_of_the_split(spark):
    texts = ["", "a", "b c", "d", "É é ÀB-c9", "the of", "  x  ", "", "y.z", "ſt Kelvin İi", "0", "日本 w1", None, "no end", "go on", ""]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string").orderBy("n")
    want = [r[0] for r in df.select(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")).collect()]
    lower = pa.array([r[0] for r in df.select(F.lower(F.coalesce("text", F.lit("")))).collect()])
    for start in (0, 3):  # a slice of an array as well
        words, n = query_sets.split_words(lower[start:])
        ends = np.cumsum(n)
        assert [words.to_pylist()[a:b] for a, b in zip(np.append(0, ends), ends)] == want[start:]


def test_scores_are_rounded_as_spark_does(spark):
    rng = random.Random(3)
    scores = [n / 2e6 for n in range(60)] + [rng.randrange(10**9) / 1e7 for _ in range(500)] + [rng.random() * 50 for _ in range(500)] + [1.0000005, 2.5000015, 8.0000045]
    df = spark.createDataFrame([(n, s) for n, s in enumerate(scores)], "n int, s double")
    want = [r[0] for r in df.orderBy("n").select(F.round("s", 6)).collect()]
    assert query_sets.rounded(np.array(scores)).tolist() == want


@pytest.fixture
def corpus():
    """Documents of few words, many of them alike, and sets of one to four of the words."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(25)]
    pick = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(25)], k=n))
    docs = [(f"https://d{rng.randrange(10**6)}.example/", pick(rng.randint(0, 2)), pick(rng.randint(0, 12)) + " the") for _ in range(400)]
    docs += [(f"https://same{n}.example/", "w1", "w2 w2") for n in range(50)] + [(None, "w1", "w2 w2"), ("https://none.example/", "", "")]
    rng.shuffle(docs)
    sets = sorted({tuple(sorted(rng.sample(words, rng.randint(1, 4)))) for _ in range(80)}) + [("nowhere", "w1"), ("the",), ("", "w1")]
    return docs, sets


def given(docs, sets):
    vocabulary = pa.array(sorted({w for s in sets for w in s} - {"the"}))
    held = [set(f"{label} {body}".split()) for _, label, body in docs]
    df = np.array([sum(w in h for h in held) for w in vocabulary.to_pylist()])
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    return query_sets.arrange(np.arange(len(sets)) * 3, pa.array(sets, pa.list_(pa.string())), vocabulary, df, idf), df


def batches(docs, rows):
    for at in range(0, len(docs), rows):
        yield pa.RecordBatch.from_pylist([dict(zip(("doc_url", "label", "body"), d)) for d in docs[at : at + rows]], pa.schema([(n, pa.string()) for n in ("doc_url", "label", "body")]))


SCORING = query_sets.Scoring(6.5, 10.0, 1.0, 1.2, 0.75)


@pytest.mark.parametrize("block, at_once, rows", [(8 << 20, 2_000_000, 1000), (300, 40, 7), (1, 1, 100)])
def test_the_best_of_many_blocks(corpus, monkeypatch, block, at_once, rows):
    """Against scoring every document for every set: ties by url, a null url, sets with a word that is nowhere or not indexed."""
    monkeypatch.setattr(query_sets, "BLOCK_BYTES", block)
    monkeypatch.setattr(query_sets, "CANDIDATES", at_once)
    docs, sets = corpus
    made, _ = given(docs, sets)
    idf = dict(zip(made.words.to_pylist(), made.idf.tolist()))
    want = []
    for n, words in enumerate(sets):
        found = []
        for url, label, body in docs:
            label, body = ([w for w in t.split() if w != "the"] for t in (label, body))
            if all(w in label or w in body for w in words):
                tf = {w: 10.0 * label.count(w) + body.count(w) for w in words}
                longer = 1.2 * (1 - 0.75 + 0.75 * (len(label) + len(body)) / 6.5)
                found.append((-round(sum(idf[w] * tf[w] * 2.2 / (tf[w] + longer) for w in words), 6), url or "", url))
        want += [(n * 3, url, -rank) for rank, _, url in sorted(found, key=lambda f: f[:2])[:4]]
    got = [r for b in query_sets.best(batches(docs, rows), made, pa.array(["the"]), SCORING, 4) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)


def test_words_are_counted_once_a_document(corpus, monkeypatch):
    monkeypatch.setattr(query_sets, "BLOCK_BYTES", 200)
    docs, sets = corpus
    made, df = given(docs, sets)
    (counted,) = query_sets.count(batches(docs, 30), made.words, pa.array(["the"]))
    got = dict(zip(counted["term"].to_pylist(), counted["df"].to_pylist()))
    words = sum(w != "the" for _, label, body in docs for w in f"{label} {body}".split())
    assert got.pop(-1) == len(docs) and counted["n"].to_pylist()[-1] == words
    assert got == {n: d for n, d in enumerate(df.tolist()) if d}


def test_sets_that_cannot_better_their_best_are_passed_over(corpus, monkeypatch):
    monkeypatch.setattr(query_sets, "BLOCK_BYTES", 200)
    docs = [("https://a.example/", "w1 w1 w1", "")] * 10 + [(f"https://d{n}.example/", "", "w1 w2 w3 w4 w5 w6 w7 w8") for n in range(200)]
    made, _ = given(docs, [("w1",)])
    kept, matched, plain = query_sets._Best, [], query_sets._matches
    monkeypatch.setattr(kept, "add", lambda self, *more: self.more.append(more) or self.settle())
    monkeypatch.setattr(query_sets, "_matches", lambda sets, some, *more: matched.append(len(some)) or plain(sets, some, *more))
    (found,) = query_sets.best(batches(docs, 5), made, pa.array(["the"]), SCORING, 10)
    assert found["doc_url"].to_pylist() == ["https://a.example/"] * 10
    assert sum(matched) < 10 < len(matched)


def test_more_hidden_urls_than_are_broadcast_move_no_text(spark, monkeypatch):
    """Nothing is shuffled below the step that matches documents, and a document's words are not made rows."""
    monkeypatch.setattr(gates, "BROADCAST_KEYS", 3)
    docs = spark.createDataFrame([(f"https://d{n}.example/", "tea", "tea time") for n in range(40)], "doc_url string, label string, body string")
    queries = spark.createDataFrame([(1, ["tea"])], "query_id long, words array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = search.bulk(queries, docs, 40, hidden=docs.filter("doc_url LIKE '%3%'"))
        below = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)[1]
        assert "Exchange hashpartitioning" not in below and "Generate" not in below
        assert found.count() == sum("3" not in str(n) for n in range(40))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_urls_of_one_hash_are_compared_themselves(spark, monkeypatch):
    monkeypatch.setattr(gates, "BROADCAST_KEYS", 3)
    docs = spark.createDataFrame([("u" * (n % 5) + str(n),) for n in range(40)] + [(None,)], "doc_url string").withColumn("body", F.lit("x"))
    hidden = docs.filter("doc_url LIKE '%7%' OR length(doc_url) = 6 OR doc_url = '0' OR doc_url IS NULL").union(docs.limit(0))
    want = {r[0] for r in docs.collect()} - {r[0] for r in hidden.collect()} | {None}
    for weak in (lambda key: F.xxhash64(key), lambda key: F.length(key).cast("long"), lambda key: F.lit(1).cast("long")):
        monkeypatch.setattr(gates, "_hash", weak)
        got = gates.unhidden(docs, hidden)
        assert got.columns == ["doc_url", "body"] and sorted(map(str, (r[0] for r in got.collect()))) == sorted(map(str, want))
