"""The stored index against ranking without one."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import search, text_index


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = [f"w{n}" for n in range(40)]
    pick = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=n))
    rows = [(f"https://d{n}.example/", pick(rng.randint(0, 3)), pick(rng.randint(0, 60)) if n % 9 else None) for n in range(600)]
    return spark.createDataFrame(rows, "doc_url string, label string, body string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(9)
    rows = [(n, [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 3))]) for n in range(30)] + [(98, ["nowhere"]), (99, ["w1", "nowhere"]), (100, [])]
    return spark.createDataFrame(rows, "query_id long, words array<string>")


def found(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("named", [1000, 3])
def test_index_ranks_as_without(spark, docs, queries, tmp_path, monkeypatch, named):
    monkeypatch.setattr(text_index, "SLICE_DOCS", 20)
    monkeypatch.setattr(text_index, "NAMED_TERMS", named)
    index = text_index.build(docs, f"{tmp_path}/index")
    postings, sizes = search.postings(docs), search.lengths(docs)
    hidden = docs.filter(F.col("doc_url").contains("3"))
    assert (index.docs, round(index.mean, 9)) == (600, round(sizes.agg(F.avg("n")).first()[0], 9))
    for weight in (10.0, 0.0, 3.0, 25.0):
        want = search.rank(queries, postings, sizes, weight, hidden)
        assert found(text_index.rank(queries, index, weight, hidden), "query_id", "doc_url", "rank") == found(want, "query_id", "doc_url", "rank")
        for k in (1, 7):
            got = text_index.best(queries, index, k, weight, hidden)
            assert found(got, "query_id", "place", "doc_url", "rank") == found(search.top(want, k), "query_id", "place", "doc_url", "rank")
    assert found(text_index.match(queries, index), "query_id", "doc_url") == found(search.match(queries, postings), "query_id", "doc_url")


def test_only_asked_folders_are_read(spark, docs, tmp_path):
    index = text_index.build(docs, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, ["w7"])], "query_id long, words array<string>")
    folders = {name.split("bucket=")[1].split("/")[0] for name in index.blocks(search.query_terms(asked)).inputFiles()}
    blocks = index.blocks(search.query_terms(asked))
    assert len(folders) > 1
    read = {r[0].split("bucket=")[1].split("/")[0] for r in blocks.select(F.input_file_name()).distinct().collect()}
    assert len(read) == 1


def test_slices_are_skipped(spark, docs, tmp_path, monkeypatch):
    """Most slices stay closed for a query of one frequent term."""
    monkeypatch.setattr(text_index, "SLICE_DOCS", 10)
    index = text_index.build(docs, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, ["w0"])], "query_id long, words array<string>")
    opened = []
    plain = text_index._scored
    monkeypatch.setattr(text_index, "_scored", lambda slices, *more: opened.append(slices.count()) or plain(slices, *more))
    assert text_index.best(asked, index, 1).count() == 1
    assert opened[0] == text_index.FIRST_SLICES and opened[1] <= 20 < text_index._asked(asked, index, 10.0).count()


def test_index_is_kept_and_made_anew(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/docs")
    read = lambda: spark.read.parquet(f"{tmp_path}/docs")
    first = text_index.stored(read(), "1")
    written = spark.read.parquet(f"{first.folder}/head").inputFiles()
    assert text_index.stored(read(), "1") == first and spark.read.parquet(f"{first.folder}/head").inputFiles() == written
    docs.limit(5).write.mode("append").parquet(f"{tmp_path}/docs")
    assert text_index.stored(read(), "1").folder != first.folder
    assert text_index.stored(read(), "2").folder != first.folder


def test_empty_index(spark, docs, queries, tmp_path):
    index = text_index.build(docs.limit(0), f"{tmp_path}/none")
    assert text_index.rank(queries, index).collect() == [] and text_index.best(queries, index, 3).collect() == []


@pytest.mark.parametrize("at_once", [100_000, 7])
def test_bulk_ranks_as_one_by_one(spark, docs, queries, at_once):
    """Queries of the same words, of one word, of words that nothing holds, of no words; in one and in several readings."""
    more = queries.union(queries.filter("query_id < 4").select(F.col("query_id") + 1000, F.reverse("words")))
    hidden = docs.filter(F.col("doc_url").contains("3"))
    for weight in (10.0, 0.0):
        want = search.top(search.rank(more, search.postings(docs), search.lengths(docs), weight, hidden), 7)
        got = search.bulk(more, docs, 7, weight, hidden, at_once)
        assert found(got, "query_id", "place", "doc_url", "rank") == found(want, "query_id", "place", "doc_url", "rank")
    assert search.bulk(more, docs.limit(0), 7).collect() == []


def test_bulk_shuffles_no_texts(spark, docs, queries, tmp_path):
    """What a reading of the documents passes on is narrow: ranked rows of at most k for a set and task."""
    plan = search.bulk(queries, docs, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_an_index_moves_texts_once_and_then_blocks(spark, docs, tmp_path, monkeypatch):
    """No single postings are written out or shuffled while an index is made."""
    from weft.operators import tables

    for module in (text_index, tables):
        monkeypatch.setattr(module, "cut", lambda df: pytest.fail("postings are written out"))
    monkeypatch.setattr(text_index, "SLICE_DOCS", 20)
    index = text_index.build(docs, f"{tmp_path}/index")
    assert "postings" not in spark.read.parquet(f"{index.folder}/blocks").columns


def test_words_are_counted_by_slice_and_not_as_rows(spark):
    """Blocks against counting in Python: repeated documents, documents without words or url, characters beyond ASCII; no row is made for a word."""
    from collections import Counter

    rows = [(f"https://d{n}.example/é", f"w{n % 3} Top", " ".join(["w1"] * (n % 4) + [f"W{n % 5}"])) for n in range(40)]
    rows += [rows[7], ("https://d7.example/é", "w1", None), ("https://none.example/", None, "the"), (None, "w9", "w9 w1"), (None, None, "")]
    made = text_index._blocks_of(spark.createDataFrame(rows, "doc_url string, label string, body string"), 4, 2.5)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    want: dict = {}
    for url, label, body in rows:
        split = [Counter(w for w in (text or "").lower().split() if w != "the") for text in (label, body)]
        size = sum(map(sum, (c.values() for c in split)))
        for term in set(split[0]) | set(split[1]):
            tf = want.setdefault((term, url, size), [0, 0])
            tf[0] += split[0][term]
            tf[1] += split[1][term]
    got, slices = {}, {}
    for r in made.collect():
        postings = list(zip(r.doc_url, r.words, r.label_tf, r.body_tf, strict=True))
        assert r.n == len(postings) and [p[:2] for p in postings] == sorted((p[:2] for p in postings), key=lambda p: (p[0] or "", p[1]))
        part = lambda weight: max((t := weight * a + b) * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / 2.5)) for _, n, a, b in postings)
        assert (r.most, r.plain) == pytest.approx((part(10.0), part(0.0)))
        for url, n, a, b in postings:
            assert (r.term, url, n) not in got and slices.setdefault(url, r.slice) == r.slice
            got[r.term, url, n] = [a, b]
    assert got == want
