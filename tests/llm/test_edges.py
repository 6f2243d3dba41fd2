"""Every operator and stage on nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import byte_bpe, decontaminate, fingerprints, licenses, near_dedup, pii, sharding, token_counts, toxicity, url_filter


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (9, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "quick brown fox jumps over the lazy dog near the river"), (1, "quick brown fox jumps over the lazy dog near the river"), (2, None), (3, ""), (None, "one"), (4, "one"), (5, "!!!")]
    return spark.createDataFrame(rows, "item_id long, text string")


CALLS = {
    "op2": lambda d, l, b: fingerprints.op2(d),
    "op3": lambda d, l, b: sharding.op3(d),
    "op4": lambda d, l, b: decontaminate.op4(d, b),
    "op5": lambda d, l, b: near_dedup.op5(d),
    "op6": lambda d, l, b: toxicity.op6(d, l),
    "op8": lambda d, l, b: token_counts.op8(d),
    "op9": lambda d, l, b: byte_bpe.op9(d),
    "op10": lambda d, l, b: pii.op10(d),
    "leaks": lambda d, l, b: decontaminate.find_leaks(d, b),
    "leaks in passes": lambda d, l, b: decontaminate.find_leaks(d, b, words_per_pass=5),
    "toxicity": lambda d, l, b: toxicity.score(d, toxicity.Lexicon()),
    "tokens": lambda d, l, b: token_counts.count_tokens(d),
    "bpe": lambda d, l, b: byte_bpe.encode(d),
    "pii": lambda d, l, b: pii.find_personal_data(d),
    "mask": lambda d, l, b: pii.mask(d),
    "sketch": lambda d, l, b: fingerprints.fingerprint(d),
}


@pytest.mark.parametrize("name", CALLS)
def test_one_row_for_each_row(name, odd_docs, no_docs, labels, benchmark):
    assert len(CALLS[name](odd_docs, labels, benchmark).collect()) == odd_docs.count()
    assert CALLS[name](no_docs, labels.limit(0), benchmark.limit(0)).collect() == []


def test_keep_one(odd_docs, no_docs):
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # Of 1, 1 and 2 one row of 1 stays, of 7 and 8 the first; blank and null texts all stay.
    assert ids == sorted([(False, i) for i in (1, 3, 4, 5, 6, 7, 9, 10, 11)] + [(True, 0), (True, 0)])
    assert near_dedup.keep_one(no_docs).collect() == []


def test_licenses(spark, odd_docs, no_docs):
    found = licenses.scan(odd_docs, licenses.train(odd_docs)).collect()
    assert [(r.doc_id, r.number, r.family) for r in found] == [(10, 0, "MIT")]
    assert licenses.op7(no_docs).collect() == []


def test_urls(spark, labels):
    rows = [(1, "http://A.Example.com/en/5?q=1", "x"), (1, "http://A.Example.com/en/5?q=1", None), (None, None, None), (2, "no scheme", ""), (3, "", ""), (4, "x://" + "h" * 9_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "tokens": F.lit("clash")})
    found = url_filter.op1(pages, labels).collect()
    assert len(found) == 6
    assert {(r.host, r.path, r.rule, r.verdict) for r in found if r.page_id == 1} == {("a.example.com", "/en/5", "com/en/", "block")}
    assert all((r.host, r.path, r.verdict) == ("", "", "allow") for r in found if r.page_id in (None, 2, 3))
    assert url_filter.op1(pages.limit(0), labels.limit(0)).collect() == []


def test_stages(spark, odd_docs, no_docs, tmp_path, labels, benchmark):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "MinHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE encoding and decoding"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).collect() == []
    docs = odd_docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id for r in docs.collect()}
    # The insult, the copies, the row with a benchmark window and the one-word item are gone.
    assert left == {3, None, 4, 5, 7, 9, 10, 11}
    assert all(r.round_trip for r in docs.collect())
