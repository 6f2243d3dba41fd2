"""Stored tables: upserts by parts, snapshots of several tables, and lookups that skip row groups."""

import os

import pytest
from pyspark.sql import functions as F

from weft.operators import erase, stats, tables


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def times(folder):
    return {d: max(os.stat(f"{folder}/rows/{d}/{f}").st_mtime_ns for f in os.listdir(f"{folder}/rows/{d}")) for d in os.listdir(f"{folder}/rows") if d.startswith("part=")}


def test_upsert_writes_only_touched_parts(spark, tmp_path):
    kind = "doc_url string, label string, v long"
    old = spark.createDataFrame([(f"d{n}", "old", 0) for n in range(1_000)], kind)
    tables.store_parts(old, f"{tmp_path}/t", "doc_url", 64)
    before = times(f"{tmp_path}/t")
    changes = spark.createDataFrame([("d3", "first", 1), ("d3", "second", 2), ("new", "new", 1), ("d500", "new", 5)], kind)
    touched = tables.upsert_parts(f"{tmp_path}/t", changes, "doc_url", "v")
    after = times(f"{tmp_path}/t")
    assert 1 <= len(touched) <= 3 and len(before) == 64
    assert {d for d in after if after[d] != before.get(d)} == {f"part={n}" for n in touched}
    want = found(tables.upsert(old, changes, "doc_url", "v"))
    assert found(tables.stored_parts(spark, f"{tmp_path}/t").select("doc_url", "label", "v")) == want
    # Once more, as after a failure, and with nothing.
    tables.upsert_parts(f"{tmp_path}/t", changes, "doc_url", "v")
    assert tables.upsert_parts(f"{tmp_path}/t", changes.limit(0), "doc_url", "v") == []
    assert found(tables.stored_parts(spark, f"{tmp_path}/t").select("doc_url", "label", "v")) == want


def index(spark):
    docs = spark.createDataFrame([("da", "done", "a", "A"), ("db", "done", "b", "B")], "doc_url string, state string, webid string, label string")
    triples = spark.createDataFrame([("a", "knows", "b", True, "a", "da"), ("b", "knows", "a", True, "b", "db")], "s string, p string, o string, o_is_iri boolean, webid string, doc_url string")
    gone = spark.createDataFrame([], "webid string, doc_url string, reason string, created_at long, proof string")
    inbox, objects = spark.createDataFrame([(1, "about a"), (2, "about b")], "id long, body string"), spark.createDataFrame([(1, "a"), (2, "b")], "id long, object string")
    return erase.Index(docs, triples, stats.contributions(triples), gone, inbox, objects)


def test_an_erasure_is_seen_whole_or_not_at_all(spark, tmp_path):
    snapshots = tables.Snapshots(spark, f"{tmp_path}/index")
    assert snapshots.read() == {} and snapshots.commit(index(spark)._asdict(), 0) == 1
    people = spark.createDataFrame([("a", "da", "erasure", 5, None)], "webid string, doc_url string, reason string, created_at long, proof string")
    old = {name: found(df) for name, df in snapshots.read().items()}
    # A writer that dies between tables: its tables are in no commit.
    after = erase.erase(erase.Index(**snapshots.read()), people)._asdict()
    broken = {name: (df if n < 3 else df.filter(F.raise_error(F.lit("lost")).cast("boolean"))) for n, (name, df) in enumerate(after.items())}
    with pytest.raises(Exception, match="lost"):
        snapshots.commit(broken, 1)
    assert snapshots.version() == 1 and {name: found(df) for name, df in snapshots.read().items()} == old
    reader = snapshots.read()
    new = erase.erase_stored(snapshots, people)
    assert snapshots.version() == 2
    assert [r.webid for r in new.triples.collect()] == ["b"] and [r.webid for r in new.tombstones.collect()] == ["a"] and [r.id for r in new.inbox_objects.collect()] == [2]
    # Who reads the old snapshot still sees all of it, and a writer that started from it is refused.
    assert {name: found(df) for name, df in reader.items()} == old
    with pytest.raises(tables.Conflict):
        snapshots.commit(after, 1)
    assert snapshots.version() == 2


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(n).metrics().apply("numOutputRows").value() for n in range(leaves.size()))


def test_lookups_skip_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(F.format_string("s%06d", F.col("id")).alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("o"))
    tables.store_sorted(rows, f"{tmp_path}/t", ["s"], {"o": 20_000}, 1 << 20)
    kept = spark.read.parquet(f"{tmp_path}/t")
    s, o = (kept.filter(F.col(c) == v) for c, v in (("s", "s012345"), ("o", rows.filter("id = 777").first().o)))
    assert s.count() == o.count() == 1
    assert rows_scanned(s) <= 40_000 and rows_scanned(o) <= 60_000
    absent = kept.filter(F.col("o") == "0" * 40)
    assert absent.count() == 0 and rows_scanned(absent) <= 20_000
