"""Streams in event time: pauses, backlogs, disorder, frames, restarts and late rows."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import crawl, intake, stats
from weft.streaming import run, streams

HOUR = 3_600_000
DAY = 24 * HOUR
#: A stream's watermark begins at 0, so events do not.
T0 = 1_700_000_000_000 // DAY * DAY


def files(spark, folder, kind, batches):
    """Rows of each batch as a file, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/b{n:03d}")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")


def cut_into(rows, sizes):
    out, at = [], 0
    for size in sizes:
        out.append(rows[at : at + size])
        at += size
    return [x for x in out + [rows[at:]] if x]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sizes", [[], [40, 1, 3, 80]])
def test_rate_after_a_pause(spark, tmp_path, sizes):
    """Days without events, a backlog at once, and the window that was open before goes on."""
    rng = random.Random(len(sizes))
    times = sorted([rng.randrange(2 * DAY) for _ in range(90)] + [9 * DAY + rng.randrange(2 * DAY) for _ in range(110)])
    hits = [(f"k{rng.randrange(4)}", T0 + at, n) for n, at in enumerate(times)]
    want = found(intake.rate_limit(spark.createDataFrame(hits, "key string, at_ms long, id long"), DAY, 3).select("key", "at_ms", "id", "n", "granted"))
    stream = files(spark, tmp_path, "key string, at_ms long, id long", cut_into(hits, sizes))
    assert found(run.rows_of(streams.rate_stream(stream, DAY, 3))) == want


def test_a_used_challenge_stays_used(spark, tmp_path):
    kind = "webid string, event_id long, at_ms long, action string"
    rows = [("a", 1, 0, "issue"), ("b", 2, 5, "issue"), ("a", 3, HOUR, "confirm")]
    backlog = [("a", 4, 2 * HOUR, "confirm"), ("b", 5, 3 * HOUR, "confirm"), ("b", 6, 20 * HOUR, "issue"), ("b", 7, 43 * HOUR, "confirm"), ("a", 8, 50 * HOUR, "confirm")]
    stream = files(spark, tmp_path, kind, [[(w, n, T0 + at, a) for w, n, at, a in x] for x in (rows, backlog)])
    assert found(run.rows_of(streams.nonce_stream(stream))) == [(3, "a", True), (4, "a", False), (5, "b", True), (7, "b", True), (8, "a", False)]


@pytest.mark.parametrize("sizes", [[], [30], [5, 5, 100, 7, 7]])
def test_leases_and_due_times(spark, tmp_path, sizes):
    """Leases end and documents become due without an event of theirs, however the input is cut."""
    rng = random.Random(7)
    events, at = [], T0
    for n in range(220):
        at += rng.randrange(1, 40_000) if n != 120 else 5 * DAY
        kind = rng.choice(["claim", "claim", f"done:{at + 900_000}", f"failed:{at + 60_000}"])
        events.append((f"d{rng.randrange(5)}", n, at, kind))
    events += [("d9", 900, at + 1, "claim"), ("d8", 901, at + 1, "done:5")]
    kind = "doc_url string, event_id long, at_ms long, kind string"
    horizon = max(e[2] for e in events) - HOUR
    want = found(crawl.lease_history(spark.createDataFrame(events, kind), 100_000, horizon))
    stream = files(spark, tmp_path, kind, cut_into(events, sizes))
    assert found(run.rows_of(streams.lease_stream(stream, 100_000))) == want
    assert {"claimed", "lease over", "due", "late", "done", "failed"} == {r[2] for r in want}


def test_a_key_of_many_frames(spark, tmp_path):
    """Frames of one key in disorder are folded in order of time."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        hits = [("hot", T0 + (n * 7919 % 2000) * 100_000, n) for n in range(2000)] + [("cold", T0 + 5, 1)]
        stream = files(spark, tmp_path, "key string, at_ms long, id long", [hits])
        want = found(intake.rate_limit(spark.createDataFrame(hits, "key string, at_ms long, id long"), DAY, 3).select("key", "at_ms", "id", "n", "granted"))
        assert found(run.rows_of(streams.rate_stream(stream, DAY, 3))) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_late_rows_are_counted_and_windows_closed(spark, tmp_path):
    kind = "user string, at_ms long"
    batches = [[("a", T0 + at) for at in (10, HOUR + 1)] + [("b", T0 + 5 * HOUR)], [("b", T0 + 5 * HOUR + 5)], [("a", T0 + 20), ("a", T0 + 9 * HOUR)]]
    stream = files(spark, tmp_path / "in", kind, batches).withColumn("at", F.timestamp_millis("at_ms"))
    counts = streams.tumbling(stream, "at", "user").select("user", F.unix_millis("window.start").alias("start"), "n")
    done = run.drain(counts, folder=f"{tmp_path}/run")
    # The third batch's row of the first hour comes after the watermark: it is counted, not added.
    assert done.late_rows == 1
    assert found(spark.read.parquet(done.out)) == [("a", T0, 1), ("a", T0 + HOUR, 1), ("b", T0 + 5 * HOUR, 2)]


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    """A failure in the third batch, then another run with the same folder; then more files, and another run."""
    kind = "key string, at_ms long, id long"
    hits = [(f"k{n % 3}", T0 + n * HOUR, n) for n in range(60)]
    files(spark, tmp_path / "in", kind, cut_into(hits[:50], [10, 10, 10, 10]))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
    folder, seen = f"{tmp_path}/run", []

    def each(batch, batch_id):
        if batch_id == 2 and batch_id not in seen:
            seen.append(batch_id)
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{folder}/table/{batch_id}")

    rated = streams.rate_stream(stream, DAY, 3)
    with pytest.raises(Exception, match="lost"):
        run.drain(rated, each=each, folder=folder)
    first = run.drain(rated, each=each, folder=folder)
    files(spark, tmp_path / "in/late", kind, [hits[50:]])
    for part in (tmp_path / "in/late").glob("b000"):
        part.rename(tmp_path / "in/b900")
    again = run.drain(rated, each=each, folder=folder)
    want = found(intake.rate_limit(spark.createDataFrame(hits, kind), DAY, 3).select("key", "at_ms", "id", "n", "granted"))
    assert found(spark.read.parquet(f"{folder}/table/*")) == want
    assert first.batches >= 3 and 1 <= again.batches <= 2


def test_statistics_go_on_where_they_stopped(spark, tmp_path):
    """Statistics through the runner: a batch that fails after its version is written is not applied twice."""
    kind = "s string, p string, o string, o_is_iri boolean, webid string, doc_url string"
    new = [(f"s{n}", "knows", f"s{n + 1}", True, f"w{n}", f"w{n}") for n in range(12)]
    stream = files(spark, tmp_path / "in", kind, cut_into(new, [3, 3, 3]))
    none, folder, failed = spark.createDataFrame([], kind), f"{tmp_path}/run", []

    def each(batch, batch_id):
        streams.RunningStats(spark, f"{folder}/stats")(none, batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run.drain(stream, each=each, folder=folder)
    run.drain(stream, each=each, folder=folder)
    got = streams.RunningStats(spark, f"{folder}/stats").read()
    assert found(got) == found(stats.contributions(spark.createDataFrame(new, kind)))


def test_reading_before_the_first_batch(spark, tmp_path):
    assert streams.RunningStats(spark, f"{tmp_path}/none").read().collect() == []
    empty = spark.createDataFrame([], "webid string, doc_url string, state string, terminal_at long")
    assert streams.Intake(spark, f"{tmp_path}/no", empty, empty, 0, 1, (1, 1)).read().collect() == []


def test_an_end_mark_closes_all_windows_and_sessions(spark, tmp_path):
    """Windows and sessions that the watermark has not passed are put out too, rows of a null key with them; the mark itself is not counted."""
    kind = "user string, at_ms long"
    files(spark, tmp_path / "in", kind, [[("a", T0), ("a", T0 + 10 * 60_000), ("b", T0 + 5 * HOUR), (None, T0 + 5 * HOUR), ("b", T0 + 5 * HOUR + 1)]])
    events = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/b*").select("user", F.timestamp_millis("at_ms").alias("at"))
    windows = lambda rows: streams.tumbling(rows, "at", "user").select("user", F.unix_millis("window.start").alias("start"), "n")
    sessions = lambda rows: streams.sessions(rows, "at", "user").select("user", F.unix_millis("session_window.start").alias("start"), "n")
    want = {("a", T0, 2), ("b", T0 + 5 * HOUR, 2), (None, T0 + 5 * HOUR, 1)}
    assert set(map(tuple, run.rows_to_end(events, "at", windows).collect())) == want
    assert set(map(tuple, run.rows_to_end(events, "at", sessions).collect())) == want
