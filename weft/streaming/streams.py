"""Stateful streams: rate limits, crawl states, challenges, intake and running statistics. Times are epoch milliseconds."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weft.functions.crawl import LEASE, MAX_ATTEMPTS, RECRAWL_OTHER
from weft.functions.urls import admission_reason, canonical_doc_url, canonical_webid
from weft.operators import intake, stats
from weft.operators.tables import cut
from weft.streaming.run import Versions

DAY = 86_400_000
REST = 2 * RECRAWL_OTHER


class EventTimeProcessor(StatefulProcessor):
    """Folds the events (key, at, at_ms, id, kind) of each key in order of (at_ms, id) and keeps state only until the watermark says that it no longer matters.

    Everything is told by event time, so a stream that stands still for days and then reads its backlog, or reads it in other pieces, gives
    the same rows. A key's events of one batch that come in several frames are laid down in the state store by time and folded one stretch after the other, so
    no more than a frame and a stretch of them are held at once. An event that comes in a later batch than newer ones, but before the watermark, is folded when it comes.
    """

    STATE = ""
    OUTPUT = ""
    #: Milliseconds that are folded at once of a key with several frames.
    STRETCH = 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        self.laid = handle.getMapState("laid", "stretch long, n long", "rows binary")

    def step(self, state: tuple | None, at: int, event: int, kind: str | None) -> tuple[tuple | None, list[tuple]]:
        """State and output rows, without the key, after an event."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int:
        """From when on a state is as good as none, or has a row to put out."""
        raise NotImplementedError

    def ended(self, state: tuple) -> list[tuple]:
        """Rows to put out when a state ends."""
        return []

    def _in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = next(frames, None), next(frames, None)
        if second is None:
            if first is not None:
                yield first.sort_values(["at_ms", "id"])
            return
        places: dict[int, int] = {}
        for frame in chain((first, second), frames):
            for stretch, part in frame.groupby(frame["at_ms"] // self.STRETCH):
                n = places[int(stretch)] = places.get(int(stretch), 0) + 1
                self.laid.updateValue((int(stretch), n), (pickle.dumps(part),))
        for stretch in sorted(places):
            keys = [(stretch, n + 1) for n in range(places[stretch])]
            parts = [pickle.loads(self.laid.getValue(key)[0]) for key in keys]
            for key in keys:
                self.laid.removeKey(key)
            yield pd.concat(parts).sort_values(["at_ms", "id"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = state = tuple(self.state.get()) if self.state.exists() else None
        for frame in self._in_order(rows):
            out = []
            for at, event, kind in zip(frame["at_ms"].tolist(), frame["id"].tolist(), frame["kind"].tolist()):
                if state is not None and self.ends(state) <= at:
                    out += self.ended(state)
                    state = None
                state, found = self.step(state, at, event, kind)
                out += found
            yield self._rows(key, out)
        old, new = (None if x is None else self.ends(x) for x in (before, state))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        if state is not None:
            self.state.update(state)
        elif before is not None:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            state = tuple(self.state.get())
            if self.ends(state) <= expiredTimerInfo.getExpiryTimeInMs():
                out = self.ended(state)
                self.state.clear()
        yield self._rows(key, out)

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        kinds = {"long": "int64", "boolean": "bool", "string": "object"}
        fields = [f.split() for f in self.OUTPUT.split(", ")[1:]]
        columns = {name: pd.Series([r[n] for r in out], dtype=kinds[kind]) for n, (name, kind) in enumerate(fields)}
        return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="object"), **columns})

    def close(self) -> None:
        pass


class RateProcessor(EventTimeProcessor):
    """Fixed window anchored at a key's first hit; refused hits count."""

    STATE, OUTPUT = "start long, n long", "key string, at_ms long, id long, n long, granted boolean"

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit

    def ends(self, state):
        return state[0] + self.window

    def step(self, state, at, event, kind):
        start, n = state or (at, 0)
        return (start, n + 1), [(at, event, n + 1, n < self.limit)]


class CrawlProcessor(EventTimeProcessor):
    """State of a document from its fetch results: transient failures in a row fail it in the end, anything else resets them. Failures
    are forgotten when a document has not been fetched for twice its longest interval."""

    STATE, OUTPUT = "failures long, last long", "key string, event_id long, state string, failures long"

    def ends(self, state):
        return state[1] + REST

    def step(self, state, at, event, kind):
        outcome, transient = kind.rstrip("!"), kind.endswith("!")
        failures = (state or (0, 0))[0] + 1 if transient else 0
        name = "failed" if transient and failures >= MAX_ATTEMPTS else "done" if outcome == "parse" else outcome
        return ((failures, at) if failures else None), [(event, name, failures)]


class NonceProcessor(EventTimeProcessor):
    """Challenges: the newest replaces earlier ones, expires after ``ttl`` and is used once."""

    STATE, OUTPUT = "issued long, seen boolean", "key string, event_id long, confirmed boolean"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def ends(self, state):
        return state[0] + self.ttl

    def step(self, state, at, event, kind):
        if kind == "issue":
            return (at, False), []
        return (state and (state[0], True)), [(event, state is not None and not state[1])]


class CooldownProcessor(EventTimeProcessor):
    """Suggestions of a key rest for ``cooldown`` after its document has ended."""

    STATE, OUTPUT = "at long", "key string, event_id long, rests boolean"

    def __init__(self, cooldown: int):
        self.cooldown = cooldown

    def ends(self, state):
        return state[0] + self.cooldown

    def step(self, state, at, event, kind):
        if kind == "ended":
            return (max(at, state[0]) if state else at,), []
        return state, [(event, state is not None)]


class LeaseProcessor(EventTimeProcessor):
    """A document is claimed, its claim completed or its lease over, and it is due again some time after its completion.

    Kinds are `claim`, and `done` or `failed` with the time of the next fetch after a colon. A completion counts only while its claim's lease lasts. When a lease
    ends or a document is due, a row says so without any event of the document.
    """

    STATE, OUTPUT = "state string, until long", "key string, at_ms long, event string"

    def __init__(self, lease: int):
        self.lease = lease

    def ends(self, state):
        return state[1]

    def ended(self, state):
        return [(state[1], "lease over" if state[0] == "claimed" else "due")]

    def step(self, state, at, event, kind):
        if kind == "claim":
            return ("claimed", at + self.lease), [(at, "claimed")]
        outcome, _, due = kind.partition(":")
        if state is None or state[0] != "claimed":
            return state, [(at, "late")]
        return (outcome, max(int(due), at + 1)), [(at, outcome)]


def _stateful(events: DataFrame, processor: EventTimeProcessor, key: str, at: str, event: str, kind, late: str) -> DataFrame:
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.timestamp_millis(at).alias("at"), F.col(at).cast("long").alias("at_ms"), F.col(event).cast("long").alias("id"), kind.alias("kind")
    )
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(processor, processor.OUTPUT, "Append", "EventTime")


#: How late an event may come.
LATE = "1 hour"


def rate_stream(hits: DataFrame, window: int, limit: int, late: str = LATE) -> DataFrame:
    """Stream form of :func:`weft.operators.intake.rate_limit`."""
    return _stateful(hits, RateProcessor(window, limit), "key", "at_ms", "id", F.lit(None).cast("string"), late)


def crawl_state_stream(results: DataFrame, late: str = LATE) -> DataFrame:
    """(event_id, doc_url, state, failures) after each fetch result (doc_url, event_id, fetched_at, next_state, fail_class)."""
    kind = F.concat(F.coalesce("next_state", F.lit("")), F.when(F.col("fail_class") == "transient", "!").otherwise(""))
    told = _stateful(results, CrawlProcessor(), "doc_url", "fetched_at", "event_id", kind, late)
    return told.select("event_id", F.col("key").alias("doc_url"), "state", "failures")


def lease_stream(events: DataFrame, lease: int = LEASE, late: str = LATE) -> DataFrame:
    """(doc_url, at_ms, event) of documents' claims and completions (doc_url, event_id, at_ms, kind), with rows for leases that end and documents that become due.

    Batch form: :func:`weft.operators.crawl.lease_history`.
    """
    return _stateful(events, LeaseProcessor(lease), "doc_url", "at_ms", "event_id", F.col("kind"), late).withColumnRenamed("key", "doc_url")


def nonce_stream(events: DataFrame, ttl: int = DAY, late: str = LATE) -> DataFrame:
    """Stream form of :func:`weft.operators.erase.nonce_consume`."""
    told = _stateful(events, NonceProcessor(ttl), "webid", "at_ms", "event_id", F.col("action"), late)
    return told.select("event_id", F.col("key").alias("webid"), "confirmed")


def cooldown_stream(events: DataFrame, cooldown: int = intake.COOLDOWN, late: str = LATE) -> DataFrame:
    """(event_id, key, rests) of each suggestion among events (key, event_id, at_ms, kind: ended or suggested)."""
    return _stateful(events, CooldownProcessor(cooldown), "key", "at_ms", "event_id", F.col("kind"), late).select("event_id", "key", "rests")


def once_within(rows: DataFrame, time: str, keys: list[str], within: str = "7 days") -> DataFrame:
    """``rows`` without repeats of the same keys within a time after one that passed: the cheap form for plain repeats."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(keys).select(*keys)


def late_discard(completions: DataFrame, docs: DataFrame) -> DataFrame:
    """``completions`` (doc_url, claim_token, ...) of a stream with flag kept: false where the lease has been superseded."""
    current = docs.select("doc_url", "claim_token", F.lit(True).alias("kept"))
    return completions.join(current, ["doc_url", "claim_token"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def tumbling(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, window, n): counts in tumbling windows; ``time`` is a timestamp. In append mode a window's count is put out, and its state
    dropped, when the watermark passes its end; later rows of it are left out and counted by :func:`weft.streaming.run.drain`."""
    return events.withWatermark(time, late).groupBy(key, F.window(time, width)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_window, n): counts in sessions that end after ``gap`` without an event; put out as those of :func:`tumbling`."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))


class Intake:
    """Decisions on notifications in ``foreachBatch``: type, bounds, rate, admission, canonical keys, status and daily cap in turn.

    Rate windows and each day's admissions are carried from batch to batch in ``folder``, so however the input is cut into batches in its order, the decisions are the
    same. A replayed batch starts from what the batches before it left and writes the same rows again.
    """

    def __init__(self, spark, folder: str, docs: DataFrame, tombstones: DataFrame, now: int, daily: int, rate: tuple[int, int]):
        self.docs, self.tombstones, self.now, self.daily, self.rate = docs, tombstones, now, daily, rate
        self.windows, self.days, self.decisions = (Versions(spark, f"{folder}/{name}") for name in ("windows", "days", "decisions"))

    def __call__(self, suggestions: DataFrame, objects: DataFrame, batch_id: int) -> None:
        """Decide on a batch (event_id, at_ms, user_id, type, n_objects) with its candidates (id, webid)."""
        good = suggestions.filter(F.col("type").isin(intake.ACCEPTED_TYPES) & F.col("n_objects").between(1, intake.MOST_OBJECTS))
        hits = good.select(F.concat(F.lit("ip:"), "user_id").alias("key"), "at_ms", F.col("event_id").alias("id"))
        windows, days = self.windows.before(batch_id), self.days.before(batch_id)
        numbered = cut(intake.rate_limit(hits, *self.rate, carried=windows))
        granted = cut(intake.daily_admission(numbered.filter("granted").select("id", "at_ms"), self.daily, days))
        candidates = objects.select("id", F.col("webid").alias("raw")).join(granted.select("id", "admitted"), "id")
        refused = admission_reason(F.col("raw")).isNotNull()
        # Few bytes and much work, so dealt anew to all cores.
        candidates = candidates.repartition("id", "raw")
        keyed = cut(candidates.select("id", "admitted", canonical_webid(F.col("raw")).alias("webid"), canonical_doc_url(F.col("raw")).alias("doc_url"), refused.alias("refused")))
        known = intake.suggestion_status(keyed, self.docs, self.tombstones, self.now)
        status = F.when(F.col("refused") | F.col("webid").isNull(), F.lit("refused")).otherwise(F.col("status"))
        # Two short columns that are asked for four times.
        decided = cut(intake.intake_decision(known.select("id", status.alias("status"), "admitted")))
        rest = suggestions.select(F.col("event_id").alias("id")).join(decided, "id", "left_anti")
        limited = rest.join(good.select(F.col("event_id").alias("id")), "id", "left_semi").select("id", F.lit("rate-limited").alias("decision"))
        all_ = decided.union(limited).union(rest.join(limited, "id", "left_anti").select("id", F.lit("invalid").alias("decision")))
        self.decisions.put(all_, batch_id)
        self.windows.put(self._windows(numbered, windows), batch_id)
        self.days.put(self._days(granted, days), batch_id)

    def _windows(self, numbered: DataFrame, old: DataFrame | None) -> DataFrame:
        """The last window (key, start, n) of each key that has not been over for a window's length."""
        width = self.rate[0]
        last = numbered.groupBy("key").agg(F.max(F.struct("at_ms", "n"))["n"].alias("n"), F.max("at_ms").alias("at"))
        began = numbered.filter("n = 1").groupBy("key").agg(F.max("at_ms").alias("start"))
        new = last.join(began, "key", "left")
        if old is None:
            return new.select("key", "start", "n")
        both = new.join(old.select("key", F.col("start").alias("old_start"), F.col("n").alias("old_n")), "key", "full_outer")
        kept = both.select("key", F.coalesce("start", "old_start").alias("start"), F.coalesce("n", "old_n").alias("n"))
        latest = numbered.agg(F.max("at_ms")).first()[0]
        return kept if latest is None else kept.filter(F.col("start") > latest - 2 * width)

    def _days(self, granted: DataFrame, old: DataFrame | None) -> DataFrame:
        """(day, n): admissions so far."""
        new = granted.filter("admitted").groupBy(F.floor(F.col("at_ms") / DAY).alias("day")).agg(F.count("*").alias("n"))
        return (new if old is None else new.union(old.select("day", "n"))).groupBy("day").agg(F.sum("n").alias("n"))

    def read(self) -> DataFrame:
        """(id, decision) of all batches; no rows before the first."""
        return self.decisions.all("id long, decision string")


class RunningStats:
    """Counters (k, v) kept by signed deltas in ``foreachBatch``: each batch writes a new version named after it. The newest older
    version is found in the folder, also after a restart, and a replayed batch whose version is complete is not applied twice.
    """

    def __init__(self, spark, folder: str, start: DataFrame | None = None):
        self.versions = Versions(spark, folder)
        if start is not None and not self.versions.ids():
            self.versions.put(start, -1)

    def __call__(self, old: DataFrame, new: DataFrame, batch_id: int) -> None:
        """Triples ``old`` are replaced by ``new``, both those of the same people."""
        if self.versions.has(batch_id):
            return
        change = stats.delta(old, new)
        before = self.versions.before(batch_id)
        self.versions.put(stats.apply(before if before is not None else change.limit(0), change), batch_id)

    def read(self) -> DataFrame:
        newest = self.versions.before(1 << 62)
        return stats.visible(newest if newest is not None else self.versions.all("k string, v long"))
