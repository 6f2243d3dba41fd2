"""Suggestions: extraction, status, rate limits, daily admission and decisions. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.tables import cut
from weft.sources.logs import ACCEPTED_TYPES

DAY = 86_400_000
MOST_OBJECTS, DAILY, COOLDOWN = 10, 5_000, 7 * DAY
TERMINAL = ["done", "skipped", "failed", "blocked"]


def activity_extract(triples: DataFrame) -> DataFrame:
    """(id, types, objects, actor) of activities given as (id, subject, predicate, value): objects of subjects of an
    accepted type only; an activity without one yields no row."""
    typed = triples.filter((F.col("predicate") == "type") & F.col("value").isin(ACCEPTED_TYPES)).select("id", "subject").distinct()
    own = triples.join(typed, ["id", "subject"], "left_semi")
    pick = lambda p: F.array_sort(F.collect_set(F.when(F.col("predicate") == p, F.col("value"))))
    types = F.filter(pick("type"), lambda t: t.isin(ACCEPTED_TYPES))
    actor = F.min(F.when(F.col("predicate") == "actor", F.col("value")))
    return own.groupBy("id").agg(types.alias("types"), pick("object").alias("objects"), actor.alias("actor"))


def candidate_bounds(rows: DataFrame, objects: str = "objects") -> DataFrame:
    """``rows`` with flag in_bounds: one to ten candidates."""
    return rows.withColumn("in_bounds", F.size(objects).between(1, MOST_OBJECTS))


#: Rows of one key, about, that one task joins.
FREQUENT = 50_000


def _looked_up(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``known``, which has one row for a key. Rows of a frequent key, or of none, are dealt to as many tasks as their number asks for."""
    parts = F.ceil(F.col("n") / FREQUENT).cast("int").alias("__parts")
    frequent = cut(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > FREQUENT).select(key, parts))  # one for FREQUENT rows at most
    if frequent.isEmpty():
        return rows.join(known, key, "left")
    dealt, count = F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1))
    part = F.when(F.col(key).isNull(), F.pmod(dealt, F.lit(1000))).otherwise(F.pmod(dealt, count)).cast("int")
    left = rows.join(F.broadcast(frequent), key, "left").withColumn("__part", part).drop("__parts")
    right = known.join(F.broadcast(frequent), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), count - 1))).drop("__parts")
    return left.join(right, [key, "__part"], "left").drop("__part")


def suggestion_status(candidates: DataFrame, docs: DataFrame, tombstones: DataFrame, now: int, cooldown: int = COOLDOWN) -> DataFrame:
    """``candidates`` (webid, doc_url, ...) with status: tombstoned, cooldown, live or unknown, by either key, the strictest first.

    A document in a terminal state (state, terminal_at) cools down for ``cooldown`` after it; others are live.
    """
    level = (
        F.when(F.col("state") == "tombstone", F.lit(3))
        .when(F.col("state").isin(TERMINAL) & (F.col("terminal_at") > now - cooldown), F.lit(2))
        .otherwise(F.lit(1))
    )
    known = docs.select("webid", "doc_url", level.alias("level")).union(tombstones.select("webid", "doc_url", F.lit(3)))
    by_webid = known.filter("webid IS NOT NULL").groupBy("webid").agg(F.max("level").alias("a"))
    by_doc = known.filter("doc_url IS NOT NULL").groupBy("doc_url").agg(F.max("level").alias("b"))
    both = _looked_up(_looked_up(candidates, by_webid, "webid"), by_doc, "doc_url")
    names = F.lit(["unknown", "live", "cooldown", "tombstoned"])
    strictest = F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))
    return both.withColumn("status", F.element_at(names, strictest + 1)).drop("a", "b")


#: Slices of a window whose hits are numbered by one task each, and salts of a day's rows.
SLICES, SALTS = 64, 32
#: Hits in a row without a gap of a window's length that one task folds; in longer runs pointers are doubled.
FOLDED = 100_000


def _window_starts(times: DataFrame, window: int) -> DataFrame:
    """(key, start) of all windows of ``times`` (key, at_ms).

    A gap of a window's length always begins a window, so a key's times are first cut at such gaps, which its first and last times in each era of a
    window's length show. A run of up to FOLDED hits is then folded over its distinct times; in a longer one each time points to
    the first one that a window begun by it leaves out, and the pointers are doubled.
    """
    times = times.withColumn("era", F.floor(F.col("at_ms") / window))
    eras = times.groupBy("key", "era").agg(F.min("at_ms").alias("low"), F.max("at_ms").alias("high"), F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy("era")
    gap = F.col("low") - F.lag("high").over(order) >= window
    runs = eras.withColumn("gap", gap).withColumn("run", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(order))
    runs = cut(runs.select("key", "era", "run", F.sum("n").over(Window.partitionBy("key", "run")).alias("hits")))
    owned = times.join(runs, ["key", "era"])
    step = lambda done, t: F.when((F.size(done) == 0) | (F.element_at(done, -1) + window <= t), F.array_append(done, t)).otherwise(done)
    few = owned.filter(F.col("hits") <= FOLDED).groupBy("key", "run").agg(F.array_sort(F.collect_set("at_ms")).alias("t"))
    none = F.array().cast("array<bigint>")
    starts = few.select("key", F.explode(F.aggregate("t", none, lambda done, t: F.when(F.size(done) == 0, F.array(t)).otherwise(step(done, t)))).alias("start"))
    if runs.filter(F.col("hits") > FOLDED).isEmpty():
        return starts
    many = owned.filter(F.col("hits") > FOLDED).select("key", "run", "at_ms").distinct()
    return starts.union(_followed(cut(many), window))


def _next_starts(times: DataFrame, window: int) -> DataFrame:
    """(key, run, at_ms, next): for each of the distinct ``times`` (key, run, at_ms) the first one from a window's length later on, where there is one.

    A run's times are cut into cells of a part of a window, so a cell is one task's work; what a cell lacks is the first time of the next cell that has any.
    """
    cell = F.floor(F.col("t") / max(1, window // SLICES)).alias("cell")
    points = times.select("key", "run", F.col("at_ms").alias("t"), F.col("at_ms").alias("point"), F.lit(None).cast("long").alias("asks"))
    asks = times.select("key", "run", (F.col("at_ms") + window).alias("t"), F.lit(None).cast("long").alias("point"), F.col("at_ms").alias("asks"))
    both = points.union(asks).select("*", cell)
    later = Window.partitionBy("key", "run").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = both.groupBy("key", "run", "cell").agg(F.min("point").alias("low")).select("key", "run", "cell", F.min("low").over(later).alias("after"))
    # From the cell's end back, a time before those that ask for it.
    back = Window.partitionBy("key", "run", "cell").orderBy(F.desc("t"), F.col("point").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("inside", F.min("point").over(back)).filter("asks IS NOT NULL").join(cells, ["key", "run", "cell"])
    return found.select("key", "run", F.col("asks").alias("at_ms"), F.coalesce("inside", "after").alias("next")).filter("next IS NOT NULL")


def _followed(times: DataFrame, window: int) -> DataFrame:
    """(key, start) of all windows of runs of distinct ``times`` (key, run, at_ms), by doubling pointers.

    Known starts are followed by the pointers, and the pointers by themselves, so each round knows twice as many starts of every run and pointers reach twice as far: as many rounds as
    the logarithm of the windows of the longest run.
    """
    known = times.groupBy("key", "run").agg(F.min("at_ms").alias("at_ms"))
    pointers = cut(_next_starts(times, window))
    while True:
        more = cut(known.join(pointers, ["key", "run", "at_ms"]).select("key", "run", F.col("next").alias("at_ms")))
        if more.isEmpty():
            return known.select("key", F.col("at_ms").alias("start"))
        known = known.union(more)
        far = pointers.select("key", "run", F.col("at_ms").alias("next"), F.col("next").alias("far"))
        pointers = cut(pointers.join(far, ["key", "run", "next"]).select("key", "run", "at_ms", F.col("far").alias("next")))


def rate_limit(hits: DataFrame, window: int, limit: int, carried: DataFrame | None = None) -> DataFrame:
    """``hits`` (key, at_ms, id) with n, the hit's number in its window, and granted.

    A window begins with a key's first hit and lasts ``window``; the next hit after it begins another. Refused hits
    count too. ``carried`` (key, start, n) are windows that earlier hits have begun, and their numbers of hits so far.

    Only window starts are found one after the other; hits are then joined with their start, counted in slices of a window and
    numbered inside a slice, so a busy key is many tasks' work.
    """
    rows = hits.select("key", F.col("at_ms").cast("long").alias("at_ms"), F.col("id").cast("long").alias("id"))
    times = rows.select("key", "at_ms")
    if carried is not None:
        times = times.union(carried.join(rows.select("key").distinct(), "key", "left_semi").select("key", "start"))
    starts = cut(_window_starts(times, window))
    if carried is not None:
        starts = starts.join(carried.select("key", "start", F.col("n").alias("had")), ["key", "start"], "left")
    else:
        starts = starts.withColumn("had", F.lit(0))
    # A hit's window begins in its own era of a window's length or in the one before.
    era = lambda c: F.floor(c / window)
    begun = starts.select("key", "start", F.coalesce("had", F.lit(0)).alias("had"), F.explode(F.array(era(F.col("start")), era(F.col("start")) + 1)).alias("era"))
    inside = (F.col("at_ms") >= F.col("start")) & (F.col("at_ms") < F.col("start") + window)
    owned = rows.withColumn("era", era(F.col("at_ms"))).join(begun, ["key", "era"]).filter(inside)
    owned = owned.withColumn("slice", F.floor((F.col("at_ms") - F.col("start")) * SLICES / window))
    counts = owned.groupBy("key", "start", "slice").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("key", "start").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "start", "slice", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("key", "start", "slice").orderBy("at_ms", "id"))
    n = (F.col("had") + F.col("before") + F.col("own")).cast("long")
    return owned.withColumn("own", own).join(before, ["key", "start", "slice"]).select("key", "at_ms", "id", n.alias("n"), (n <= limit).alias("granted"))


def daily_admission(rows: DataFrame, most: int = DAILY, used: DataFrame | None = None) -> DataFrame:
    """``rows`` (at_ms, id; ids are unique) with admitted: the first ``most`` of each UTC day; others are deferred. ``used`` (day, n) are
    admissions of earlier batches, days counted from 1970.

    Each of a day's salts keeps its first rows, the day's last admitted one is found among those, and all rows are compared with it.
    """
    keyed = rows.withColumn("__day", F.floor(F.col("at_ms") / DAY))
    stamp = F.struct("at_ms", "id")
    salted = Window.partitionBy("__day", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("at_ms", "id")
    few = keyed.select("__day", "at_ms", "id").withColumn("__n", F.row_number().over(salted)).filter(F.col("__n") <= most)
    ranked = few.withColumn("__n", F.row_number().over(Window.partitionBy("__day").orderBy("at_ms", "id"))).select("__day", "__n", stamp.alias("__at"))
    if used is not None:
        ranked = ranked.join(used.select(F.col("day").alias("__day"), F.col("n").alias("__used")), "__day", "left")
        room = most - F.coalesce("__used", F.lit(0))
    else:
        room = F.lit(most)
    cutoffs = ranked.filter(F.col("__n") <= room).groupBy("__day").agg(F.max("__at").alias("__last"))
    return keyed.join(cutoffs, "__day", "left").withColumn("admitted", F.coalesce(stamp <= F.col("__last"), F.lit(False))).drop("__day", "__last")


def intake_decision(objects: DataFrame) -> DataFrame:
    """(id, decision) from candidates (id, status, admitted): accepted, deferred, refused, already or invalid, in this order."""
    count = lambda c: F.count(F.when(c, F.lit(1)))
    fresh = F.col("status") == "unknown"
    sums = objects.groupBy("id").agg(
        count(fresh & F.col("admitted")).alias("a"),
        count(fresh & ~F.col("admitted")).alias("d"),
        count(F.col("status") == "tombstoned").alias("t"),
        count(F.col("status").isin("live", "cooldown")).alias("k"),
    )
    decision = (
        F.when(F.col("a") > 0, F.lit("accepted"))
        .when(F.col("d") > 0, F.lit("deferred"))
        .when((F.col("t") > 0) & (F.col("k") == 0), F.lit("refused"))
        .when(F.col("k") > 0, F.lit("already"))
        .otherwise(F.lit("invalid"))
    )
    return sums.select("id", decision.alias("decision"))


def drain(rows: DataFrame, most: int = DAILY) -> DataFrame:
    """Deferred notifications (id, at_ms, processed) that a day's run admits, the oldest first."""
    return rows.filter(~F.col("processed")).orderBy("at_ms", "id").limit(most)
