"""Maintenance of keyed tables as new snapshots: upserts, inserts, schema growth, lookups and pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session without executors of its own may go without: a cluster's machines would not see each other's files.
    """
    place = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="weft-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so lost executors cost no recomputation of the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def live(docs: DataFrame) -> DataFrame:
    """Documents that may be shown: all but tombstones."""
    return docs.filter("state != 'tombstone'")


def lookup(urls: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """``urls`` (doc_url, ...) annotated with ``columns`` of their live document, null where there is none."""
    return urls.join(live(docs).select("doc_url", *columns), "doc_url", "left")


def exists(urls: DataFrame, docs: DataFrame) -> DataFrame:
    """``urls`` with flag ``present``: is there a live document?"""
    known = live(docs).select("doc_url").distinct().withColumn("present", F.lit(True))
    return urls.join(known, "doc_url", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def upsert(existing: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """``existing`` with the latest change for each key put in its place or added; the columns of both are kept."""
    last = Window.partitionBy(key).orderBy(F.col(version).desc(), F.xxhash64(*changes.columns))
    latest = changes.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: the first of ``new`` for each key that ``existing`` lacks."""
    first = Window.partitionBy(key).orderBy(order)
    once = new.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return once.join(existing.select(key), key, "left_anti")


def evolve(existing: DataFrame, more: DataFrame) -> DataFrame:
    """``existing`` with the columns of ``more`` that it lacks, null; nothing changes the second time."""
    return existing.unionByName(more.limit(0), allowMissingColumns=True)


def enum_rejected(allowed: dict[str, list[str]]) -> Column:
    """Does a row have a value outside the allowed ones? Null is allowed."""
    bad = F.lit(False)
    for column, values in allowed.items():
        bad = bad | F.coalesce(~F.col(column).isin(values), F.lit(False))
    return bad


def key_page(rows: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """First ``size`` + 1 rows by ``key`` after a cursor."""
    rows = rows.filter(F.col(key) > F.lit(after)) if after is not None else rows
    return rows.orderBy(key).limit(size + 1)


def newest_page(rows: DataFrame, time: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """First ``size`` + 1 rows, newest first, ties by descending key, before a cursor (time, key)."""
    if after:
        rows = rows.filter((F.col(time) < after[0]) | ((F.col(time) == after[0]) & (F.col(key) < after[1])))
    return rows.orderBy(F.col(time).desc(), F.col(key).desc()).limit(size + 1)


# Tables in the shared folder.


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def store_parts(rows: DataFrame, folder: str, key: str, parts: int) -> None:
    """Write a table in ``parts`` folders by a hash of its key, so that an upsert can replace few of them. Each part is written by as many tasks as its rows ask for."""
    rows.withColumn("part", _part(key, parts)).repartition("part", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(16))).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
    rows.sparkSession.createDataFrame([(parts,)], "parts int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/head")


def stored_parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows").drop("part")


def upsert_parts(folder: str, changes: DataFrame, key: str, version: str) -> list[int]:
    """:func:`upsert` into a table of :func:`store_parts`: only the parts that hold a changed key are read and written. Returns their numbers.

    The new rows of those parts are written out before the old ones are replaced, so they do not depend on what they replace; changes have no columns that the table lacks. Run again after a
    failure it gives the same table.
    """
    spark = changes.sparkSession
    parts = spark.read.parquet(f"{folder}/head").first()[0]
    changes = cut(changes.withColumn("part", _part(key, parts)))
    touched = sorted(r[0] for r in changes.select("part").distinct().collect())  # as many as parts, at most
    if touched:
        old = spark.read.parquet(f"{folder}/rows").filter(F.col("part").isin(touched))
        new = cut(upsert(old, changes, key, version))
        spread = new.repartition("part", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(16)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/rows")
    return touched


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot that a commit starts from."""


class Snapshots:
    """Several tables that change together. A commit writes all of them to new folders and then one small file that names them; readers take the newest such file.

    A writer that dies before that file leaves nothing that a reader sees, and of two writers that start from one snapshot the second is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def version(self) -> int:
        """Number of the newest snapshot, 0 before the first."""
        fs, path = _path(self.spark, f"{self.folder}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot by name, the newest if none is named; none before the first."""
        version = version or self.version()
        if not version:
            return {}
        lines = [r.value for r in self.spark.read.text(f"{self.folder}/commits/{version}").collect()]
        return {name: self.spark.read.parquet(place) for name, place in (line.split("\t") for line in lines)}

    def commit(self, tables: dict[str, DataFrame], after: int) -> int:
        """Make ``tables``, all of them, the snapshot that follows ``after``."""
        own = f"{self.folder}/data/{after + 1}-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{own}/{name}")
        text = "".join(f"{name}\t{own}/{name}\n" for name in sorted(tables))
        # A file is written elsewhere first and then renamed, which does not replace one that is there.
        fs, draft = _path(self.spark, f"{own}/_commit")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, place = _path(self.spark, f"{self.folder}/commits/{after + 1}")
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(draft, place):
            raise Conflict(f"snapshot {after + 1} is there already")
        return after + 1


def store_sorted(rows: DataFrame, folder: str, by: list[str], bloom: dict[str, int], group_bytes: int = 16 << 20) -> None:
    """Write rows in order of ``by``, with Bloom filters on the columns of ``bloom`` for about so many values in a row group.

    A lookup by the first of ``by`` opens only row groups whose range holds the value, one by a filtered column only those whose filter may.
    """
    writer = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("parquet.block.size", group_bytes)
    for column, values in bloom.items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", values)
    writer.parquet(folder)


#: Rows of a range, about, that one task puts in order.
ROWS_PER_RANGE = 200_000


def number_groups(rows: DataFrame, group: list[str], order: list[str], into: str, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``rows`` with their number from 0 among those of the same ``group`` (none: all), in the order of ``order``, in column ``into``.

    Spark cuts the rows into as many ranges as their number asks for, by group and order, so that a large group lies in several; each range is sorted
    by itself, and a group that goes on from earlier ranges is counted on by the number of its rows in them. Nulls are a group of their own.
    """
    rows = cut(rows)
    parts = -(-rows.count() // per_range) or 1
    # Cut again: bounds of ranges come from samples, and counts and numbers must see the same ranges.
    ranged = cut(rows.repartitionByRange(parts, *group, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*group, "__range").agg(F.count("*").alias("n"))
    # Only the first group of a range can go on from earlier ones, so this has at most one row for each range.
    starts = counts.withColumn("__first", F.sum("n").over(before)).filter("__first > 0")
    starts = starts.select(F.col("__range").alias("__at"), *[F.col(g).alias(f"__g_{g}") for g in group], "__first")
    same = F.col("__range") == F.col("__at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    own = Window.partitionBy("__range", *group).orderBy(*order)
    place = F.coalesce("__first", F.lit(0)) + F.row_number().over(own) - 1
    return ranged.join(F.broadcast(starts), same, "left").select(*rows.columns, place.cast("long").alias(into))
