"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.tables import cut  # noqa: F401

#: A driver-side lookup is broadcast up to this many rows; beyond it the operators join by shuffle.
BROADCAST_ROWS = 100_000

#: Rows of an Arrow batch: a worker holds one batch of whole texts at a time.
BATCH_ROWS = 500

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, _UPPER, _UPPER.lower())


def bounded_sample(rows: DataFrame, most: int, count: int, *by: str) -> DataFrame:
    """At most ``most`` of ``rows``, those of the smallest hash of ``by``; ``count`` is the number of rows or less.

    A filter on the hash first leaves about twice as many, so the final ordering sees few rows at any size.
    """
    hashed = F.xxhash64(*by)
    return rows.filter(F.pmod(hashed, F.lit(max(1, count // (2 * most)))) == 0).orderBy(hashed, *by).limit(most)


def spaced_words(column):
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text after lower-casing A-Z; null gives no words."""
    return F.filter(F.split(ascii_lower(F.coalesce(column, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of few rows; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return free memory to the system: Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; now and then, and at the end, the worker gives its free memory back."""
    try:
        for n, batch in enumerate(batches):
            yield batch
            if n % 4 == 3:
                give_back()
    finally:
        gc.collect()
        give_back()


_held: dict[str, tuple[Hashable, object]] = {}


def held(name: str, key: Hashable, make: Callable[[], object]):
    """The value of ``make()``, held by a worker process for its later tasks too; one value for each ``name``, that of the last ``key``."""
    if name not in _held or _held[name][0] != key:
        _held[name] = (key, make())
    return _held[name][1]


class Recent:
    """Values by key, of which at least half of ``most``, those last asked for, are kept, and at most ``most``."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def get_all(self, keys: list, missing: Callable[[list], list]) -> list:
        """The value of each of the distinct ``keys``; those of unknown keys come from ``missing(unknown keys)``."""
        new, old = self.new, self.old
        out, unknown = list(map(new.get, keys)), []
        for n in [n for n, v in enumerate(out) if v is None]:
            if (v := old.get(keys[n])) is None:
                unknown.append(n)
            else:
                out[n] = new[keys[n]] = v
        if unknown:
            for n, v in zip(unknown, missing([keys[n] for n in unknown]), strict=True):
                out[n] = new[keys[n]] = v
        if len(new) > self.half:
            self.old, self.new = new, {}
        return out


def with_struct(
    df: DataFrame, text: str, into: str, kind: str, work: Callable[[], Callable[[pa.Array], list]]
) -> DataFrame:
    """Append struct column ``into`` of DDL type ``kind``, computed from string column ``text``.

    ``work()`` is called once for each task and gives a function from an Arrow string array to
    a list of dicts or an Arrow array, a value for each row. A column already named ``into`` is replaced.
    """
    df = df.drop(into)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T._parse_datatype_string(kind))])
    arrow_kind = _arrow(schema[into].dataType)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = work()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fn(batch.column(batch.schema.get_field_index(text)))
            if isinstance(out, pa.Array):
                out = out if out.type == arrow_kind else out.cast(arrow_kind)
            else:
                out = pa.array(out, arrow_kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, into])

    return df.mapInArrow(lambda batches: release(run(batches)), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
