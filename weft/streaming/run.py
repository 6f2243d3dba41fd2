"""Running a stream over what has landed, to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.tables import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


class Versions:
    """A table of small state that each micro-batch writes anew under its id, in a shared folder, so that it outlives the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def ids(self) -> list[int]:
        """Ids of the complete versions, ascending."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.lstrip("-").isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")))

    def before(self, batch_id: int) -> DataFrame | None:
        """The newest version older than ``batch_id``."""
        older = [n for n in self.ids() if n < batch_id]
        return self.spark.read.parquet(f"{self.folder}/{older[-1]}") if older else None

    def all(self, kind: str) -> DataFrame:
        """Rows of all versions; none, of the columns ``kind``, where there is no version."""
        ids = self.ids()
        return self.spark.read.parquet(*[f"{self.folder}/{n}" for n in ids]) if ids else self.spark.createDataFrame([], kind)

    def put(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}")

    def has(self, batch_id: int) -> bool:
        return batch_id in self.ids()


def landed(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, at most ``files`` in a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern, since a stream's plain path must be a folder and the table may be one file.
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


class Drained(NamedTuple):
    """What a run of a stream has done: the folder of its output, how many batches this run took, and how many rows it
    left out because the watermark had passed them."""

    out: str
    batches: int
    late_rows: int


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> Drained:
    """Run ``stream`` until all landed rows are through; its output is Parquet in a folder, or with ``each`` goes to each(batch, batch_id).

    ``folder`` names a durable place in the shared file system for the stream's progress, state and output. Another run of the same stream with that folder, after
    its end or a failure, goes on where the last one stopped: files read and rows put out are not read or put out again, and a batch that had not ended is
    run again under its old number. Without a name the run is one by itself. State is kept in RocksDB, in as many partitions as the session shuffles into when
    the folder is new. The counts are of this run's last 10,000 batches at most.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.numRecentProgressUpdates": "10000"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
        writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{folder}/out")
        running = writer.start()
        try:
            running.awaitTermination()
            told = [p for p in running.recentProgress]
        finally:
            running.stop()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    late = sum(operator["numRowsDroppedByWatermark"] for p in told for operator in p["stateOperators"])
    return Drained(f"{folder}/out", len({p["batchId"] for p in told}), late)


def rows_of(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows that an append-mode stream has put out for what has landed, in all runs with ``folder``."""
    return stream.sparkSession.read.schema(stream.schema).parquet(drain(stream, folder=folder).out)


#: Fixed value: the time of an end mark, later than any event's.
END = "9999-01-01 00:00:00"


def rows_to_end(events: DataFrame, time: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that the append-mode stream ``make(events)`` puts out for all that has landed, with those that wait for the watermark.

    When the events are through, an end mark lands: a row of nulls but for its late ``time``. The run goes on with it and the watermark passes all windows and sessions but the mark's own, which stays open.
    """
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    blank = spark.range(1).select(*[F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in events.schema])
    blank.limit(0).write.parquet(f"{folder}/ends")
    stream = make(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/ends")))
    drain(stream, folder=f"{folder}/run")
    blank.write.mode("append").parquet(f"{folder}/ends")
    return rows_of(stream, f"{folder}/run")
