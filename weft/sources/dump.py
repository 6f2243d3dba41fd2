"""Paged dumps of the served triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.triples import TERMS, line


def manifest(numbered: DataFrame) -> DataFrame:
    """(page_no, n, first_s, last_s, next_page) of triples with their page numbers; the last page has no next."""
    pages = numbered.groupBy("page_no").agg(F.count("*").alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))
    following = pages.select((F.col("page_no") - 1).alias("page_no"), F.col("page_no").alias("next_page"))
    return pages.join(following, "page_no", "left")


def write_dump(triples: DataFrame, folder: str, size: int) -> None:
    """Write distinct triples in order as N-Triples files of at most ``size`` statements.

    Spark cuts them into ranges, which are written side by side; the names of the files are in the order of what they hold. The last file of a range is not full.
    """
    ordered = triples.select(*TERMS).distinct().repartitionByRange(*TERMS).sortWithinPartitions(*TERMS)
    ordered.select(line(*[F.col(c) for c in TERMS]).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", size).text(folder)


def read_dump(spark: SparkSession, folder: str) -> DataFrame:
    """(file, value): the statements of a dump and the files that they are in."""
    return spark.read.text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value").filter("value != ''")


def written_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(page_no, file, n, first, last, next_file) of a dump, from what was written; a row for each file."""
    files = read_dump(spark, folder).groupBy("file").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
    order = Window.orderBy("file")
    return files.select((F.row_number().over(order) - 1).cast("long").alias("page_no"), "file", "n", "first", "last", F.lead("file").over(order).alias("next_file"))
