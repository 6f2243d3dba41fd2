"""A training-corpus pipeline over ``documents``, made of the operators in ``weft.llm``.

Each stage takes (spark, docs, sf_dir) and returns documents again, but the last, which returns token ids. A document's
columns are doc_id, text, lang, source and n_chars; other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import byte_bpe, decontaminate, near_dedup, pii, toxicity
from weft.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The lexicon is fitted to the labelled documents among ``docs``."""
    docs = docs.select(*COLUMNS)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col("toxicity.score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    found = decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter("size(leaks.hits) = 0").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in angle brackets and n_chars counted anew."""
    masked = pii.mask(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids of each text and whether decoding them gives the text back."""
    done = byte_bpe.encode(docs.select(*COLUMNS))
    same = F.col("bpe.decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return done.select(
        "doc_id", "lang", "source", F.col("bpe.ids").alias("ids"), F.size("bpe.ids").cast("long").alias("n_tokens"), same.alias("round_trip")
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("byte-level BPE encoding and decoding", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: The fitted lexicon, the random field and the merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None
