"""Queries of the corpus operators and the SQL that checks them, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import (
    alignment,
    byte_bpe,
    decontaminate,
    fingerprints,
    language_id,
    licenses,
    near_dedup,
    pii,
    prefix_trie,
    sharding,
    token_counts,
    toxicity,
    url_filter,
)
from .common import table


def op1_url_filters(spark, sf_dir):
    return url_filter.op1(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark, sf_dir):
    return fingerprints.op2(table(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return sharding.op3(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark, sf_dir):
    return near_dedup.op5(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark, sf_dir):
    return licenses.op7(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.op8(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.op9(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.op10(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.op11(table(spark, sf_dir, "conversations"))


def op12_alignment(spark, sf_dir):
    return alignment.op12(table(spark, sf_dir, "documents"))


def op13_language_id(spark, sf_dir):
    return language_id.op13(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_fingerprints,
        op3_sharding,
        op4_decontaminate,
        op5_near_dedup,
        op6_toxicity,
        op7_licenses,
        op8_token_counts,
        op9_byte_bpe,
        op10_pii,
        op11_prefix_trie,
        op12_alignment,
        op13_language_id,
    )
}

ORACLE_SQL = {"op4_decontaminate": decontaminate.OP4_SQL, "op5_near_dedup": near_dedup.OP5_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL}
