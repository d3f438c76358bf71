"""Queries of the operators that learn: op2, op7 and op9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from .katz import katz_scores
from .license_scan import license_scan
from .shared import remainder_of_id, table


def held_out(divisor: int) -> Column:
    """Whether a document's text was kept from training; one without an id was not."""
    return F.coalesce(remainder_of_id("doc_id", divisor) == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(4)))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, F.col("license_score").alias("score"))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents").select("doc_id", "text", held_out(7).alias("held_out")))


QUERIES = {"op2_katz_scores": op2_katz_scores, "op7_license_scan": op7_license_scan, "op9_language_id": op9_language_id}
ORACLE_SQL = {}
