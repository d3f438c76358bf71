"""A corpus pipeline of five operators of runloom.llm, applied to the table ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; ``run`` writes what a stage
returns as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import language_id
from runloom.llm.decontamination import decontaminate
from runloom.llm.line_dedup import line_dedup
from runloom.llm.mixing import mix_sources, quality_weights, word_count
from runloom.llm.ngram_jaccard import ngram_jaccard_join
from runloom.llm.query_model import held_out
from runloom.llm.shared import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; learns as the query op9 does, from three quarters of docs."""
    model = language_id.fit(docs.where(~held_out(4)))
    return language_id.identify(docs.select(COLUMNS), model).where("not lang_rejected").select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; a document all of whose lines go, goes."""
    left = line_dedup(docs.select(COLUMNS), window=3)
    shorter = F.col("n_removed") > 0
    n_chars = F.when(shorter, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.where(~shorter | (F.col("n_removed") < F.col("n_lines"))).withColumn("n_chars", n_chars).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (5-word shingles, Jaccard 0.8).

    Of rows that repeat that doc_id with equal sets of shingles one stays. Documents without words or id stay.
    """
    _, members = ngram_jaccard_join(docs, k=5, percent=80, every_link=False)
    gone = members.where("n_shingles > 0 and doc_id != component_id").select("doc_id").distinct()
    kept = docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)
    twice = members.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    marked = kept.join(twice, F.col("doc_id") == F.col("_id"), "left")
    once = marked.where("_id is not null").groupBy("doc_id").agg(F.min(F.struct(*[F.col(c) for c in COLUMNS[1:]])).alias("r")).select("doc_id", "r.*")
    return marked.where("_id is null").select(COLUMNS).unionByName(once)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), window=10, locate=False).where("n_hit = 0").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix of sources takes; the texts are those of the stage before, by doc_id."""
    sized = docs.select("doc_id", "lang", "source", "n_chars", word_count().alias("size"))
    found = mix_sources(quality_weights(sized, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "lang", "source", "n_chars", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Language identification and similarity joins are not SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
