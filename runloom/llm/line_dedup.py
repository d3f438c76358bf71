"""Line deduplication by overlapping windows of three lines.

Consecutive lines are hashed, windows that occur more than once anywhere are found by one aggregation, and every
occurrence but the first (smallest doc_id, then place) is removed: the lines that such windows cover, merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def repeated_places(docs: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, places): the lines of each text, from 0, that later occurrences of repeated windows cover, sorted."""
    hashes = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("x"), F.hash(x).alias("y")))
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", hashes.alias("h"))
    lines = lines.where(F.size("h") >= window)
    starts = F.sequence(F.lit(0), F.size("h") - window)
    keys = F.transform(starts, lambda i: F.struct(i.cast("int").alias("at"), F.xxhash64(F.slice("h", i + 1, window)).alias("k1"), F.hash(F.slice("h", i + 1, window)).alias("k2")))
    windows = stored(lines.select("doc_id", F.explode(keys).alias("w")).select("doc_id", "w.*"))
    first = windows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Stored, so that the join with a window that very many texts have can be split.
    later = windows.join(stored(first), ["k1", "k2"]).where(F.struct("doc_id", "at") != F.col("first"))
    # Sets are combined before the shuffle: however often a doc_id is repeated, no more than its lines come together.
    starts = later.groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    covered = F.flatten(F.transform("starts", lambda at: F.sequence(at, at + (window - 1))))
    return starts.select("doc_id", F.array_sort(F.array_distinct(covered)).alias("places"))


def line_dedup(docs: DataFrame, window: int = 3) -> DataFrame:
    """Rewrites text without later occurrences of repeated windows and adds n_lines and n_removed.

    Other columns stay (n_lines and n_removed are replaced). Texts of fewer than ``window`` lines have no window and stay
    whole; null stays null with no lines; a row without doc_id stays whole. Of several rows with the same doc_id each
    loses the places found in any of them. A text all of whose lines go is empty.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = F.split("text", "\n", -1)
    places = repeated_places(docs.select("doc_id", "text"), window).withColumnRenamed("doc_id", "_id")
    joined = docs.select(*keep).join(places, F.col("doc_id") == F.col("_id"), "left").withColumn("_lines", lines)
    left_over = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("places"))  # in order, by a hash set
    kept = F.transform(left_over, lambda i: F.get("_lines", i))
    text = F.when(F.col("places").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint")
    left = F.when(F.col("places").isNull() | F.col("text").isNull(), total).otherwise(F.size(kept))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in keep], total.alias("n_lines"), (total - left).cast("bigint").alias("n_removed"))
