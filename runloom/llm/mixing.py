"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key ``-ln(u)/weight``; the smallest keys are taken first, which samples without replacement in
proportion to the weights. A source whose target is e times its size and a rest takes e complete epochs, and of the last
epoch the documents in key order until their sizes sum to the rest.

The prefix sums are taken in two steps: sizes are summed by source and range of keys, these sums are accumulated, and only
the one range in which a source reaches its rest is sorted document by document. No task gathers a source; one has the sums of
a source's ranges, some thousandths of its rows. All other documents only meet one row for their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Documents per range of keys, about.
RANGE_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def exponential_key(weight: Column, doc_id: str = "doc_id", salt: str = "mix") -> Column:
    """-ln(u)/weight, u being 52 bits of the id's MD5: the same in every run. A weight that is not positive comes last."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def targets(sizes: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size); one row for each source, of which there are few.

    Sources in order of code points, null last, weigh ``cycle`` over and over. ``share`` times all sizes is shared by
    weight; what would exceed ``most`` times a source's size is shared among the others until none is above.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("n") % len(cycle) + 1).cast("int"))
    ranked = sizes.withColumn("n", order).withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "n")
    whole = Window.partitionBy()
    ranked = ranked.withColumn("before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("rest", F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (share * F.sum("source_size").over(whole) - F.col("before")) / F.col("rest"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "n", "level"))
    ranked = ranked.withColumn("level", F.min(fits).over(whole)["level"])
    return ranked.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds source_size, target, epochs (copies of the document in the mix) and taken (size * epochs) to each row.

    Takes doc_id, source, size (null or negative: 0) and weight (null: 1); further columns stay, those named like a
    result are replaced. Null sources are a source of their own. Rows that repeat a doc_id draw the same key and are
    ordered by size. Empty documents take nothing. The last document is taken if the sum comes nearer the target so.
    """
    keep = [c for c in docs.columns if c not in ("source_size", "target", "epochs", "taken")]
    docs = docs.select(*keep).withColumn("size", F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)))
    key = exponential_key(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    docs = stored(docs.withColumn("_key", key))
    ranges = max(16, docs.count() // RANGE_ROWS)
    docs = docs.withColumn("_range", F.least(F.floor((1 - F.exp(-F.col("_key"))) * ranges), F.lit(ranges - 1)).cast("int"))
    sums = stored(docs.groupBy("source", "_range").agg(F.sum("size").alias("sum")))
    plan = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), cycle, share, most)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    rising = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("_end", F.sum("sum").over(rising)).withColumn("_begin", F.col("_end") - F.col("sum"))
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_rest")
    # For each source the last range that is taken whole, and the range in which the rest ends.
    within = F.when((F.col("_begin") < F.col("_rest")) & (F.col("_rest") < F.col("_end")), F.struct("_range", "_begin"))
    cuts = ends.join(plan, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s", "source_size", "target", "_whole", "_rest").agg(
        F.max(F.when(F.col("_end") <= F.col("_rest"), F.col("_range"))).alias("_full"), F.max(within).alias("_edge")
    )
    placed = docs.join(stored(cuts), F.col("source").eqNullSafe(F.col("_s")))
    edge = F.coalesce(F.col("_edge._range") == F.col("_range"), F.lit(False))
    sure = placed.where(~edge).withColumn("_more", F.coalesce(F.col("_range") <= F.col("_full"), F.lit(False)).cast("int"))
    ordered = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_edge._begin") + F.sum("size").over(ordered) - F.col("size") / 2
    near = placed.where(edge).withColumn("_more", (middle <= F.col("_rest")).cast("int"))
    mixed = sure.unionByName(near).withColumn("epochs", (F.col("_whole") + F.col("_more")).cast("int"))
    return mixed.select(*keep, "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))


def quality_weights(docs: DataFrame, labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """Adds weight: ``good`` or ``bad`` by the label's quality (1 or 0; the best if a document has several), else 1."""
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    weight = F.when(F.col("_q") == 1, good).when(F.col("_q") == 0, bad).otherwise(1.0)
    return docs.drop("weight").join(best, F.col("doc_id") == F.col("_id"), "left").withColumn("weight", weight).drop("_id", "_q")
