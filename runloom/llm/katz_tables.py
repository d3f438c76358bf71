"""Katz backoff of any order as stored tables: a model that is kept, and scores any table.

The tables, for each order n, partitioned by n and by a hash of the context: ``grams`` (context, word, p: the discounted
probability of a word seen after a context) and ``contexts`` (context, alpha: log10 of the weight with which what was not seen
backs off). A context is the n - 1 words before a word. Scoring is recursive, token by token: a word is looked up after its
longest context; where it was not seen there, the context's weight is added (0 for a context that was not seen itself) and
the word is looked up after the context without its first word, and so on to the word alone and the unknown word.

``katz.katz_scores`` is the order that fits the limits of a large run, in one pass without kept tables; this is the general form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .katz import K, discounts
from .shared import removed, spread, stored

#: White space, which no word has, stands for a text's end and what is before its first word.
END, BEGIN = "\n", "\t"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str = "text") -> Column:
    """The words of a text and its end; a null text is empty."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.concat(F.regexp_extract_all(lower, F.lit(r"([^\x20\x09-\x0D]+)")), F.array(F.lit(END)))


def _grams(docs: DataFrame, order: int, *keys: str) -> DataFrame:
    """(keys, context, word): one row for each token, the context being the ``order - 1`` words before it, joined by spaces."""
    padded = F.concat(F.array_repeat(F.lit(BEGIN), order - 1), tokens()) if order > 1 else tokens()
    at = docs.select(*keys, padded.alias("_t")).select("*", F.explode(F.sequence(F.lit(order), F.size("_t"))).alias("_i"))
    context = F.array_join(F.slice("_t", F.col("_i") - (order - 1), order - 1), " ") if order > 1 else F.lit("")
    return at.select(*keys, context.alias("context"), F.element_at("_t", F.col("_i")).alias("word"))


def shorter(context: Column) -> Column:
    """A context without its first word."""
    return F.when(context.contains(" "), F.regexp_replace(context, "^[^ ]* ", "")).otherwise("")


def _log(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1e-300)))


@dataclass
class KatzModel:
    """``grams[n]`` and ``contexts[n]`` by order; ``unknown`` is the probability of the unknown word."""

    order: int
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    unknown: float
    train_tokens: int

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, score) for each row of docs (doc_id, text): log10 probability of the whole text, its end included.

        Rows that repeat a doc_id are scored each by itself; they have to be the same when a task runs again.
        """
        rows = stored(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
        left = _grams(rows, self.order, "key").groupBy("key", "context", "word").agg(F.count("*").alias("n")).withColumn("log", F.lit(0.0))
        parts, n_tokens = [], rows.select("key", "doc_id", F.size(tokens()).cast("bigint").alias("n_tokens"))
        for n in range(self.order, 0, -1):
            looked = left.join(self.grams[n].select("context", "word", "p"), ["context", "word"], "left")
            if n > 1:
                looked = stored(looked.join(self.contexts[n].select("context", "alpha"), "context", "left"))
            else:
                looked = looked.withColumn("p", F.coalesce("p", F.lit(self.unknown)))
            parts.append(looked.where("p is not null").select("key", (F.col("n") * (F.col("log") + _log(F.col("p")))).alias("log")))
            if n > 1:
                left = looked.where("p is null").select("key", shorter(F.col("context")).alias("context"), "word", "n", (F.col("log") + F.coalesce("alpha", F.lit(0.0))).alias("log"))
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        total = total.groupBy("key").agg(F.sum("log").alias("score"))
        return n_tokens.join(total, "key").select("doc_id", "n_tokens", "score")


def fit(docs: DataFrame, order: int = 3) -> KatzModel:
    """Counts the n-grams of docs (text) for n up to ``order`` and stores discounted probabilities and backoff weights.

    Good-Turing discounts are those of each order's own counts of counts (``katz.discounts``). Without texts every word is the
    unknown one, with probability 1. The driver is given ``K + 2`` numbers for each order.
    """
    buckets = spread(docs)
    bucket = F.pmod(F.xxhash64("context"), F.lit(buckets)).cast("int").alias("bucket")
    grams, contexts, unknown, total = {}, {}, 1.0, 0
    for n in range(1, order + 1):
        counts = stored(_grams(docs, n).groupBy("context", "word").agg(F.count("*").alias("r")))
        of_count = {x.r: x.m for x in counts.where(f"r <= {K + 1}").groupBy("r").agg(F.count("*").alias("m")).collect()}
        if n == 1:
            total = counts.agg(F.coalesce(F.sum("r"), F.lit(0))).first()[0]
        d = discounts(of_count, total)
        rate = F.element_at(F.array(*[F.lit(float(x)) for x in d[1:]]), F.least("r", F.lit(K + 1)).cast("int"))
        if n == 1:
            small = sum(r * m * (1 - d[r]) for r, m in of_count.items() if r <= K)
            large = total - sum(r * m for r, m in of_count.items() if r <= K)
            unknown = float((small + large * (1 - d[K + 1])) / total) if total else 1.0
            grams[1] = stored(counts.select(bucket, "context", "word", (rate * F.col("r") / max(1, total)).alias("p")), "bucket")
        else:
            sums = stored(counts.groupBy("context").agg(F.sum("r").alias("c"), F.sum((1 - rate) * F.col("r")).alias("rest")))
            made = counts.join(sums.select("context", "c"), "context").select(bucket, "context", "word", (rate * F.col("r") / F.col("c")).alias("p"))
            grams[n] = stored(made, "bucket")
            low = grams[n].select("context", shorter(F.col("context")).alias("_low"), "word")
            below = grams[n - 1].select(F.col("context").alias("_low"), "word", F.col("p").alias("q"))
            seen = low.join(below, ["_low", "word"]).groupBy("context").agg(F.sum("q").alias("seen"))
            alpha = _log(F.col("rest") / F.col("c")) - _log(1 - F.col("seen"))
            contexts[n] = stored(sums.join(seen, "context").select(bucket, "context", alpha.alias("alpha")), "bucket")
            removed(sums)
        removed(counts)
    return KatzModel(order, grams, contexts, unknown, int(total))

