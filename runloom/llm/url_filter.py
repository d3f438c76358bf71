"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

The URLs that a rule fits are the labelled ones: they teach the trees what a blocked URL looks like.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains where the path starts with ``path``; text is like ``com/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tail(url: str) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.expr(f"instr({url}, '://')")
    return F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_tail(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule (ties: first by text) that fits, as struct(text, verdict), or null. For lists that fit in a plan."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "label_length", "suffix_length", "vowel_ratio", "secure"]


def lexical_features(url: str = "url", host: str = "host", path: str = "path") -> dict[str, Column]:
    """Numbers from the characters of a URL; 0 for a null or empty one."""
    u, h, p = (F.coalesce(F.col(c), F.lit("")) for c in (url, host, path))
    size = F.greatest(F.length(u), F.lit(1))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x)))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c))) / size
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-12)))))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    labels = F.split(h, r"\.")
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    vowels = F.length(h) - F.length(F.translate(h, "aeiou", ""))
    values = [
        F.length(u), F.length(h), F.length(p), count(p, "/"), F.size(labels), digits / size, entropy,
        F.when(query == "", 0).otherwise(count(query, "&") + 1), count(u, "-"),
        F.array_max(F.transform(labels, F.length)), F.length(F.element_at(labels, -1)), vowels / F.greatest(F.length(h), F.lit(1)), u.startswith("https").cast("int"),
    ]
    return {name: F.coalesce(v.cast("double"), F.lit(0.0)) for name, v in zip(FEATURES, values, strict=True)}


def _suffix(host: str = "host") -> Column:
    """The last two labels of a host, empty for a host of one."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


#: Folds of the labelled URLs: a training row's suffix is judged by the rows of the other folds only, never by itself.
FOLDS = 4
#: How many rows of the whole table's share of blocked URLs each suffix counts besides its own.
PRIOR_ROWS = 2


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, n, b, ns, bs): labelled and blocked URLs of each suffix, of all and by fold. A host of one label has none."""
    blocked = F.col("blocked").cast("int")
    own = lambda value: F.array(*[F.sum(F.when(_fold() == i, value).otherwise(0)) for i in range(FOLDS)])
    rows = labelled.withColumn("suffix", _suffix()).where("suffix != ''")
    return rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum(blocked).alias("b"), own(F.lit(1)).alias("ns"), own(blocked).alias("bs"))


def _assembled(df: DataFrame, suffixes: DataFrame, prior: float, training: bool = False) -> DataFrame:
    """Adds the vector of features; the share of blocked URLs of a row's suffix is that of all labelled rows, smoothed.

    In ``training`` it is that of the other folds' rows.
    """
    known = suffixes.select(F.col("suffix").alias("_suffix"), F.struct("n", "b", "ns", "bs").alias("_known"))
    joined = df.join(known, _suffix() == F.col("_suffix"), "left")
    n, b = F.col("_known.n"), F.col("_known.b")
    if training:
        n, b = n - F.get("_known.ns", _fold()), b - F.get("_known.bs", _fold())
    statistic = F.coalesce((b + PRIOR_ROWS * prior) / (n + PRIOR_ROWS), F.lit(prior))
    df = joined.select(*df.columns, *[c.alias(f"f_{n}") for n, c in lexical_features().items()], statistic.alias("f_suffix_blocked"))
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES] + ["f_suffix_blocked"], outputCol="features").transform(df)


@dataclass
class UrlModel:
    """``suffixes`` is the table of suffix_counts, ``prior`` the share of blocked URLs among all labelled ones."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    prior: float

    def blocked(self, df: DataFrame) -> DataFrame:
        """Adds block_score (0 to 1) to (url, host, path)."""
        if self.trees is None:
            return df.withColumn("block_score", F.lit(self.prior))
        scored = self.trees.transform(_assembled(df, self.suffixes, self.prior))
        return scored.withColumn("block_score", vector_to_array("probability")[1]).select(*df.columns, "block_score")


def fit(labelled: DataFrame, sample: int = 20000, trees: int = 8, depth: int = 3) -> UrlModel:
    """Boosted trees from (url, host, path, blocked).

    ``sample`` bounds the rows that the trees are fitted on (about; by a hash of the URL, so that reruns agree; a URL
    that is drawn counts once, however many rows repeat it). The share of blocked
    URLs of a host's suffix is a feature; it is counted over all labelled rows, for all suffixes. Without labelled rows, or
    with one label only, there are no trees and every URL gets that label (none: allow).
    """
    totals = labelled.agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("int")).alias("b")).first()
    if not totals.n or totals.b in (0, totals.n):
        return UrlModel(None, None, 1.0 if totals.n and totals.b else 0.0)
    prior = float(totals.b / totals.n)
    spread = F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1 << 20))
    drawn = stored(labelled.where(spread < min(1.0, sample / totals.n) * (1 << 20)).select("url", "host", "path", F.col("blocked").cast("double").alias("label")).distinct())
    if drawn.agg(F.countDistinct("label")).first()[0] < 2:
        return UrlModel(None, None, prior)
    suffixes = stored(suffix_counts(labelled))
    training = _assembled(drawn, suffixes, prior, training=True).select("features", "label")
    return UrlModel(GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=32).fit(training), suffixes, prior)


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel | None = None) -> DataFrame:
    """Adds host, path, rule, verdict and block_score to each row of pages (url); columns of these names are replaced.

    A null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the model like the
    others. Without a model one is learned from the URLs that rules fit.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score", "_fit")]
    pages = pages.select(*keep).withColumn("host", host_of()).withColumn("path", path_of())
    pages = pages.withColumn("_fit", fitting_rule(rules, F.col("host"), F.col("path")))
    if model is None:
        model = fit(pages.where("_fit is not null").select("url", "host", "path", (F.col("_fit.verdict") == BLOCK).alias("blocked")))
    scored = model.blocked(pages)
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW))
    return scored.select(*keep, "host", "path", F.col("_fit.text").alias("rule"), verdict.alias("verdict"), "block_score")
