"""Evaluation of predictions: correlation, error, precision and recall, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def pearson_spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``(pearson, spearman, corr)``; ranks of ties are their mean. Ranks come from value counts, so equal values meet as one row."""

    def ranks(c: str, name: str) -> DataFrame:
        # running counts over ranges of values: a prefix sum by blocks, not one window over all rows
        counts = rows.groupBy(c).agg(F.count("*").alias("n"))
        blocked = counts.withColumn("_b", F.floor(F.col(c).cast("double") / _width(counts, c)))
        inner = F.sum("n").over(W.partitionBy("_b").orderBy(c))
        totals = blocked.groupBy("_b").agg(F.sum("n").alias("t"))
        before = totals.withColumn("before", F.sum("t").over(W.orderBy("_b")) - F.col("t")).select("_b", "before")
        return blocked.withColumn("_i", inner).join(before, "_b").select(c, (F.col("before") + F.col("_i") - (F.col("n") - 1) / 2).alias(name))

    both = rows.select(a, b).join(ranks(a, "ra"), a).join(ranks(b, "rb"), b)
    out = both.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("p"), F.corr("ra", "rb").alias("s"))
    return out.select(F.round("p", 6).alias("pearson"), F.round("s", 6).alias("spearman"), F.round((F.col("p") + F.col("s")) / 2, 6).alias("corr"))


def _width(counts: DataFrame, c: str, blocks: int = 1000) -> float:
    lo, hi = counts.agg(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).first()
    return max(1e-9, ((hi or 0) - (lo or 0)) / blocks) or 1.0


def binary(rows: DataFrame, truth: str, score: str, threshold: float) -> DataFrame:
    """``(precision, recall, f1, rmse)``; a quotient without a denominator is 0."""
    hit = F.col(score) >= threshold
    c = rows.agg(
        F.count_if(hit & (F.col(truth) == 1)).alias("tp"), F.count_if(hit).alias("pp"), F.count_if(F.col(truth) == 1).alias("p"),
        F.sqrt(F.avg((F.col(truth) - F.col(score)) * (F.col(truth) - F.col(score)))).alias("e"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return c.select(F.round(zero(F.col("tp"), F.col("pp")), 6).alias("precision"), F.round(zero(F.col("tp"), F.col("p")), 6).alias("recall"), F.round(zero(2 * F.col("tp"), F.col("pp") + F.col("p")), 6).alias("f1"), F.round("e", 6).alias("rmse"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bucket, cnt, ratio)`` of values in the range, the last bin closed."""
    x = F.col(column).cast("double")
    inside = rows.where((x >= low) & (x <= high))
    bucket = F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1)).cast("long")
    counts = inside.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("cnt"))
    return counts.select("bucket", "cnt", F.round(F.col("cnt").cast("double") / F.sum("cnt").over(W.partitionBy()), 6).alias("ratio"))  # a row for each bin only


def example_based(rows: DataFrame) -> DataFrame:
    """``(p, r, f1)``: means of per-row precision and recall ``rows(p, r)``, and the F1 of these means."""
    means = rows.agg(F.avg("p").alias("p"), F.avg("r").alias("r"))
    return means.select(F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), 6).alias("f1"))
