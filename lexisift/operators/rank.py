"""Rank lists: order, prune, dedup, top-k, compression, cumulative confidence, budgets, normalisation, interpolation, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W


#: Values of an integer tie, and ranks, that are counted within one task; a longer list of a key is dealt out over its blocks.
BLOCK = 65_536


def _names(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _by(keys, *order):
    return W.partitionBy(*_names(keys)).orderBy(*order)


def _matched(rows: DataFrame, sums: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``sums``, which has one row for each ``on``; nulls meet nulls."""
    other = sums.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in sums.columns if c not in on])
    same = [rows[c].eqNullSafe(other[f"_on{i}"]) for i, c in enumerate(on)]
    return rows.join(other, same).drop(*[f"_on{i}" for i in range(len(on))])


def ranked(scores: DataFrame, keys: str | list[str], *ties: str, score: str = "score", bounded: bool = False) -> DataFrame:
    """Adds ``rank``: score descending, nulls last, ties by the given columns ascending.

    A key may hold any share of the rows: a rank is the number of rows of better scores, plus those of equal score in earlier blocks of the
    first tie (if it is an integer), plus the place within the block. Only a key's distinct scores, and a score's blocks, meet in a window.
    ``bounded`` lists, of a k that the caller has set, are one window each.
    """
    keys = _names(keys)
    if bounded:
        return scores.withColumn("rank", F.row_number().over(_by(keys, F.desc(score), *ties)))
    split = bool(ties) and isinstance(scores.schema[ties[0]].dataType, IntegralType)
    rows = scores.withColumn("_block", F.floor(F.col(ties[0]) / BLOCK) if split else F.lit(0).cast("long"))
    blocks = rows.groupBy(*keys, score, "_block").agg(F.count("*").alias("_n"))
    values = blocks.groupBy(*keys, score).agg(F.sum("_n").alias("_n"))
    better = values.select(*keys, score, (F.sum("_n").over(_by(keys, F.desc(score))) - F.col("_n")).alias("_better"))
    earlier = F.sum("_n").over(_by([*keys, score], "_block")) - F.col("_n")
    base = _matched(blocks.withColumn("_earlier", earlier), better, [*keys, score])
    base = base.select(*keys, score, "_block", (F.col("_better") + F.col("_earlier")).alias("_base"))
    on = [*keys, score, "_block"]
    return _matched(rows, base, on).withColumn("rank", F.col("_base") + F.row_number().over(_by(on, *(ties or ["_base"])))).drop("_base", "_block")


def top_k(scores: DataFrame, k: int, keys: str | list[str], *ties: str, score: str = "score") -> DataFrame:
    """The k best of each key, with ``rank``; Spark cuts each partition to k rows of a key before the shuffle."""
    return ranked(scores, keys, *ties, score=score, bounded=True).where(F.col("rank") <= k)


def running(ranks: DataFrame, keys: str | list[str], value: str, name: str = "_before", bounded: bool = False) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a key before this one, by ``rank``: 0 for the first, nulls as 0.

    Sums of blocks of ranks are added up first, so a long list isn't one task's; ``bounded`` lists are one window each.
    """
    keys = _names(keys)
    x = F.coalesce(F.col(value), F.lit(0))
    if bounded:
        return ranks.withColumn(name, F.coalesce(F.sum(x).over(_by(keys, "rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = ranks.withColumn("_part", F.floor((F.col("rank") - 1) / BLOCK))
    sums = rows.groupBy(*keys, "_part").agg(F.sum(x).alias("_sum"))
    base = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(_by(keys, "_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    on = [*keys, "_part"]
    inner = F.coalesce(F.sum(x).over(_by(on, "rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _matched(rows, base, on).withColumn(name, F.col("_base") + inner).drop("_base", "_part")


def compressed(ranks: DataFrame, ratio: float, keys: str, least: int = 0) -> DataFrame:
    """The head of ``floor(n * ratio)`` rows, ``least`` at least."""
    sizes = ranks.groupBy(keys).agg(F.count("*").alias("_n"))
    return ranks.join(sizes, keys).where(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("_n") * F.lit(ratio)))).drop("_n")


def confident(ranks: DataFrame, threshold: float, keys: str, value: str = "score", least: int = 0, bounded: bool = False) -> DataFrame:
    """Rows until the running share of the value first reaches the threshold, that row included; all of a key with no positive total."""
    totals = ranks.groupBy(keys).agg(F.sum(F.greatest(F.col(value), F.lit(0))).alias("_total"))
    kept = (F.col("_total") <= 0) | (F.col("_before") < F.col("_total") * F.lit(threshold)) | (F.col("rank") <= least)
    return running(ranks, keys, value, bounded=bounded).join(totals, keys).where(kept).drop("_before", "_total")


def budgeted(ranks: DataFrame, budget: int, keys: str, words: str = "n_words", bounded: bool = False) -> DataFrame:
    """Rows until the running words reach the budget, that row included; adds ``cum_words``."""
    return running(ranks, keys, words, bounded=bounded).where(F.col("_before") < budget).withColumn("cum_words", F.col("_before") + F.col(words)).drop("_before")


def pruned(ranks: DataFrame, least: float = 1e-10) -> DataFrame:
    return ranks.where(F.col("score") > least)


def deduplicated(ranks: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each group of equal keys; the minimum is pre-aggregated, so copies don't meet in a window."""
    rest = [c for c in ranks.columns if c not in keys and c not in order]
    return ranks.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*")


def _joined(scores: DataFrame, keys: str, **aggregates: Column) -> DataFrame:
    return scores.join(scores.groupBy(keys).agg(*[v.alias(k) for k, v in aggregates.items()]), keys)


def min_max(scores: DataFrame, keys: str, score: str = "score") -> DataFrame:
    out = _joined(scores, keys, _lo=F.min(score), _hi=F.max(score))
    return out.withColumn("normed", F.coalesce(F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def l1(scores: DataFrame, keys: str, score: str = "score", squash: bool = False) -> DataFrame:
    """Shares of the sum, negative scores as 0; with ``squash`` of ``tanh(sqrt(x))``."""
    if squash:
        scores = scores.withColumn(score, F.tanh(F.sqrt(F.greatest(F.col(score).cast("double"), F.lit(0.0)))))
    out = _joined(scores, keys, _sum=F.sum(F.greatest(F.col(score), F.lit(0))))
    return out.withColumn("normed", F.coalesce(F.try_divide(F.greatest(F.col(score), F.lit(0)), F.col("_sum")), F.lit(0.0))).drop("_sum")


def softmax(scores: DataFrame, keys: str, score: str = "score") -> DataFrame:
    out = _joined(scores, keys, _hi=F.max(score)).withColumn("_e", F.exp(F.col(score) - F.col("_hi")))
    return _joined(out, keys, _sum=F.sum("_e")).withColumn("normed", F.col("_e") / F.col("_sum")).drop("_e", "_hi", "_sum")


def interpolated(first: DataFrame, second: DataFrame, on: list[str], weight: float, scaled_by: str | None = None) -> DataFrame:
    """``weight * first + (1 - weight) * second`` of two score tables on the same rows; each as shares of its sum by ``scaled_by`` first, if named."""
    if scaled_by:
        first, second = (l1(s, scaled_by).drop("score").withColumnRenamed("normed", "score") for s in (first, second))
    both = first.withColumnRenamed("score", "_a").join(second.withColumnRenamed("score", "_b"), on)
    return both.withColumn("score", weight * F.col("_a") + (1 - weight) * F.col("_b")).drop("_a", "_b")


def retrieved(scores: DataFrame, keys: str, *ties: str, filter: str = "topK", var: float = 150, least: int = 0) -> DataFrame:
    """Prune, rank, then one of the filters topK, comp and conf."""
    if filter == "topK":
        return top_k(pruned(scores), int(var), keys, *ties)
    ranks = ranked(pruned(scores), keys, *ties)
    if filter == "comp":
        return compressed(ranks, var, keys, least)
    if filter == "conf":
        return confident(ranks, var, keys, least=least)
    raise ValueError(filter)


def records(ranks: DataFrame, keys: str, kind: str, grid: list[float], least: int = 0) -> DataFrame:
    """``ranks`` once for each setting of ``grid`` that keeps the row, with ``var``: the lists that ``topK``, ``comp`` or ``conf`` would keep, in one pass."""
    if kind == "topK":
        need = F.col("rank").cast("double")
    elif kind == "comp":
        ranks = _joined(ranks, keys, _all=F.count("*"))
        need = F.when(F.col("rank") <= least, 0.0).otherwise(F.col("rank") / F.col("_all"))
    elif kind == "conf":
        ranks = _joined(running(ranks, keys, "score"), keys, _all=F.sum(F.greatest(F.col("score"), F.lit(0))))
        need = F.when((F.col("_all") <= 0) | (F.col("rank") <= least), -1.0).otherwise(F.col("_before") / F.col("_all"))
    else:
        raise ValueError(kind)
    every = F.array(*[F.lit(float(v)) for v in grid])
    held = F.filter(every, lambda v: (F.col("_need") < v) if kind == "conf" else (F.col("_need") <= v + 1e-12))
    return ranks.withColumn("_need", need).withColumn("var", F.explode(held)).drop("_need", "_all", "_before")


#: The settings that are tried: filters in steps of 0.05, lists in steps of 10, and each length of a short list.
FILTERS, TOP, FINE = [round(0.05 * i, 2) for i in range(1, 21)], list(range(10, 151, 10)), list(range(1, 31))


def sweep(ranks: DataFrame, ks: list[int], keys: str) -> DataFrame:
    """``(k, n_kept, total)``: what each top-k of a grid keeps, in one pass: each row says the smallest k that keeps it, then running sums."""
    grid = F.array(*[F.lit(k) for k in sorted(ks)])
    least = F.element_at(F.filter(grid, lambda k: k >= F.col("rank")), 1)
    own = ranks.where(F.col("rank") <= max(ks)).groupBy(least.alias("k")).agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    every = ranks.sparkSession.createDataFrame([(k,) for k in sorted(ks)], "k int").join(own, "k", "left").na.fill(0)
    w = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)  # a row for each k only
    return every.select("k", F.sum("n").over(w).alias("n_kept"), F.sum("s").over(w).alias("total"))
