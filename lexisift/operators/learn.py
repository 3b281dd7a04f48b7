"""Ridge regression by distributed normal equations: a Gram matrix of each partition, added up cell by cell, solved on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ridge:
    """Weights by feature, for features as they come, and what is added to them."""

    weights: dict[str, float]
    intercept: float

    def column(self) -> Column:
        return reduce(lambda a, b: a + b, (F.lit(w) * F.col(c) for c, w in self.weights.items()), F.lit(self.intercept))


def _grams(k: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)])
            total += x @ x.T
        cell, value = np.arange(k * k, dtype=np.int32), total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(value)], ["cell", "value"])

    return run


def gram(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of the columns and a column of ones; rows with a null are left out. A square of the number of columns reaches the driver."""
    k = len(columns) + 1
    values = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    cells = values.mapInArrow(_grams(k), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(k * k)
    for r in cells:
        out[r.cell] = r.value
    return out.reshape(k, k)


def fit_ridge(rows: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> Ridge:
    """The ridge regression of a label on features, which are standardised for the penalty; a constant feature gets no weight.

    Without rows the prediction is 0. However many rows there are, each partition yields one matrix.
    """
    g = gram(rows, [*features, label])
    n = g[0, 0]
    if n == 0:
        return Ridge(dict.fromkeys(features, 0.0), 0.0)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    used = sd > 1e-12 * (1 + np.abs(mean[:-1]))
    safe = np.where(used, sd, 1.0)
    a = n * cov[:-1, :-1] / np.outer(safe, safe) * np.outer(used, used) + np.diag(np.where(used, penalty, 1.0))
    w = np.linalg.solve(a, n * cov[:-1, -1] / safe * used) / safe
    return Ridge(dict(zip(features, w.tolist(), strict=True)), float(mean[-1] - w @ mean[:-1]))


def held_out(rows: DataFrame, label: str, prediction: Column) -> DataFrame:
    """``(n, rmse, rmse_of_mean, pearson)`` of predictions; null where nothing varies."""
    p = rows.select(F.col(label).cast("double").alias("y"), prediction.alias("p"))
    out = p.agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))).alias("e"), F.stddev_pop("y").alias("s"), F.corr("y", "p").alias("c"))
    return out.select("n", F.round("e", 6).alias("rmse"), F.round("s", 6).alias("rmse_of_mean"), F.round("c", 6).alias("pearson"))
