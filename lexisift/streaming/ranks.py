"""Rank lists that follow a stream: the best of each cluster, merged with every batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.operators import rank
from lexisift.session import _folder, delete

KEYS = ("cid", "doc_id", "sent_idx")


def _states(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose whole state is in the folder."""
    target, system = _folder(spark, path)
    if not system.exists(target):
        return []
    names = [s.getPath() for s in system.listStatus(target)]
    done = [p for p in names if p.getName().startswith("batch=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch=")) for p in done)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rank lists after the last whole batch, or None before the first."""
    found = _states(spark, path)
    return spark.read.parquet(f"{path}/batch={found[-1]}") if found else None


def merged_into(path: str, k: int, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch ``(cid, doc_id, sent_idx, score, ...)`` with the ``k`` best of each cluster so far.

    The state after a batch is a table of its own, made from the state before it. So a batch that comes again, after a loss or by a restart,
    replaces its state and counts once. A row that comes again in a later batch counts once too, with its last score; rows may come late and
    in any order, as the best ``k`` of the union of all rows are those of the union of the lists. ``keep`` states are kept. State: ``k`` rows a
    cluster.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _states(spark, path) if n < number]
        rows = batch.withColumn("_n", F.lit(number).cast("long"))
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{path}/batch={before[-1]}").drop("rank").withColumn("_n", F.lit(-1).cast("long")))
        columns = [c for c in rows.columns if c not in (*KEYS, "_n")]
        latest = rows.groupBy(*KEYS).agg(F.max(F.struct("_n", *columns)).alias("x")).select(*KEYS, *[F.col(f"x.{c}").alias(c) for c in columns])
        rank.top_k(latest, k, *KEYS).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in before[: len(before) + 1 - keep]:
            delete(spark, f"{path}/batch={old}")

    return merge
