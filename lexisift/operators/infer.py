"""Batch inference with any callable as model, and tables that remember what was computed for which input."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lexisift.session import exists

#: Characters of a batch of texts, each counted as long as the longest of them.
BATCH_CHARS = 65_536
#: The models of this worker process.
_LOADED: dict[str, Callable] = {}

Model = Callable[[list[Sequence]], Sequence[float]]


def length_batches(sizes: np.ndarray, most: int = BATCH_CHARS) -> Iterator[np.ndarray]:
    """Positions in batches of like sizes: as many as fit ``most`` when all are padded to the longest, one at least."""
    order = np.argsort(sizes, kind="stable")
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - start) * max(1, sizes[order[i]]) > most:
            yield order[start:i]
            start = i


def _scored(load: Callable[[], Model], token: str, inputs: list[str], most: int):
    def run(batches):
        from lexisift.operators.infer import _LOADED as loaded  # the worker's own: a function travels with copies of what it names

        if token not in loaded:
            loaded[token] = load()
        model = loaded[token]
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            sizes = np.array([sum(len(v) for v in row if isinstance(v, str)) for row in zip(*columns, strict=True)], int)
            out = np.empty(batch.num_rows)
            for at in length_batches(sizes, most):
                out[at] = model([[c[i] for i in at] for c in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    return run


def scored(rows: DataFrame, inputs: list[str], load: Callable[[], Model], most: int = BATCH_CHARS) -> DataFrame:
    """``rows`` with ``score``: what the model gives for the input columns of each row, whatever the order of the rows.

    ``load`` is called once in a worker process, however many tasks that runs; the model takes lists of values, a list for each input, and
    gives a number for each. Rows of an Arrow batch go to it in batches of like length, so that padding costs little. No shuffle; a lost task
    scores its rows again. Nulls reach the model as None.
    """
    schema = StructType(list(rows.schema.fields)).add("score", DoubleType())
    return rows.mapInArrow(_scored(load, uuid.uuid4().hex, inputs, most), schema)


def remembered(rows: DataFrame, inputs: list[str], settings: str, path: str, compute: Callable[[DataFrame], DataFrame], steps: int = 1) -> DataFrame:
    """``rows`` with the columns that ``compute`` adds, which are computed only for inputs that the table at ``path`` doesn't have.

    The table's key is a digest of the input columns and of ``settings``, which must name all else that the results depend on. Equal inputs
    are computed once. New results are appended in ``steps`` parts, each complete or absent: a run that breaks off goes on after its last
    part. Runs at the same time may compute the same, and either result is taken. ``compute`` gets ``_digest`` and the inputs and keeps the former.
    """
    spark = rows.sparkSession
    digest = F.sha2(F.concat_ws("\x1f", F.lit(settings), F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})), 256)
    keyed = rows.withColumn("_digest", digest)
    wanted = keyed.select("_digest", *inputs).dropDuplicates(["_digest"])
    schema = compute(wanted.limit(0)).drop(*inputs).schema
    table = lambda: spark.read.schema(schema).parquet(path)
    for step in range(steps):
        part = wanted.where(F.pmod(F.xxhash64("_digest"), F.lit(steps)) == step) if steps > 1 else wanted
        if exists(spark, path):
            part = part.join(table().select("_digest"), "_digest", "left_anti")
        compute(part).drop(*inputs).select(*schema.names).write.mode("append").parquet(path)
    return keyed.join(table().dropDuplicates(["_digest"]), "_digest").drop("_digest")
