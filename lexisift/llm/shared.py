"""What the operators of this subpackage share: shared-folder tables, words and Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker holds as objects at a time, and rows of an Arrow batch.
PART, BATCH = 500, 1000
#: Rows of a batch of the Parquet reader: a column of texts is one array in the JVM.
READ = 512
#: Stands for a null id where a join key must not be null.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of sessions on this machine that name none.
_OWN: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers, wherever they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one on one machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="lexisift-")
        _OWN[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: lineage ends here and a lost executor loses nothing.

    ``by`` names columns of few values that are folders of their own.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexisift_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lexisift_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scope:
    """Tables of ``written`` that are deleted together when the block ends, or when the owner calls ``close`` after the last read."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        self.tables.append(written(df, name, *by))
        return self.tables[-1]

    def adopt(self, df: DataFrame, path: str) -> None:
        """Delete ``path``, which ``df`` reads, together with the tables."""
        df._lexisift_path = path
        self.tables.append(df)

    def close(self) -> None:
        discard(*self.tables)
        self.tables.clear()

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def column_text(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def mapped(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over each Arrow batch, a part at a time, without a shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                yield from function(batch.slice(at, PART))

    return df.mapInArrow(run, schema)


def row_key(text: str = "text", doc_id: str = "doc_id") -> list:
    """Key columns of a document row that are never null: equal for repeated rows, different for different texts under one id."""
    return [F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col(text)).alias("_th")]


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import this library wherever the driver was started; installed clusters don't need it.

    Also bounds Arrow batches and the batches of the Parquet reader, which hold whole texts, unless the session has bounds of its own.
    """
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
