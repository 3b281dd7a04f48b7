"""Incremental ingestion of sentences, an extension: a file stream of documents becomes sentence rows, scored against fixed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.sources.tables import sentences

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence_stream(spark: SparkSession, folder: str, lang: str | None = None) -> DataFrame:
    """``(cid, doc_id, sent_idx, sent)`` of Parquet files as they arrive in ``folder``; no state."""
    docs = spark.readStream.schema(DOCUMENTS).parquet(folder)
    docs = docs.where(F.col("lang") == lang) if lang else docs
    return sentences(docs.select(F.col("source").alias("cid"), "doc_id", "text"))


def scored_stream(sents: DataFrame, queries: DataFrame) -> DataFrame:
    """Each arriving sentence with its overlap count against the query of its cluster; ``queries(cid, query)`` is static."""
    words = F.transform(T.tokens(F.col("query")), lambda x: x)
    joined = sents.join(queries.select("cid", words.alias("q")), "cid")
    hits = F.aggregate(F.transform(T.tokens(F.col("sent")), lambda w: F.size(F.filter("q", lambda x: x == w))), F.lit(0), lambda a, x: a + x)
    return joined.select("cid", "doc_id", "sent_idx", "sent", hits.cast("long").alias("score"))
