"""The relations of the query-focused data model, read from the tables of a folder.

A cluster is a source of documents; its query and its references are benchmark items. Order is data: ``doc_id`` and ``sent_idx`` order
sentences, ``rank`` orders rank lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.punkt import Punkt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """``(cid, doc_id, text)``, of one language if it is named; that filter reaches the scan."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.where(F.col("lang") == lang) if lang else docs
    return docs.select(F.col("source").alias("cid"), "doc_id", "text")


def sentences(docs: DataFrame, model: Punkt | None = None) -> DataFrame:
    """``(cid, doc_id, sent_idx, sent)`` of ``docs(cid, doc_id, text)``: one row a sentence, blanks dropped before they are numbered.

    Sentences end at every closing mark before a blank, or where a model of sentence boundaries says so (``punkt.train``).
    """
    split = model.sentences("text") if model else T.split_sentences(F.col("text"))
    return docs.select("cid", "doc_id", F.posexplode(split).alias("sent_idx", "sent"))


def paragraphs(docs: DataFrame, between: str = "\n\n", per_document: int | None = None) -> DataFrame:
    """``(cid, doc_id, para_idx, para)`` of ``docs(cid, doc_id, text)``: blocks that aren't blank, the first ``per_document`` of each document."""
    blocks = F.filter(F.split("text", between), lambda x: F.trim(x) != "")
    blocks = F.slice(blocks, 1, per_document) if per_document else blocks
    return docs.select("cid", "doc_id", F.posexplode(blocks).alias("para_idx", "para"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cid, query)``: the benchmark item with the lowest number of each cluster."""
    items = references(spark, sf_dir)
    return items.groupBy("cid").agg(F.min_by("text", "item_id").alias("query"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cid, item_id, ref_idx, text)``."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("cid"), "item_id", F.floor(F.col("item_id") / 20).cast("long").alias("ref_idx"), "text")
