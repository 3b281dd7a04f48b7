"""Documents to token identifiers: quality rules, near-duplicate removal, substring dedup, decontamination, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.llm import decontaminate, minhash, quality, sentencepieces, substrings
from lexisift.llm.shared import Scope, discard, importable, table, tokenizer_path, written


def _scoped(out: DataFrame, scope: Scope) -> DataFrame:
    """A stage's result with the tables that it reads, for ``run`` to delete once the result is written."""
    out._lexisift_scope = scope
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps; null and empty texts go.

    Repeated rows are judged alike and all stay here. Null ids and columns of any name are carried; an empty table gives an empty one.
    """
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five-word shingles, similarity 0.8 or more) the row with the smallest id, or one without an id if no row has one.

    Rows are told apart by id and text, so other texts under a kept id are judged by their own groups. Of repeated rows one stays, and of rows
    that differ in other columns only the one whose columns hash least; of several texts of a group under its smallest id, or without any id,
    the one with the least key. Null and empty texts are groups of their own and stay. An empty table gives an empty one.
    """
    importable(spark)
    scope = Scope()
    rows = minhash.grouped(docs, shingle=5, num=80, den=100, scope=scope)
    kept = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select(F.col("first.key").alias("_key"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*docs.columns).alias("_hash"), minhash.text_key().alias("_key"))
    out = whole.join(kept, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")
    return _scoped(out, scope)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 35 words that occur twice or more among them; a document of which nothing is left goes.

    Null and empty texts go. Repeated rows lose each other's windows. Null ids and other columns are carried, ``n_chars`` follows the text; an
    empty table gives an empty one.
    """
    importable(spark)
    scope = Scope()
    out = substrings.without_repeats(docs, width=35, scope=scope)
    return _scoped(out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out, scope)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item.

    Null and empty texts have none and stay. Repeated rows are judged alike; null ids and other columns are carried; without items all stay.
    """
    importable(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), width=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens)``: the identifiers of each document's text, none of a null or empty one; a row for each row."""
    importable(spark)
    return sentencepieces.encoded(docs, tokenizer_path("piece_bpe_32k.model")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Suffix automata, minimum hashes and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage read is deleted as soon as the next table is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        after = written(out, name)
        getattr(out, "_lexisift_scope", Scope()).close()
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
