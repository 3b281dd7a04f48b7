"""Writers: rank lists, extracts, JSON lines. A folder that exists is never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ranks(ranks: DataFrame, path: str) -> None:
    """``ranks(run, cid, rank, ...)`` as Parquet partitioned by run; clusters are sorted, not folders of their own."""
    ranks.repartitionByRange("run", "cid", "rank").sortWithinPartitions("run", "cid", "rank").write.mode("errorifexists").partitionBy("run").parquet(path)


def rank_lines(ranks: DataFrame, with_rank: bool = False) -> DataFrame:
    """Text lines ``[rank TAB] sid TAB score TAB sentence``."""
    cols = (["rank"] if with_rank else []) + ["sid", "score", "sent"]
    return ranks.select("cid", "rank", F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("line"))


def extract_text(selected: DataFrame) -> DataFrame:
    """``(cid, text)``: the selected sentences of a cluster in their order, one a line."""
    return selected.groupBy("cid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sent"))), lambda x: x["sent"]), "\n").alias("text"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_clusters(rows: DataFrame, path: str) -> None:
    """A folder of text for each cluster of ``rows(cid, pos, line)``, lines in their order."""
    rows.repartition("cid").sortWithinPartitions("cid", "pos").select("cid", "line").write.mode("errorifexists").partitionBy("cid").text(path)


def reference_targets(references: DataFrame, single: bool = False) -> DataFrame:
    """``(file, text)``: references named ``cid_idx``, or ``cid`` with only the first of each cluster."""
    if single:
        return references.groupBy("cid").agg(F.min_by("text", "ref_idx").alias("text")).withColumnRenamed("cid", "file")
    return references.select(F.concat_ws("_", "cid", F.col("ref_idx").cast("string")).alias("file"), "text")


def write_index_input(summaries: DataFrame, path: str) -> None:
    """JSON lines ``{id, text}`` of ``summaries(cid, text)`` for a search index."""
    summaries.select(F.col("cid").cast("string").alias("id"), "text").write.mode("errorifexists").json(path)


def write_components(similarities: DataFrame, relevance: DataFrame, path: str) -> None:
    """Parts of a cluster's graph: ``sims`` with ``(cid, i, j, sim)`` and ``scores`` with relevance, as Parquet sorted by cluster."""
    for rows, name in ((similarities, "sims"), (relevance, "scores")):
        rows.repartitionByRange("cid").sortWithinPartitions("cid").write.mode("errorifexists").parquet(f"{path}/{name}")


def matrix_lines(similarities: DataFrame) -> DataFrame:
    """``(cid, i, line)``: a row of a bounded cluster's similarities as text, with zeros where there is no pair."""
    sizes = similarities.groupBy("cid").agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("n"))
    rows = similarities.groupBy("cid", "i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("long"), F.col("sim")))).alias("m")).join(sizes, "cid")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda k: F.format_string("%.6f", F.coalesce(F.col("m")[k], F.lit(0.0))))
    return rows.select("cid", "i", F.array_join(cells, " ").alias("line"))


def append_tuning(points: DataFrame, path: str) -> None:
    """Points of a tuning curve ``(var, recall, f1)`` as lines with tabs, added to those that are there; percentages of two decimals."""
    share = lambda c: F.format_string("%.2f", F.round(F.col(c) * 100, 2))
    points.orderBy("var").select(F.concat_ws("\t", F.col("var").cast("string"), share("recall"), share("f1")).alias("value")).coalesce(1).write.mode("append").text(path)


def write_retrieval(ranks: DataFrame, path: str) -> None:
    """A folder of lines ``sid TAB score TAB sentence`` for each cluster of ``ranks(cid, rank, sid, score, sent)``, best first."""
    write_clusters(rank_lines(ranks).select("cid", F.col("rank").alias("pos"), "line"), path)


def statistics_lines(stats: DataFrame) -> DataFrame:
    """One line ``name: value`` for each column of a row of statistics."""
    return stats.select(F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in stats.columns])).alias("value"))


def appended_subqueries(outputs: DataFrame) -> DataFrame:
    """``(cid, text)`` of ``outputs(cid, slot, text)``: the outputs of a cluster's sub-queries by slot, a line each, empty ones left out."""
    own = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("slot", "text"))))
    return outputs.groupBy("cid").agg(F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))


def write_examples(stories: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """``stories(did, article, abstract)`` as Parquet and ``vocabulary(token, cnt)`` as lines ``token count``, most frequent first."""
    stories.select("did", "article", "abstract").write.mode("errorifexists").parquet(f"{path}/examples")
    ordered = vocabulary.repartitionByRange(F.desc("cnt"), "token").sortWithinPartitions(F.desc("cnt"), "token")
    ordered.select(F.concat_ws(" ", "token", F.col("cnt").cast("string")).alias("value")).write.mode("errorifexists").text(f"{path}/vocab")
