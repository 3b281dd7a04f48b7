"""Whole ways through the library: tables of sentence scores, tuning, run records, generator input and its evaluation; choices by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.functions.stem import stemmed
from lexisift.operators import assemble, rank, rouge, score
from lexisift.sources import readers, sinks

#: Splitters of a text into words, relevance models and pooling, by the names that settings use.
TOKENISERS: dict[str, Callable[[Column], Column]] = {"words": T.tokens, "stems": lambda c: stemmed(T.tokens(c)), "spaces": lambda c: F.split(T.one_space(c), " ")}
RELEVANCE: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "tf": lambda s, q: score.lexical(s, q).withColumn("score", F.col("tf_cosine")), "count": score.overlaps, "tfidf": score.tfidf_cosine, "bm25": score.bm25, "kl": score.kl_divergence,
    "weighted_count": lambda s, q: score.lexical(s, q).withColumn("score", F.col("weighted_count")), "bhattacharyya": lambda s, q: score.lexical(s, q).withColumn("score", F.col("bhattacharyya")),
}
#: Tokens of a packed input by the kind of its text; a query beside a paragraph shares the paragraph's.
MOST_TOKENS = {"query": 32, "para": 128, "article": 512, "sent": 64}


def most_tokens(source: str, joined: bool = False) -> int:
    if source not in MOST_TOKENS:
        raise ValueError(source)
    return MOST_TOKENS[source] + (MOST_TOKENS["query"] if joined else 0)


def run_name(**settings) -> str:
    """A run's name from its settings, in the order of their names; settings of None are left out."""
    return "-".join(f"{k}_{settings[k]}" for k in sorted(settings) if settings[k] is not None)


def sentence_scores(sents: DataFrame, references: DataFrame, path: str | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """ROUGE-1 and -2 of every sentence ``(cid, doc_id, sent_idx, sent)`` against its cluster's summary, in one job; as JSON lines if a path is given.

    ``start`` and ``end`` bound ``doc_id``. Clusters without a summary have no rows.
    """
    ids = ["cid", "doc_id", "sent_idx"]
    rows = assemble.index_range(sents, "doc_id", start, end).select(*ids, "sent", T.tokens(F.col("sent")).alias("words"))
    both = rouge.scores(rows, references, [*ids, "sent"], (1, 2))
    of = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c))).alias(f"rouge_{n}_{c}")
    wide = both.groupBy(*ids, "sent").agg(*[of(n, c) for n in ("1", "2") for c in ("recall", "f1")])
    out = wide.select(F.concat_ws("_", "cid", F.col("doc_id").cast("string"), F.col("sent_idx").cast("string")).alias("sid"), F.col("sent").alias("sentence"), *[f"rouge_{n}_{c}" for n in (1, 2) for c in ("recall", "f1")])
    if path:
        sinks.write_json_lines(out, path)
    return out


def tuned(ranks: DataFrame, references: DataFrame, kind: str, grid: list[float], least: int = 0) -> DataFrame:
    """``(var, recall, f1)``: ROUGE-2 of what each setting of a filter keeps of ``ranks(cid, rank, score, words)``, all settings in one pass.

    The words of a setting's sentences are one text; clusters that keep nothing score 0.
    """
    kept = rank.records(ranks.select("cid", "rank", "score", "words"), "cid", kind, grid, least)
    texts = kept.groupBy("var", "cid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "words"))), lambda x: x["words"])).alias("words"))
    every = references.select("cid").distinct().withColumn("var", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    texts = every.join(texts, ["cid", "var"], "left")
    each = rouge.scores(texts, references, ["var", "cid"], 2).groupBy("var", "cid").agg(F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return each.groupBy("var").agg(rouge.mean("recall").alias("recall"), rouge.mean("f1").alias("f1"))


def generator_input(ranks: DataFrame, targets: DataFrame, mode: str = "none", queries: DataFrame | None = None, masked: DataFrame | None = None, order: str = "rank") -> DataFrame:
    """``(cid, src, tgt)`` with the query that a mode names: ``none``, ``raw`` of ``queries(cid, query)``, or ``masked`` of ``masked(cid, query)``."""
    chosen = {"none": None, "raw": queries, "masked": masked}[mode]
    if mode != "none" and chosen is None:
        raise ValueError(f"no queries for {mode}")
    ordered = assemble.local_order(ranks) if order == "pos" else ranks
    return assemble.generator_rows(assemble.sources(ordered, order), targets, queries=chosen)


def decoded_texts(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """``(cid, text, words)`` of a decoder's output, detokenised; line i belongs to unit i of ``ids(line_no, cid)``."""
    rows = readers.decoded(spark, path, ids).withColumn("text", T.detokenised(F.col("text")))
    return rows.withColumn("words", T.tokens(F.col("text")))


def evaluated(runs: dict[str, DataFrame], references: DataFrame, kinds: tuple = (1, 2, "su4"), limit: int | None = None) -> DataFrame:
    """``(run, n, recall, f1, n_clusters)`` of several runs' texts ``(cid, words)``: checkpoints, or settings, side by side."""
    parts = [rouge.system_score(texts, references, kinds, limit).withColumn("run", F.lit(name)) for name, texts in runs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("run", "n", "recall", "f1", "n_clusters")
