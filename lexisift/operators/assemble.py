"""Rows for training and generation from scored and ranked sentences: orders, merges, samples, leads, sub-summaries, sources.

A text that is put together from sentences is bounded by its caller: a retrieval's k, or a word budget.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexisift.functions import text as T
from lexisift.operators import rank


def _seeded(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def local_order(ranks: DataFrame) -> DataFrame:
    """Adds ``pos`` to ``ranks(cid, doc_id, sent_idx, rank, score)``: documents by mean score, ties by their first rank, sentences as they stand in them."""
    means = ranks.groupBy("cid", "doc_id").agg(F.avg("score").alias("_mean"), F.min("rank").alias("_first"))
    order = W.partitionBy("cid").orderBy(F.desc("_mean"), "_first", "sent_idx")
    return ranks.join(means, ["cid", "doc_id"]).withColumn("pos", F.row_number().over(order)).drop("_mean", "_first")


def merged_lists(lists: DataFrame, keys: str) -> DataFrame:
    """One list of several: score descending; on ties the earlier list, then its own order. ``lists(keys, list_no, rank, score)``."""
    return rank.ranked(lists.withColumnRenamed("rank", "_own"), keys, "list_no", "_own").withColumnRenamed("rank", "merged_rank").withColumnRenamed("_own", "rank")


def positives_and_negatives(sents: DataFrame, n: int = 20, seed: int = 2020) -> DataFrame:
    """``(cid, doc_id, sent_idx, positive)``: the first n sentences document by document in turn, and n others in the order of a hash.

    A cluster of at most 2 n sentences comes out whole. At most n of the first 2 n by hash are positives, so both windows stop early.
    """
    keys = ["cid", "doc_id", "sent_idx"]
    rows = sents.select(*keys)
    first = rows.withColumn("_p", F.row_number().over(W.partitionBy("cid").orderBy("sent_idx", "doc_id"))).where(F.col("_p") <= n).select(*keys)
    by_hash = W.partitionBy("cid").orderBy("_h", "doc_id", "sent_idx")
    drawn = rows.withColumn("_h", _seeded(seed, "doc_id", "sent_idx")).withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= 2 * n)
    others = drawn.join(first, keys, "left_anti").withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= n).select(*keys)
    return first.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))


def lead_and_others(sents: DataFrame, lead: int = 3, others: int = 3, seed: int = 2020) -> DataFrame:
    """``(cid, doc_id, sent_idx)``: of each document the first sentences and as many others by hash; documents with fewer than both are skipped."""
    per_doc = W.partitionBy("cid", "doc_id")
    rows = sents.select("cid", "doc_id", "sent_idx").withColumn("_n", F.count("*").over(per_doc)).where(F.col("_n") >= lead + others)
    rows = rows.withColumn("_in", F.col("sent_idx") < lead).withColumn("_h", _seeded(seed, "doc_id", "sent_idx"))
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("cid", "doc_id", "_in").orderBy("_h", "sent_idx")))
    return rows.where(F.col("_in") | (F.col("_r") <= others)).select("cid", "doc_id", "sent_idx")


def sampled_clusters(clusters: DataFrame, k: int, seed: int = 2020) -> DataFrame:
    """k clusters of each year, in the order of a hash: ``clusters(year, cid)``."""
    order = W.partitionBy("year").orderBy(_seeded(seed, "year", "cid"), "cid")
    return clusters.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def lead(extracts: DataFrame, budget: int, unit: str = "words") -> DataFrame:
    """The leading sentences of ``extracts(cid, pos, n_words)``, up to the one that reaches the words; extracts that never do are left out.
    With ``unit`` sentences, the first ``budget`` of each."""
    if unit == "sentences":
        return extracts.where(F.col("pos") <= budget)
    if unit != "words":
        raise ValueError(unit)
    up_to = F.sum("n_words").over(W.partitionBy("cid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    enough = extracts.groupBy("cid").agg(F.sum("n_words").alias("_all")).where(F.col("_all") >= budget).select("cid")
    return extracts.withColumn("_cum", up_to).where(F.col("_cum") - F.col("n_words") < budget).join(enough, "cid", "left_semi").drop("_cum")


def joined_subsummaries(parts: Column, budget: int) -> Column:
    """One summary of an array of sub-summaries, each with an equal share of the words that are left.

    Empty ones are dropped; a single one stays whole. Of each, the sentences before the one that reaches its share are taken, all if none
    does; the words seen, that sentence's included, are gone from what is left.
    """
    texts = F.filter(parts, lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast("array<string>")

    def one(state: Column, text: Column) -> Column:
        share = state["left"] / state["parts"]
        start = F.struct(F.lit(0).cast("long").alias("seen"), none.alias("kept"), F.lit(False).alias("full"))

        def walk(s: Column, sent: Column) -> Column:
            seen = F.when(s["full"], s["seen"]).otherwise(s["seen"] + F.size(T.tokens(sent)))
            full = s["full"] | (seen >= share)
            return F.struct(seen.alias("seen"), F.when(full, s["kept"]).otherwise(F.array_append(s["kept"], sent)).alias("kept"), full.alias("full"))

        got = F.aggregate(T.split_sentences(text), start, walk)
        return F.struct((state["left"] - got["seen"]).alias("left"), (state["parts"] - 1).alias("parts"), F.concat(state["kept"], got["kept"]).alias("kept"))

    begin = F.struct(F.lit(budget).cast("double").alias("left"), F.size(texts).cast("long").alias("parts"), none.alias("kept"))
    begin = begin.cast("struct<left: double, parts: bigint, kept: array<string>>")
    whole = F.aggregate(texts, begin, lambda s, x: one(s, x).cast("struct<left: double, parts: bigint, kept: array<string>>"), lambda s: F.array_join(s["kept"], " "))
    return F.when(F.size(texts) == 1, texts[0]).otherwise(whole)


def sources(ordered: DataFrame, order: str) -> DataFrame:
    """``(cid, src)``: the sentences of ``ordered(cid, sent, order)`` joined by spaces."""
    return ordered.groupBy("cid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "sent"))), lambda x: x["sent"]), " ").alias("src"))


def generator_rows(sources_: DataFrame, targets: DataFrame, least: int = 0, queries: DataFrame | None = None, length: bool = True) -> DataFrame:
    """``(cid, src, tgt)``: a length token of the target, then the query and ``[SEP]`` if there are ``queries(cid, query)``, before each source;
    targets with fewer than ``least`` words are left out, and an empty query is none."""
    words = F.size(T.tokens(F.col("tgt")))
    rows = sources_.join(targets.select("cid", "tgt").withColumn("_n", words).where(F.col("_n") >= least), "cid")
    rows = rows.withColumn("_q", F.lit(None).cast("string")) if queries is None else rows.join(queries.select("cid", F.nullif("query", F.lit("")).alias("_q")), "cid", "left")
    return rows.select("cid", F.concat_ws(" ", *([T.length_token(F.col("_n"))] if length else []), F.concat("_q", F.lit(" [SEP]")), "src").alias("src"), "tgt")


def weighted(scores: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
    """Scores times the weights of their documents; 0 without one."""
    return scores.join(weights.withColumnRenamed("weight", "_w"), on, "left").withColumn("score", F.col("score") * F.coalesce("_w", F.lit(0.0))).drop("_w")


def conditioned(pairs: DataFrame) -> DataFrame:
    """Similarities without the diagonal, scaled to 0..1 in each cluster; all 0 if they are equal."""
    rest = pairs.where("i <> j")
    ends = rest.groupBy("cid").agg(F.min("sim").alias("_lo"), F.max("sim").alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col("sim") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return rest.join(ends, "cid").withColumn("sim", scaled).drop("_lo", "_hi")


def prefix_matches(names: DataFrame, clusters: DataFrame, fold: bool = False) -> DataFrame:
    """``names(prefix, ...)`` with each cluster whose id starts with the prefix: every prefix of an id is a row, so the join is on equality.

    An empty prefix matches an empty id only.
    """
    key = F.lower("cid") if fold else F.col("cid")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(key))), lambda n: F.substring(key, F.lit(1), n))
    spread = clusters.select("cid", F.explode(F.array_distinct(every)).alias("prefix"))
    return names.withColumn("prefix", F.lower("prefix") if fold else F.col("prefix")).join(spread, "prefix")


def masked_mean(vectors: Column, valid: Column) -> Column:
    """The mean of the first ``valid`` vectors of an array; null without one."""
    real = F.slice(vectors, F.lit(1), F.least(valid, F.size(vectors)).cast("int"))
    total = F.aggregate(F.slice(real, F.lit(2), F.greatest(F.size(real) - 1, F.lit(0))), real[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(real) > 0, F.transform(total, lambda x: x / F.size(real)))


def swap_order(scores: list[float], probability: float, seed: str) -> list[int]:
    """Positions after noise: each position not yet moved is swapped, with the probability given, for a later unmoved one, near scores likelier."""
    rng, order, still = random.Random(seed), list(range(len(scores))), set(range(len(scores)))
    for i in range(len(scores) - 1):
        if i not in still or rng.random() >= probability:
            continue
        later = [j for j in sorted(still) if j > i]
        if later:
            j = rng.choices(later, [1 / (abs(scores[i] - scores[j]) + 1e-7) for j in later])[0]
            order[i], order[j] = order[j], order[i]
            still -= {i, j}
    return order


def swapped(ranks: DataFrame, probability: float, seed: int = 2020) -> DataFrame:
    """``(cid, pos, doc_id, sent_idx, score)`` of retrieved ``ranks(cid, rank, doc_id, sent_idx, score)``: the order with noise, alike in every run."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        out = pdf.iloc[swap_order(pdf["score"].tolist(), probability, f"{seed}:{pdf['cid'].iloc[0]}")]
        return out.assign(pos=range(1, len(out) + 1))[["cid", "pos", "doc_id", "sent_idx", "score"]]

    rows = ranks.select("cid", "rank", "doc_id", "sent_idx", F.col("score").cast("double").alias("score"))
    return rows.groupBy("cid").applyInPandas(one, "cid string, pos long, doc_id long, sent_idx long, score double")


def training_rows(scored: DataFrame, masks: DataFrame) -> DataFrame:
    """``scored(sid, sentence, ...)`` with its cluster's ``masks(cid, masked_summary)``, line-break marks gone from sentences.

    The cluster is the first part of a sentence's id; one without a masked summary is an error, as a row would be lost.
    """
    rows = scored.withColumn("cid", F.split_part("sid", F.lit("_"), F.lit(1))).withColumn("sentence", T.without_newline_marks(F.col("sentence")))
    joined = rows.join(masks.select(F.col("cid").cast("string").alias("cid"), "masked_summary", F.lit(True).alias("_known")), "cid", "left")
    missing = F.raise_error(F.concat(F.lit("no masked summary of cluster "), "cid")).cast("boolean")
    return joined.where(F.coalesce("_known", missing)).drop("_known")


def member_sentences(members: DataFrame, sents: DataFrame) -> DataFrame:
    """``(cluster_id, pos, doc_id, sents)`` of ``members(cluster_id, pos, doc_id)``: each member's sentences in order; a missing one has none."""
    lists = sents.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sent"))), lambda x: x["sent"]).alias("sents"))
    return members.join(lists, "doc_id", "left").withColumn("sents", F.coalesce("sents", F.array().cast("array<string>"))).select("cluster_id", "pos", "doc_id", "sents")


def member_queries(members: DataFrame, queries: DataFrame) -> DataFrame:
    """``(cluster_id, query)``: the queries ``(doc_id, query)`` of a cluster's members in their order, joined by a space; missing and empty ones are skipped."""
    rows = members.join(queries.where("query <> ''"), "doc_id", "left")
    own = F.sort_array(F.collect_list(F.when(F.col("query").isNotNull(), F.struct("pos", "query"))))
    return rows.groupBy("cluster_id").agg(F.array_join(F.transform(own, lambda x: x["query"]), " ").alias("query"))


def triggers(queries: DataFrame, headlines: DataFrame) -> DataFrame:
    """``(cid, query, headlines)``: a query and a map of the headlines ``(did, headline)`` of the documents whose ids start with the cluster's."""
    hits = prefix_matches(queries.select(F.col("cid").alias("prefix")).distinct(), headlines.select(F.col("did").alias("cid")).distinct())
    own = hits.select(F.col("prefix").alias("cid"), F.col("cid").alias("did")).join(headlines, "did")
    maps = own.groupBy("cid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("did", "headline")))).alias("headlines"))
    return queries.join(maps, "cid", "left").withColumn("headlines", F.coalesce("headlines", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def trigger_rows(queries: DataFrame, headlines: DataFrame) -> DataFrame:
    """``(cid, query, did, headline)``: a query with each headline of its cluster's documents, a row each; without one the last two are null.

    The same relation as ``triggers`` for clusters of any size: a cluster's headlines never meet in one row.
    """
    hits = prefix_matches(queries.select(F.col("cid").alias("prefix")).distinct(), headlines.select(F.col("did").alias("cid")).distinct())
    own = hits.select(F.col("prefix").alias("cid"), F.col("cid").alias("did")).join(headlines, "did")
    return queries.join(own, "cid", "left").select("cid", "query", "did", "headline")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``(token, id)``: the distinct tokens numbered from 1 in their order, by blocks of their first two letters: no task has all of them."""
    words = tokens.select("token").distinct().withColumn("_b", F.substring("token", 1, 2))
    sizes = words.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each pair of letters
    inner = F.row_number().over(W.partitionBy("_b").orderBy("token"))
    return words.withColumn("_i", inner).join(sizes.select("_b", before.alias("_before")), "_b").select("token", (F.col("_before") + F.col("_i")).cast("int").alias("id"))


def with_references(systems: DataFrame, files: DataFrame) -> DataFrame:
    """``(cid, text, file, reference)``: a system's text with each reference file that is named by its id, or by it and ``_`` and a digit."""
    named = files.select(F.regexp_replace("file", "_[0-9]$", "").alias("cid"), "file", F.col("text").alias("reference"))
    return systems.join(named, "cid")


def sentences_by_id(ids: DataFrame, sents: DataFrame) -> DataFrame:
    """``ids(doc_id, sent_idx, ...)`` with their sentences; an id out of bounds is an error."""
    joined = ids.join(sents.select("doc_id", "sent_idx", "sent", F.lit(True).alias("_known")), ["doc_id", "sent_idx"], "left")
    missing = F.raise_error(F.concat(F.lit("no sentence "), F.concat_ws("_", F.col("doc_id").cast("string"), F.col("sent_idx").cast("string")))).cast("boolean")
    return joined.where(F.coalesce("_known", missing)).drop("_known")


def index_range(rows: DataFrame, column: str, start: int, end: int | None = None) -> DataFrame:
    """Rows from ``start`` on, up to but not including ``end``."""
    return rows.where((F.col(column) >= start) & (F.lit(True) if end is None else F.col(column) < end))


def split(rows: DataFrame, key: str, year: str, test_year: int, dev_ids: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``split``: ``test`` in its year, ``dev`` by the list of ids, the others ``train``; blacklisted ids go. Lists are joined, not collected."""
    if blacklist is not None:
        rows = rows.join(blacklist.select(key).distinct(), key, "left_anti")
    marked = rows.join(dev_ids.select(key).distinct().withColumn("_dev", F.lit(True)), key, "left")
    return marked.withColumn("split", F.when(F.col(year) == test_year, "test").when(F.col("_dev"), "dev").otherwise("train")).drop("_dev")


def group_numbers(rows: DataFrame, within: str, order: list[str], keys: list[str]) -> DataFrame:
    """Adds ``group``: how often the keys have changed so far, from 0, row by row within a partition."""
    w = W.partitionBy(within).orderBy(*order)
    changed = F.lag(F.struct(*keys)).over(w)
    rows = rows.withColumn("_c", (~F.struct(*keys).eqNullSafe(changed)).cast("int"))
    return rows.withColumn("group", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_c")


def token_ids(rows: DataFrame, vocabulary: DataFrame, key: str, unknown: int = 100) -> DataFrame:
    """``(key, ids)`` of ``rows(key, words)`` by ``vocabulary(token, id)``, in order; words that it lacks get ``unknown``."""
    words = rows.select(key, F.posexplode_outer("words").alias("pos", "token")).join(vocabulary.select("token", "id"), "token", "left")
    found = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id")))
    return words.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(found)), lambda x: x["id"]).alias("ids"))


def unit_order(units: DataFrame) -> DataFrame:
    """``(unit, cid, slot, line_no)`` of generation units, named by a cluster or ``cid_slot``: by cluster, slots as numbers."""
    parts = units.select("unit", F.regexp_extract("unit", r"^(.*?)(?:_([0-9]+))?$", 1).alias("cid"), F.regexp_extract("unit", r"_([0-9]+)$", 1).try_cast("int").alias("slot"))
    every = F.row_number().over(W.orderBy("cid", F.asc_nulls_first("slot"))) - 1  # a row for each unit: as many as a generator decodes
    return parts.withColumn("line_no", every)


def batched(rows: DataFrame, keys: str | list[str], order: list[str], size: int, whole: bool = False, seed: int | None = None) -> DataFrame:
    """Adds ``batch``: rows of a key, in their order or, with a seed, in that of a hash, so many at a time; ``whole`` drops a last batch that isn't full."""
    keys = [keys] if isinstance(keys, str) else keys
    by = [_seeded(seed, *keys, *order), *order] if seed is not None else order
    rows = rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*by)) - 1) / size))
    if not whole:
        return rows
    full = rows.groupBy(*keys, "batch").agg(F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")
    return rows.join(full, [*keys, "batch"], "left_semi")


def paired_inputs(queries: DataFrame, sents: DataFrame, most: int, query_words: int = 32) -> DataFrame:
    """``(cid, doc_id, sent_idx, tokens, segments, mask)``: each sentence packed with its cluster's query, which is cut to its words first; a cluster
    without a query, as in a test set, gets the placeholder of one mask."""
    q = queries.select("cid", T.clipped(T.tokens(F.col("query")), query_words).alias("_q"))
    rows = sents.select("cid", "doc_id", "sent_idx", T.tokens(F.col("sent")).alias("_s")).join(q, "cid", "left")
    rows = rows.withColumn("_q", F.coalesce("_q", F.array(F.lit(T.MASK), F.lit("."))))
    a, b = T.pair_lengths(F.size("_q"), F.size("_s"), most - 3)
    rows = rows.withColumn("_a", F.slice("_q", F.lit(1), a)).withColumn("_b", F.slice("_s", F.lit(1), b))
    return rows.select("cid", "doc_id", "sent_idx", *[c.alias(k) for k, c in T.pair_features(F.col("_a"), F.col("_b"), most).items()])
