"""Readers, writers, joins and drivers over small fixtures."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.operators import assemble, rank, rouge, score
from lexisift.plans import drivers
from lexisift.sources import readers, sinks


def _one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()[0]


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"line {i}" * (i % 5) for i in range(4000)]
    (tmp_path / "a").write_text("\n".join(lines) + "\n")
    (tmp_path / "b").write_text("x\n\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = readers.numbered_lines(spark, f"{tmp_path}/*")
        assert spark.read.text(f"{tmp_path}/a").rdd.getNumPartitions() > 10
        got = {(r.file, r.line_no): r.line for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a", i): x for i, x in enumerate(lines)} | {("b", 0): "x", ("b", 1): "", ("b", 2): "y"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "masks").write_text("\n".join(json.dumps({"masked_seq": [f"m{i}", "[MASK]"], "original_summary": "s"}) for i in range(3)))
    masks = readers.masked_summaries(spark, f"{tmp_path}/masks")
    assert {r.cid: r.masked_summary[0] for r in masks.collect()} == {"0": "m0", "1": "m1", "2": "m2"}
    scored = [{"sid": f"{c}_0_{i}", "sentence": f"NEWLINE_CHAR s {i} ", "rouge_1_f1": 0.2, "rouge_2_f1": 0.1, "rouge_1_recall": 0.0, "rouge_2_recall": 0.0} for c in (0, 2) for i in range(2)]
    (tmp_path / "scored").write_text("\n".join(map(json.dumps, scored)) + "\n\n")
    rows = assemble.training_rows(readers.json_lines(spark, f"{tmp_path}/scored", readers.SCORED_SENTENCE), masks)
    sinks.write_json_lines(rows, f"{tmp_path}/train")
    ex = {r.guid: r for r in readers.examples(spark, f"{tmp_path}/train").collect()}
    assert len(ex) == 4 and ex["2_0_1"].text_a == "m2 [MASK]" and ex["2_0_1"].text_b == "s 1" and ex["2_0_1"].label == pytest.approx(0.85 * 0.1 + 0.15 * 0.2)
    with pytest.raises(Exception, match="no masked summary of cluster 2"):
        assemble.training_rows(readers.json_lines(spark, f"{tmp_path}/scored", readers.SCORED_SENTENCE), masks.where("cid = '0'")).collect()
    (tmp_path / "c7.json").write_text("\n".join(json.dumps({"sid": f"7_{i}", "sentence": f"s{i}", "masked_summary": ["first" if i == 0 else "other"]}) for i in range(3)))
    c = readers.cluster_rows(spark, f"{tmp_path}/c7.json").first()
    assert c.cid == "c7" and c.masked_summary == ["first"] and [x.sentence for x in c.sents] == ["s0", "s1", "s2"]
    (tmp_path / "p").write_text("\n".join(json.dumps({"cid": "a", "pid": str(i), "text": "t"}) for i in range(4)))
    ids = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "9")], "cid string, pid string")
    assert readers.passages(spark, f"{tmp_path}/p").count() == 4 and [r.pid for r in readers.passages(spark, f"{tmp_path}/p", ids).collect()] == ["1"]


def test_other_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes('﻿a\t"x\ty"\nb\tz\n'.encode())
    assert sorted(tuple(r) for r in readers.separated(spark, f"{tmp_path}/t.tsv", "k string, v string").collect()) == [("a", "x\ty"), ("b", "z")]
    for name, m in (("m.npy", np.arange(6.0).reshape(2, 3)), ("v.npy", np.array([1, 2], np.int64))):
        np.save(tmp_path / name, m)
    got = {(r.file, r.i): r.row for r in readers.matrices(spark, f"{tmp_path}/*.npy").collect()}
    assert got == {("m.npy", 0): [0, 1, 2], ("m.npy", 1): [3, 4, 5], ("v.npy", 0): [1], ("v.npy", 1): [2]}
    records = [b"", b"one", bytes(300)]
    (tmp_path / "x.bin").write_bytes(b"".join(struct.pack("<q", len(r)) + r for r in records))
    assert [bytes(r.record) for r in readers.length_prefixed(spark, f"{tmp_path}/x.bin").orderBy("i").collect()] == records
    (tmp_path / "y.bin").write_bytes(struct.pack("<q", 9) + b"cut")
    with pytest.raises(Exception, match="is cut"):
        readers.length_prefixed(spark, f"{tmp_path}/y.bin").collect()
    (tmp_path / "out").write_text("---\n1 ROUGE-2 Average_R: 0.08123 (95%-conf.int. 0.07 - 0.09)\n1 ROUGE-2 Average_F: 0.09000 (95%)\nnoise\n1 ROUGE-SU4 Average_P: 0.1\n")
    assert sorted(tuple(r) for r in readers.result_table(spark, f"{tmp_path}/out").collect()) == [("1", "2", "f1", 0.09), ("1", "2", "recall", 0.08123), ("1", "SU4", "precision", 0.1)]
    (tmp_path / "s.json").write_text('{"model": {"lr": 0.1}}')
    assert readers.settings(f"{tmp_path}/s.json") == {"model": {"lr": 0.1}}
    (tmp_path / "s.json").write_text('{"model": 3}')
    with pytest.raises(ValueError):
        readers.settings(f"{tmp_path}/s.json")
    refs = spark.createDataFrame([("a", 0, "no"), ("a", 1, "one\ntwo")], "cid string, ref_idx int, text string")
    assert [tuple(r) for r in readers.oracle_queries(refs).collect()] == [("a", "onetwo")]


def test_writers(spark, tmp_path):
    sims = spark.createDataFrame([("c", 0, 1, 0.5), ("c", 2, 1, 0.25), ("c", 1, 0, 0.5)], "cid string, i int, j int, sim double")
    lines = {r.i: r.line for r in sinks.matrix_lines(sims).collect()}
    assert lines == {0: "0.000000 0.500000 0.000000", 1: "0.500000 0.000000 0.000000", 2: "0.000000 0.250000 0.000000"}
    sinks.write_components(sims, sims.select("cid", F.col("i"), F.col("sim").alias("score")), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c/sims").count() == 3 == spark.read.parquet(f"{tmp_path}/c/scores").count()
    points = spark.createDataFrame([(10.0, 0.12345, 0.5)], "var double, recall double, f1 double")
    for _ in range(2):
        sinks.append_tuning(points, f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["10.0\t12.35\t50.00"] * 2
    ranks = spark.createDataFrame([("c", 2, "0_1", 0.5, "b"), ("c", 1, "0_0", 0.9, "a")], "cid string, rank int, sid string, score double, sent string")
    sinks.write_retrieval(ranks, f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == ["0_0\t0.9\ta", "0_1\t0.5\tb"]
    assert [r.value for r in sinks.statistics_lines(points).collect()] == ["var: 10.0", "recall: 0.12345", "f1: 0.5"]
    outs = spark.createDataFrame([("c", 10, "z"), ("c", 2, "y"), ("c", 3, "")], "cid string, slot int, text string")
    assert sinks.appended_subqueries(outs).first().text == "y\nz"
    stories = spark.createDataFrame([("d", "a b", "s", 1)], "did string, article string, abstract string, n int")
    sinks.write_examples(stories, spark.createDataFrame([("b", 1), ("a", 9), ("c", 1)], "token string, cnt long"), f"{tmp_path}/e")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/e/vocab").collect()) == ["a 9", "b 1", "c 1"] and spark.read.parquet(f"{tmp_path}/e/examples").columns == ["did", "article", "abstract"]


def test_joins(spark):
    sents = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc_id long, sent_idx int, sent string")
    members = spark.createDataFrame([(7, 0, 1), (7, 1, 5)], "cluster_id long, pos int, doc_id long")
    assert {r.doc_id: r.sents for r in assemble.member_sentences(members, sents).collect()} == {1: ["a", "b"], 5: []}
    queries = spark.createDataFrame([(1, "q one"), (5, "")], "doc_id long, query string")
    assert assemble.member_queries(members, queries).first().query == "q one"
    q = spark.createDataFrame([("D1", "x"), ("D2", "y")], "cid string, query string")
    heads = spark.createDataFrame([("D1b", "h2"), ("D1a", "h1"), ("E", "h3")], "did string, headline string")
    assert {r.cid: r.headlines for r in assemble.triggers(q, heads).collect()} == {"D1": {"D1a": "h1", "D1b": "h2"}, "D2": {}}
    files = spark.createDataFrame([("c_0", "r0"), ("c_1", "r1"), ("c", "r"), ("cc", "no")], "file string, text string")
    assert sorted(r.file for r in assemble.with_references(spark.createDataFrame([("c", "sys")], "cid string, text string"), files).collect()) == ["c", "c_0", "c_1"]
    ids = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, sent_idx int")
    assert {r.sent for r in assemble.sentences_by_id(ids, sents).collect()} == {"b", "c"}
    with pytest.raises(Exception, match="no sentence 2_0"):
        assemble.sentences_by_id(ids, sents.where("doc_id = 1")).collect()
    assert assemble.index_range(sents, "doc_id", 2).count() == 1 and assemble.index_range(sents, "doc_id", 1, 2).count() == 2
    units = spark.createDataFrame([("a_10",), ("a_2",), ("b",)], "unit string")
    assert [r.unit for r in assemble.unit_order(units).orderBy("line_no").collect()] == ["a_2", "a_10", "b"]
    vec = spark.createDataFrame([("c", [0.5, 0.25, float("-inf"), 1.0])], "cid string, vector array<double>")
    found = score.identified(vec, spark.createDataFrame([("c", 0, "0_0"), ("c", 1, "0_4"), ("c", 3, "1_0")], "cid string, abs long, sid string")).collect()
    assert sorted((r.sid, r.score) for r in found) == [("0_0", 0.5), ("0_4", 0.25)]


def test_records(spark):
    ranks = spark.createDataFrame([("c", i + 1, s) for i, s in enumerate([5.0, 3.0, 1.0, 1.0])] + [("z", 1, 0.0), ("z", 2, 0.0)], "cid string, rank int, score double")
    for kind, grid in (("topK", [1, 3]), ("comp", [0.25, 0.5, 1.0]), ("conf", [0.05, 0.5, 0.75, 1.0])):
        got = {(r.cid, r["var"]): r.n for r in rank.records(ranks, "cid", kind, grid).groupBy("cid", "var").agg(F.count("*").alias("n")).collect()}
        for v in grid:
            one = {"topK": lambda v=v: ranks.where(F.col("rank") <= v), "comp": lambda v=v: rank.compressed(ranks, v, "cid"), "conf": lambda v=v: rank.confident(ranks, v, "cid")}[kind]()
            assert {k[0]: n for k, n in got.items() if k[1] == v} == {r.cid: r["count"] for r in one.groupBy("cid").count().collect()}, (kind, v)
    with pytest.raises(ValueError):
        rank.records(ranks, "cid", "x", [1])


def test_packing(spark):
    f = T.single_features(F.col("w"), 4)
    assert _one(spark, F.struct(*f.values()), "w array<string>", ["a", "b", "c", "d"])[0] == ["[CLS]", "a", "b", "c"]
    assert list(_one(spark, F.struct(*f.values()), "w array<string>", ["a"])) == [["[CLS]", "a", "[PAD]", "[PAD]"], [0] * 4, [1, 1, 0, 0]]
    assert _one(spark, T.span_masks(F.col("n"), 3, 6), "n array<int>", [2, 1]) == [[0, 1, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0], [0] * 6]
    base = T.merge_masks(F.col("w"), "[BASE]")
    assert _one(spark, base, "w array<string>", ["[BASE]", "[MASK]", "[BASE]", "[MASK]"]) == []
    assert _one(spark, base, "w array<string>", ["[MASK]", "[BASE]", "[MASK]", "a"]) == ["[MASK]", "a"]
    assert _one(spark, T.normal_sentence(F.col("s"), stem=True), "s string", "The Ponies  hopping") == "the poni hop"
    assert _one(spark, T.normal_sentence(F.col("s"), stem=True), "s string", " ") is None
    assert _one(spark, T.tokens(F.col("s")), "s string", "Für 2 Straßen, l'été!") == ["für", "2", "straßen", "l", "été"]
    with pytest.raises(KeyError):
        T.raw_query(F.col("w"), "x")


def test_rouge_of_empty_texts(spark):
    texts = spark.createDataFrame([("c", 1, ["a"]), ("c", 2, []), ("c", 3, None), ("d", 4, ["a"])], "cid string, i int, words array<string>")
    refs = spark.createDataFrame([("c", 0, ["a", "b"]), ("c", 1, []), ("e", 0, ["x"])], "cid string, ref_idx int, words array<string>")
    got = {(r.i, r.ref_idx, r.n): (r.overlap, r.sys_n, r.ref_n, r.recall, r.f1) for r in rouge.scores(texts, refs, ["cid", "i"], (1, 2)).collect()}
    assert len(got) == 12 and got[1, 0, "1"] == (1, 1, 2, 0.5, 0.666667) and got[1, 0, "2"] == (0, 0, 1, 0.0, 0.0) and got[2, 1, "1"] == got[3, 1, "1"] == (0, 0, 0, 0.0, 0.0)
    means = {r.n: (r.recall, r.n_clusters) for r in rouge.system_score(texts.where("i = 1").select("cid", "words"), refs, (1,)).collect()}
    assert means == {"1": (0.125, 2)}  # a cluster without a text counts
    assert rouge.scores(texts.limit(0), refs, ["cid", "i"]).count() == 0


def test_choices_by_name(spark, tmp_path):
    sents = spark.createDataFrame([("c", 1, 0, "red dogs run"), ("c", 1, 1, "blue"), ("x", 2, 0, "red")], "cid string, doc_id long, sent_idx int, sent string")
    queries = spark.createDataFrame([("c", "red dog")], "cid string, query string")
    for name, model in drivers.RELEVANCE.items():
        rows = {(r.doc_id, r.sent_idx): r.score for r in model(sents, queries).collect()}
        assert rows.keys() == {(1, 0), (1, 1)}, name
        if name != "kl":
            assert (rows[1, 0] > 0 or name == "bm25") and rows[1, 1] == 0, name
    assert _one(spark, drivers.TOKENISERS["stems"](F.col("s")), "s string", "Running dogs") == ["run", "dog"]
    assert drivers.most_tokens("para", joined=True) == 160 and drivers.run_name(b=2, a=None, c="x") == "b_2-c_x"
    with pytest.raises(ValueError):
        drivers.most_tokens("x")
    nodes = sents.where("cid = 'c'").withColumn("i", F.col("sent_idx").cast("long"))
    for kind in ("tfidf", "bm25", "partial"):
        assert [x.columns[-1] for x in score.components(nodes, queries, kind)] == ["sim", "score"]
    with pytest.raises(ValueError):
        score.components(nodes, queries, "x")
    vectors = spark.createDataFrame([("c", "s1", [1.0, 0.0]), ("c", "s2", None)], "cid string, sid string, embedding array<double>")
    both = spark.createDataFrame([("c", [1.0, 0.0]), ("c", [0.0, 1.0]), ("c", None)], "cid string, embedding array<double>")
    assert [(r.sid, r.score) for r in score.pooled(vectors, both).collect()] == [("s1", 0.5)] and score.pooled(vectors, both, pool="max").first().score == 1.0


def test_generation(spark, tmp_path):
    ranks = spark.createDataFrame([("c", 1, 0, 2, 1.0, "two"), ("c", 2, 0, 1, 5.0, "one")], "cid string, doc_id long, sent_idx int, rank int, score double, sent string")
    targets, queries = spark.createDataFrame([("c", "a target")], "cid string, tgt string"), spark.createDataFrame([("c", "why")], "cid string, query string")
    assert drivers.generator_input(ranks, targets).first().src == "[unused85] one two"
    assert drivers.generator_input(ranks, targets, "raw", queries, order="pos").first().src == "[unused85] why [SEP] one two"
    with pytest.raises(ValueError):
        drivers.generator_input(ranks, targets, "masked", queries)
    (tmp_path / "decoded").write_text("it ' s red\nnothing")
    ids = spark.createDataFrame([(0, "c"), (1, "d")], "line_no long, cid string")
    texts = drivers.decoded_texts(spark, f"{tmp_path}/decoded", ids)
    assert {r.cid: r.text for r in texts.collect()} == {"c": "it 's red", "d": "nothing"}
    refs = spark.createDataFrame([("c", 0, ["it", "s", "red"]), ("d", 0, ["x"])], "cid string, ref_idx int, words array<string>")
    got = {(r.run, r.n): r.f1 for r in drivers.evaluated({"a": texts, "b": texts.where("cid = 'd'")}, refs, (1,)).collect()}
    assert got == {("a", "1"): 0.5, ("b", "1"): 0.0}


def test_batches(spark):
    rows = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 0)], "cid string, i int")
    got = {(r.cid, r.i): r.batch for r in assemble.batched(rows, "cid", ["i"], 3).collect()}
    assert got == {("a", i): i // 3 for i in range(7)} | {("b", 0): 0}
    assert assemble.batched(rows, "cid", ["i"], 3, whole=True).count() == 6
    one, two = ({(r.cid, r.i): r.batch for r in assemble.batched(rows, "cid", ["i"], 3, seed=s).collect()} for s in (1, 1))
    assert one == two != got and sorted(one.values()) == sorted(got.values())
    sents = spark.createDataFrame([("a", 1, 0, "One two three four."), ("b", 2, 0, "five")], "cid string, doc_id long, sent_idx int, sent string")
    packed = {r.cid: r for r in assemble.paired_inputs(spark.createDataFrame([("a", "why not")], "cid string, query string"), sents, 8).collect()}
    assert packed["a"].tokens == ["[CLS]", "why", "not", "[SEP]", "one", "two", "three", "[SEP]"] and packed["a"].segments == [0] * 4 + [1] * 4
    assert packed["b"].tokens == ["[CLS]", "[MASK]", ".", "[SEP]", "five", "[SEP]", "[PAD]", "[PAD]"] and packed["b"].mask == [1] * 6 + [0] * 2


def test_years_and_references(spark, tmp_path):
    for year in (2005, 2006):
        (tmp_path / str(year)).write_text(f"<num> D{year} </num>\n<title> Rain </title>\n<narr>\nWhy?\n</narr>")
    got = readers.topics_of_years(spark, {y: f"{tmp_path}/{y}" for y in (2006, 2005)}).collect()
    assert sorted((r.year, r.num) for r in got) == [(2005, "D2005"), (2006, "D2006")]
    (tmp_path / "r").mkdir()
    for name in ("D1.M.250.A.B", "D1.M.100.A.B", "D1.P.250.A.B"):
        (tmp_path / "r" / name).write_text("x")
    assert [r.file for r in readers.manual_references(spark, f"{tmp_path}/r").collect()] == ["D1.M.250.A.B"]
    rows = readers.manual_references(spark, f"{tmp_path}/r")
    assert readers.counted(rows, 1) is rows
    with pytest.raises(ValueError, match="1 rows instead of 2"):
        readers.counted(rows, 2)


def test_ranks_and_running_sums_over_blocks(spark, monkeypatch):
    """One key holds most rows and one score most of its rows; blocks of four, so that each list is in many of them."""
    monkeypatch.setattr(rank, "BLOCK", 4)
    rng = random.Random(5)
    rows = [(None if i % 50 == 7 else "hot" if i % 3 else f"k{i % 11}", i * 3 - 200, None if i % 41 == 0 else float("nan") if i % 43 == 0 else -0.0 if i % 17 == 0 else 0.0 if i % 2 else rng.choice([1.5, -2.0, rng.random()]), rng.randrange(9)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "cid string, i long, score double, n long")
    got = rank.ranked(df, "cid", "i")
    assert got.columns == [*df.columns, "rank"]
    own = {}
    for cid in {r[0] for r in rows}:
        better = lambda r: (r[2] is None, 0 if r[2] is None else -math.inf if math.isnan(r[2]) else -r[2], r[1])
        own[cid] = sorted((r for r in rows if r[0] == cid), key=better)
    assert {(r.cid, r.i): r["rank"] for r in got.collect()} == {(cid, r[1]): k for cid, best in own.items() for k, r in enumerate(best, 1)}
    before = {(cid, r[1]): sum(x[3] for x in best[:k]) for cid, best in own.items() for k, r in enumerate(best)}
    assert {(r.cid, r.i): r["_before"] for r in rank.running(got, "cid", "n").collect()} == before
    assert {(r.cid, r.i): r.cum_words for r in rank.budgeted(got, 30, "cid", "n").collect()} == {(cid, r[1]): before[cid, r[1]] + r[3] for cid, best in own.items() for r in best if before[cid, r[1]] < 30}
    named = df.withColumn("name", F.concat(F.lit("n"), F.format_string("%05d", F.col("i") + 500)))
    assert {(r.cid, r.i): r["rank"] for r in rank.ranked(named, ["cid"], "name").collect()} == {(r.cid, r.i): r["rank"] for r in got.collect()}
    assert rank.ranked(df.limit(0), "cid", "i").count() == 0 and rank.running(got.limit(0), "cid", "n").count() == 0
