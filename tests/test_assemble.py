"""Sub-summaries, samples, leads, packing functions and readers against plain Python and small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.operators import assemble
from lexisift.sources import readers, sinks


def _one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()[0]


def _joined(parts, budget):
    parts = [p for p in parts if p]
    if len(parts) == 1:
        return parts[0]
    left, out = float(budget), []
    for k, part in enumerate(parts):
        share, seen = left / (len(parts) - k), 0
        for sent in [s for s in re.sub(r"([.!?]) +", r"\1\n", " ".join(part.split())).split("\n") if s]:
            seen += len(re.findall("[a-z0-9]+", sent.lower()))
            if seen >= share:
                break
            out.append(sent)
        left -= seen
    return " ".join(out)


def test_joined_subsummaries(spark):
    rng = random.Random(1)
    text = lambda: " ".join(" ".join(rng.choices("abc", k=rng.randint(1, 9))) + "." for _ in range(rng.randint(0, 6)))
    rows = [(i, [text() for _ in range(rng.randint(0, 5))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, p array<string>")
    for budget in (0, 12, 40):
        got = dict(df.select("i", assemble.joined_subsummaries(F.col("p"), budget)).collect())
        assert got == {i: _joined(p, budget) for i, p in rows}


def test_samples(spark):
    sents = spark.createDataFrame([("a", d, s) for d in range(3) for s in range(12)] + [("b", d, s) for d in range(9) for s in range(d + 2)], "cid string, doc_id long, sent_idx int")
    got = assemble.positives_and_negatives(sents).collect()
    assert len([r for r in got if r.cid == "a"]) == 36 == len({r[:3] for r in got if r.cid == "a"})
    assert sorted((r.positive for r in got if r.cid == "b")) == [False] * 20 + [True] * 20
    assert len({r[:3] for r in got}) == len(got)
    per_doc = {}
    for r in assemble.lead_and_others(sents).collect():
        per_doc.setdefault((r.cid, r.doc_id), set()).add(r.sent_idx)
    assert all(len(v) == 6 and {0, 1, 2} <= v for v in per_doc.values())
    assert {d for c, d in per_doc if c == "b"} == {4, 5, 6, 7, 8}


def test_lead(spark):
    rows = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 3, 4), ("b", 1, 3)], "cid string, pos int, n_words int")
    assert sorted(tuple(r)[:2] for r in assemble.lead(rows, 6).collect()) == [("a", 1), ("a", 2)]
    assert assemble.lead(rows, 1, "sentences").count() == 2
    with pytest.raises(ValueError):
        assemble.lead(rows, 1, "pages")


def test_orders(spark):
    ranks = spark.createDataFrame([("c", 1, 5, 1, 9.0), ("c", 1, 0, 4, 1.0), ("c", 2, 3, 2, 6.0), ("c", 3, 1, 3, 5.0)], "cid string, doc_id long, sent_idx int, rank int, score double")
    placed = {r.pos: (r.doc_id, r.sent_idx) for r in assemble.local_order(ranks).collect()}
    assert [placed[i] for i in (1, 2, 3, 4)] == [(2, 3), (1, 0), (1, 5), (3, 1)]
    pairs = spark.createDataFrame([("c", 0, 0, 1.0), ("c", 0, 1, 0.2), ("c", 0, 2, 0.6), ("d", 0, 1, 0.5)], "cid string, i int, j int, sim double")
    assert sorted((r.cid, r.j, round(r.sim, 6)) for r in assemble.conditioned(pairs).collect()) == [("c", 1, 0.0), ("c", 2, 1.0), ("d", 1, 0.0)]


def test_prefixes(spark):
    names = spark.createDataFrame([("D1", "x"), ("", "y"), (None, "z")], "prefix string, file string")
    clusters = spark.createDataFrame([("d12",), ("d2",), ("",), (None,)], "cid string")
    assert assemble.prefix_matches(names, clusters).count() == 1
    assert {r.cid for r in assemble.prefix_matches(names, clusters, fold=True).where("file = 'x'").collect()} == {"d12"}


def test_packing(spark):
    assert _one(spark, T.subquery_tokens(F.col("w"), "[S]", 4), "w array<string>", ["a", "[SUBQUERY]", "b", "c"]) == ["a", "[S]", "b", "[S]"]
    assert _one(spark, T.tagged_abstract(F.col("w")), "w array<string>", ["a b", "c"]) == "<s> a b </s> <s> c </s>"
    assert _one(spark, T.ragged_mask(F.col("n"), 3, 2), "n array<int>", [1, 5]) == [[1, 0], [1, 1], [0, 0]]
    assert _one(spark, T.label_vector(F.col("n")), "n array<int>", [1, -1, 0]) == [1.0, 0.0, 0.0]
    assert _one(spark, T.reversed_labels(F.col("n")), "n array<int>", [1, 0]) == [0, 1]
    assert _one(spark, T.percent(F.col("x")), "x double", 0.12345) == "12.35"
    assert _one(spark, T.is_number(F.col("x")), "x string", "3,000") and not _one(spark, T.is_number(F.col("x")), "x string", "3a")
    assert _one(spark, T.first_field(F.col("x")), "x string", "a\tb") == "a"
    mean = assemble.masked_mean(F.col("v"), F.col("n"))
    assert _one(spark, mean, "v array<array<double>>, n int", [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], 2) == [2.0, 3.0]
    assert _one(spark, mean, "v array<array<double>>, n int", [[1.0, 2.0]], 0) is None


def test_readers(spark, tmp_path):
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "D1.M.txt").write_text("Rain fell.")
    (tmp_path / "refs" / "x.swp").write_text("")
    assert [tuple(r) for r in readers.file_names(spark, str(tmp_path / "refs")).collect()] == [("refs", "D1.M.txt")]
    assert [tuple(r) for r in readers.reference_texts(spark, f"{tmp_path}/refs/*.txt").collect()] == [("D1", "D1.M.txt", "Rain fell.")]
    (tmp_path / "labels").write_text("0_2\n1\n")
    got = readers.label_lines(spark, str(tmp_path / "labels"), 3).orderBy("sent_idx").collect()
    assert [r.labels for r in got] == [[1, 0, 1], [0, 1, 0]]
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "line_no int, cid string")
    assert sorted(tuple(r) for r in readers.decoded(spark, str(tmp_path / "labels"), ids).collect()) == [("a", "0_2"), ("b", "1")]


def test_swaps(spark):
    scores = [random.Random(3).random() for _ in range(40)]
    assert assemble.swap_order(scores, 0, "s") == list(range(40)) == assemble.swap_order([], 1, "s") + list(range(40))
    order = assemble.swap_order(scores, 1, "s")
    assert sorted(order) == list(range(40)) and order == assemble.swap_order(scores, 1, "s")
    assert all(order[j] == i for i, j in enumerate(order)) and order != list(range(40))


def test_sinks(spark, tmp_path):
    refs = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "cid string, ref_idx int, text string")
    assert {r.file for r in sinks.reference_targets(refs).collect()} == {"a_0", "a_1", "b_0"}
    assert {tuple(r) for r in sinks.reference_targets(refs, single=True).select("file", "text").collect()} == {("a", "x"), ("b", "z")}
    sinks.write_clusters(refs.select("cid", F.col("ref_idx").alias("pos"), F.col("text").alias("line")), f"{tmp_path}/c")
    assert {tuple(r) for r in spark.read.text(f"{tmp_path}/c").select("cid", "value").collect()} == {("a", "x"), ("a", "y"), ("b", "z")}
    sinks.write_index_input(refs.select("cid", "text"), f"{tmp_path}/i")
    assert spark.read.json(f"{tmp_path}/i").columns == ["id", "text"]
