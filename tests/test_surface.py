"""Data sources, SQL functions, rank lists of a stream and centrality of any size against plain versions."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.functions import punkt, sql
from lexisift.functions import text as T
from lexisift.functions.stem import stem
from lexisift.operators import graph, rank
from lexisift.operators.select import lexrank_scores
from lexisift.sources import datasource, tables
from lexisift.streaming import ranks

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sources(spark):
    datasource.register(spark)
    return spark


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_tagged_articles(sources, tmp_path, size, monkeypatch):
    monkeypatch.setattr(datasource, "STEP", 16)
    rng = random.Random(size)
    texts = ["x" * rng.randint(0, 90) + ("é<DO" if i % 3 else "<P> a </P>") for i in range(40)]
    (tmp_path / "a.sgml").write_text("head" + "".join(f"\n<DOC>\n{t}\n</DOC> between " for t in texts), encoding="utf-8")
    (tmp_path / "b.sgml").write_text("nothing here")
    (tmp_path / "_c").write_text("<DOC>hidden</DOC>")
    df = sources.read.format("tagged_articles").option("partitionBytes", size).load(str(tmp_path))
    assert [r.raw for r in df.orderBy("file", "offset").collect()] == texts
    assert df.rdd.getNumPartitions() > 1 or size > 1000


def test_cut_article(sources, tmp_path):
    (tmp_path / "a").write_text("<DOC> a </DOC> <DOC> b")
    with pytest.raises(Exception, match="is cut"):
        sources.read.format("tagged_articles").load(str(tmp_path / "a")).collect()


@pytest.mark.parametrize("array", [np.arange(12.0).reshape(4, 3), np.asfortranarray(np.arange(5000, dtype=np.int32).reshape(2500, 2)), np.arange(7, dtype=np.float32), np.zeros((0, 3)), np.zeros((3, 0)), np.arange(6, dtype=">i8").reshape(3, 2)])
@pytest.mark.parametrize("size", [1, 4000, 10**6])
def test_arrays(sources, tmp_path, array, size):
    if size == 1:
        array = array[:30]
    np.save(tmp_path / "a.npy", array)
    df = sources.read.format("numpy_arrays").option("partitionBytes", size).load(f"file://{tmp_path}")
    assert [r.row for r in df.orderBy("i").collect()] == array.reshape(len(array), -1 if array.size else array.shape[-1]).astype(float).tolist()
    if array.nbytes > 2 * size:
        assert df.rdd.getNumPartitions() > 1


def test_length_prefixed(sources, tmp_path):
    rng = random.Random(1)
    for name, n in (("a", 300), ("b", 0), ("c", 1)):
        records = [rng.randbytes(rng.choice([0, 3, 200])) for _ in range(n)]
        (tmp_path / name).write_bytes(b"".join(struct.pack("<q", len(r)) + r for r in records))
        df = sources.read.format("length_prefixed").option("partitionBytes", 900).load(str(tmp_path / name))
        assert [bytes(r.record) for r in df.orderBy("i").collect()] == records
        assert (df.rdd.getNumPartitions() > 5) == (n == 300)
    (tmp_path / "d").write_bytes(struct.pack("<q", 9) + b"short")
    with pytest.raises(Exception, match="is cut"):
        sources.read.format("length_prefixed").load(str(tmp_path / "d")).collect()
    with pytest.raises(Exception, match="nowhere"):
        sources.read.format("length_prefixed").load(str(tmp_path / "nowhere")).collect()


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "explode_sentences" in names
    docs = tables.documents(spark, DIR)
    docs.createOrReplaceTempView("docs")
    got = spark.sql("select doc_id, sent_idx, sent, n_words(sent) as n from docs, lateral explode_sentences(text)").collect()
    want = tables.sentences(docs).select("doc_id", "sent_idx", "sent", F.size(T.tokens(F.col("sent"))).alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    row = spark.sql("select overlap_count('A b a c', 'a b b'), sentence_id(3, 4), word_ngrams('a b a b', 2), word_ngrams('a', 2), smoothed_label(0D, 1D), length_token(130), porter_stem('running'), split_sentences(null), word_ngrams(null, 1)").first()
    assert tuple(row) == (4, "3_4", ["a b", "b a"], [], 0.85, "[unused130]", stem("running"), None, [])
    assert spark.sql("select count(*) from (select null as t), lateral explode_sentences(cast(t as string))").first()[0] == 0
    plan = spark.sql("select n_words(text) from docs")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "Python" not in plan
    sql.register(spark, punkt.Punkt(abbreviation=frozenset({"dr"})))
    assert [r.sent for r in spark.sql("select sent from explode_sentences('Dr. Who came. He left.') order by sent_idx").collect()] == ["Dr. Who came.", "He left."]
    sql.register(spark)


@pytest.mark.parametrize("seed", range(3))
def test_ranks_of_a_stream(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.randrange(40), rng.randrange(5), rng.randrange(9), "x") for _ in range(400)]
    rows = list({r[:3]: r for r in rows}.values())
    schema = "cid string, doc_id long, sent_idx long, score long, note string"
    merge = ranks.merged_into(str(tmp_path), 7)
    order = rows[:]
    rng.shuffle(order)
    cuts = sorted(rng.sample(range(len(order)), 3))
    parts = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)]
    assert ranks.current(spark, str(tmp_path)) is None
    for number, part in enumerate(parts):
        again = part + order[: 20 if number else 0]  # rows that come again in a later batch
        for _ in range(1 + (number == 2)):  # a batch that comes again
            merge(spark.createDataFrame(again, schema), number)
    got = sorted(map(tuple, ranks.current(spark, str(tmp_path)).select("cid", "rank", "doc_id", "sent_idx", "score").collect()))
    want = rank.top_k(spark.createDataFrame(rows, schema), 7, "cid", "doc_id", "sent_idx").select("cid", "rank", "doc_id", "sent_idx", "score").collect()
    assert got == sorted(map(tuple, want))
    assert len(ranks._states(spark, str(tmp_path))) == 2
    # a batch whose state wasn't finished doesn't count
    (tmp_path / "batch=9").mkdir()
    assert len(ranks._states(spark, str(tmp_path))) == 2


def test_ranks_follow_a_file_stream(spark, tmp_path):
    schema = "cid string, doc_id long, sent_idx long, score long"
    rows = [("ab"[i % 2], i, 0, i * 7 % 13) for i in range(60)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(ranks.merged_into(str(tmp_path / "out"), 5)).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    want = rank.top_k(spark.createDataFrame(rows, schema), 5, "cid", "doc_id", "sent_idx").collect()
    got = ranks.current(spark, str(tmp_path / "out")).select(*want[0].__fields__).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_centrality_equals_the_dense_solve(spark):
    rng = np.random.default_rng(5)
    nodes, edges, want = [], [], {}
    for cid, n, density in (("a", 40, 0.2), ("b", 25, 0.04), ("c", 1, 0), ("d", 3, 0), ("e", 30, 0.9)):
        sim = np.triu(rng.random((n, n)) * (rng.random((n, n)) < density), 1)
        restart = rng.integers(0, 5, n).astype(float) if cid != "d" else np.zeros(n)
        nodes += [(cid, i, float(x)) for i, x in enumerate(restart)]
        edges += [(cid, i, j, float(sim[i, j])) for i in range(n) for j in range(i + 1, n) if sim[i, j] > 0]
        want |= {(cid, i): x for i, x in enumerate(lexrank_scores(sim + sim.T, restart))}
    out = graph.lexrank(spark.createDataFrame(nodes, "cid string, i long, restart double"), spark.createDataFrame(edges, "cid string, i long, j long, sim double")).collect()
    got = {(r.cid, r.i): r.score for r in out}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
