"""Ridge regression, batch inference and remembered features against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.operators import infer, learn
from lexisift.plans import learned
from lexisift.plans.learned import linear_ranker


@pytest.mark.parametrize("parts, penalty", [(1, 0.0), (7, 1.0), (40, 25.0)])
def test_ridge_equals_a_plain_solve(spark, parts, penalty):
    rng = np.random.default_rng(parts)
    x = rng.normal(size=(500, 5)) * [1, 10, 0.01, 3, 0] + [0, 5, 1, -2, 4]
    y = x @ [0.5, -0.2, 30, 0, 9] + rng.normal(size=500)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0, None)], "a double, b double, c double, d double, e double, y double").repartition(parts)
    model = learn.fit_ridge(df, list("abcde"), "y", penalty)
    z, sd = x[:, :4] - x[:, :4].mean(0), x[:, :4].std(0)
    z /= sd
    w = np.linalg.solve(z.T @ z + penalty * np.eye(4), z.T @ (y - y.mean())) / sd
    assert [model.weights[k] for k in "abcd"] == pytest.approx(w.tolist(), rel=1e-6) and model.weights["e"] == 0
    assert model.intercept == pytest.approx(y.mean() - w @ x[:, :4].mean(0))
    got = learn.held_out(df.na.drop(), "y", model.column()).first()
    p = x[:, :4] @ w + model.intercept
    assert (got.n, got.rmse, got.pearson) == (500, pytest.approx(np.sqrt(np.mean((y - p) ** 2)), abs=1e-5), pytest.approx(np.corrcoef(y, p)[0, 1], abs=1e-5))
    assert learn.fit_ridge(df.limit(0), ["a", "b"], "y") == learn.Ridge({"a": 0.0, "b": 0.0}, 0.0)


def test_batches_hold_like_lengths():
    rng = np.random.default_rng(1)
    for most in (1, 50, 10_000):
        sizes = rng.integers(0, 60, 300)
        found = list(infer.length_batches(sizes, most))
        assert sorted(np.concatenate(found).tolist()) == list(range(300))
        assert all(len(b) == 1 or len(b) * max(1, sizes[b].max()) <= most for b in found)
        assert [sizes[b].max() for b in found] == sorted(sizes[b].max() for b in found)
    assert not list(infer.length_batches(np.zeros(0, int)))


@pytest.mark.parametrize("most", [1, 200, 10**6])
def test_scores_equal_row_by_row(spark, most):
    rng = random.Random(most)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) if i % 11 else None, rng.choice(["a b", "c", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "i long, sent string, query string")
    model = linear_ranker()()
    want = {i: model([[s], [q]])[0] for i, s, q in rows}
    for order in (df.repartition(3), df.orderBy(F.desc("i")).coalesce(2)):
        got = infer.scored(order, ["sent", "query"], linear_ranker(), most)
        assert got.columns == ["i", "sent", "query", "score"] and {r.i: r.score for r in got.collect()} == pytest.approx(want)


def test_a_worker_loads_a_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import tempfile

        os.close(tempfile.mkstemp(dir=folder, prefix=f"{os.getpid()}-")[0])
        return lambda columns: [1.0] * len(columns[0])

    df = spark.range(4000).repartition(40).withColumn("t", F.col("id").cast("string"))
    assert infer.scored(df, ["t"], load).agg(F.sum("score")).first()[0] == 4000
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids)) <= 8


def test_only_what_is_new_is_computed(spark, tmp_path):
    path, done = str(tmp_path / "memo"), spark.sparkContext.accumulator(0)

    def compute(rows):
        def run(batches):
            for b in batches:
                done.add(b.num_rows)
                yield b.append_column("n", infer.pa.array([len(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()], infer.pa.int64()))

        return rows.mapInArrow(run, "_digest string, text string, n long")

    def ask(rows, settings="a", steps=1):
        before = done.value
        df = spark.createDataFrame(rows, "id long, text string")
        got = {(r.id, r.text): r.n for r in infer.remembered(df, ["text"], settings, path, compute, steps).collect()}
        assert got == {(i, t): len(t or "") for i, t in rows}
        return done.value - before

    rows = [(i, "x" * (i % 7)) for i in range(50)] + [(99, None)]
    assert ask(rows) == 8  # equal texts once; null isn't empty
    assert ask(rows) == 0 and ask(rows, steps=3) == 0
    assert ask([*rows, (100, "new")]) == 1 and ask([(0, "other"), *rows[1:]]) == 1
    assert ask(rows, settings="b", steps=4) == 8
    assert ask([]) == 0


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    path, seen = str(tmp_path / "memo"), []

    def compute(rows):
        seen.append(1)
        if len(seen) == 4:  # the first call is for the schema
            raise RuntimeError("lost")
        return rows.withColumn("n", F.length("text"))

    df = spark.createDataFrame([(i, str(i)) for i in range(100)], "id long, text string")
    with pytest.raises(RuntimeError):
        infer.remembered(df, ["text"], "s", path, compute, steps=5)
    kept = spark.read.parquet(path).count()
    assert 0 < kept < 100
    again = []
    out = infer.remembered(df, ["text"], "s", path, lambda rows: (again.append(rows), rows.withColumn("n", F.length("text")))[1], steps=5)
    assert out.count() == 100 and spark.read.parquet(path).count() == 100


def test_what_is_fitted_is_made_once(spark):
    found = learned.ridge_label_rows(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Generate" not in plan  # neither sentences nor their labels are made again after the fit
