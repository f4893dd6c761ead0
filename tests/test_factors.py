"""Factors against a dense solver; embedders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.embedders import HashedTrigrams, Model, Precomputed
from tessera.operators import factors, search


def cells_of(spark, x):
    return spark.createDataFrame([(int(i), f"f{j:02}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "item long, feature string, x double").repartition(5)


def dense_loss(x, rank, rounds=3000, seed=0):
    """Best of three random starts of multiplicative updates on the whole matrix."""
    best = np.inf
    for s in range(seed, seed + 3):
        rng = np.random.default_rng(s)
        w, h = rng.random((x.shape[0], rank)), rng.random((rank, x.shape[1]))
        for _ in range(rounds):
            h *= w.T @ x / (w.T @ w @ h + 1e-12)
            w *= x @ h.T / (w @ h @ h.T + 1e-12)
        best = min(best, ((x - w @ h) ** 2).sum())
    return best


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    w, h = rng.random((80, 4)) * (rng.random((80, 4)) < 0.5), rng.random((4, 30)) * (rng.random((4, 30)) < 0.5)
    x = w @ h + 0.05 * rng.random((80, 30)) * (rng.random((80, 30)) < 0.3)
    return x * (x > 0.01)


def test_loss_is_near_that_of_a_dense_solver(spark, data):
    weights, features, losses = factors.factorise(cells_of(spark, data), rank=4, rounds=45, least_gain=1e-4)
    assert all(a >= b - 1e-9 for a, b in zip(losses, losses[1:]))
    w = np.array([r.w for r in weights.orderBy("item").collect()])
    h = np.zeros((4, 30))
    for r in features.collect():
        h[r.k, int(r.feature[1:])] = r.h
    assert (w >= 0).all() and (h >= 0).all()
    items = sorted(np.flatnonzero(data.any(axis=1)).tolist())
    loss = ((data[items] - w @ h) ** 2).sum()
    assert abs(loss - losses[-1]) < 1e-3 * loss + 1e-9
    assert losses[-1] <= 1.1 * dense_loss(data, 4), (losses[-1], dense_loss(data, 4))
    assert losses[-1] < 0.05 * (data**2).sum() and losses[0] < 0.3 * (data**2).sum()  # the start is no random one


def test_factor_table_numbers_factors_by_mean_weight(spark):
    weights = spark.createDataFrame([(1, [0.0, 2.0, 5.0]), (2, [1.0, 4.0, 5.0])], "item long, w array<double>")
    features = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.7), (1, "a", 1.0), (1, "b", 1e-9), (2, "c", 1e-9)], "k int, feature string, h double")
    found = [(r.factor, r.k, r.rn, r.feature, r.n_active) for r in factors.factor_table(weights, features).orderBy("factor", "rn").collect()]
    assert found == [(0, 1, 1, "a", 2), (1, 0, 1, "b", 1), (1, 0, 2, "a", 1)]


def test_odd_cells(spark):
    assert factors.factorise(spark.createDataFrame([], "item long, feature string, x double"))[2] == []
    odd = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "b", -3.0), (None, "a", 2.0), (3, None, 2.0), (4, "b", 2.0)], "item long, feature string, x double")
    weights, features, losses = factors.factorise(odd, rank=150, rounds=30)
    assert sorted(r.item for r in weights.collect()) == [1, 4] and losses[-1] < 1e-3
    assert {r.feature for r in features.collect()} == {"a", "b"}


def shelf(spark):
    rows = [("b", i, f"{c} {t}", "tools", "high", 1.0) for i, (c, t) in enumerate((c, t) for c in ("red", "blue", "green") for t in ("anvil", "bolt", "gear"))]
    return spark.createDataFrame(rows, "block string, id long, label string, category string, confidence string, mean_activation double")


def test_three_embedders_give_the_same_search(spark):
    from tests.toy_model import load

    rows, asked = shelf(spark), spark.createDataFrame([(0, "blue gear")], "query_id int, phrase string")
    texts = rows.select(F.col("label").alias("text")).union(asked.select("phrase"))
    model = Model(load)
    table = model.embed(texts, F.col("text"), "vector")
    by = {e.name: [(r.id, round(r.semantic, 6)) for r in search.hybrid(asked, rows, 5, embedder=e).orderBy("rn").collect()] for e in (model, Precomputed(table), HashedTrigrams(64))}
    assert by["model"] == by["precomputed"] and by["model"][0][0] == by["trigrams"][0][0] == 5


def test_an_embedder_without_a_vector_leaves_the_row_to_the_words(spark):
    none = Precomputed(spark.createDataFrame([("blue gear", [1.0, 0.0])], "text string, vector array<double>"))
    asked = spark.createDataFrame([(0, "blue gear")], "query_id int, phrase string")
    found = search.hybrid(asked, shelf(spark), 3, embedder=none).orderBy("rn").collect()
    assert found[0].id == 5 and found[0].semantic == 1.0 and {r.semantic for r in found[1:]} == {0.0}
    assert Model(lambda: None).embed(asked.limit(0), F.col("phrase"), "v").count() == 0
    empty = asked.withColumn("phrase", F.lit(None).cast("string"))
    assert HashedTrigrams(8).embed(empty, F.col("phrase"), "v").first().v is None
