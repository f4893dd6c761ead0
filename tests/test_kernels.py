"""Operators that SQL does not express, against plain loops."""

import math

import numpy as np
import pytest

from tessera.operators import learn, series
from tessera.session import checkpoint_root, materialize
from tessera.streaming import telemetry


def curve(spark, values, track=1, stem="view"):
    return spark.createDataFrame([(track, stem, i, float(v)) for i, v in enumerate(values)], "track long, stem string, frame_idx int, v double")


def test_debounce_is_greedy(spark):
    at = [0, 1, 4, 5, 9, 12, 13]
    rows = spark.createDataFrame([(1, "view", i, 1.0) for i in at], "track long, stem string, frame_idx int, v double")
    kept = sorted(r.frame_idx for r in series.debounce(rows, 4).collect())
    want = []
    for x in at:
        if not want or x - want[-1] >= 4:
            want.append(x)
    assert kept == want


def test_envelope_is_a_one_pole_follower(spark):
    values = [0, 5, 5, 1, 0, 8, 2, 2]
    got = [r.envelope for r in series.asymmetric_envelope(curve(spark, values)).orderBy("frame_idx").collect()]
    y, want = 0.0, []
    for v in values:
        y += (1 - math.exp(-1 / (2.0 if v > y else 12.0))) * (v - y)
        want.append(y)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n", [3, 4])
def test_uniform_mean_reflects_edges(spark, n):
    values = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0]
    padded = values[n // 2 - 1 :: -1] + values + values[: -n // 2 - 1 : -1]
    want = [np.mean(padded[i : i + n]) for i in range(len(values))]
    got = [r.smooth for r in series.uniform_mean(curve(spark, values).selectExpr("*"), n).orderBy("frame_idx").collect()]
    assert got == pytest.approx(want)


def test_factorisation_lowers_the_loss(spark):
    rng = np.random.default_rng(1)
    x = rng.random((12, 2)) @ rng.random((2, 9))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(9)], "item long, feature int, x double")

    def loss(rounds):
        w, h = learn.nmf(cells, 3, rounds)
        wm, hm = np.zeros((12, 3)), np.zeros((3, 9))
        for r in w.collect():
            wm[r.item, r.k] = r.w
        for r in h.collect():
            hm[r.k, r.feature] = r.h
        assert (wm >= 0).all() and (hm >= 0).all()
        return ((x - wm @ hm) ** 2).sum()

    first, later = loss(1), loss(4)
    assert later < first < (x**2).sum()


def test_triggers_follow_the_rules_in_order():
    state, fired = (-1000, -1, ""), []
    for hour, eligible in ((2, True), (17, True), (18, True), (26, False), (30, True), (41, True), (57, True), (60, True), (72, True)):
        state = telemetry.trigger_step(state, hour, eligible)
        if state[2]:
            fired.append((hour, state[2]))
    assert fired == [(2, "stable_interval"), (17, "stable_interval"), (30, "section_change"), (57, "section_change"), (72, "section_change")]
    assert telemetry.trigger_step((-5, -1, ""), 18, True) == (18, 0, "section_near")


def test_materialized_rows_stand_in_the_checkpoint_folder(spark):
    df = materialize(spark.range(5).selectExpr("id AS x"), "probe")
    assert sorted(r.x for r in df.collect()) == list(range(5))
    assert df.inputFiles()[0].replace("file://", "").startswith(checkpoint_root(spark).replace("file:", "").replace("//", "/"))
