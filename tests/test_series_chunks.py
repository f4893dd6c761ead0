"""Chunked series equal whole ones, at the edges of chunks and of series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import coupling, halo, series

CHUNKS = (17, 64, 1_000_000)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(t, s, i, rng.random() * 400 if rng.random() < 0.6 else 0.0) for t in (1, 2) for s in ("a", "b", "c") for i in range(150 if t == 1 else 9)]
    return spark.createDataFrame(data, "track long, stem string, frame_idx int, v double").repartition(5).cache()


def values(df, column):
    return {(r.track, r.stem, r.frame_idx): r[column] for r in df.collect()}


def by_series(rows):
    out: dict = {}
    for r in rows.orderBy("frame_idx").collect():
        out.setdefault((r.track, r.stem), []).append(r.v)
    return out


def mirror(x, i):
    return x[-i - 1] if i < 0 else x[2 * len(x) - 1 - i] if i >= len(x) else x[i]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_means_differences_and_totals(rows, chunk):
    means = values(halo.uniform_means(rows, 8, ("v",), chunk=chunk), "m_v")
    change = values(halo.before(rows, ("v",), chunk=chunk), "p_v")
    top = values(halo.over_series(rows, chunk=chunk, top=F.max("v")), "top")
    for (t, s), x in by_series(rows).items():
        for i in range(len(x)):
            assert math.isclose(means[t, s, i], sum(mirror(x, j) for j in range(i - 4, i + 4)) / 8, abs_tol=1e-9)
            assert change[t, s, i] == x[max(i - 1, 0)] and top[t, s, i] == max(x)
    assert len(means) == len(change) == len(top) == rows.count()


@pytest.mark.parametrize("chunk", CHUNKS)
def test_smoothing_of_several_channels(rows, chunk):
    wide = rows.filter("track = 1").withColumn("w", F.col("v") * 2)
    found = halo.gaussians(wide, {"s": ("v", 1.5), "l": ("w", 9.0)}, chunk=chunk)
    short, long = values(found, "s"), values(found, "l")
    for (t, s), x in by_series(wide).items():
        for got, sigma, scale in ((short, 1.5, 1), (long, 9.0, 2)):
            k = halo.kernel(sigma)
            r = len(k) // 2
            for i in range(len(x)):
                assert math.isclose(got[t, s, i], scale * sum(w * mirror(x, i + o - r) for o, w in enumerate(k)), abs_tol=1e-9)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_followers_warm_up_ahead_of_their_chunk(rows, chunk, monkeypatch):
    monkeypatch.setattr(series, "warmed", lambda df, warm: halo.warmed(df, warm, chunk))
    found = values(series.asymmetric_envelope(rows, 1.0, 3.0), "envelope")
    step = series.follow_step(1.0, 3.0)
    for (t, s), x in by_series(rows).items():
        state = (0.0,)
        for i, v in enumerate(x):
            state = step(state, v)
            assert math.isclose(found[t, s, i], state[0], rel_tol=1e-12, abs_tol=1e-12)


def test_every_pair_is_coupled(rows):
    wanted = {(1, a, b) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}
    df = rows.filter("track = 1")
    found = coupling.coupled(df, 24).cache()
    assert {(r.track, r.stem_a, r.stem_b) for r in found.select(*coupling.PAIR).distinct().collect()} == wanted and found.count() == 450
    for column, alone in (("local_corr", coupling.local_correlation(df, 24)), ("plv", coupling.phase_locking(df, 24)), ("sync", coupling.onset_sync(df)), ("response", coupling.call_response(df))):
        both = found.select(*coupling.PAIR, "frame_idx", F.col(column).alias("x")).join(alone, [*coupling.PAIR, "frame_idx"])
        assert both.count() == 450 and both.filter(F.abs(F.col("x") - F.col(column)) > 1e-9).count() == 0
    one = coupling.coupled(df, 24, (("c", "a"),))
    assert {(r.stem_a, r.stem_b) for r in one.select("stem_a", "stem_b").distinct().collect()} == {("a", "c")}


def test_a_stem_is_locked_to_itself(spark):
    x = [200 * (1 + math.sin(i / 5)) for i in range(120)]
    twins = spark.createDataFrame([(1, s, i, v) for s in ("a", "b") for i, v in enumerate(x)], "track long, stem string, frame_idx int, v double")
    rows = coupling.coupled(twins).collect()
    assert all(r.local_corr > 0.999 and r.plv > 0.999 and r.response < 1e-9 for r in rows)
    opposite = twins.withColumn("v", F.when(F.col("stem") == "b", 400 - F.col("v")).otherwise(F.col("v")))
    assert all(r.local_corr < -0.999 and r.plv > 0.9 for r in coupling.coupled(opposite).filter("frame_idx BETWEEN 40 AND 80").collect())
