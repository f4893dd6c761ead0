"""Hard negatives against all pairs in Python, the bounds, and blocks of anchors."""

import math
import random

import numpy as np
import pytest

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<float>, means string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, every=100):
    fit = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-hn.LIMIT, min(hn.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v]
        fit[i] = min(fit.get(i, (label, whole)), (label, whole))
    out = []
    for a in fit:
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(fit[a][1], fit[i][1])) for i in fit if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if fit[i][0] == fit[a][0]][:5]:
            fits = [i for i in ranked if fit[i][0] != fit[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(fits[:5])]
    return sorted(out)


def got(found):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect())


def clusters(seed, n, dims=64, labels=5, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    at = rng.integers(0, labels, n)
    v = centres[at] + rng.normal(scale=spread, size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, int(k), x) for i, k, x in zip(range(n), rng.integers(0, labels, n), v.astype(np.float32).tolist())]


@pytest.mark.parametrize("seed,dims", [(1, 64), (2, 7), (3, 1)])
def test_clustered_vectors(spark, seed, dims):
    rows = clusters(seed, 700, dims)
    want = brute(rows, 50)
    assert got(hn.mine_hard_negatives(frame(spark, rows).repartition(5), every=50)) == want and want


def test_blocks_of_anchors_change_nothing(spark):
    rows = clusters(4, 400)
    assert got(hn.mine_hard_negatives(frame(spark, rows), every=10, block=7)) == brute(rows, 10)


def test_ties_and_copies(spark):
    """Many equal vectors and scores: smaller ids come first."""
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), [float(rng.randrange(2)) for _ in range(4)]) for i in range(500)]
    assert got(hn.mine_hard_negatives(frame(spark, rows).repartition(6), every=25)) == brute(rows, 25)


def test_rows_that_take_no_part(spark):
    rows = clusters(6, 120, 8)
    rows += [(None, 1, [1.0] * 8), (200, None, [1.0] * 8), (300, 1, None), (400, 1, [1.0, None] * 4), (500, 1, [float("nan")] * 8), (600, 1, [float("-inf")] * 8)]
    rows += [rows[3], (5, 0, [0.5] * 8), (5, 0, [0.25] * 8), (700, 2, [0.5, 0.5]), (800, 2, []), (900, 1, [3e38] * 8), (1000, 2, [-3e38] * 8), (1001, 2, [3e38] * 8)]
    assert got(hn.mine_hard_negatives(frame(spark, rows))) == brute(rows)
    assert hn.mine_hard_negatives(frame(spark, rows).limit(0)).count() == 0
    assert hn.mine_hard_negatives(frame(spark, [(100, 1, [1.0])])).count() == 0


@pytest.mark.parametrize("dims", [1, 3, 5, 16, 64, 100])
def test_segment_bounds_hold(dims):
    rng = np.random.default_rng(dims)
    a, b = (np.floor(256 * rng.normal(size=(40, dims)) * rng.uniform(0, 2, (40, 1))) for _ in range(2))
    (ma, da), (mb, db) = hn.summaries(a), hn.summaries(b)
    at, scores = 0, a @ b.T
    width = []
    for parts in hn.LEVELS:
        sizes = np.diff(np.append(e := hn.edges(dims, parts), dims))
        s = slice(at, at + len(e))
        middle, spread = (ma[:, s] * sizes) @ mb[:, s].T, (da[:, s] * sizes) @ db[:, s].T
        assert (np.abs(scores - middle) <= spread + 1e-6 * np.abs(scores).max()).all()
        width.append(spread.mean())
        at += len(e)
    assert all(x >= y - 1e-9 for x, y in zip(width, width[1:]))


def test_bounds_spare_exact_scores():
    """Vectors whose components vary slowly are told apart by their segments."""
    rng = np.random.default_rng(8)
    steps = np.repeat(rng.normal(size=(2000, 16)), 4, axis=1) + rng.normal(scale=0.05, size=(2000, 64))
    vectors = np.floor(256 * steps)
    labels = rng.integers(0, 4, 2000)
    means, deviations = hn.summaries(vectors)
    import pyarrow as pa

    anchors = pa.table({"vec_id": np.arange(20), "label": labels[:20], "vector": list(vectors[:20].astype(np.int32)), "means": list(means[:20]), "deviations": list(deviations[:20])})
    search = hn.Search(hn.Block(anchors, 64, np.full((20, 1), hn.NONE + 1), np.full((20, 1), np.iinfo(np.int64).max), True, 5))
    for at in range(0, 2000, 100):
        part = slice(at, at + 100)
        search.add(np.arange(at, at + 100), labels[part], vectors[part], means[part], deviations[part])
    assert search.scored < 0.4 * search.seen
    best = {i: sorted((-int(vectors[i] @ vectors[j]), j) for j in range(2000) if j != i and labels[j] == labels[i])[:5] for i in range(20)}
    assert all([(-s, j) for s, j in zip(search.scores[i, 0].tolist(), search.ids[i, 0].tolist())] == best[i] for i in range(20))
