"""Non-negative factorisation at size: items stay in Spark, the factor of the features goes to the tasks in a bounded block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.learn import matrix
from tessera.session import materialize

#: Factors, rounds at most, and the relative gain of a round's loss below which no other follows.
RANK, ROUNDS, LEAST_GAIN = 150, 500, 1e-4
#: Features that a task may hold for each factor; columns more than the rank, and power rounds, of the random projection of the start.
MOST_FEATURES, EXTRA, POWER = 200_000, 10, 2
#: Updates of an item's weights for each pass.
INNER = 10
EPS = 1e-12
SUMS = "part long, row int, sums array<double>"


def item_rows(cells: DataFrame, features: list) -> DataFrame:
    """(item, at, x): each item's features by their place in ``features`` and their values; repeated cells add up, negative ones count as zero."""
    places = cells.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], cells.select("feature", F.lit(0).alias("at")).schema)  # at most MOST_FEATURES rows
    known = cells.filter("item IS NOT NULL AND x > 0").join(F.broadcast(places), "feature").groupBy("item", "at").agg(F.sum(F.col("x").cast("double")).alias("x"))
    listed = known.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("c"))  # at most one entry a feature
    return listed.select("item", F.col("c.at").alias("at"), F.col("c.x").alias("x"))


def _dense(batch: pa.RecordBatch, n: int, rows: int = 512):
    """Blocks of (first row, matrix) of the sparse rows of a batch."""
    at, x = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "x"))
    for a in range(0, batch.num_rows, rows):
        part, values = at.slice(a, rows), x.slice(a, rows)
        sizes = np.diff(part.offsets.to_numpy())
        out = np.zeros((len(part), n))
        out[np.repeat(np.arange(len(part)), sizes), part.flatten().to_numpy()] = values.flatten().to_numpy()
        yield a, out


def _lists(matrix_: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix_.size + 1, matrix_.shape[1] or 1, dtype=np.int32)[: len(matrix_) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix_.ravel()))


def summed(rows: DataFrame, function, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Sums over all tasks of the matrices that ``function(batches)`` yields for one task, of these shapes.

    Only sums move: tasks give their rows, Spark adds them up entry by entry, and the driver gets one matrix of each shape.
    """

    def run(batches):
        for part, total in enumerate(function(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), _lists(total)], ["part", "row", "sums"])

    cells = rows.mapInArrow(run, SUMS).select("part", "row", F.posexplode("sums").alias("col", "v")).groupBy("part", "row", "col").agg(F.sum("v").alias("v"))
    found = cells.groupBy("part", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "v"))), lambda z: z["v"]).alias("v")).toArrow()
    out = [np.zeros(s) for s in shapes]
    for part, row, v in zip(*(found.column(c).to_pylist() for c in ("part", "row", "v"))):
        out[part][row] = v
    return out


def svd_start(rows: DataFrame, n: int, rank: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(map, singular values, V) of a randomised singular value decomposition: U is X times the map over the values, V has a row each.

    Passes over the items sum up X'X Q for a narrow Q, which the driver orthonormalises; X itself is never gathered.
    """
    width = min(rank + EXTRA, n)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    context = rows.sparkSession.sparkContext
    for _ in range(POWER + 1):
        sent = context.broadcast(q)

        def gather(batches, sent=sent):
            total = np.zeros((width, n))
            for batch in batches:
                for _, x in _dense(batch, n):
                    total += (x @ sent.value).T @ x
            yield total

        (product,) = summed(rows, gather, [(width, n)])
        basis, last = q, product.T
        q = np.linalg.qr(last)[0]
    small = basis.T @ last  # Q'X'XQ of the last narrow Q
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    right = basis @ vectors[:, order]
    return right, np.sqrt(np.maximum(values[order], 0.0)), right.T


def non_negative_parts(u: np.ndarray, s: np.ndarray, up: np.ndarray, un: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each singular pair the half of more weight: (scale of W, sign, H); ``up`` and ``un`` are the norms of the positive and negative part of each column of U."""
    vp, vn = np.maximum(v, 0), np.maximum(-v, 0)
    sizes_p, sizes_n = np.linalg.norm(vp, axis=1), np.linalg.norm(vn, axis=1)
    positive = up * sizes_p >= un * sizes_n
    weight = np.where(positive, up * sizes_p, un * sizes_n)
    norm_u, norm_v = np.where(positive, up, un), np.where(positive, sizes_p, sizes_n)
    scale = np.sqrt(s * weight)
    h = np.where(positive[:, None], vp, vn) * (scale / np.maximum(norm_v, EPS))[:, None]
    return scale / np.maximum(norm_u, EPS), np.where(positive, 1.0, -1.0), h


def updated(x: np.ndarray, w: np.ndarray, h: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """``w`` after INNER multiplicative updates with ``h`` fixed."""
    top = x @ h.T
    for _ in range(INNER):
        w = w * top / (w @ gram + EPS)
    return w


def factorise(cells: DataFrame, rank: int = RANK, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN) -> tuple[DataFrame, DataFrame, list[float]]:
    """(W(item, w), H(k, feature, h), losses) of cells(item, feature, x): non-negative, |X - WH|^2 falling from round to round.

    The start is the non-negative half of a randomised singular value decomposition.  In a round each task updates the weights of
    its items by the features' factor, which it gets whole (rank times at most MOST_FEATURES numbers, checked), and sums up W'X and W'W, from
    which the driver moves that factor on.  Items are never gathered; a round writes their weights once.  It ends after ``rounds``
    or when a round gains less than ``least_gain`` of the loss.  Absent cells are zeros; a table without positive cells has no factors.
    """
    spark = cells.sparkSession
    features = [r[0] for r in cells.filter("x > 0 AND feature IS NOT NULL").select("feature").distinct().orderBy("feature").limit(MOST_FEATURES + 1).collect()]
    if len(features) > MOST_FEATURES:
        raise ValueError(f"over {MOST_FEATURES} features; deal them into blocks")
    kinds = f"item {cells.schema['item'].dataType.simpleString()}, w array<double>", f"k int, feature {cells.schema['feature'].dataType.simpleString()}, h double"
    n = len(features)
    if not n:
        return spark.createDataFrame([], kinds[0]), spark.createDataFrame([], kinds[1]), []
    rows = materialize(item_rows(cells, features), "items")
    rank = min(rank, n, rows.count())
    to_u, s, v = svd_start(rows, n, rank)
    to_u = to_u / np.maximum(s, EPS)
    sent = spark.sparkContext.broadcast(to_u)

    def norms(batches):
        total = np.zeros((3, rank))
        for batch in batches:
            for _, x in _dense(batch, n):
                u = x @ sent.value
                total += [(np.maximum(u, 0) ** 2).sum(0), (np.maximum(-u, 0) ** 2).sum(0), np.full(rank, (x**2).sum())]
        yield total

    (sizes,) = summed(rows, norms, [(3, rank)])
    square = float(sizes[2, 0])
    scale, sign, h = non_negative_parts(to_u, s, np.sqrt(sizes[0]), np.sqrt(sizes[1]), v)
    mean = square**0.5 / max(1.0, (rows.count() * n) ** 0.5) * 1e-2
    h = np.maximum(h, mean)
    state = rows.withColumn("w", F.lit(None).cast("array<double>"))
    kind = f"item {cells.schema['item'].dataType.simpleString()}, at array<int>, x array<double>, w array<double>"
    losses: list[float] = []
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((h, h @ h.T))

        def step(batches, now=now):
            h_, gram = now.value
            for batch in batches:
                w = np.zeros((batch.num_rows, rank))
                old = batch.column(3)
                for a, x in _dense(batch, n):
                    part = old.slice(a, len(x))
                    start = np.maximum(x @ sent.value * sign, 0) * scale + mean if part.null_count else part.flatten().to_numpy().reshape(len(x), rank)
                    w[a : a + len(x)] = updated(x, start, h_, gram)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(w)], ["item", "at", "x", "w"])

        state = materialize(state.mapInArrow(step, kind), "weights")

        def sums(batches):
            wx, ww = np.zeros((rank, n)), np.zeros((rank, rank))
            for batch in batches:
                w = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, rank)
                for a, x in _dense(batch, n):
                    wx += w[a : a + len(x)].T @ x
                ww += w.T @ w
            yield wx
            yield ww

        wx, ww = summed(state, sums, [(rank, n), (rank, rank)])
        for _ in range(INNER):
            h = h * wx / (ww @ h + EPS)
        losses.append(max(0.0, square - 2 * float((wx * h).sum()) + float((ww @ h * h).sum())))
        if len(losses) > 1 and losses[-2] - losses[-1] < least_gain * losses[-2]:
            break
    entries = [(k, features[i], float(h[k, i])) for k in range(rank) for i in np.flatnonzero(h[k] >= 1e-12).tolist()]
    return state.select("item", "w"), spark.createDataFrame(entries, kinds[1]), losses


def factor_table(weights: DataFrame, features: DataFrame, top: int = 10, least: float = 1e-6) -> DataFrame:
    """(factor, k, mean_w, max_w, n_active, rn, feature, h): the ``top`` features of each factor, factors numbered by falling mean weight.

    Weights of features under ``least`` do not count; factors without features are left out.
    """
    each = weights.select(F.posexplode("w").alias("k", "w"))
    stats = each.groupBy("k").agg(F.avg("w").alias("mean_w"), F.max("w").alias("max_w"), F.count_if(F.col("w") > least).alias("n_active"))
    order = Window.partitionBy("k").orderBy(F.desc("h"), "feature")
    best = features.filter(F.col("h") >= least).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top)
    used = stats.hint("merge").join(best.select("k").distinct(), "k")
    numbered = used.withColumn("factor", F.row_number().over(Window.orderBy(F.desc("mean_w"), "k")) - 1)  # a row for each factor
    return numbered.hint("merge").join(best, "k").select("factor", "k", "mean_w", "max_w", "n_active", "rn", "feature", "h")


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, features, _ = factorise(materialize(matrix(spark, sf_dir), "cells"), rounds=8)
    return factor_table(weights, features)


QUERIES = {"ml_nmf_factors": _factors}
#: Random starts and rounds of updates have no SQL form; tests hold the loss against a dense solver.
ORACLE_SQL: dict[str, str] = {}
