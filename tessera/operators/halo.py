"""Long series in chunks with overlap: windows, smoothing and followers of a series run in many tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("track", "stem")
#: Frames of a chunk.
CHUNK = 4096
AUX = ("size", "home", "place", "chunk", "own")


def over_series(df: DataFrame, keys: tuple[str, ...] = SERIES, chunk: int = CHUNK, **totals: Column) -> DataFrame:
    """``df`` with totals of each series beside each of its frames; the totals meet the frames chunk by chunk."""
    home = F.floor(F.col("frame_idx") / chunk)
    known = df.groupBy(*keys).agg(F.max(home).alias("_last"), *[c.alias(n) for n, c in totals.items()])
    spread = known.withColumn("_home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    return df.withColumn("_home", home).hint("merge").join(spread, [*keys, "_home"]).drop("_home")


def haloed(df: DataFrame, reach: int, keys: tuple[str, ...] = SERIES, chunk: int = CHUNK) -> DataFrame:
    """Frames of gapless series from 0, each in its chunk and in those whose frames are within ``reach`` of it.

    Adds chunk, place (the frame, or beyond an edge the place of its mirror image) and own (whether the row is the
    frame itself in its own chunk), so that windows by ``keys`` and chunk, ordered by place and of ``reach`` rows
    either way, are whole for own rows.
    """
    rows = over_series(df, keys, chunk, size=F.count("*"))
    at, size, place = F.col("frame_idx"), F.col("size"), F.col("place")
    places = F.array_compact(F.array(at.cast("long"), F.when(at < reach, -at.cast("long") - 1), F.when(at >= size - reach, 2 * size - 1 - at)))
    first, last = F.floor(F.greatest(place - reach, F.lit(0)) / chunk), F.floor(F.least(place + reach, size - 1) / chunk)
    spread = rows.withColumn("place", F.explode(places)).withColumn("chunk", F.explode(F.sequence(F.least(first, last), last)))
    return spread.withColumn("own", (place == at) & (F.col("chunk") == F.floor(at / chunk))).drop("size")


def _bare(df: DataFrame) -> DataFrame:
    return df.filter("own").drop("own", "place", "chunk")


def before(df: DataFrame, values: tuple[str, ...], keys: tuple[str, ...] = SERIES, chunk: int = CHUNK) -> DataFrame:
    """``df`` with p_x, the value x of the frame before; of the first frame its own."""
    w = Window.partitionBy(*keys, "chunk").orderBy("place")
    return _bare(haloed(df, 1, keys, chunk).withColumns({f"p_{v}": F.lag(v).over(w) for v in values}))


def uniform_means(df: DataFrame, n: int, values: tuple[str, ...], keys: tuple[str, ...] = SERIES, chunk: int = CHUNK) -> DataFrame:
    """``df`` with m_x, the centred mean of n samples of each value x with mirrored edges, in one pass; an even n reaches n/2 back."""
    half = n // 2
    w = Window.partitionBy(*keys, "chunk").orderBy("place").rowsBetween(-half, n - half - 1)
    return _bare(haloed(df, half, keys, chunk).withColumns({f"m_{v}": F.avg(v).over(w) for v in values}))


def kernel(sigma: float) -> list[float]:
    """Normalised Gaussian weights cut at four sigma."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussians(df: DataFrame, channels: dict[str, tuple[str, float]], keys: tuple[str, ...] = SERIES, chunk: int = CHUNK) -> DataFrame:
    """``df`` with a smoothed column for each (value, sigma) of ``channels``, all in one pass over chunks; edges are mirrored."""
    weights = {name: np.array(kernel(sigma)) for name, (_, sigma) in channels.items()}
    spread = haloed(df, max(len(w) // 2 for w in weights.values()), keys, chunk)
    columns = [c for c in spread.columns if c not in ("own", "place", "chunk")]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        own = rows.column("own").to_numpy()
        out = rows.select(columns).filter(rows.column("own"))
        for name, (value, _) in channels.items():
            r = len(weights[name]) // 2
            x = np.pad(rows.column(value).to_numpy().astype(float), r)
            out = out.append_column(name, pa.array(np.convolve(x, weights[name], "valid")[own]))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.select(*columns).schema.fields)
    return spread.groupBy(*keys, "chunk").applyInArrow(run, schema + "".join(f", `{n}` double" for n in channels))


def warmed(df: DataFrame, warm: int, chunk: int = CHUNK) -> DataFrame:
    """Frames in their chunk and, for ``warm`` frames ahead of one, in the next: chunk, own."""
    home = F.floor(F.col("frame_idx") / chunk)
    last = F.floor((F.col("frame_idx") + warm) / chunk)
    return df.withColumn("chunk", F.explode(F.sequence(home, last))).withColumn("own", F.col("chunk") == home)
