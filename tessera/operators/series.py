"""Frame series: grids, normalisation, smoothing, differences, as-of and interval joins, profiles."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.halo import uniform_means, warmed
from tessera.session import table

SERIES = ("track", "stem")
#: Events per second of a frame, for tempo; a frame is an hour of the table.
FPS = 60
#: Mean event value from which a frame is an onset, and from which a purchase begins a section.
BEAT, LOUD = 100, 200
#: Event value of full scale.
SCALE = 500.0


def _series(order: str = "frame_idx"):
    return Window.partitionBy(*SERIES).orderBy(order)


def _whole():
    return Window.partitionBy(*SERIES)


def hours(events: DataFrame) -> DataFrame:
    """(h0, n): the first hour of a table of events and the number of hours up to its last; one row."""
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return events.agg(F.min(hour).alias("h0"), (F.max(hour) - F.min(hour) + 1).cast("int").alias("n"))


def framed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with track (the user modulo ten), stem (the event type) and frame_idx (hours since the first)."""
    events = table(spark, sf_dir, "events")
    frame = (F.floor(F.unix_timestamp("ts") / 3600) - F.col("h0")).cast("int")
    return events.crossJoin(F.broadcast(hours(events))).select((F.col("user_id") % 10).alias("track"), F.col("event_type").alias("stem"), frame.alias("frame_idx"), "value")


def observed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, stem, frame_idx, v): mean event value of each hour that has events."""
    return framed_events(spark, sf_dir).groupBy(*SERIES, "frame_idx").agg(F.avg("value").alias("v"))


def full_grid(seen: DataFrame, n: DataFrame) -> DataFrame:
    """A row for each series of ``seen`` and each of the n hours of the table."""
    return seen.select(*SERIES).distinct().crossJoin(F.broadcast(n.select("n"))).select(*SERIES, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_idx"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the grid of all hours from the table's first to its last, silent frames zero."""
    seen = observed_frames(spark, sf_dir)
    grid = full_grid(seen, hours(table(spark, sf_dir, "events")))
    return grid.hint("merge").join(seen, [*SERIES, "frame_idx"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def percentile_norm(df: DataFrame) -> DataFrame:
    """(v - p5) / (p95 - p5) clipped to [0, 1]; zero where the range is 1e-8 or less."""
    bounds = df.groupBy(*SERIES).agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    width = F.col("q")[1] - F.col("q")[0]
    value = F.when(width <= 1e-8, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("q")[0]) / width)))
    return df.hint("merge").join(bounds, list(SERIES)).select(*SERIES, "frame_idx", value.alias("norm"))


def uniform_mean(df: DataFrame, n: int, value: str = "v") -> DataFrame:
    """Centred mean of n samples with reflected edges; an even n reaches n/2 back and n/2 - 1 on."""
    return uniform_means(df, n, (value,)).withColumnRenamed(f"m_{value}", "smooth")


def stem_pairs(df: DataFrame) -> DataFrame:
    """Frame-aligned values of all unordered pairs of the few stems of a track."""
    a, b = df.alias("a"), df.alias("b")
    return a.hint("merge").join(b, (F.col("a.track") == F.col("b.track")) & (F.col("a.frame_idx") == F.col("b.frame_idx")) & (F.col("a.stem") < F.col("b.stem"))).select(
        F.col("a.track").alias("track"), F.col("a.stem").alias("stem_a"), F.col("b.stem").alias("stem_b"), F.col("a.frame_idx").alias("frame_idx"), F.col("a.v").alias("va"), F.col("b.v").alias("vb")
    )


def linear_at(probes: DataFrame, curve: DataFrame) -> DataFrame:
    """Value of ``curve``(track, stem, t, v) at each probe (track, stem, t), linear between samples and flat beyond them.

    Probes and samples are united and each probe looks back and ahead once: one sort
    of the series, no range join.
    """
    both = curve.select(*SERIES, "t", F.col("v"), F.struct(F.col("t").alias("t"), F.col("v").alias("v")).alias("s"), F.lit(0).alias("kind")).unionByName(
        probes.select(*SERIES, "t", F.lit(None).cast("double").alias("v"), F.lit(None).cast("struct<t:double,v:double>").alias("s"), F.lit(1).alias("kind"))
    )
    w = Window.partitionBy(*SERIES).orderBy("t", "kind")
    back = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("p", back).withColumn("q", ahead).filter("kind = 1")
    value = (
        F.when(F.col("p").isNull(), F.col("q.v")).when(F.col("q").isNull() | (F.col("q.t") == F.col("p.t")), F.col("p.v"))
        .otherwise(F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("q.t") - F.col("p.t")))
    )
    return found.select(*SERIES, "t", value.alias("value"))


def _probes(spark: SparkSession, sf_dir: str, step: float) -> DataFrame:
    """Times every ``step`` frames from zero to the end of the table, for each series."""
    grid = observed_frames(spark, sf_dir).select(*SERIES).distinct().crossJoin(F.broadcast(hours(table(spark, sf_dir, "events")).select("n")))
    last = F.floor((F.col("n") - 1) / F.lit(step)).cast("int")
    return grid.select(*SERIES, F.explode(F.sequence(F.lit(0), last)).alias("i")).select(*SERIES, (F.col("i") * F.lit(step)).alias("t"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_frames(spark, sf_dir).select(*SERIES, F.col("frame_idx").cast("double").alias("t"), "v")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each track: one starts at zero and at each purchase frame over LOUD, and ends at the next or with the series."""
    all_frames = frames(spark, sf_dir)
    ends = all_frames.groupBy("track").agg((F.max("frame_idx") + 1).alias("n"))
    loud = all_frames.filter(f"stem = 'purchase' AND v > {LOUD}").select("track", "frame_idx").union(ends.select("track", F.lit(0))).distinct()
    w = Window.partitionBy("track").orderBy("frame_idx")
    return loud.hint("merge").join(ends, "track").select("track", F.col("frame_idx").alias("start"), F.coalesce(F.lead("frame_idx").over(w), F.col("n")).alias("stop"), (F.row_number().over(w) - 1).alias("section"))


def section_of(df: DataFrame, sections: DataFrame) -> DataFrame:
    """(track, stem, frame_idx, at, section, to_next) of each frame: the last section start at or before it, carried forward."""
    rows = df.select(*SERIES, "frame_idx", F.lit(None).cast("struct<at:int,section:int,stop:int>").alias("s"), F.lit(1).alias("kind"))
    mark = F.struct(F.col("start").cast("int").alias("at"), F.col("section").cast("int").alias("section"), F.col("stop").cast("int").alias("stop"))
    marks = df.select(*SERIES).distinct().hint("merge").join(sections, "track").select(*SERIES, F.col("start").alias("frame_idx"), mark.alias("s"), F.lit(0).alias("kind"))
    w = Window.partitionBy(*SERIES).orderBy("frame_idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.unionByName(marks).withColumn("s", F.last("s", ignorenulls=True).over(w)).filter("kind = 1")
    return placed.select(*SERIES, "frame_idx", "s.at", "s.section", (F.col("s.stop") - F.col("frame_idx")).alias("to_next"))


def surprise_decay(df: DataFrame, rate: float = 0.33) -> DataFrame:
    """Jumps to larger boosts and linear decay to zero: running max of (boost + rate t) less rate t."""
    t = F.col("frame_idx") * F.lit(rate)
    top = F.max(F.col("v") / SCALE + t).over(_series().rowsBetween(Window.unboundedPreceding, 0))
    return df.select(*SERIES, "frame_idx", F.greatest(F.lit(0.0), top - t).alias("surprise"))


def peaks(df: DataFrame, before: int = 3, after: int = 3, reach: int = 10, delta: float = 50.0) -> DataFrame:
    """Candidates: the maximum of [-before, after) and ``delta`` over the mean of [-reach, reach]."""
    w = _series()
    return (
        df.withColumn("top", F.max("v").over(w.rowsBetween(-before, after - 1))).withColumn("mean", F.avg("v").over(w.rowsBetween(-reach, reach)))
        .filter((F.col("v") == F.col("top")) & (F.col("v") >= F.col("mean") + delta)).select(*SERIES, "frame_idx", "v")
    )


def folded(df: DataFrame, step: Callable[..., tuple], start: tuple, inputs: tuple[str, ...], name: str, kind: str = "double", warm: int | None = None) -> DataFrame:
    """A fold over the ordered frames of each series: one value of ``name`` a frame.

    ``step`` takes the state and the ``inputs`` of a frame and returns the next state, whose
    first entry is the value.  Where what a state keeps of one ``warm`` frames ago is below rounding, give
    that number: then each chunk of a series is folded on its own, from ``start`` that many frames
    ahead of it.  Otherwise a series goes through one task in one pass, frame by frame.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*SERIES).schema.fields) + f", frame_idx int, {name} {kind}"
    arrow = pa.float64() if kind == "double" else pa.int32()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        state, out = start, []
        for values in zip(*(rows.column(c).to_pylist() for c in inputs)):
            state = step(state, *values)
            out.append(state[0])
        return pa.table([*(rows.column(c) for c in (*SERIES, "frame_idx")), pa.array(out, arrow)], names=[*SERIES, "frame_idx", name])

    rows = df.select(*SERIES, F.col("frame_idx").cast("int").alias("frame_idx"), *inputs)
    if warm is None:
        return rows.groupBy(*SERIES).applyInArrow(run, schema)
    spread = warmed(rows, warm)
    return spread.groupBy(*SERIES, "chunk").applyInArrow(lambda part: run(part).filter(part.sort_by("frame_idx").column("own")), schema)


def debounce(candidates: DataFrame, spacing: int = 4) -> DataFrame:
    """Greedy spacing: a candidate stays if it comes ``spacing`` frames or more after the last one that stayed."""

    def step(state: tuple, at: int) -> tuple:
        keep = at - state[1] >= spacing
        return int(keep), at if keep else state[1]

    return folded(candidates.withColumn("at", F.col("frame_idx")), step, (0, -spacing), ("at",), "keep", "int").filter("keep = 1").select(*SERIES, "frame_idx")


def settled(constant: float) -> int:
    """Frames after which a follower of this time constant has forgotten its state to 1e-15."""
    return math.ceil(35 * constant)


def follow_step(attack: float, release: float) -> Callable[[tuple, float], tuple]:
    """One step of a one-pole follower with a time constant for rise and one for fall, in frames."""
    up, down = 1 - math.exp(-1 / attack), 1 - math.exp(-1 / release)
    return lambda state, x: (state[0] + (up if x > state[0] else down) * (x - state[0]),)


def asymmetric_envelope(df: DataFrame, attack: float = 2.0, release: float = 12.0, value: str = "v") -> DataFrame:
    """One-pole follower with separate attack and release, from zero."""
    return folded(df, follow_step(attack, release), (0.0,), (value,), "envelope", warm=settled(max(attack, release)))


def target_profile(df: DataFrame) -> DataFrame:
    """Percentiles, score, range, share of active frames and density of onsets of each series."""
    q = df.groupBy(*SERIES).agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("sd"), F.count_if(F.col("v") > 0).alias("n_onsets"), F.count("*").alias("n"))
    active = df.hint("merge").join(q.select(*SERIES, F.greatest(F.lit(0.08), F.col("q")[1] + 0.1 * F.col("sd")).alias("bar")), list(SERIES)).groupBy(*SERIES).agg(F.avg((F.col("v") > F.col("bar")).cast("double")).alias("active_ratio"))
    return q.hint("merge").join(active, list(SERIES)).select(
        *SERIES, F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "mean_v", (F.col("q")[2] - F.col("q")[0]).alias("dynamic_range"),
        (0.5 * F.col("mean_v") + 0.5 * F.col("q")[2]).alias("score"), "active_ratio", (F.col("n_onsets") / F.col("n")).alias("onset_density"),
    )


def correlations(df: DataFrame, least: float = 0.0, k: int = 3) -> DataFrame:
    """The k partners of each stem with the largest absolute correlation."""
    pairs = stem_pairs(df).groupBy("track", "stem_a", "stem_b").agg(F.coalesce(F.corr("va", "vb"), F.lit(0.0)).alias("r"))
    both = pairs.unionByName(pairs.select("track", F.col("stem_b").alias("stem_a"), F.col("stem_a").alias("stem_b"), "r"))
    w = Window.partitionBy("track", "stem_a").orderBy(F.desc(F.round(F.abs("r"), 9)), "stem_b")
    return both.filter(F.abs("r") >= least).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("track", "stem_a", "stem_b", "r", "rn")


def intervals(df: DataFrame) -> DataFrame:
    """Beats of each series: frames with a value over BEAT, each open until the next; energy is the value over SCALE."""
    w = _series("start")
    beats = df.filter(f"v > {BEAT}").select(*SERIES, F.col("frame_idx").alias("start"), (F.col("v") / SCALE).alias("energy"))
    return beats.withColumn("stop", F.lead("start").over(w)).withColumn("before", F.coalesce(F.sum("energy").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def in_beats(df: DataFrame) -> DataFrame:
    """Each frame with the beat b that it lies in, the last one open; null before the first."""
    marks = intervals(df).select(*SERIES, F.col("start").alias("frame_idx"), F.struct("start", "stop", "energy", "before").alias("b"))
    w = _series().rowsBetween(Window.unboundedPreceding, 0)
    return df.hint("merge").join(marks, [*SERIES, "frame_idx"], "left").withColumn("b", F.last("b", ignorenulls=True).over(w))


def ease(x: Column) -> Column:
    """Cubic easing in and out of a share of an interval."""
    back = 2 - 2 * x
    return F.when(x < 0.5, 4 * x * x * x).otherwise(1 - back * back * back / 2)


def beat_ease(df: DataFrame) -> DataFrame:
    """Angle of each frame: a turn for the energy of each past beat and the eased share of the current one; held after the last."""
    turn = 2 * math.pi
    x = (F.col("frame_idx") - F.col("b.start")) / (F.col("b.stop") - F.col("b.start"))
    share = F.when(F.col("b.stop").isNull(), 0.0).otherwise(ease(x))
    angle = F.coalesce(turn * (F.col("b.before") + F.col("b.energy") * share), F.lit(0.0))
    return in_beats(df).select(*SERIES, "frame_idx", angle.alias("angle"))


def band_stats(df: DataFrame, sections: DataFrame, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Mean, maximum and change of each value in each section of a series' track, both ends of the section included.

    Frames carry their section; the first frame of one is the last of the one before.  A
    section without frames has the value that lies on a line at its middle and no change.
    """
    inside = section_of(df, sections).hint("merge").join(df, [*SERIES, "frame_idx"])
    own = F.array(F.struct("section"), F.struct((F.col("section") - 1).alias("section")))
    inside = inside.withColumn("s", F.explode(F.when(F.col("frame_idx") == F.col("at"), own).otherwise(F.slice(own, 1, 1)))).drop("section").withColumn("section", F.col("s.section")).filter("section >= 0")
    stats = [x for v in values for x in (F.avg(v).alias(f"mean_{v}"), F.max(v).alias(f"max_{v}"), (F.max_by(v, "frame_idx") - F.min_by(v, "frame_idx")).alias(f"delta_{v}"))]
    return inside.groupBy(*SERIES, "section").agg(*stats)


def windowed(curve: DataFrame, sections: DataFrame) -> DataFrame:
    """``band_stats`` of sparse curves (track, stem, t, v) for every section, empty ones by interpolation at their middle."""
    frames_ = curve.select(*SERIES, F.col("t").cast("int").alias("frame_idx"), "v")
    found = band_stats(frames_, sections)
    every = curve.select(*SERIES).distinct().hint("merge").join(sections, "track").withColumn("t", (F.col("start") + F.col("stop")) * 0.5)
    middle = linear_at(every.select(*SERIES, "t").distinct(), curve)
    joined = every.hint("merge").join(found, [*SERIES, "section"], "left").hint("merge").join(middle, [*SERIES, "t"], "left")
    return joined.select(*SERIES, "section", F.coalesce("mean_v", "value").alias("mean_v"), F.coalesce("max_v", "value").alias("max_v"), F.coalesce("delta_v", F.lit(0.0)).alias("delta"))


def cross_stem_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the stems of a track of their curves, drawn as lines on the grid of all frames and clipped to [0, 1]."""
    grid = frames(spark, sf_dir).select(*SERIES, F.col("frame_idx").cast("double").alias("t"))
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / SCALE))
    return linear_at(grid, _curve(spark, sf_dir)).groupBy("track", F.col("t").cast("int").alias("frame_idx")).agg(F.avg(level).alias("mean_v"))


def arc(curve: DataFrame, points: int = 10, dead: float = 0.05) -> DataFrame:
    """Up to ``points`` evenly spaced values of each curve, clipped to [0, 1], with the trend since the one before and a dead band."""
    ends = curve.groupBy(*SERIES).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.least(F.count("*"), F.lit(points)).cast("int").alias("k"))
    at = F.when(F.col("k") == 1, F.col("lo")).otherwise(F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (F.col("k") - 1))
    probes = ends.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select(*SERIES, at.alias("t"))
    level = linear_at(probes, curve).withColumn("level", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / SCALE)))
    step = F.col("level") - F.lag("level").over(_series("t"))
    return level.select(*SERIES, "t", "level", F.when(step > dead, "rising").when(step < -dead, "falling").otherwise("stable").alias("trend"))


def recent_upcoming(df: DataFrame, reach: int = 12, back: int = 4, dead: float = 0.05) -> DataFrame:
    """Mean, least and largest level over the frames before and after each frame, and the trend over the last ``back`` of them."""
    w = _series()
    x = df.withColumn("x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / SCALE)))
    cols = {}
    for name, span in (("recent", w.rangeBetween(-reach, 0)), ("upcoming", w.rangeBetween(0, reach))):
        cols |= {f"{name}_mean": F.avg("x").over(span), f"{name}_min": F.min("x").over(span), f"{name}_max": F.max("x").over(span)}
    step = F.col("x") - F.first("x").over(w.rangeBetween(-back, 0))
    return x.withColumns(cols).withColumn("trend", F.when(step > dead, "rising").when(step < -dead, "falling").otherwise("stable")).drop("v", "x")


def tempo(df: DataFrame, fallback: float = 120.0) -> DataFrame:
    """60 over the median gap of beats in seconds; ``fallback`` for fewer than two beats or a tempo outside 40 to 220."""
    gaps = intervals(df).groupBy(*SERIES).agg((F.median(F.col("stop") - F.col("start")) / FPS).alias("gap"), F.count("*").alias("n_beats"))
    found = 60.0 / F.col("gap")
    return gaps.select(*SERIES, "n_beats", F.when((F.col("n_beats") >= 2) & found.between(40.0, 220.0), found).otherwise(fallback).alias("tempo"))


QUERIES = {
    "win_percentile_norm": lambda s, d: percentile_norm(frames(s, d)),
    "win_max_norm": lambda s, d: frames(s, d).withColumn("top", F.max("v").over(_whole())).select(*SERIES, "frame_idx", F.when(F.col("top") > 1e-8, F.col("v") / F.col("top")).otherwise(0.0).alias("norm")),
    "win_energy_db": lambda s, d: frames(s, d).withColumn("top", F.max("v").over(_whole())).select(*SERIES, "frame_idx", F.when(F.col("v") > 0, F.greatest(F.lit(-40.0), 20 * F.log10(F.col("v") / F.col("top")))).otherwise(-40.0).alias("db")),
    "win_abs_delta": lambda s, d: frames(s, d).select(*SERIES, "frame_idx", F.coalesce(F.abs(F.col("v") - F.lag("v").over(_series())), F.lit(0.0)).alias("delta")),
    "win_mean_uniform": lambda s, d: uniform_mean(frames(s, d), 6).select(*SERIES, "frame_idx", "smooth"),
    "win_peak_pick": lambda s, d: peaks(frames(s, d)),
    "win_debounce": lambda s, d: debounce(peaks(frames(s, d))),
    "win_asym_envelope": lambda s, d: asymmetric_envelope(frames(s, d)),
    "win_surprise_decay": lambda s, d: surprise_decay(frames(s, d)),
    "win_trend": lambda s, d: arc(_curve(s, d)),
    "win_recent_upcoming": lambda s, d: recent_upcoming(frames(s, d)),
    "win_beat_ease": lambda s, d: beat_ease(frames(s, d)),
    "win_resample_grid": lambda s, d: linear_at(_probes(s, d, 2.25), _curve(s, d)),
    "join_asof_linear": lambda s, d: linear_at(_probes(s, d, 10.5), _curve(s, d)),
    "join_asof_section": lambda s, d: section_of(frames(s, d), boundaries(s, d)).drop("at"),
    "join_interval_beats": lambda s, d: in_beats(frames(s, d)).filter("b IS NOT NULL").select(*SERIES, "frame_idx", "b.start", "b.stop", "b.energy"),
    "join_pairs_upper": lambda s, d: stem_pairs(observed_frames(s, d)),
    "join_band_window": lambda s, d: windowed(_curve(s, d), boundaries(s, d)),
    "set_boundaries": boundaries,
    "agg_cross_stem_mean": cross_stem_mean,
    "agg_energy_ratio": lambda s, d: frames(s, d).groupBy("track").agg(F.sqrt(F.avg(F.when(F.col("stem") == "purchase", F.col("v") * F.col("v")))).alias("p"), F.sqrt(F.avg(F.when(F.col("stem") == "view", F.col("v") * F.col("v")))).alias("h")).select("track", F.when(F.col("p") + F.col("h") > 0, F.col("p") / (F.col("p") + F.col("h"))).otherwise(0.5).alias("ratio")),
    "agg_tempo": lambda s, d: tempo(frames(s, d)),
}

_FRAMES = """span AS (SELECT h0, (h1 - h0 + 1)::INTEGER AS n FROM (SELECT min(floor(epoch(ts) / 3600))::BIGINT AS h0, max(floor(epoch(ts) / 3600))::BIGINT AS h1 FROM events)),
seen AS (SELECT track, stem, frame_idx, avg(value) AS v FROM (
  SELECT user_id % 10 AS track, event_type AS stem, (floor(epoch(ts) / 3600) - h0)::INTEGER AS frame_idx, value FROM events, span) GROUP BY ALL),
frames AS (
  SELECT track, stem, frame_idx, coalesce(v, 0.0) AS v FROM (SELECT track, stem, unnest(range(0, n))::INTEGER AS frame_idx FROM (SELECT DISTINCT track, stem FROM seen), span)
  LEFT JOIN seen USING (track, stem, frame_idx))"""
#: The number of frames of a series, in SQL.
N = "(SELECT n FROM span)"
_W = "(PARTITION BY track, stem ORDER BY frame_idx"


def _uniform(source: str, n: int, value: str, keys: str, name: str) -> str:
    half = n // 2
    return f"""{name} AS (
  SELECT {keys}, frame_idx, v_orig, smooth FROM (
    SELECT *, avg(x) OVER (PARTITION BY {keys} ORDER BY place ROWS BETWEEN {half} PRECEDING AND {n - half - 1} FOLLOWING) AS smooth FROM (
      SELECT {keys}, frame_idx, {value} AS x, {value} AS v_orig, frame_idx AS place FROM {source}
      UNION ALL SELECT {keys}, frame_idx, {value}, NULL, -frame_idx - 1 FROM {source} WHERE frame_idx < {half}
      UNION ALL SELECT {keys}, frame_idx, {value}, NULL, 2 * {N} - 1 - frame_idx FROM {source} WHERE frame_idx >= {N} - {half}))
  WHERE v_orig IS NOT NULL)"""


_SECTIONS = f"""starts AS (SELECT track, frame_idx AS start FROM frames WHERE stem = 'purchase' AND v > {LOUD} UNION SELECT track, 0 FROM frames),
sections AS (SELECT track, start, coalesce(lead(start) OVER w, {N})::INTEGER AS stop, (row_number() OVER w - 1)::INTEGER AS section FROM starts WINDOW w AS (PARTITION BY track ORDER BY start)),
placed AS (SELECT f.*, s.section, s.stop - f.frame_idx AS to_next FROM frames f JOIN sections s ON f.track = s.track AND f.frame_idx >= s.start AND f.frame_idx < s.stop),
bands AS (SELECT f.track, f.stem, s.section, avg(v) AS mean_v, max(v) AS max_v, arg_max(v, frame_idx) - arg_min(v, frame_idx) AS delta FROM frames f JOIN sections s ON f.track = s.track AND f.frame_idx BETWEEN s.start AND s.stop GROUP BY ALL)"""
_BEATS = f"""beats AS (
  SELECT track, stem, start, energy, lead(start) OVER w AS stop, coalesce(sum(energy) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT track, stem, frame_idx AS start, v / {SCALE}::DOUBLE AS energy FROM frames WHERE v > {BEAT}) WINDOW w AS (PARTITION BY track, stem ORDER BY start))"""


def _lines(probes: str, name: str = "lines") -> str:
    """Value of the observed curves at probes(track, stem, t), linear between samples and flat beyond them."""
    return f"""{name}_lo AS (SELECT p.track, p.stem, p.t, c.frame_idx::DOUBLE AS t0, c.v AS v0 FROM {probes} p ASOF LEFT JOIN seen c ON p.track = c.track AND p.stem = c.stem AND p.t >= c.frame_idx),
{name}_hi AS (SELECT p.*, c.frame_idx::DOUBLE AS t1, c.v AS v1 FROM {name}_lo p ASOF LEFT JOIN seen c ON p.track = c.track AND p.stem = c.stem AND p.t <= c.frame_idx),
{name} AS (SELECT track, stem, t, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS value FROM {name}_hi)"""


def _linear(step: float) -> str:
    return f"""WITH {_FRAMES}, probes AS (SELECT track, stem, i * {step}::DOUBLE AS t FROM (SELECT track, stem, unnest(range(0, floor((n - 1) / {step})::BIGINT + 1)) AS i FROM (SELECT DISTINCT track, stem FROM seen), span)),
{_lines('probes')} SELECT * FROM lines"""


def _fold_sql(source: str, state: dict[str, tuple[str, str]], name: str, keys: str = "track, stem") -> str:
    """A fold over the rows of ``source`` by frame_idx as a recursive query.

    ``state`` has for each column its start and its step, in which s is the state before and x the row.
    """
    on = " AND ".join(f"x.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    first = ", ".join(f"{start} AS {c}" for c, (start, _) in state.items())
    later = ", ".join(f"{step} AS {c}" for c, (_, step) in state.items())
    return f"""{name}_rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY frame_idx) AS i FROM {source}),
{name} AS (SELECT {keys}, -1 AS frame_idx, 0::BIGINT AS i, {first} FROM (SELECT DISTINCT {keys} FROM {source})
  UNION ALL SELECT {', '.join('x.' + k.strip() for k in keys.split(','))}, x.frame_idx, x.i, {later} FROM {name} s JOIN {name}_rows x ON {on} AND x.i = s.i + 1)"""


def _debounce_sql(source: str, spacing: int, name: str) -> str:
    """Rows of ``name`` with keep = 1 are the candidates that stay."""
    keep = f"(x.frame_idx - s.at >= {spacing})"
    return _fold_sql(source, {"keep": ("0", f"{keep}::INTEGER"), "at": (f"-{spacing}", f"CASE WHEN {keep} THEN x.frame_idx ELSE s.at END")}, name)


def _envelope_sql(source: str, attack: float, release: float, name: str, value: str = "v", keys: str = "track, stem") -> str:
    up, down = 1 - math.exp(-1 / attack), 1 - math.exp(-1 / release)
    return _fold_sql(source, {"y": ("0.0::DOUBLE", f"s.y + CASE WHEN x.{value} > s.y THEN {up!r}::DOUBLE ELSE {down!r}::DOUBLE END * (x.{value} - s.y)")}, name, keys)


_PEAKS = f"""peaks AS (SELECT track, stem, frame_idx, v FROM (
  SELECT *, max(v) OVER {_W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS top, avg(v) OVER {_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS mean FROM frames)
WHERE v = top AND v >= mean + 50)"""
_ARC = f"""ends AS (SELECT track, stem, min(frame_idx) AS lo, max(frame_idx) AS hi, least(count(*), 10) AS k FROM seen GROUP BY ALL),
probes AS (SELECT track, stem, CASE WHEN k = 1 THEN lo::DOUBLE ELSE lo + i * (hi - lo)::DOUBLE / (k - 1) END AS t FROM (SELECT *, unnest(range(0, k)) AS i FROM ends)),
{_lines('probes')}, level AS (SELECT track, stem, t, greatest(0.0, least(1.0, value / {SCALE})) AS level FROM lines)"""
_LEVEL = f"level AS (SELECT track, stem, frame_idx, greatest(0.0, least(1.0, v / {SCALE})) AS x FROM frames)"
_EASE = "CASE WHEN x < 0.5 THEN 4 * x * x * x ELSE 1 - (2 - 2 * x) * (2 - 2 * x) * (2 - 2 * x) / 2 END"

ORACLE_SQL = {
    "win_percentile_norm": f"""WITH {_FRAMES}, q AS (SELECT track, stem, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM frames GROUP BY ALL)
SELECT track, stem, frame_idx, CASE WHEN hi - lo <= 1e-8 THEN 0.0 ELSE greatest(0.0, least(1.0, (v - lo) / (hi - lo))) END AS norm FROM frames JOIN q USING (track, stem)""",
    "win_max_norm": f"WITH {_FRAMES} SELECT track, stem, frame_idx, CASE WHEN top > 1e-8 THEN v / top ELSE 0.0 END AS norm FROM (SELECT *, max(v) OVER (PARTITION BY track, stem) AS top FROM frames)",
    "win_energy_db": f"WITH {_FRAMES} SELECT track, stem, frame_idx, CASE WHEN v > 0 THEN greatest(-40.0, 20 * log10(v / top)) ELSE -40.0 END AS db FROM (SELECT *, max(v) OVER (PARTITION BY track, stem) AS top FROM frames)",
    "win_abs_delta": f"WITH {_FRAMES} SELECT track, stem, frame_idx, coalesce(abs(v - lag(v) OVER {_W})), 0.0) AS delta FROM frames",
    "win_mean_uniform": f"WITH {_FRAMES}, {_uniform('frames', 6, 'v', 'track, stem', 'u')} SELECT track, stem, frame_idx, smooth FROM u",
    "win_peak_pick": f"WITH {_FRAMES}, {_PEAKS} SELECT * FROM peaks",
    "win_debounce": f"WITH RECURSIVE {_FRAMES}, {_PEAKS}, {_debounce_sql('peaks', 4, 'kept')} SELECT track, stem, frame_idx FROM kept WHERE keep = 1",
    "win_asym_envelope": f"WITH RECURSIVE {_FRAMES}, {_envelope_sql('frames', 2.0, 12.0, 'env')} SELECT track, stem, frame_idx, y AS envelope FROM env WHERE i > 0",
    "win_surprise_decay": f"WITH {_FRAMES} SELECT track, stem, frame_idx, greatest(0.0, max(v / 500.0 + frame_idx * 0.33::DOUBLE) OVER {_W} ROWS UNBOUNDED PRECEDING) - frame_idx * 0.33::DOUBLE) AS surprise FROM frames",
    "win_trend": f"""WITH {_FRAMES}, {_ARC} SELECT track, stem, t, level, CASE WHEN step > 0.05 THEN 'rising' WHEN step < -0.05 THEN 'falling' ELSE 'stable' END AS trend
FROM (SELECT *, level - lag(level) OVER (PARTITION BY track, stem ORDER BY t) AS step FROM level)""",
    "win_recent_upcoming": f"""WITH {_FRAMES}, {_LEVEL} SELECT track, stem, frame_idx, recent_mean, recent_min, recent_max, upcoming_mean, upcoming_min, upcoming_max,
  CASE WHEN x - past > 0.05 THEN 'rising' WHEN x - past < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM (
  SELECT *, avg(x) OVER r AS recent_mean, min(x) OVER r AS recent_min, max(x) OVER r AS recent_max, avg(x) OVER u AS upcoming_mean, min(x) OVER u AS upcoming_min, max(x) OVER u AS upcoming_max,
    first(x) OVER {_W} RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS past
  FROM level WINDOW r AS {_W} RANGE BETWEEN 12 PRECEDING AND CURRENT ROW), u AS {_W} RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING))""",
    "win_beat_ease": f"""WITH {_FRAMES}, {_BEATS}, held AS (SELECT f.track, f.stem, f.frame_idx, b.* EXCLUDE (track, stem) FROM frames f ASOF LEFT JOIN beats b ON f.track = b.track AND f.stem = b.stem AND f.frame_idx >= b.start),
x AS (SELECT *, (frame_idx - start) / (stop - start)::DOUBLE AS x FROM held)
SELECT track, stem, frame_idx, coalesce(2 * pi() * (before + energy * CASE WHEN stop IS NULL THEN 0.0 ELSE {_EASE} END), 0.0) AS angle FROM x""",
    "win_resample_grid": _linear(2.25),
    "join_asof_linear": _linear(10.5),
    "join_asof_section": f"WITH {_FRAMES}, {_SECTIONS} SELECT track, stem, frame_idx, section, to_next FROM placed",
    "join_interval_beats": f"WITH {_FRAMES}, {_BEATS} SELECT f.track, f.stem, f.frame_idx, b.start, b.stop, b.energy FROM frames f ASOF JOIN beats b ON f.track = b.track AND f.stem = b.stem AND f.frame_idx >= b.start",
    "join_pairs_upper": f"WITH {_FRAMES} SELECT a.track, a.stem AS stem_a, b.stem AS stem_b, a.frame_idx, a.v AS va, b.v AS vb FROM seen a JOIN seen b ON a.track = b.track AND a.frame_idx = b.frame_idx AND a.stem < b.stem",
    "join_band_window": f"""WITH {_FRAMES}, {_SECTIONS}, w AS (SELECT DISTINCT x.track, x.stem, s.start, s.stop, s.section, (s.start + s.stop) * 0.5::DOUBLE AS t FROM seen x JOIN sections s ON x.track = s.track),
{_lines('w')}, b AS (SELECT f.track, f.stem, s.section, avg(v) AS m, max(v) AS h, arg_max(v, frame_idx) - arg_min(v, frame_idx) AS d FROM seen f JOIN sections s ON f.track = s.track AND f.frame_idx BETWEEN s.start AND s.stop GROUP BY ALL)
SELECT DISTINCT w.track, w.stem, w.section, coalesce(m, value) AS mean_v, coalesce(h, value) AS max_v, coalesce(d, 0.0) AS delta FROM w LEFT JOIN b ON w.track = b.track AND w.stem = b.stem AND w.section = b.section JOIN lines l ON w.track = l.track AND w.stem = l.stem AND w.t = l.t""",
    "set_boundaries": f"WITH {_FRAMES}, {_SECTIONS} SELECT * FROM sections",
    "agg_cross_stem_mean": f"""WITH {_FRAMES}, probes AS (SELECT track, stem, frame_idx::DOUBLE AS t FROM frames), {_lines('probes')}
SELECT track, t::INTEGER AS frame_idx, avg(greatest(0.0, least(1.0, value / {SCALE}))) AS mean_v FROM lines GROUP BY ALL""",
    "agg_energy_ratio": f"""WITH {_FRAMES} SELECT track, CASE WHEN p + h > 0 THEN p / (p + h) ELSE 0.5 END AS ratio FROM (
  SELECT track, sqrt(avg(v * v) FILTER (stem = 'purchase')) AS p, sqrt(avg(v * v) FILTER (stem = 'view')) AS h FROM frames GROUP BY track)""",
    "agg_tempo": f"""WITH {_FRAMES}, {_BEATS}, g AS (SELECT track, stem, count(*) AS n_beats, median(stop - start) / {FPS}::DOUBLE AS gap FROM beats GROUP BY ALL)
SELECT track, stem, n_beats, CASE WHEN n_beats >= 2 AND 60.0 / gap BETWEEN 40 AND 220 THEN 60.0::DOUBLE / gap ELSE 120.0::DOUBLE END AS tempo FROM g""",
}
