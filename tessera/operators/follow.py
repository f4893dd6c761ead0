"""Followers, pitch and beat weights of frame series, clusters of vectors, and whole-track records."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.graph import connected_components
from tessera.operators.coupling import _LOCK, lock_index
from tessera.operators.profile import _CHANGE, _K, _PROMINENCE, _STARTS, _smooth_sql, gaussian, prominence, sections
from tessera.operators.search import dot, unit
from tessera.operators.series import (
    _BEATS, _EASE, _FRAMES, N, SCALE, SERIES, _envelope_sql, _fold_sql, _lines, _series, asymmetric_envelope, beat_ease, folded, frames, linear_at, observed_frames, tempo,
)
from tessera.operators.signals import _CHARACTER, _RANKS, _SIG, _STEMS, _WIDE, overall_character, ranked_drivers, stem_frames, stem_profiles, target_profiles, target_signals
from tessera.operators.spectra import clamp
from tessera.session import materialize, table

#: Seconds of a frame for followers.
DT = 0.016
#: Order in which a track's reference axis is looked for.
AXIS_ORDER = ("purchase", "view", "click", "signup", "error")
#: Slots: name, target, its stem (null where it has none), least and largest strength, intensity curve, gamma, whether enabled.
SLOTS = (("s0", "purchase", "purchase", -30.0, 30.0, "linear", 1.0, True), ("s1", "click_percussive", "click", 0.0, 40.0, "gamma", 2.2, True), ("s2", "global", None, -10.0, 20.0, "clip", 1.0, True), ("s3", "view", "view", 0.0, 10.0, "linear", 1.0, False))


def alpha(dt: float, ms: float) -> float:
    """Share of the way that a follower with a time constant of ``ms`` goes in ``dt`` seconds; all of it without one."""
    return 1.0 if ms <= 0 else 1.0 - math.exp(-dt / (ms / 1000.0))


def ema_follow(df: DataFrame, dt: float = DT, smoothing_ms: float = 50.0, drift_ms: float = 1500.0, drift: bool = True) -> DataFrame:
    """Place that follows the sounding frames from 0.5; in silence it drifts back to 0.5, or holds."""
    near, far = alpha(dt, smoothing_ms), alpha(dt, drift_ms) if drift else 0.0

    def step(state: tuple, v: float) -> tuple:
        return (state[0] + (near * (v / SCALE - state[0]) if v > 0 else far * (0.5 - state[0])),)

    return folded(df, step, (0.5,), ("v",), "place")


def slew_limit(df: DataFrame, rate: float = 2.0, dt: float = DT) -> DataFrame:
    """Place that follows the level by at most ``rate`` a second; a rate of 0 or less follows at once."""
    most = rate * dt

    def step(state: tuple, v: float) -> tuple:
        gap = v / SCALE - state[0]
        return (v / SCALE if rate <= 0 else state[0] + max(-most, min(most, gap)),)

    return folded(df, step, (0.0,), ("v",), "place")


def dual_layer(df: DataFrame) -> DataFrame:
    """A quick and a slow envelope of each series and their mean."""
    flash = asymmetric_envelope(df, 1.0, 4.0).withColumnRenamed("envelope", "flash")
    sustain = asymmetric_envelope(df, 6.0, 24.0).withColumnRenamed("envelope", "sustain")
    return flash.hint("merge").join(sustain, [*SERIES, "frame_idx"]).withColumn("combined", (F.col("flash") + F.col("sustain")) / 2)


def voiced_norm(wide: DataFrame, threshold: float = 0.5) -> DataFrame:
    """p5 to p95 over the frames that sound with confidence; fewer than ten give zero, a range under ten the least - 20 to the largest + 20."""
    sure = (F.col("v") > 0) & (F.col("pitch_confidence") >= threshold)
    q = wide.filter(sure).groupBy(*SERIES).agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    narrow = F.col("q")[1] - F.col("q")[0] < 10
    lo = F.when(narrow, F.col("lo") - 20).otherwise(F.col("q")[0])
    hi = F.when(narrow, F.col("hi") + 20).otherwise(F.col("q")[1])
    value = F.when((F.col("n") >= 10) & sure, clamp((F.col("v") - lo) / (hi - lo))).otherwise(0.0)
    return wide.hint("merge").join(q, list(SERIES), "left").select(*SERIES, "frame_idx", value.alias("pitch"))


def align_pad(df: DataFrame, n: int) -> DataFrame:
    """Each series cut, or carried on from its last value, to n frames."""
    grid = df.select(*SERIES).distinct().select(*SERIES, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("frame_idx"))
    w = _series().rowsBetween(Window.unboundedPreceding, 0)
    return grid.hint("merge").join(df, [*SERIES, "frame_idx"], "left").withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(w), F.lit(0.0)))


def beat_weight(wide: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Transient over energy, from its 5th to its 95th percentile (0.5 where it is flat), smoothed."""
    ratio = wide.select(*SERIES, "frame_idx", (F.col("transient") / F.greatest("energy_smooth", F.lit(0.05))).alias("ratio"))
    q = ratio.groupBy(*SERIES).agg(F.percentile("ratio", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    width = F.col("q")[1] - F.col("q")[0]
    scaled = ratio.hint("merge").join(q, list(SERIES)).select(*SERIES, "frame_idx", F.when(width > 1e-6, clamp((F.col("ratio") - F.col("q")[0]) / width)).otherwise(0.5).alias("ratio"))
    return gaussian(scaled, sigma, "ratio", "weight").select(*SERIES, "frame_idx", "weight")


def blend_curve(df: DataFrame, wide: DataFrame, distance: float = 1.5) -> DataFrame:
    """Angles by mode: pulse (the beats'), continuous (the drift of tonal distance) and auto (blended by the beat weight)."""
    pulse, drift = F.col("angle"), F.col("tonal_distance") * (math.pi / 2)
    auto = F.col("weight") * pulse + (1 - F.col("weight")) * drift
    rows = beat_ease(df).hint("merge").join(beat_weight(wide), [*SERIES, "frame_idx"]).hint("merge").join(wide.select(*SERIES, "frame_idx", "tonal_distance"), [*SERIES, "frame_idx"])
    return rows.select(*SERIES, "frame_idx", (distance * pulse).alias("pulse"), (distance * drift).alias("continuous"), (distance * auto).alias("auto"))


#: Hash tables, hyperplanes of a table's cell, neighbours compared on each side, and how near a core's third neighbour must be.
TABLES, PLANES, SIDE = 6, 3, 8
MIN_SAMPLES, MIN_SIZE, RADIUS = 3, 5, 0.75


def _signs(i: int, dims: int = 64) -> list[float]:
    """A fixed direction of plus and minus ones from the MD5 of its number and place."""
    return [1.0 if hashlib.md5(f"{i}|{k}".encode()).digest()[0] & 1 else -1.0 for k in range(dims)]


def _plane(i: int) -> Column:
    return F.array(*[F.lit(x) for x in _signs(i)])


def neighbours(vectors: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, distance) of near vectors: in each table a cell is ordered along one more direction and each row meets the SIDE before it.

    Every vector stands in every table, so that a row has SIDE neighbours on each side of
    it in each; no cell is paired in full.  Distance is one less the cosine.
    """
    rows = materialize(vectors.select("vec_id", unit(F.col("embedding")).alias("v")), "units")
    cells = []
    for t in range(TABLES):
        planes = [_plane(t * (PLANES + 1) + i) for i in range(PLANES + 1)]
        code = sum((F.when(dot(F.col("v"), p) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes[:-1])), F.lit(0))
        cells.append(F.struct(F.lit(t).alias("t"), code.alias("cell"), dot(F.col("v"), planes[-1]).alias("at")))
    keyed = rows.select("vec_id", F.explode(F.array(*cells)).alias("c")).select("vec_id", "c.*")
    order = Window.partitionBy("t", "cell").orderBy("at", "vec_id")
    near = F.array_compact(F.array(*[F.lag("vec_id", k).over(order) for k in range(1, SIDE + 1)]))
    pairs = materialize(keyed.select("vec_id", near.alias("near")).select(F.explode("near").alias("x"), F.col("vec_id").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    left, right = rows.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), rows.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", (1 - dot(F.col("va"), F.col("vb"))).alias("distance"))


def density_clusters(vectors: DataFrame, radius: float = RADIUS, least: int = MIN_SIZE) -> DataFrame:
    """(vec_id, label, cluster): density clusters over a neighbour graph; cluster is its least vec_id, -1 is noise.

    A row's core distance is that to its MIN_SAMPLES-th neighbour.  Rows link where neither
    core distance nor their own is over ``radius``; linked rows are one cluster if they are ``least`` or more.
    """
    near = materialize(neighbours(vectors), "neighbours")
    both = near.select(F.col("a").alias("x"), "distance").unionByName(near.select(F.col("b").alias("x"), "distance"))
    nth = F.row_number().over(Window.partitionBy("x").orderBy("distance"))
    core = materialize(both.withColumn("rn", nth).filter(F.col("rn") == MIN_SAMPLES).select("x", F.col("distance").alias("core")), "cores")
    linked = near.hint("merge").join(core.select(F.col("x").alias("a"), F.col("core").alias("ca")), "a").hint("merge").join(core.select(F.col("x").alias("b"), F.col("core").alias("cb")), "b")
    roots = connected_components(linked.filter(F.greatest("ca", "cb", "distance") <= radius).select("a", "b"))
    rooted = vectors.select("vec_id", "label").hint("merge").join(roots.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id"))
    size = F.count("*").over(Window.partitionBy("root"))
    return rooted.withColumn("n", size).select("vec_id", "label", F.when(F.col("n") >= least, F.col("root")).otherwise(-1).alias("cluster"))


def cluster_sizes(clusters: DataFrame, k: int = 5) -> DataFrame:
    """The k largest clusters with the number of all clusters and the share of noise."""
    sums = clusters.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.avg((F.col("cluster") < 0).cast("double")).alias("noise_share"))
    top = clusters.filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(k)
    return top.crossJoin(F.broadcast(sums))


def cohesion(clusters: DataFrame) -> DataFrame:
    """For each label: its rows in clusters, how many clusters they lie in, and the share in the one that holds most."""
    by = clusters.filter("cluster >= 0").groupBy("label", "cluster").agg(F.count("*").alias("n"))
    return by.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("n_clusters"), (F.max("n") / F.sum("n")).alias("together"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return density_clusters(table(s, d, "embeddings"))


#: Points of the arcs of a track, and the change between the means of its first and last third that makes it rise or fall.
ARC_POINTS, ARC_CHANGE = 10, 0.02
#: Added before rounding, so that halves go up whatever the last bit.
TIE = 1e-9


def arcs(curve: DataFrame, n: DataFrame, value: str, name: str) -> DataFrame:
    """(track, name): means of ``value``(track, frame_idx) over ARC_POINTS equal parts of each track of n_frames frames, to six places, in order."""
    part = F.floor(F.col("frame_idx") * ARC_POINTS / F.col("n_frames")).cast("int")
    means = curve.hint("merge").join(n, "track").groupBy("track", part.alias("part")).agg(F.round(F.avg(value) + TIE, 6).alias("mean"))
    return means.groupBy("track").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "mean"))), lambda z: z["mean"]).alias(name))  # ARC_POINTS numbers


def trend(arc: Column) -> Column:
    """rising, falling or stable: the mean of an arc's last three points against that of its first three."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 3
    change = mean(F.slice(arc, -3, 3)) - mean(F.slice(arc, 1, 3))
    return F.when(change > ARC_CHANGE, "rising").when(change < -ARC_CHANGE, "falling").otherwise("stable")


def coupling_map(df: DataFrame) -> DataFrame:
    """(track, mean_lock, coupling, strongest_pair): mean lock over all pairs of stems, that of each pair in thousandths as a=b:n, and the pair of the largest."""
    pairs = lock_index(df).groupBy("track", "stem_a", "stem_b").agg(F.avg("lock").alias("lock"), F.count("*").alias("n"))
    pairs = pairs.select("track", F.concat_ws("=", "stem_a", "stem_b").alias("pair"), "lock", "n", F.round(F.round("lock", 6) * 1000).cast("int").alias("share"))
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pair", "share"))), lambda z: F.concat_ws(":", z["pair"], z["share"])), ",")  # a row for each pair of the few stems
    return pairs.groupBy("track").agg((F.sum(F.col("lock") * F.col("n")) / F.sum("n")).alias("mean_lock"), shown.alias("coupling"), F.min_by("pair", F.struct(-F.col("share"), "pair")).alias("strongest_pair"))


def track_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each track: length, tempo, character, stems, sections, coupling of all pairs of stems, mean tension, arcs of energy and tension with their trends, first driver."""
    df, wide, signals = materialize(frames(spark, sf_dir), "frames"), stem_frames(spark, sf_dir), materialize(target_signals(spark, sf_dir), "signals")
    out = overall_character(stem_profiles(wide)).select("track", "character")
    n = materialize(df.groupBy("track").agg((F.max("frame_idx") + 1).alias("n_frames")), "lengths")
    parts = (
        n,
        df.groupBy("track").agg(F.array_join(F.array_sort(F.collect_set("stem")), ",").alias("stems")),  # the few stems
        arcs(df.withColumn("level", F.col("v") / SCALE), n, "level", "energy_arc"),
        arcs(signals.filter("target = 'tension'"), n, "energy_smooth", "tension_arc"),
        tempo(df).filter("stem = 'purchase'").select("track", F.col("tempo").alias("bpm")),
        sections(df).groupBy("track").agg(F.count("*").alias("n_sections")),
        coupling_map(df),
        signals.filter("target = 'tension'").groupBy("track").agg(F.avg("energy_smooth").alias("mean_tension")),
        ranked_drivers(target_profiles(signals)).filter("kind = 'primary_driver' AND rn = 1").select("track", F.col("target").alias("driver")),
    )
    for part in parts:
        out = out.hint("merge").join(part, "track", "left")
    return out.withColumns({"energy_trend": trend(F.col("energy_arc")), "tension_trend": trend(F.col("tension_arc"))})


def shaped(x: Column, curve: Column, gamma: Column) -> Column:
    """Intensity curve of a level: linear, a power, or half as much again, held in [0, 1]."""
    return F.when(curve == "gamma", F.pow(clamp(x), F.greatest(F.lit(0.01), gamma))).when(curve == "clip", clamp(1.5 * x)).otherwise(clamp(x))


def slot_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of each enabled slot: its target's level by the slot's curve, followed, put in the slot's range and scaled by prominence (0.5 without a stem)."""
    slots = spark.createDataFrame(SLOTS, "slot string, target string, base string, lo double, hi double, curve string, gamma double, enabled boolean").filter("enabled")  # a handful of rows
    signals = target_signals(spark, sf_dir).select("track", "target", "frame_idx", "energy_smooth")
    rows = signals.join(F.broadcast(slots), "target").withColumn("x", shaped(F.col("energy_smooth"), F.col("curve"), F.col("gamma"))).withColumnRenamed("slot", "stem")
    rows = materialize(rows, "slots")
    step = alpha(DT, 50.0)
    moved = folded(rows, lambda state, x: (state[0] + step * (x - state[0]),), (0.0,), ("x",), "moved")
    loud = prominence(stem_frames(spark, sf_dir)).withColumnRenamed("stem", "base")
    joined = rows.hint("merge").join(moved, [*SERIES, "frame_idx"]).hint("merge").join(loud, ["track", "base", "frame_idx"], "left")
    strength = (F.col("lo") + F.col("moved") * (F.col("hi") - F.col("lo"))) * F.when(F.col("base").isNull(), 0.5).otherwise(F.col("prominence"))
    return joined.select("track", F.col("stem").alias("slot"), "frame_idx", strength.alias("strength"))


def _refer(s, d):
    """All curves of a track on the frames of the first of its stems in AXIS_ORDER."""
    curve = observed_frames(s, d).select(*SERIES, F.col("frame_idx").cast("double").alias("t"), "v")
    place = F.array_position(F.array(*map(F.lit, AXIS_ORDER)), F.col("stem"))
    first = curve.groupBy("track").agg(F.min_by("stem", F.struct(F.when(place > 0, place).otherwise(len(AXIS_ORDER) + 1), "stem")).alias("first"))
    axis = curve.hint("merge").join(first, "track").filter("stem = first").select("track", "t")
    probes = axis.hint("merge").join(curve.select(*SERIES).distinct(), "track").select(*SERIES, "t")
    return linear_at(probes, curve)


QUERIES = {
    "win_ema_follow": lambda s, d: ema_follow(frames(s, d)),
    "win_slew_limit": lambda s, d: slew_limit(frames(s, d)),
    "win_dual_layer": lambda s, d: dual_layer(frames(s, d)),
    "win_pitch_norm": lambda s, d: voiced_norm(stem_frames(s, d)),
    "win_align_pad": lambda s, d: align_pad(observed_frames(s, d), 400),
    "win_beat_weight": lambda s, d: beat_weight(stem_frames(s, d)),
    "win_blend_curve": lambda s, d: blend_curve(frames(s, d), stem_frames(s, d)),
    "join_refer_curves": _refer,
    "ml_density_cluster": _clusters,
    "agg_cluster_sizes": lambda s, d: cluster_sizes(_clusters(s, d)),
    "ml_cluster_cohesion": lambda s, d: cohesion(_clusters(s, d)),
    "ml_track_profile": track_profile,
    "ml_slot_strength": slot_strength,
}


def _follow_sql(source: str, near: float, far: float, name: str) -> str:
    return _fold_sql(source, {"y": ("0.5::DOUBLE", f"s.y + CASE WHEN x.v > 0 THEN {near!r}::DOUBLE * (x.v / {SCALE} - s.y) ELSE {far!r}::DOUBLE * (0.5 - s.y) END")}, name)


_WEIGHT = f"""bw0 AS (SELECT track, stem, frame_idx, transient / greatest(energy_smooth, 0.05) AS ratio, tonal_distance FROM wide),
bwq AS (SELECT track, stem, quantile_cont(ratio, 0.05) AS lo, quantile_cont(ratio, 0.95) AS hi FROM bw0 GROUP BY ALL),
bw1 AS (SELECT track, stem, frame_idx, CASE WHEN hi - lo > 1e-6 THEN greatest(0.0, least(1.0, (ratio - lo) / (hi - lo))) ELSE 0.5 END AS c FROM bw0 JOIN bwq USING (track, stem)),
{_smooth_sql('bw1', 2.0, 'c', _K, 'bw')}"""
_SLOT_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" for x in row) + ")" for row in SLOTS)

def _cell_sql(t: int) -> str:
    planes = [f"list_dot_product(v, {_signs(t * (PLANES + 1) + i)}::DOUBLE[])" for i in range(PLANES + 1)]
    code = " + ".join(f"CASE WHEN {p} > 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(planes[:-1]))
    return f"SELECT vec_id, {t} AS t, {code} AS cell, {planes[-1]} AS place FROM units"


_CLUSTERS = f"""units AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
keyed AS ({' UNION ALL '.join(_cell_sql(t) for t in range(TABLES))}),
met AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT vec_id AS y, unnest([{', '.join(f'lag(vec_id, {k}) OVER w' for k in range(1, SIDE + 1))}]) AS x FROM keyed WINDOW w AS (PARTITION BY t, cell ORDER BY place, vec_id)) WHERE x IS NOT NULL),
near AS MATERIALIZED (SELECT a, b, 1 - list_dot_product(p.v, q.v) AS distance FROM met JOIN units p ON a = p.vec_id JOIN units q ON b = q.vec_id),
cores AS (SELECT x, distance AS core FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY distance) AS rn FROM (SELECT a AS x, distance FROM near UNION ALL SELECT b, distance FROM near)) WHERE rn = {MIN_SAMPLES}),
links AS (SELECT a, b FROM near JOIN cores c ON a = c.x JOIN cores d ON b = d.x WHERE greatest(c.core, d.core, distance) <= {RADIUS}),
ways2 AS MATERIALIZED (SELECT a AS u, b AS w FROM links UNION ALL SELECT b, a FROM links),
reached(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT w, root FROM reached JOIN ways2 ON u = node WHERE root < w),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node),
clusters AS (SELECT vec_id, label, CASE WHEN count(*) OVER (PARTITION BY root) >= {MIN_SIZE} THEN root ELSE -1 END AS cluster FROM embeddings JOIN roots ON node = vec_id)"""

def _trend_sql(arc: str) -> str:
    change = f"list_sum({arc}[-3:]) / 3 - list_sum({arc}[1:3]) / 3"
    return f"CASE WHEN {change} > {ARC_CHANGE} THEN 'rising' WHEN {change} < -{ARC_CHANGE} THEN 'falling' ELSE 'stable' END"


ORACLE_SQL = {
    "ml_density_cluster": f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM clusters",
    "agg_cluster_sizes": f"""WITH RECURSIVE {_CLUSTERS}, k AS (SELECT cluster, count(*) AS n FROM clusters WHERE cluster >= 0 GROUP BY cluster ORDER BY n DESC, cluster LIMIT 5),
t AS (SELECT count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters, avg((cluster < 0)::INT) AS noise_share FROM clusters) SELECT * FROM k, t""",
    "ml_cluster_cohesion": f"""WITH RECURSIVE {_CLUSTERS}, k AS (SELECT label, cluster, count(*) AS n FROM clusters WHERE cluster >= 0 GROUP BY ALL)
SELECT label, sum(n)::BIGINT AS n, count(*) AS n_clusters, max(n) / sum(n) AS together FROM k GROUP BY label""",
    "win_ema_follow": f"WITH RECURSIVE {_FRAMES}, {_follow_sql('frames', alpha(DT, 50.0), alpha(DT, 1500.0), 'f')} SELECT track, stem, frame_idx, y AS place FROM f WHERE i > 0",
    "win_slew_limit": f"""WITH RECURSIVE {_FRAMES}, {_fold_sql('frames', {'y': ('0.0::DOUBLE', f's.y + greatest(-{2.0 * DT!r}::DOUBLE, least({2.0 * DT!r}::DOUBLE, x.v / {SCALE} - s.y))')}, 'f')} SELECT track, stem, frame_idx, y AS place FROM f WHERE i > 0""",
    "win_dual_layer": f"""WITH RECURSIVE {_FRAMES}, {_envelope_sql('frames', 1.0, 4.0, 'a')}, {_envelope_sql('frames', 6.0, 24.0, 'b')}
SELECT track, stem, frame_idx, a.y AS flash, b.y AS sustain, (a.y + b.y) / 2 AS combined FROM a JOIN b USING (track, stem, frame_idx) WHERE a.i > 0""",
    "win_pitch_norm": f"""WITH {_WIDE}, q AS (SELECT track, stem, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b, min(v) AS mn, max(v) AS mx, count(*) AS n FROM wide WHERE v > 0 AND pitch_confidence >= 0.5 GROUP BY ALL),
r AS (SELECT *, CASE WHEN b - a < 10 THEN mn - 20 ELSE a END AS lo, CASE WHEN b - a < 10 THEN mx + 20 ELSE b END AS hi FROM q)
SELECT track, stem, frame_idx, CASE WHEN n >= 10 AND v > 0 AND pitch_confidence >= 0.5 THEN greatest(0.0, least(1.0, (v - lo) / (hi - lo))) ELSE 0.0 END AS pitch FROM wide LEFT JOIN r USING (track, stem)""",
    "win_align_pad": f"""WITH {_FRAMES}, g AS (SELECT track, stem, unnest(range(0, 400))::INTEGER AS frame_idx FROM (SELECT DISTINCT track, stem FROM seen))
SELECT g.*, coalesce(s.v, 0.0) AS v FROM g ASOF LEFT JOIN seen s ON g.track = s.track AND g.stem = s.stem AND g.frame_idx >= s.frame_idx""",
    "win_beat_weight": f"WITH {_WIDE}, {_WEIGHT} SELECT track, stem, frame_idx, smooth AS weight FROM bw",
    "win_blend_curve": f"""WITH {_WIDE}, {_BEATS}, {_WEIGHT}, held AS (SELECT f.track, f.stem, f.frame_idx, b.* EXCLUDE (track, stem) FROM frames f ASOF LEFT JOIN beats b ON f.track = b.track AND f.stem = b.stem AND f.frame_idx >= b.start),
eased AS (SELECT *, (frame_idx - start) / (stop - start)::DOUBLE AS x FROM held),
angles AS (SELECT track, stem, frame_idx, coalesce(2 * pi() * (before + energy * CASE WHEN stop IS NULL THEN 0.0 ELSE {_EASE} END), 0.0) AS pulse FROM eased)
SELECT track, stem, frame_idx, 1.5 * pulse AS pulse, 1.5 * tonal_distance * pi() / 2 AS continuous, 1.5 * (smooth * pulse + (1 - smooth) * tonal_distance * pi() / 2) AS auto
FROM angles JOIN bw USING (track, stem, frame_idx) JOIN bw0 USING (track, stem, frame_idx)""",
    "join_refer_curves": f"""WITH {_FRAMES}, axis AS (SELECT s.track, s.frame_idx FROM seen s JOIN (SELECT track, arg_min(stem, list_position({list(AXIS_ORDER)!r}, stem)) AS first FROM seen GROUP BY track) f ON s.track = f.track AND s.stem = f.first),
probes AS (SELECT a.track, b.stem, a.frame_idx::DOUBLE AS t FROM axis a JOIN (SELECT DISTINCT track, stem FROM seen) b USING (track)), {_lines('probes')} SELECT * FROM lines""",
    "ml_track_profile": f"""WITH RECURSIVE {_RANKS}, {_STEMS}, {_CHARACTER}, {_CHANGE}, {_STARTS}, {_LOCK}, {_BEATS},
arc0 AS (SELECT track, floor(frame_idx * {ARC_POINTS} / {N})::INT AS part, round(avg(v / {SCALE}) + {TIE}, 6) AS mean FROM frames GROUP BY ALL),
arc1 AS (SELECT track, floor(frame_idx * {ARC_POINTS} / {N})::INT AS part, round(avg(energy_smooth) + {TIE}, 6) AS mean FROM sig WHERE target = 'tension' GROUP BY ALL),
a0 AS (SELECT track, list(mean ORDER BY part) AS energy_arc FROM arc0 GROUP BY track), a1 AS (SELECT track, list(mean ORDER BY part) AS tension_arc FROM arc1 GROUP BY track),
pl AS (SELECT track, stem_a || '=' || stem_b AS pair, round(round(avg(lock), 6) * 1000)::INT AS share FROM lock_ GROUP BY track, stem_a, stem_b),
cm AS (SELECT track, string_agg(pair || ':' || share, ',' ORDER BY pair) AS coupling, arg_min(pair, (-share, pair)) AS strongest_pair FROM pl GROUP BY track),
st AS (SELECT track, string_agg(DISTINCT stem, ',' ORDER BY stem) AS stems FROM frames GROUP BY track),
g AS (SELECT track, stem, count(*) AS n_beats, median(stop - start) / 60.0::DOUBLE AS gap FROM beats GROUP BY ALL)
SELECT c.track, c.character, {N} AS n_frames, b.bpm, n_sections, mean_lock, mean_tension, d.target AS driver, stems, coupling, strongest_pair, energy_arc, tension_arc, {_trend_sql("energy_arc")} AS energy_trend, {_trend_sql("tension_arc")} AS tension_trend FROM chars c
LEFT JOIN a0 ON c.track = a0.track LEFT JOIN a1 ON c.track = a1.track LEFT JOIN cm ON c.track = cm.track LEFT JOIN st ON c.track = st.track
LEFT JOIN (SELECT track, CASE WHEN n_beats >= 2 AND 60.0 / gap BETWEEN 40 AND 220 THEN 60.0::DOUBLE / gap ELSE 120.0::DOUBLE END AS bpm FROM g WHERE stem = 'purchase') b ON c.track = b.track
LEFT JOIN (SELECT track, count(*) AS n_sections FROM found GROUP BY track) n ON c.track = n.track LEFT JOIN (SELECT track, avg(lock) AS mean_lock FROM lock_ GROUP BY track) l ON c.track = l.track
LEFT JOIN (SELECT track, avg(energy_smooth) AS mean_tension FROM sig WHERE target = 'tension' GROUP BY track) t ON c.track = t.track LEFT JOIN (SELECT track, target FROM ranks WHERE kind = 'primary_driver' AND rn = 1) d ON c.track = d.track""",
    "ml_slot_strength": f"""WITH RECURSIVE {_SIG}, {_PROMINENCE}, slots AS (SELECT * FROM (VALUES {_SLOT_ROWS}) v(slot, target, base, lo, hi, curve, gamma, enabled) WHERE enabled),
fed AS (SELECT track, slot AS stem, frame_idx, base, lo, hi, CASE curve WHEN 'gamma' THEN pow(greatest(0.0, least(1.0, energy_smooth)), greatest(0.01, gamma)) WHEN 'clip' THEN greatest(0.0, least(1.0, 1.5 * energy_smooth)) ELSE greatest(0.0, least(1.0, energy_smooth)) END AS x FROM sig JOIN slots USING (target)),
{_fold_sql('fed', {'y': ('0.0::DOUBLE', f's.y + {alpha(DT, 50.0)!r}::DOUBLE * (x.x - s.y)')}, 'moved2')}
SELECT f.track, f.stem AS slot, f.frame_idx, (lo + y * (hi - lo)) * CASE WHEN base IS NULL THEN 0.5 ELSE prominence END AS strength FROM fed f JOIN moved2 m ON f.track = m.track AND f.stem = m.stem AND f.frame_idx = m.frame_idx
LEFT JOIN prominent p ON f.track = p.track AND f.base = p.stem AND f.frame_idx = p.frame_idx""",
}
