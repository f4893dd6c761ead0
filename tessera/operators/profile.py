"""Smoothing, novelty, layers, coupling of pairs of stems, sections and prominence over frame series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.coupling import RADIUS, WINDOW, coupled
from tessera.operators.halo import before, gaussians, kernel, over_series
from tessera.operators.series import _FRAMES, BEAT, N, SCALE, SERIES, _debounce_sql, _fold_sql, _uniform, _whole, debounce, folded, frames, percentile_norm, stem_pairs
from tessera.operators.signals import _WIDE, PHYSICAL, stem_frames
from tessera.operators.spectra import clamp
from tessera.session import materialize, table

TOLERANCE = RADIUS
#: Rank of each stem (null for the others) and prominence of each rank.
RANKS = {"purchase": 1, "view": 1, "click": 2}
BASE = {1: 1.0, 2: 0.65, 3: 0.40, 4: 0.25}
UNRANKED = 0.05
#: Pairs of stems of equal rank, the null rank among them.
RIVALS = (("purchase", "view"), ("error", "signup"))
#: Fixed values of prominence: largest boosts, call and response factors, promotions of unranked stems and their decay a frame.
NOVELTY_MAX, COUPLING_MAX, CALL, RESPONSE = 0.3, 0.5, 1.3, 0.6
ENTRY_BOOST, NOVELTY_BAR, NOVELTY_BOOST, DECAY = 0.7, 0.5, 0.5, 0.033
#: Fixed values of layers: bars of flux and of flatness change, frames between entries, frames of decay, silence in dB.
FLUX_BAR, FLATNESS_BAR, ENTRY_SPACING, LAYER_FRAMES, SILENCE_DB = 0.4, 0.15, 5, 80, -35.0
#: Tempo that the time scales of novelty are set for here.
BPM = 90.0


def gaussian(df: DataFrame, sigma: float, value: str = "v", name: str = "smooth") -> DataFrame:
    """Gaussian smoothing with reflected edges, chunk by chunk."""
    return gaussians(df, {name: (value, sigma)})


def max_norm(df: DataFrame, *values: str) -> DataFrame:
    """Each value over its largest of the series."""
    tops = over_series(df, **{f"top_{v}": F.max(v) for v in values})
    return tops.withColumns({v: F.when(F.col(f"top_{v}") > 1e-8, F.col(v) / F.col(f"top_{v}")).otherwise(0.0) for v in values}).drop(*[f"top_{v}" for v in values])


def time_scales(fps: float = 1.0, bpm: float = BPM) -> tuple[int, int, int]:
    """Short, medium and long sigma in frames: half a second, 4 and 16 at 120 beats a minute, longer for slower music."""
    scale = 120.0 / max(60.0, min(180.0, bpm))
    return tuple(max(least, int(s * fps * scale)) for s, least in ((0.5, 1), (4.0, 2), (16.0, 4)))


def novelty(df: DataFrame, sigmas: tuple[float, ...] | None = None) -> DataFrame:
    """Absolute change of the series, smoothed at several scales in one pass, each over its largest value."""
    sigmas = sigmas or time_scales()
    names = [f"n{i}" for i in range(len(sigmas))]
    change = before(df.select(*SERIES, "frame_idx", "v"), ("v",)).withColumn("change", F.abs(F.col("v") - F.col("p_v")))
    smooth = gaussians(change.drop("v", "p_v"), {n: ("change", s) for n, s in zip(names, sigmas)})
    return max_norm(smooth, *names).select(*SERIES, "frame_idx", *names)


def slopes(df: DataFrame, sigmas: tuple[float, ...]) -> DataFrame:
    """Change of novelty at each scale, smoothed, over its largest absolute value: d0, d1 and so on."""
    names, slope = tuple(f"n{i}" for i in range(len(sigmas))), {f"n{i}": f"d{i}" for i in range(len(sigmas))}
    steps = before(novelty(df, sigmas), names).select(*SERIES, "frame_idx", *[(F.col(n) - F.col(f"p_{n}")).alias(n) for n in names])
    smooth = gaussians(steps, {d: (n, 1.0) for n, d in slope.items()})
    tops = over_series(smooth, **{f"top_{d}": F.max(F.abs(d)) for d in slope.values()})
    return tops.select(*SERIES, "frame_idx", *[F.when(F.col(f"top_{d}") > 1e-8, F.col(d) / F.col(f"top_{d}")).otherwise(0.0).alias(d) for d in slope.values()])


def layer_entries(wide: DataFrame) -> DataFrame:
    """Frames with much flux and a large smoothed change of flatness, ENTRY_SPACING apart."""
    change = before(wide.select(*SERIES, "frame_idx", "flux", "flatness"), ("flatness",)).withColumn("change", F.abs(F.col("flatness") - F.col("p_flatness")))
    both = gaussian(max_norm(change.drop("flatness", "p_flatness"), "flux"), 1.0, "change", "moved")
    return debounce(both.filter((F.col("flux") > FLUX_BAR) & (F.col("moved") > FLATNESS_BAR)).select(*SERIES, "frame_idx"), ENTRY_SPACING)


def energy_db(df: DataFrame) -> DataFrame:
    """Level of each frame below the loudest of its series, -40 dB at least."""
    top = F.max("v").over(_whole())
    return df.withColumn("top", top).select(*SERIES, "frame_idx", F.when(F.col("v") > 0, F.greatest(F.lit(-40.0), 20 * F.log10(F.col("v") / F.col("top")))).otherwise(-40.0).alias("db"))


def _entered(wide: DataFrame) -> DataFrame:
    """Each frame with hit (1 for a layer entry) and its level in dB."""
    marks = layer_entries(wide).withColumn("hit", F.lit(1))
    return energy_db(wide).hint("merge").join(marks, [*SERIES, "frame_idx"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def layer_count(wide: DataFrame) -> DataFrame:
    """Entries counted up and decaying over LAYER_FRAMES, gone in silence, rounded and held in 0 to 6."""
    def step(state: tuple, hit: int, db: float) -> tuple:
        return (0.0 if db < SILENCE_DB else max(0.0, state[0] + hit - 1 / LAYER_FRAMES),)

    count = folded(_entered(wide), step, (0.0,), ("hit", "db"), "layers")
    return count.select(*SERIES, "frame_idx", F.least(F.lit(6), F.bround("layers").cast("int")).alias("layers"))


def find_peaks(x: np.ndarray, height: float, distance: int, prominence: float) -> list[int]:
    """Places of local maxima (the middle of a plateau) of at least ``height``, ``distance`` apart with the higher one first, that stand out by ``prominence``."""
    n, found, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    found = [p for p in found if x[p] >= height]
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-x[p], p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def stands_out(p: int) -> bool:
        left = right = p
        low_left = low_right = x[p]
        while left >= 0 and x[left] <= x[p]:
            low_left = min(low_left, x[left])
            left -= 1
        while right < n and x[right] <= x[p]:
            low_right = min(low_right, x[right])
            right += 1
        return x[p] - max(low_left, low_right) >= prominence

    return sorted(p for p in kept if stands_out(p))


def section_starts(curve: np.ndarray, spacing: int = 8, prominence: float = 0.1) -> list[int]:
    """Zero and the peaks of a novelty curve over its mean and half a deviation; a curve without change has no others."""
    if len(curve) < 3 or float(np.std(curve)) <= 1e-6:
        return [0]
    height = float(np.mean(curve) + 0.5 * np.std(curve))
    return sorted({0, *(p for p in find_peaks(curve, height, spacing, prominence) if p > 0)})


def sections(df: DataFrame) -> DataFrame:
    """Section starts of each track, from its stems' mean long novelty."""
    curve = novelty(df, (time_scales()[2],)).groupBy("track", "frame_idx").agg(F.avg("n0").alias("v"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        at = section_starts(rows.column("v").to_numpy())
        return pa.table([pa.array([rows.column("track")[0].as_py()] * len(at), pa.int64()), pa.array(at, pa.int32())], names=["track", "frame_idx"])

    return curve.groupBy("track").applyInArrow(run, "track long, frame_idx int")


def energy_weighted(df: DataFrame) -> DataFrame:
    """Mean of each stem's normalised value weighted by its energy + 0.1, over the stems of a frame; 0.5 where there are none."""
    norm = percentile_norm(df).hint("merge").join(df, [*SERIES, "frame_idx"])
    w = F.col("v") / SCALE + 0.1
    return norm.groupBy("track", "frame_idx").agg(F.coalesce(F.sum(F.col("norm") * w) / F.sum(w), F.lit(0.5)).alias("tension"))


def weighted_position(df: DataFrame) -> DataFrame:
    """Position by rank-weighted intensity: silent under 0.02 of weight, no position without valid rows."""
    x = F.col("v") / SCALE
    rank = F.when(F.col("stem") == "purchase", 1.0).when(F.col("stem") == "view", 0.6).otherwise(0.3)
    valid = F.col("frame_idx") % 5 != 0
    place = (F.col("frame_idx") % 24) / 24.0
    agg = df.groupBy("track", "frame_idx").agg(F.sum(x * rank).alias("total"), F.sum(F.when(valid, x * rank)).alias("good"), F.sum(F.when(valid, x * rank * place)).alias("moment"))
    return agg.select("track", "frame_idx", (F.col("total") < 0.02).alias("silent"), F.when(F.col("good") >= 1e-6, F.col("moment") / F.col("good")).alias("position"))


def key_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation of a major or minor template that correlates best with a label's mean twelve bins; ties to the first.

    All entries of a vector fold into twelve bins.  Vectors of which over seven tenths of
    the weight lies in one bin in a dozen are percussive and left out.
    """
    folded_ = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x")).groupBy("label", "vec_id", (F.col("i") % 12).alias("bin")).agg(F.sum(F.abs(F.col("x").cast("double"))).alias("c"))
    by = Window.partitionBy("vec_id")
    harmonic = folded_.withColumn("ratio", F.max("c").over(by) / F.sum("c").over(by)).filter("ratio < 0.7")
    mean = harmonic.groupBy("label", "bin").agg(F.avg("c").alias("c"))
    rows = [(m, r, b, t[(b - r) % 12]) for m, t in enumerate((MAJOR, MINOR)) for r in range(12) for b in range(12)]
    templates = spark.createDataFrame(rows, "mode int, root int, bin int, t double")  # 288 fixed rows
    scored = mean.join(F.broadcast(templates), "bin").groupBy("label", "root", "mode").agg(F.round(F.corr("c", "t"), 9).alias("r"))
    order = Window.partitionBy("label").orderBy(F.desc("r"), "root", "mode")
    return scored.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("label", "root", "mode", clamp(F.col("r")).alias("confidence"))


#: Key profiles of Krumhansl and Kessler.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def ranked(df: DataFrame) -> DataFrame:
    """``df`` with rank (null for unranked stems) and base, the prominence that the rank gives."""
    rank = F.lit(None).cast("int")
    for stem, r in RANKS.items():
        rank = F.when(F.col("stem") == stem, r).otherwise(rank)
    base = F.lit(UNRANKED)
    for r, x in BASE.items():
        base = F.when(F.col("rank") == r, x).otherwise(base)
    return df.withColumn("rank", rank).withColumn("base", base)


def rival_effects(df: DataFrame) -> DataFrame:
    """(track, stem, frame_idx, coupling, factor): what the other stems of a stem's rank add and multiply.

    Null is a rank like any other.  Locked rivals raise each other; in a call and response
    the louder one is raised and the other lowered.
    """
    both = coupled(df, WINDOW, RIVALS)
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("stem"), F.col(y).alias("other")) for x, y in (("stem_a", "stem_b"), ("stem_b", "stem_a"))]))
    rows = both.select("track", "frame_idx", "lock", "response", ways.alias("z")).select("track", "z.*", "frame_idx", "lock", "response")
    level = df.select("track", "stem", "frame_idx", "v")
    other = level.select("track", F.col("stem").alias("other"), "frame_idx", F.col("v").alias("other_v"))
    known = rows.hint("merge").join(level, ["track", "stem", "frame_idx"]).hint("merge").join(other, ["track", "other", "frame_idx"])
    bonus = F.when(F.col("lock") > 0.5, (F.col("lock") - 0.5) * 2 * COUPLING_MAX).otherwise(0.0)
    factor = F.when(F.col("response") > 0.5, F.when(F.col("v") > F.col("other_v"), CALL).otherwise(RESPONSE)).otherwise(1.0)
    return known.groupBy(*SERIES, "frame_idx").agg(F.least(F.sum(bonus), F.lit(COUPLING_MAX)).alias("coupling"), F.exp(F.sum(F.log(factor))).alias("factor"))


def prominence(wide: DataFrame) -> DataFrame:
    """Prominence of each stem at each frame, at most one.

    The rank's base is raised by rising short novelty and by locked rivals, multiplied by
    call and response and by a gate from -40 dB to 0, and unranked stems are promoted by layer entries and by
    rising medium novelty, which then decays.
    """
    short, medium, _ = time_scales()
    wide = materialize(wide, "wide")
    df = wide.select(*SERIES, "frame_idx", "v")
    rising = slopes(df, (short, medium))
    rows = _entered(wide).hint("merge").join(rising, [*SERIES, "frame_idx"]).hint("merge").join(rival_effects(df), [*SERIES, "frame_idx"], "left")
    rows = materialize(ranked(rows).withColumn("boost", F.when(F.col("rank").isNull(), F.greatest(F.when(F.col("hit") == 1, ENTRY_BOOST).otherwise(0.0), F.when(F.col("d1") > NOVELTY_BAR, NOVELTY_BOOST).otherwise(0.0))).otherwise(0.0)), "ranked")
    surprise = folded(rows, lambda state, new: (new if new > state[0] else max(0.0, state[0] - DECAY),), (0.0,), ("boost",), "surprise")
    gate = clamp((F.col("db") + 40) / 40)
    raised = F.col("base") * (1 + NOVELTY_MAX * clamp(F.col("d0")) + F.coalesce("coupling", F.lit(0.0))) * F.coalesce("factor", F.lit(1.0)) * gate
    return rows.hint("merge").join(surprise, [*SERIES, "frame_idx"]).select(*SERIES, "frame_idx", F.least(F.lit(1.0), raised + F.when(F.col("rank").isNull(), F.col("surprise")).otherwise(0.0)).alias("prominence"))


def _f(s, d):
    return frames(s, d)


def _catalog(s, d):
    """Names of all targets: recorded stems, one for each track, and the derived ones."""
    derived = s.createDataFrame([("global",), ("tension",), ("tonal_distance",)], "target string")
    return _f(s, d).select(F.col("stem").alias("target")).union(_f(s, d).select(F.concat(F.lit("track_"), F.col("track")))).union(derived).distinct()


def _beat_energy(s, d):
    """Energy at the frame after each onset, the last one for onsets at the end."""
    ends = _f(s, d).groupBy(*SERIES).agg((F.max("frame_idx")).alias("last"))
    beats = _f(s, d).filter(f"v > {BEAT}").hint("merge").join(ends, list(SERIES)).select(*SERIES, F.least(F.col("frame_idx") + 1, F.col("last")).cast("int").alias("frame_idx")).distinct()
    return beats.hint("merge").join(_f(s, d), [*SERIES, "frame_idx"])


QUERIES = {
    "win_gaussian": lambda s, d: gaussian(_f(s, d), 2.0).select(*SERIES, "frame_idx", "smooth"),
    "win_multi_novelty": lambda s, d: novelty(_f(s, d)),
    "win_novelty_deriv": lambda s, d: slopes(_f(s, d), (2.0,)).select(*SERIES, "frame_idx", (F.round("d0", 9) + 0.0).alias("slope")),
    "win_layer_entry": lambda s, d: layer_entries(stem_frames(s, d)),
    "win_layer_count": lambda s, d: layer_count(stem_frames(s, d)),
    "win_find_peaks": lambda s, d: sections(_f(s, d)),
    "win_prominence": lambda s, d: prominence(stem_frames(s, d)),
    "agg_energy_weighted": lambda s, d: energy_weighted(_f(s, d)),
    "agg_rank_weighted_position": lambda s, d: weighted_position(_f(s, d)),
    "agg_key_estimate": key_estimate,
    "agg_global_mean": lambda s, d: _f(s, d).filter(F.col("stem").isin(*PHYSICAL)).groupBy("track", "frame_idx").agg(F.avg(F.col("v") / 2).alias("level")),
    "agg_first_available": lambda s, d: _first(s, d),
    "flt_physical_only": lambda s, d: _f(s, d).filter(F.col("stem").isin(*PHYSICAL) & (F.col("v") > 0)),
    "set_target_catalog": _catalog,
    "join_beat_energy": _beat_energy,
    "join_pair_lookup": lambda s, d: _lookup(s, d),
}


def _first(s, d):
    """Value of the first physical stem that sounds in a frame, in fixed order; 0 where none does."""
    place = F.array_position(F.array(*map(F.lit, PHYSICAL)), F.col("stem"))
    live = F.when(F.col("stem").isin(*PHYSICAL) & (F.col("v") > 0), place)
    return _f(s, d).groupBy("track", "frame_idx").agg(F.coalesce(F.min_by("v", live), F.lit(0.0)).alias("v"), F.min(live).alias("place")).select("track", "frame_idx", F.when(F.col("place").isNull(), 0.0).otherwise(F.col("v")).alias("v"))


def _lookup(s, d):
    """Correlation of an ordered pair asked for in either order; 0 where there is none."""
    pairs = stem_pairs(_f(s, d)).groupBy("track", "stem_a", "stem_b").agg(F.corr("va", "vb").alias("r"))
    asked = _f(s, d).select("track").distinct().select("track", F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in (("view", "click"), ("click", "view"), ("view", "none"))])).alias("q")).select("track", "q.*")
    keyed = asked.withColumns({"stem_a": F.least("x", "y"), "stem_b": F.greatest("x", "y")})
    return keyed.hint("merge").join(pairs, ["track", "stem_a", "stem_b"], "left").select("track", "x", "y", F.coalesce("r", F.lit(0.0)).alias("r"))


def _smooth_sql(source: str, sigma: float, value: str, keys: str, name: str) -> str:
    weights = kernel(sigma)
    r = len(weights) // 2
    return f"""{name} AS (SELECT {keys}, frame_idx, list_dot_product(near, [{', '.join(f'{w!r}::DOUBLE' for w in weights)}]) AS smooth FROM (
  SELECT *, list(x) OVER (PARTITION BY {keys} ORDER BY place ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS near FROM (
    SELECT {keys}, frame_idx, ({value})::DOUBLE AS x, true AS own, frame_idx AS place FROM {source}
    UNION ALL SELECT {keys}, frame_idx, {value}, false, -frame_idx - 1 FROM {source} WHERE frame_idx < {r}
    UNION ALL SELECT {keys}, frame_idx, {value}, false, 2 * {N} - 1 - frame_idx FROM {source} WHERE frame_idx >= {N} - {r})) WHERE own)"""


_K = "track, stem"
_CHANGE = "change AS (SELECT track, stem, frame_idx, coalesce(abs(v - lag(v) OVER (PARTITION BY track, stem ORDER BY frame_idx)), 0.0) AS c FROM frames)"


def _novelty_sql(sigmas: tuple, p: str = "") -> str:
    """CTEs {p}nov(track, stem, frame_idx, n0, n1, ...) of the CTE change."""
    smooth = ", ".join(_smooth_sql("change", s, "c", _K, f"{p}g{i}") for i, s in enumerate(sigmas))
    columns = ", ".join(f"CASE WHEN max({p}g{i}.smooth) OVER w > 1e-8 THEN {p}g{i}.smooth / max({p}g{i}.smooth) OVER w ELSE 0.0 END AS n{i}" for i in range(len(sigmas)))
    joins = " ".join(f"JOIN {p}g{i} USING (track, stem, frame_idx)" for i in range(1, len(sigmas)))
    return f"{smooth}, {p}nov AS (SELECT track, stem, frame_idx, {columns} FROM {p}g0 {joins} WINDOW w AS (PARTITION BY track, stem))"


def _slopes_sql(sigmas: tuple, p: str) -> str:
    """CTEs {p}slope(track, stem, frame_idx, d0, ...) of change."""
    out = [_novelty_sql(sigmas, p)]
    for i in range(len(sigmas)):
        out.append(f"{p}step{i} AS (SELECT track, stem, frame_idx, coalesce(n{i} - lag(n{i}) OVER (PARTITION BY track, stem ORDER BY frame_idx), 0.0) AS c FROM {p}nov)")
        out.append(_smooth_sql(f"{p}step{i}", 1.0, "c", _K, f"{p}h{i}"))
    columns = ", ".join(f"CASE WHEN max(abs({p}h{i}.smooth)) OVER w > 1e-8 THEN {p}h{i}.smooth / max(abs({p}h{i}.smooth)) OVER w ELSE 0.0 END AS d{i}" for i in range(len(sigmas)))
    joins = " ".join(f"JOIN {p}h{i} USING (track, stem, frame_idx)" for i in range(1, len(sigmas)))
    out.append(f"{p}slope AS (SELECT track, stem, frame_idx, {columns} FROM {p}h0 {joins} WINDOW w AS (PARTITION BY track, stem))")
    return ", ".join(out)


def _response_sql(a: str, b: str, p: str, window: int = 8) -> str:
    return f"""{p}one AS (SELECT x.track, x.frame_idx, ((x.v / {SCALE} > 0.3) <> (y.v / {SCALE} > 0.3))::INT AS x1 FROM frames x JOIN frames y ON x.track = y.track AND x.frame_idx = y.frame_idx AND x.stem = '{a}' AND y.stem = '{b}'),
{_smooth_sql(f'{p}one', window / 4, 'x1', 'track', f'{p}cr0')}, {p}cr AS (SELECT track, frame_idx, greatest(0.0, least(1.0, smooth)) AS response FROM {p}cr0)"""


def _sync_sql(a: str, b: str, p: str) -> str:
    return f"""{p}hits AS (SELECT DISTINCT x.track, x.frame_idx FROM frames x JOIN frames y ON x.track = y.track AND abs(x.frame_idx - y.frame_idx) <= {TOLERANCE} AND x.stem = '{a}' AND y.stem = '{b}' AND x.v > {BEAT} AND y.v > {BEAT}),
{p}marks AS (SELECT DISTINCT track, frame_idx + o AS frame_idx FROM {p}hits, (SELECT unnest(range(-{TOLERANCE}, {TOLERANCE} + 1)) AS o)),
{p}curve AS (SELECT f.track, f.frame_idx, (m.frame_idx IS NOT NULL)::INT AS x1 FROM frames f LEFT JOIN {p}marks m ON f.track = m.track AND f.frame_idx = m.frame_idx WHERE f.stem = '{a}'),
{_smooth_sql(f'{p}curve', TOLERANCE / 2, 'x1', 'track', f'{p}sy0')}, {p}sy AS (SELECT track, frame_idx, greatest(0.0, least(1.0, smooth)) AS sync FROM {p}sy0)"""


def _plv_sql(a: str, b: str, p: str) -> str:
    """Phases by the kernel of the discrete Hilbert transform, which is what the FFT does."""
    m = "(t.frame_idx - k.frame_idx)"
    even = f"CASE WHEN {m} % 2 = 0 THEN 0.0 ELSE 2.0::DOUBLE / n / tan(pi() * {m} / n) END"
    odd = f"(1 / tan(pi() * {m} / n) - cos(pi() * {m}) / sin(pi() * {m} / n)) / n"
    return f"""{p}cx AS MATERIALIZED (SELECT track, stem, frame_idx, v - avg(v) OVER (PARTITION BY track, stem) AS x FROM frames WHERE stem IN ('{a}', '{b}')),
{p}hil AS (SELECT t.track, t.stem, t.frame_idx, any_value(t.x) AS x, sum(CASE WHEN {m} = 0 THEN 0.0 WHEN n % 2 = 0 THEN k.x * {even} ELSE k.x * {odd} END) AS h FROM {p}cx t JOIN {p}cx k ON t.track = k.track AND t.stem = k.stem, span GROUP BY t.track, t.stem, t.frame_idx),
{p}gap AS (SELECT u.track, u.frame_idx, atan2(u.h, u.x) - atan2(w.h, w.x) AS d FROM {p}hil u JOIN {p}hil w ON u.track = w.track AND u.frame_idx = w.frame_idx AND u.stem = '{a}' AND w.stem = '{b}'),
{_uniform(f'{p}gap', WINDOW, 'cos(d)', 'track', f'{p}mc')}, {_uniform(f'{p}gap', WINDOW, 'sin(d)', 'track', f'{p}ms')},
{p}plv AS (SELECT track, frame_idx, sqrt({p}mc.smooth * {p}mc.smooth + {p}ms.smooth * {p}ms.smooth) AS plv FROM {p}mc JOIN {p}ms USING (track, frame_idx))"""


def _local_sql(a: str, b: str, p: str, n: int) -> str:
    return f"""{_uniform(f"(SELECT * FROM frames WHERE stem = '{a}')", n, 'v', 'track', f'{p}ua')}, {_uniform(f"(SELECT * FROM frames WHERE stem = '{b}')", n, 'v', 'track', f'{p}ub')},
{p}both AS (SELECT x.track, x.frame_idx, (x.v_orig - x.smooth) AS a, (y.v_orig - y.smooth) AS b FROM {p}ua x JOIN {p}ub y ON x.track = y.track AND x.frame_idx = y.frame_idx),
{_uniform(f'{p}both', n, 'a * b', 'track', f'{p}mab')}, {_uniform(f'{p}both', n, 'a * a', 'track', f'{p}maa')}, {_uniform(f'{p}both', n, 'b * b', 'track', f'{p}mbb')},
{p}lc AS (SELECT track, frame_idx, greatest(-1.0, least(1.0, {p}mab.smooth / (sqrt(greatest({p}maa.smooth, 0.0)) * sqrt(greatest({p}mbb.smooth, 0.0)) + 1e-8))) AS local_corr FROM {p}mab JOIN {p}maa USING (track, frame_idx) JOIN {p}mbb USING (track, frame_idx))"""


def _lock_sql(a: str, b: str, p: str) -> str:
    return f"""{_local_sql(a, b, p, WINDOW)}, {_plv_sql(a, b, p)}, {_sync_sql(a, b, p)},
{p}lock AS (SELECT track, frame_idx, greatest(0.0, least(1.0, 0.40 * (local_corr + 1) / 2 + 0.35 * plv + 0.25 * sync)) AS lock FROM {p}lc JOIN {p}plv USING (track, frame_idx) JOIN {p}sy USING (track, frame_idx))"""


_ENTRIES = f"""dflat AS (SELECT track, stem, frame_idx, CASE WHEN max(flux) OVER (PARTITION BY track, stem) > 1e-8 THEN flux / max(flux) OVER (PARTITION BY track, stem) ELSE 0.0 END AS flux,
  abs(coalesce(flatness - lag(flatness) OVER (PARTITION BY track, stem ORDER BY frame_idx), 0.0)) AS c FROM wide),
{_smooth_sql('dflat', 1.0, 'c', _K, 'moved')}, cand AS (SELECT d.track, d.stem, d.frame_idx FROM dflat d JOIN moved m USING (track, stem, frame_idx) WHERE d.flux > {FLUX_BAR} AND m.smooth > {FLATNESS_BAR}),
{_debounce_sql('cand', ENTRY_SPACING, 'entered')}, entries AS (SELECT track, stem, frame_idx FROM entered WHERE keep = 1)"""
_LEVELS = """levels AS (SELECT f.track, f.stem, f.frame_idx, f.v, (e.frame_idx IS NOT NULL)::INT AS hit, CASE WHEN f.v > 0 THEN greatest(-40.0, 20 * log10(f.v / max(f.v) OVER (PARTITION BY f.track, f.stem))) ELSE -40.0 END AS db
  FROM frames f LEFT JOIN entries e ON f.track = e.track AND f.stem = e.stem AND f.frame_idx = e.frame_idx)"""
_NORM = "q AS (SELECT track, stem, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM frames GROUP BY ALL), norm AS (SELECT f.*, CASE WHEN hi - lo <= 1e-8 THEN 0.0 ELSE greatest(0.0, least(1.0, (v - lo) / (hi - lo))) END AS norm FROM frames f JOIN q USING (track, stem))"
_IN = "('click', 'purchase', 'view')"
_TEMPLATES = ", ".join(f"({m}, {r}, {b}, {t[(b - r) % 12]}::DOUBLE)" for m, t in enumerate((MAJOR, MINOR)) for r in range(12) for b in range(12))
_SHORT, _MEDIUM, _LONG = time_scales()
_STARTS = f"""{_novelty_sql((_LONG,), 'z')}, lined AS (SELECT track, frame_idx, avg(n0) AS v FROM znov GROUP BY ALL),
bars AS (SELECT track, avg(v) + 0.5 * stddev_pop(v) AS height, stddev_pop(v) AS spread FROM lined GROUP BY track),
tops AS (SELECT l.track, l.frame_idx, l.v FROM (SELECT *, lag(v) OVER (PARTITION BY track ORDER BY frame_idx) AS b, lead(v) OVER (PARTITION BY track ORDER BY frame_idx) AS a FROM lined) l JOIN bars USING (track) WHERE l.v > b AND l.v > a AND l.v >= height AND spread > 1e-6),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track ORDER BY v DESC, frame_idx) AS i FROM tops),
picked AS (SELECT track, 0::BIGINT AS i, []::INTEGER[] AS kept FROM (SELECT DISTINCT track FROM tops)
  UNION ALL SELECT s.track, s.i + 1, CASE WHEN len(list_filter(s.kept, lambda q: abs(q - o.frame_idx) < 8)) = 0 THEN list_append(s.kept, o.frame_idx) ELSE s.kept END FROM picked s JOIN ordered o ON o.track = s.track AND o.i = s.i + 1),
apart AS (SELECT track, unnest(kept) AS frame_idx FROM (SELECT track, arg_max(kept, i) AS kept FROM picked GROUP BY track)),
reach AS (SELECT p.track, p.frame_idx, any_value(o.v) AS v, coalesce(max(l.frame_idx) FILTER (l.frame_idx < p.frame_idx AND l.v > o.v), -1) AS lo, coalesce(min(l.frame_idx) FILTER (l.frame_idx > p.frame_idx AND l.v > o.v), {N}) AS hi
  FROM apart p JOIN tops o ON p.track = o.track AND p.frame_idx = o.frame_idx JOIN lined l ON l.track = p.track GROUP BY p.track, p.frame_idx),
stand AS (SELECT r.track, r.frame_idx FROM reach r JOIN lined l ON l.track = r.track GROUP BY r.track, r.frame_idx, r.v, r.lo, r.hi
  HAVING r.v - greatest(min(l.v) FILTER (l.frame_idx > r.lo AND l.frame_idx <= r.frame_idx), min(l.v) FILTER (l.frame_idx < r.hi AND l.frame_idx >= r.frame_idx)) >= 0.1),
found AS (SELECT track, frame_idx FROM stand WHERE frame_idx > 0 UNION SELECT DISTINCT track, 0 FROM frames)"""
_RANK_SQL = "CASE " + " ".join(f"WHEN l.stem = '{k}' THEN {v}" for k, v in RANKS.items()) + " END"
_BASE_SQL = "CASE rank " + " ".join(f"WHEN {k} THEN {v}" for k, v in BASE.items()) + f" ELSE {UNRANKED} END"


def _way(i: int, a: str, b: str) -> str:
    return f"SELECT k.track, '{a}' AS stem, '{b}' AS other, k.frame_idx, k.lock, c.response FROM r{i}lock k JOIN r{i}cr c ON k.track = c.track AND k.frame_idx = c.frame_idx"


_PROMINENCE = f"""{_CHANGE}, {_slopes_sql((_SHORT, _MEDIUM), 'p')}, {_ENTRIES}, {_LEVELS}, {', '.join(f'{_lock_sql(a, b, f"r{i}")}, {_response_sql(a, b, f"r{i}")}' for i, (a, b) in enumerate(RIVALS))},
ways AS ({' UNION ALL '.join(f'{_way(i, a, b)} UNION ALL {_way(i, b, a)}' for i, (a, b) in enumerate(RIVALS))}),
effects AS (SELECT w.track, w.stem, w.frame_idx, least(sum(CASE WHEN lock > 0.5 THEN (lock - 0.5) * 2 * {COUPLING_MAX} ELSE 0.0 END), {COUPLING_MAX}) AS coupling,
  exp(sum(ln(CASE WHEN response > 0.5 THEN CASE WHEN x.v > y.v THEN {CALL} ELSE {RESPONSE} END ELSE 1.0 END))) AS factor FROM ways w JOIN frames x ON w.track = x.track AND w.stem = x.stem AND w.frame_idx = x.frame_idx
  JOIN frames y ON w.track = y.track AND w.other = y.stem AND w.frame_idx = y.frame_idx GROUP BY ALL),
mixed0 AS (SELECT l.track, l.stem, l.frame_idx, l.db, {_RANK_SQL} AS rank, d0, coalesce(coupling, 0.0) AS coupling, coalesce(factor, 1.0) AS factor,
  CASE WHEN {_RANK_SQL} IS NULL THEN greatest(CASE WHEN hit = 1 THEN {ENTRY_BOOST} ELSE 0.0 END, CASE WHEN d1 > {NOVELTY_BAR} THEN {NOVELTY_BOOST} ELSE 0.0 END)::DOUBLE ELSE 0.0::DOUBLE END AS boost
  FROM levels l JOIN pslope s ON l.track = s.track AND l.stem = s.stem AND l.frame_idx = s.frame_idx LEFT JOIN effects e ON l.track = e.track AND l.stem = e.stem AND l.frame_idx = e.frame_idx),
{_fold_sql('mixed0', {'y': ('0.0::DOUBLE', f'CASE WHEN x.boost > s.y THEN x.boost ELSE greatest(0.0, s.y - {DECAY}) END')}, 'promoted')},
prominent AS (SELECT m.track, m.stem, m.frame_idx, least(1.0, {_BASE_SQL} * (1 + {NOVELTY_MAX} * greatest(0.0, least(1.0, d0)) + coupling) * factor * greatest(0.0, least(1.0, (db + 40) / 40)) + CASE WHEN rank IS NULL THEN y ELSE 0.0 END)::DOUBLE AS prominence
  FROM mixed0 m JOIN promoted p ON m.track = p.track AND m.stem = p.stem AND m.frame_idx = p.frame_idx)"""

ORACLE_SQL = {
    "win_gaussian": f"WITH {_FRAMES}, {_smooth_sql('frames', 2.0, 'v', 'track, stem', 'g')} SELECT * FROM g",
    "win_multi_novelty": f"WITH {_FRAMES}, {_CHANGE}, {_novelty_sql(time_scales())} SELECT * FROM nov",
    "win_novelty_deriv": f"WITH {_FRAMES}, {_CHANGE}, {_slopes_sql((2.0,), '')} SELECT track, stem, frame_idx, round(d0, 9) + 0.0 AS slope FROM slope",
    "win_layer_entry": f"WITH RECURSIVE {_WIDE}, {_ENTRIES} SELECT * FROM entries",
    "win_layer_count": f"""WITH RECURSIVE {_WIDE}, {_ENTRIES}, {_LEVELS}, {_fold_sql('levels', {'y': ('0.0::DOUBLE', f'CASE WHEN x.db < {SILENCE_DB} THEN 0.0 ELSE greatest(0.0, s.y + x.hit - {1 / LAYER_FRAMES}::DOUBLE) END')}, 'counted')}
SELECT track, stem, frame_idx, least(6, round_even(y, 0)::INTEGER) AS layers FROM counted WHERE i > 0""",
    "win_find_peaks": f"WITH RECURSIVE {_FRAMES}, {_CHANGE}, {_STARTS} SELECT * FROM found",
    "win_prominence": f"WITH RECURSIVE {_WIDE}, {_PROMINENCE} SELECT * FROM prominent",
    "agg_energy_weighted": f"WITH {_FRAMES}, {_NORM} SELECT track, frame_idx, sum(norm * (v / 500.0 + 0.1)) / sum(v / 500.0 + 0.1) AS tension FROM norm GROUP BY ALL",
    "agg_rank_weighted_position": f"""WITH {_FRAMES}, x AS (SELECT *, v / 500.0 * CASE stem WHEN 'purchase' THEN 1.0 WHEN 'view' THEN 0.6 ELSE 0.3 END AS w, frame_idx % 5 <> 0 AS ok, (frame_idx % 24) / 24.0 AS p FROM frames),
a AS (SELECT track, frame_idx, sum(w) AS total, sum(w) FILTER (ok) AS good, sum(w * p) FILTER (ok) AS moment FROM x GROUP BY ALL)
SELECT track, frame_idx, total < 0.02 AS silent, CASE WHEN good >= 1e-6 THEN moment / good END AS position FROM a""",
    "agg_key_estimate": f"""WITH b AS (SELECT label, vec_id, bin, sum(abs(x::DOUBLE)) AS c FROM (SELECT label, vec_id, unnest(embedding) AS x, (unnest(range(0, len(embedding))) % 12)::INTEGER AS bin FROM embeddings) GROUP BY ALL),
m AS (SELECT label, bin, avg(c) AS c FROM (SELECT *, max(c) OVER (PARTITION BY vec_id) / sum(c) OVER (PARTITION BY vec_id) AS ratio FROM b) WHERE ratio < 0.7 GROUP BY ALL),
t AS (SELECT * FROM (VALUES {_TEMPLATES}) v(mode, root, bin, t)), s AS (SELECT label, root, mode, round(corr(c, t), 9) AS r FROM m JOIN t USING (bin) GROUP BY ALL)
SELECT label, root, mode, greatest(0.0, least(1.0, r)) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r DESC, root, mode) AS rn FROM s) WHERE rn = 1""",
    "agg_global_mean": f"WITH {_FRAMES} SELECT track, frame_idx, avg(v / 2) AS level FROM frames WHERE stem IN {_IN} GROUP BY ALL",
    "agg_first_available": f"""WITH {_FRAMES} SELECT track, frame_idx, coalesce(arg_min(v, CASE stem WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END) FILTER (stem IN {_IN} AND v > 0), 0.0) AS v FROM frames GROUP BY ALL""",
    "flt_physical_only": f"WITH {_FRAMES} SELECT * FROM frames WHERE stem IN {_IN} AND v > 0",
    "set_target_catalog": f"WITH {_FRAMES} SELECT stem AS target FROM frames UNION SELECT 'track_' || track FROM frames UNION SELECT unnest(['global', 'tension', 'tonal_distance'])",
    "join_beat_energy": f"WITH {_FRAMES}, b AS (SELECT DISTINCT track, stem, least(frame_idx + 1, {N} - 1)::INTEGER AS frame_idx FROM frames WHERE v > {BEAT}) SELECT * FROM b JOIN frames USING (track, stem, frame_idx)",
    "join_pair_lookup": f"""WITH {_FRAMES}, q AS (SELECT track, x, y FROM (SELECT DISTINCT track FROM frames), (VALUES ('view', 'click'), ('click', 'view'), ('view', 'none')) v(x, y)),
p AS (SELECT a.track, a.stem AS sa, b.stem AS sb, corr(a.v, b.v) AS r FROM frames a JOIN frames b ON a.track = b.track AND a.frame_idx = b.frame_idx AND a.stem < b.stem GROUP BY ALL)
SELECT q.track, x, y, coalesce(r, 0.0) AS r FROM q LEFT JOIN p ON q.track = p.track AND sa = least(x, y) AND sb = greatest(x, y)""",
}
