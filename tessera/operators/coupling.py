"""Coupling of all pairs of stems: local correlation, phase locking, onset synchrony, call and response, and the lock index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.halo import gaussians, kernel, uniform_means
from tessera.operators.series import _FRAMES, BEAT, N, SCALE, SERIES, _uniform, frames
from tessera.operators.spectra import clamp
from tessera.session import materialize

#: A series of a pair: the two stems in the order of their names.
PAIR = ("track", "stem_a", "stem_b")
#: Frames in which two stems are held to be locked, within which onsets match, in which call and response change, and of the plain local correlation.
WINDOW, RADIUS, TURN, LOCAL = 48, 2, 8, 24
#: Level over which a stem is loud.
LOUD_LEVEL = 0.3


def paired(df: DataFrame, values: tuple[str, ...], pairs: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """a_x and b_x, the values x of both stems, for each frame of all unordered pairs of the few stems of a track, or of ``pairs`` only."""
    side = lambda k: df.select("track", F.col("stem").alias(f"stem_{k}"), "frame_idx", *[F.col(v).alias(f"{k}_{v}") for v in values])
    both = side("a").hint("merge").join(side("b"), ["track", "frame_idx"]).filter("stem_a < stem_b")
    if pairs is not None:
        both = both.filter(F.concat_ws("|", "stem_a", "stem_b").isin(*["|".join(sorted(p)) for p in pairs]))
    return both.select(*PAIR, "frame_idx", *[f"{k}_{v}" for v in values for k in "ab"])


def deviations(df: DataFrame, n: int) -> DataFrame:
    """``df`` with dev, the value less its rolling mean."""
    return uniform_means(df.select(*SERIES, "frame_idx", "v"), n, ("v",)).withColumn("dev", F.col("v") - F.col("m_v")).drop("m_v")


def _phase(rows: pa.Table) -> pa.Table:
    """Phase of the analytic signal of one series, by FFT."""
    rows = rows.sort_by("frame_idx")
    x = rows.column("v").to_numpy()
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return rows.select(["track", "stem", "frame_idx"]).append_column("phase", pa.array(np.angle(np.fft.ifft(np.fft.fft(x - x.mean()) * gain))))


def phases(df: DataFrame) -> DataFrame:
    """(track, stem, frame_idx, phase).  The transform takes the whole of a series: one task has its numbers, nothing else."""
    return df.select(*SERIES, F.col("frame_idx").cast("int").alias("frame_idx"), "v").groupBy(*SERIES).applyInArrow(_phase, "track long, stem string, frame_idx int, phase double")


def _products(both: DataFrame) -> DataFrame:
    a, b = F.col("a_dev"), F.col("b_dev")
    return both.withColumns({"ab": a * b, "aa": a * a, "bb": b * b})


def _correlation() -> Column:
    deviation = lambda c: F.sqrt(F.greatest(F.col(c), F.lit(0.0)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("m_ab") / (deviation("m_aa") * deviation("m_bb") + 1e-8)))


def _turns(both: DataFrame) -> DataFrame:
    """With c and s, cosine and sine of the phase difference."""
    gap = F.col("a_phase") - F.col("b_phase")
    return both.withColumns({"c": F.cos(gap), "s": F.sin(gap)})


def _locking() -> Column:
    return F.sqrt(F.col("m_c") * F.col("m_c") + F.col("m_s") * F.col("m_s"))


def _one_loud() -> Column:
    loud = lambda c: F.col(c) / SCALE > LOUD_LEVEL
    return (loud("a_v") != loud("b_v")).cast("double")


def local_correlation(df: DataFrame, n: int = LOCAL, pairs=None) -> DataFrame:
    """Correlation of each pair about each sample's own rolling mean, by two passes of rolling means; clipped to [-1, 1]."""
    means = uniform_means(_products(paired(deviations(df, n), ("dev",), pairs)).select(*PAIR, "frame_idx", "ab", "aa", "bb"), n, ("ab", "aa", "bb"), PAIR)
    return means.select(*PAIR, "frame_idx", _correlation().alias("local_corr"))


def phase_locking(df: DataFrame, n: int = WINDOW, pairs=None) -> DataFrame:
    """Modulus of the rolling mean of exp(i * phase difference) of each pair, edges reflected."""
    turns = _turns(paired(phases(df), ("phase",), pairs)).select(*PAIR, "frame_idx", "c", "s")
    return uniform_means(turns, n, ("c", "s"), PAIR).select(*PAIR, "frame_idx", _locking().alias("plv"))


def matched_events(df: DataFrame, tolerance: int = RADIUS, pairs=None) -> DataFrame:
    """Onsets of the first stem of each pair with one of the second within ``tolerance`` frames: a band join by buckets."""
    size = tolerance + 1
    beats = df.filter(F.col("v") > BEAT).select("track", "stem", "frame_idx", F.floor(F.col("frame_idx") / size).alias("bucket"))
    a = beats.select("track", F.col("stem").alias("stem_a"), "frame_idx", F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])).alias("bucket"))
    b = beats.select("track", F.col("stem").alias("stem_b"), F.col("frame_idx").alias("other"), "bucket")
    near = a.hint("merge").join(b, ["track", "bucket"]).filter((F.col("stem_a") < F.col("stem_b")) & (F.abs(F.col("frame_idx") - F.col("other")) <= tolerance))
    if pairs is not None:
        near = near.filter(F.concat_ws("|", "stem_a", "stem_b").isin(*["|".join(sorted(p)) for p in pairs]))
    return near.select(*PAIR, "frame_idx").distinct()


def _marked(grid: DataFrame, df: DataFrame, tolerance: int, pairs) -> DataFrame:
    """``grid`` with hit: 1 within ``tolerance`` frames of a matched onset."""
    around = F.sequence(F.col("frame_idx") - tolerance, F.col("frame_idx") + tolerance)
    marks = matched_events(df, tolerance, pairs).select(*PAIR, F.explode(around).alias("frame_idx")).distinct().withColumn("hit", F.lit(1.0))
    return grid.hint("merge").join(marks, [*PAIR, "frame_idx"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))


def onset_sync(df: DataFrame, tolerance: int = RADIUS, pairs=None) -> DataFrame:
    """Matched onsets of each pair mark the frames within the tolerance; smoothed and clipped."""
    grid = paired(df, ("v",), pairs).select(*PAIR, "frame_idx")
    return gaussians(_marked(grid, df, tolerance, pairs), {"sync": ("hit", tolerance / 2)}, PAIR).select(*PAIR, "frame_idx", clamp(F.col("sync")).alias("sync"))


def call_response(df: DataFrame, window: int = TURN, pairs=None) -> DataFrame:
    """Frames at which exactly one stem of a pair is loud, smoothed."""
    one = paired(df, ("v",), pairs).select(*PAIR, "frame_idx", _one_loud().alias("one"))
    return gaussians(one, {"response": ("one", window / 4)}, PAIR).select(*PAIR, "frame_idx", clamp(F.col("response")).alias("response"))


def coupled(df: DataFrame, n: int = WINDOW, pairs=None) -> DataFrame:
    """Each frame of each pair with local_corr, plv, sync, response and lock.

    The stems' channels are computed once each and meet once; all rolling means of a
    pair are one pass, its smoothed curves another.  lock is 0.40 (correlation + 1) / 2 + 0.35 phase locking +
    0.25 onset synchrony.
    """
    df = materialize(df.select(*SERIES, F.col("frame_idx").cast("int").alias("frame_idx"), "v"), "stems")
    channels = materialize(deviations(df, n).hint("merge").join(phases(df), [*SERIES, "frame_idx"]), "channels")
    both = _turns(_products(paired(channels, ("v", "dev", "phase"), pairs))).withColumn("one", _one_loud())
    means = uniform_means(both.select(*PAIR, "frame_idx", "one", "ab", "aa", "bb", "c", "s"), n, ("ab", "aa", "bb", "c", "s"), PAIR)
    known = means.select(*PAIR, "frame_idx", "one", _correlation().alias("local_corr"), _locking().alias("plv"))
    curves = gaussians(_marked(known, df, RADIUS, pairs), {"sync": ("hit", RADIUS / 2), "response": ("one", TURN / 4)}, PAIR)
    curves = curves.withColumns({"sync": clamp(F.col("sync")), "response": clamp(F.col("response"))})
    lock = clamp(0.40 * (F.col("local_corr") + 1) / 2 + 0.35 * F.col("plv") + 0.25 * F.col("sync"))
    return curves.select(*PAIR, "frame_idx", "local_corr", "plv", "sync", "response", lock.alias("lock"))


def lock_index(df: DataFrame, pairs=None) -> DataFrame:
    return coupled(df, WINDOW, pairs).select(*PAIR, "frame_idx", "lock")


def mean_lock(df: DataFrame) -> DataFrame:
    return lock_index(df).groupBy(*PAIR).agg(clamp(F.avg("lock")).alias("mean_lock"))


QUERIES = {
    "win_local_corr": lambda s, d: local_correlation(frames(s, d)),
    "win_plv": lambda s, d: phase_locking(frames(s, d)),
    "join_event_tolerance": lambda s, d: matched_events(frames(s, d)),
    "win_onset_sync": lambda s, d: onset_sync(frames(s, d)),
    "win_call_response": lambda s, d: call_response(frames(s, d)),
    "win_lock_index": lambda s, d: lock_index(frames(s, d)),
    "agg_mean_lock": lambda s, d: mean_lock(frames(s, d)),
}

_K = ", ".join(PAIR)
_ON = "x.track = y.track AND x.frame_idx = y.frame_idx AND x.stem < y.stem"
_AB = "x.track, x.stem AS stem_a, y.stem AS stem_b, x.frame_idx"


def smooth_sql(source: str, sigma: float, value: str, keys: str, name: str) -> str:
    """CTE ``name``(keys, frame_idx, smooth) of ``source``."""
    weights = kernel(sigma)
    r = len(weights) // 2
    return f"""{name} AS (SELECT {keys}, frame_idx, list_dot_product(near, [{', '.join(f'{w!r}::DOUBLE' for w in weights)}]) AS smooth FROM (
  SELECT *, list(x) OVER (PARTITION BY {keys} ORDER BY place ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS near FROM (
    SELECT {keys}, frame_idx, ({value})::DOUBLE AS x, true AS own, frame_idx AS place FROM {source}
    UNION ALL SELECT {keys}, frame_idx, {value}, false, -frame_idx - 1 FROM {source} WHERE frame_idx < {r}
    UNION ALL SELECT {keys}, frame_idx, {value}, false, 2 * {N} - 1 - frame_idx FROM {source} WHERE frame_idx >= {N} - {r})) WHERE own)"""


def _local_sql(n: int) -> str:
    return f"""{_uniform('frames', n, 'v', 'track, stem', 'rolled')},
both_dev AS (SELECT {_AB}, x.v_orig - x.smooth AS a, y.v_orig - y.smooth AS b FROM rolled x JOIN rolled y ON {_ON}),
{_uniform('both_dev', n, 'a * b', _K, 'mab')}, {_uniform('both_dev', n, 'a * a', _K, 'maa')}, {_uniform('both_dev', n, 'b * b', _K, 'mbb')},
corr_ AS (SELECT {_K}, frame_idx, greatest(-1.0, least(1.0, mab.smooth / (sqrt(greatest(maa.smooth, 0.0)) * sqrt(greatest(mbb.smooth, 0.0)) + 1e-8))) AS local_corr FROM mab JOIN maa USING ({_K}, frame_idx) JOIN mbb USING ({_K}, frame_idx))"""


def _plv_sql() -> str:
    """Phases by the kernel of the discrete Hilbert transform, which is what the FFT does."""
    m = "(t.frame_idx - k.frame_idx)"
    even = f"CASE WHEN {m} % 2 = 0 THEN 0.0 ELSE 2.0::DOUBLE / n / tan(pi() * {m} / n) END"
    odd = f"(1 / tan(pi() * {m} / n) - cos(pi() * {m}) / sin(pi() * {m} / n)) / n"
    return f"""centred AS MATERIALIZED (SELECT track, stem, frame_idx, v - avg(v) OVER (PARTITION BY track, stem) AS x FROM frames),
hilbert AS MATERIALIZED (SELECT t.track, t.stem, t.frame_idx, any_value(t.x) AS x, sum(CASE WHEN {m} = 0 THEN 0.0 WHEN n % 2 = 0 THEN k.x * {even} ELSE k.x * {odd} END) AS h FROM centred t JOIN centred k ON t.track = k.track AND t.stem = k.stem, span GROUP BY t.track, t.stem, t.frame_idx),
gap AS (SELECT {_AB}, atan2(x.h, x.x) - atan2(y.h, y.x) AS d FROM hilbert x JOIN hilbert y ON {_ON}),
{_uniform('gap', WINDOW, 'cos(d)', _K, 'mc')}, {_uniform('gap', WINDOW, 'sin(d)', _K, 'ms')},
plv_ AS (SELECT {_K}, frame_idx, sqrt(mc.smooth * mc.smooth + ms.smooth * ms.smooth) AS plv FROM mc JOIN ms USING ({_K}, frame_idx))"""


_HITS = f"""hits AS (SELECT DISTINCT x.track, x.stem AS stem_a, y.stem AS stem_b, x.frame_idx FROM (SELECT * FROM frames WHERE v > {BEAT}) x JOIN (SELECT * FROM frames WHERE v > {BEAT}) y
  ON x.track = y.track AND x.stem < y.stem AND y.frame_idx BETWEEN x.frame_idx - {RADIUS} AND x.frame_idx + {RADIUS})"""
_SYNC = f"""{_HITS}, marks AS (SELECT DISTINCT {_K}, frame_idx + o AS frame_idx FROM hits, (SELECT unnest(range(-{RADIUS}, {RADIUS} + 1)) AS o)),
marked AS (SELECT g.*, (m.frame_idx IS NOT NULL)::INT AS x1 FROM (SELECT {_AB} FROM frames x JOIN frames y ON {_ON}) g LEFT JOIN marks m ON g.track = m.track AND g.stem_a = m.stem_a AND g.stem_b = m.stem_b AND g.frame_idx = m.frame_idx),
{smooth_sql('marked', RADIUS / 2, 'x1', _K, 'sync0')}, sync_ AS (SELECT {_K}, frame_idx, greatest(0.0, least(1.0, smooth)) AS sync FROM sync0)"""
_LOCK = f"""{_local_sql(WINDOW)}, {_plv_sql()}, {_SYNC},
lock_ AS (SELECT {_K}, frame_idx, greatest(0.0, least(1.0, 0.40 * (local_corr + 1) / 2 + 0.35 * plv + 0.25 * sync)) AS lock FROM corr_ JOIN plv_ USING ({_K}, frame_idx) JOIN sync_ USING ({_K}, frame_idx))"""

ORACLE_SQL = {
    "win_local_corr": f"WITH {_FRAMES}, {_local_sql(LOCAL)} SELECT * FROM corr_",
    "win_plv": f"WITH {_FRAMES}, {_plv_sql()} SELECT * FROM plv_",
    "join_event_tolerance": f"WITH {_FRAMES}, {_HITS} SELECT * FROM hits",
    "win_onset_sync": f"WITH {_FRAMES}, {_SYNC} SELECT * FROM sync_",
    "win_call_response": f"""WITH {_FRAMES}, one AS (SELECT {_AB}, ((x.v / {SCALE} > {LOUD_LEVEL}) <> (y.v / {SCALE} > {LOUD_LEVEL}))::INT AS x1 FROM frames x JOIN frames y ON {_ON}),
{smooth_sql('one', TURN / 4, 'x1', _K, 'response0')} SELECT {_K}, frame_idx, greatest(0.0, least(1.0, smooth)) AS response FROM response0""",
    "win_lock_index": f"WITH {_FRAMES}, {_LOCK} SELECT * FROM lock_",
    "agg_mean_lock": f"WITH {_FRAMES}, {_LOCK} SELECT {_K}, greatest(0.0, least(1.0, avg(lock))) AS mean_lock FROM lock_ GROUP BY {_K}",
}
