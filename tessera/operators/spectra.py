"""Array operators on spectra and vectors, and scalar rules on frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.search import dot, unit
from tessera.operators.series import _FRAMES, SERIES, _fold_sql, folded, frames
from tessera.session import table

BINS = 64


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, m): magnitudes of 64 bins from the embedding table."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("m"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def power(m: Column) -> Column:
    return F.transform(m, lambda x: x * x)


def shares(v: Column) -> Column:
    """Values over their sum; zeros where the sum is zero."""
    s = total(v)
    return F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(0.0))


def entropy(m: Column) -> Column:
    """Entropy of the power spectrum over the logarithm of its size."""
    return total(F.transform(shares(power(m)), lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0))) / F.log(F.lit(float(BINS)))


def centroid(m: Column) -> Column:
    """Mean bin, weighted by magnitude; 0 for silence."""
    return F.when(total(m) > 0, total(F.transform(m, lambda x, i: x * i)) / total(m)).otherwise(0.0)


def flatness(m: Column) -> Column:
    """Geometric over arithmetic mean of power, floors at 1e-10."""
    p = F.transform(m, lambda x: F.greatest(x * x, F.lit(1e-10)))
    return F.exp(total(F.transform(p, lambda x: F.log(x))) / BINS) / (total(p) / BINS)


def circular_mean(w: Column) -> Column:
    """Angle of twelve bins of weights as a share of the circle; 0.5 if they balance out."""
    step = 2 * 3.141592653589793 / 12
    s = total(F.transform(w, lambda x, i: x * F.sin(i * step)))
    c = total(F.transform(w, lambda x, i: x * F.cos(i * step)))
    turn = F.atan2(s, c) / (2 * 3.141592653589793)
    return F.when(F.sqrt(s * s + c * c) < 1e-6, 0.5).otherwise(F.when(turn < 0, turn + 1).otherwise(turn))


def slerp(a: Column, b: Column, t: float) -> Column:
    """Spherical interpolation of unit vectors; straight where they are close."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
    angle = F.acos(cosine)
    near = F.abs(F.sin(angle)) < 1e-6
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle))
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: wa * z["x"] + wb * z["y"])


def overlap(a: Column, b: Column) -> Column:
    """Twice the shared mass of two normalised spectra, at most one."""
    return F.least(F.lit(1.0), 2 * total(F.zip_with(shares(a), shares(b), lambda x, y: F.least(x, y))))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two distributions over ln 2."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(0.0)

    both = F.arrays_zip(p.alias("p"), q.alias("q"))
    return total(F.transform(both, lambda z: 0.5 * part(z["p"], (z["p"] + z["q"]) / 2) + 0.5 * part(z["q"], (z["p"] + z["q"]) / 2))) / F.log(F.lit(2.0))


def top_peaks(df: DataFrame, k: int = 20) -> DataFrame:
    """The k largest bins above bin 2 of each spectrum, by value, then bin."""
    cells = df.select("vec_id", F.posexplode("m").alias("bin", "mag")).filter("bin > 2")
    order = Window.partitionBy("vec_id").orderBy(F.desc("mag"), "bin")
    return cells.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


#: Hertz of a bin, peaks of a spectrum, and the curve of dissonance over the critical band.
BIN_HZ, PEAKS = 12.0, 20
BAND_SCALE, BAND_SLOPE, BAND_FLOOR, SOFT, SHARP = 0.24, 0.021, 19.0, -3.5, -5.75


def roughness(df: DataFrame) -> DataFrame:
    """Sum over the pairs of a spectrum's largest peaks of their dissonance, times four, at most one; amplitudes are shares of the peaks' sum."""
    listed = top_peaks(df, PEAKS).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("bin", "mag"))).alias("p"), F.greatest(F.sum("mag"), F.lit(1e-10)).alias("all"))

    def pair(x: Column, y: Column) -> Column:
        gap = (y["bin"] - x["bin"]) * BIN_HZ * BAND_SCALE / (BAND_SLOPE * BIN_HZ * x["bin"] + BAND_FLOOR)
        return F.greatest(F.lit(0.0), x["mag"] / F.col("all") * (y["mag"] / F.col("all")) * (F.exp(SOFT * gap) - F.exp(SHARP * gap)))

    pairs = F.flatten(F.transform("p", lambda x: F.transform(F.filter("p", lambda y: y["bin"] > x["bin"]), lambda y: pair(x, y))))
    return listed.select("vec_id", F.least(F.lit(1.0), 4 * total(pairs)).alias("roughness"))


def tension(df: DataFrame) -> DataFrame:
    """Entropy where a spectrum has much of it, else roughness; with a confidence (five times the largest share), more roughness the surer it is."""
    e, r = F.col("entropy"), F.col("roughness")
    x = roughness(df).hint("merge").join(df.select("vec_id", entropy(F.col("m")).alias("entropy"), clamp(5 * F.array_max(F.col("m")) / total(F.col("m"))).alias("confidence")), "vec_id")
    blend = 1 / (1 + F.exp(-10 * (F.col("confidence") - 0.3)))
    return x.select("vec_id", ((1 - clamp(e)) * r + clamp(e) * e).alias("tension"), (blend * r + (1 - blend) * e).alias("sure_tension"))


def flux(df: DataFrame) -> DataFrame:
    """Positive change of each bin's share since the spectrum before, summed, over the largest such sum of the label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    x = df.withColumn("m", shares(F.col("m")))
    raw = x.withColumn("before", F.lag("m").over(w)).withColumn("raw", F.when(F.col("before").isNull(), 0.0).otherwise(total(F.zip_with("m", "before", lambda x, y: F.greatest(F.lit(0.0), x - y)))))
    top = F.max("raw").over(Window.partitionBy("label"))
    return raw.withColumn("top", top).select("label", "vec_id", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0).alias("flux"))


#: Time constants of tonal distance in frames: quick for rises, slow for returns.
RISE, RETURN = 3.6, 24.0


def jsd_to_mean(df: DataFrame) -> DataFrame:
    """Divergence of each spectrum's distribution from its label's mean one, smoothed from the first on and put between its 5th and 95th percentile."""
    dist = df.select("label", "vec_id", shares(F.col("m")).alias("p"), F.col("m"))
    sums = df.select("label", F.posexplode("m").alias("bin", "x")).groupBy("label", "bin").agg(F.sum("x").alias("x"))
    mean = sums.groupBy("label").agg(shares(F.transform(F.sort_array(F.collect_list(F.struct("bin", "x"))), lambda z: z["x"])).alias("q"))
    raw = dist.hint("merge").join(mean, "label").select(F.col("label").alias("track"), F.lit("all").alias("stem"), F.col("vec_id").alias("frame_idx"), clamp(divergence(F.col("p"), F.col("q"))).alias("jsd"))
    up, down = 1 - math.exp(-1 / RISE), 1 - math.exp(-1 / RETURN)

    def step(state: tuple, x: float) -> tuple:
        y = state[0]
        return (x if y is None else y + (up if x > y else down) * (x - y),)

    smooth = folded(raw, step, (None,), ("jsd",), "smooth")
    q = smooth.groupBy("track").agg(F.percentile("smooth", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    width = F.col("q")[1] - F.col("q")[0]
    return smooth.hint("merge").join(q, "track").select(F.col("track").alias("label"), F.col("frame_idx").cast("long").alias("vec_id"), F.when(width > 1e-6, clamp((F.col("smooth") - F.col("q")[0]) / width)).otherwise(0.0).alias("distance"))


def _labelled(s, d):
    return table(s, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("m"))


def _pairs(s, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(s, d, "embeddings")
    return e.withColumn("other", F.lag("embedding").over(w)).filter("other IS NOT NULL").select("vec_id", unit(F.col("embedding")).alias("a"), unit(F.col("other")).alias("b"))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def _rules(s, d):
    """Scalar rules of one frame value: clean, intensity curves, gate, stage map, log pitch, frame of a time."""
    x = F.col("v") / 250.0
    return frames(s, d).select(
        *SERIES, "frame_idx",
        clamp(x).alias("linear"), F.pow(clamp(x), 2.2).alias("gamma"), clamp(1.5 * x).alias("clipped"),
        clamp((F.when(F.col("v") > 0, F.greatest(F.lit(-40.0), 20 * F.log10(F.col("v") / 500.0))).otherwise(-40.0) + 40) / 40).alias("gate"),
        clamp((0.5 + 0.8 * (0.1 + clamp(x) * 0.8 - 0.5))).alias("staged"),
        clamp(F.log(F.greatest(F.col("v"), F.lit(80.0)) / 80.0) / F.log(F.lit(2000.0 / 80.0))).alias("pitch"),
        F.least(F.floor(12 * clamp(x)), F.lit(11)).cast("int").alias("pitch_bin"),
        F.bround(F.col("frame_idx") * 0.5).cast("int").alias("half_frame"),
    )


def _dirty(s, d):
    """Curves with NaN and infinities put in by rule, cleaned again."""
    dirty = F.when(F.col("frame_idx") % 7 == 0, F.lit(float("nan"))).when(F.col("frame_idx") % 11 == 0, F.lit(float("inf"))).when(F.col("frame_idx") % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("v") / 250.0)
    return frames(s, d).select(*SERIES, "frame_idx", dirty.alias("x"))


def clean(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), 1.0).when(x == float("-inf"), 0.0).otherwise(clamp(x))


QUERIES = {
    "fn_entropy": lambda s, d: spectra(s, d).select("vec_id", entropy(F.col("m")).alias("entropy")),
    "fn_centroid": lambda s, d: spectra(s, d).select("vec_id", centroid(F.col("m")).alias("centroid")),
    "fn_flatness": lambda s, d: spectra(s, d).select("vec_id", flatness(F.col("m")).alias("flatness")),
    "fn_circular_mean": lambda s, d: spectra(s, d).select("vec_id", circular_mean(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda b: total(F.filter(F.col("m"), lambda x, i: i % 12 == b)))).alias("turn")),
    "fn_slerp": lambda s, d: _pairs(s, d).select("vec_id", slerp(F.col("a"), F.col("b"), 0.3).alias("v")).select("vec_id", dot(F.col("v"), F.col("v")).alias("norm2"), F.element_at("v", 1).alias("first")),
    "fn_spectral_overlap": lambda s, d: _pairs(s, d).select("vec_id", overlap(F.transform("a", lambda x: F.abs(x)), F.transform("b", lambda x: F.abs(x))).alias("overlap")),
    "top_spectral_peaks": lambda s, d: top_peaks(spectra(s, d)),
    "fn_roughness": lambda s, d: roughness(spectra(s, d)),
    "fn_tension": lambda s, d: tension(spectra(s, d)),
    "win_first_diff_flux": lambda s, d: flux(_labelled(s, d)),
    "win_jsd_distance": lambda s, d: jsd_to_mean(_labelled(s, d)),
    "fn_mask_active": lambda s, d: spectra(s, d).select("vec_id", F.size(F.filter("m", lambda x: x > 0)).cast("long").alias("active")),
    "fn_intensity_curve": _rules,
    "fn_clean_curve": lambda s, d: _dirty(s, d).select(*SERIES, "frame_idx", clean(F.col("x")).alias("clean")),
    "flt_finite": lambda s, d: _dirty(s, d).groupBy(*SERIES).agg(F.avg(F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))).alias("mean"), F.var_pop(F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))).alias("variance")),
    "fn_content_hash": lambda s, d: table(s, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_hash")),
    "fn_curve_name": lambda s, d: frames(s, d).select(*SERIES).distinct().select(*SERIES, F.concat_ws(":", F.lit("target"), F.col("track"), F.col("stem")).alias("name")).select("name", F.split("name", ":", 3)[1].alias("target"), F.split("name", ":", 3)[2].alias("channel")),
}

_M = "s AS (SELECT label, vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS m FROM embeddings)"
_P = "list_transform(m, lambda x: x * x / list_sum(list_transform(m, lambda z: z * z)))"
_U = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))))"
_PAIR = f"""pairs AS (SELECT vec_id, {_U.format('embedding')} AS a, {_U.format('other')} AS b FROM (
  SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings) WHERE other IS NOT NULL)"""
_CELLS = "cells AS (SELECT vec_id, unnest(range(0, 64))::INTEGER AS bin, unnest(m) AS mag FROM s)"
_FR = _FRAMES
_DIRTY = f"{_FR}, dirty AS (SELECT track, stem, frame_idx, CASE WHEN frame_idx % 7 = 0 THEN 'nan'::DOUBLE WHEN frame_idx % 11 = 0 THEN 'inf'::DOUBLE WHEN frame_idx % 13 = 0 THEN '-inf'::DOUBLE ELSE v / 250.0 END AS x FROM frames)"
_ROUGH = f"""{_M}, {_CELLS}, p AS (SELECT *, mag / greatest(sum(mag) OVER (PARTITION BY vec_id), 1e-10) AS amp FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mag DESC, bin) AS rn FROM cells WHERE bin > 2) WHERE rn <= {PEAKS}),
g AS (SELECT a.vec_id, a.amp * b.amp AS aa, (b.bin - a.bin) * {BIN_HZ} * {BAND_SCALE} / ({BAND_SLOPE} * {BIN_HZ} * a.bin + {BAND_FLOOR})::DOUBLE AS gap FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.bin < b.bin),
rough AS (SELECT vec_id, least(1.0, 4 * sum(greatest(0.0, aa * (exp({SOFT} * gap) - exp({SHARP} * gap))))) AS roughness FROM g GROUP BY vec_id)"""
_ENT = f"list_sum(list_transform({_P}, lambda p: CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END)) / ln(64)"
_CLAMP = "greatest(0.0, least(1.0, {0}))"
_X = _CLAMP.format("v / 250.0")

ORACLE_SQL = {
    "fn_entropy": f"WITH {_M} SELECT vec_id, {_ENT} AS entropy FROM s",
    "fn_centroid": f"WITH {_M}, {_CELLS} SELECT vec_id, sum(mag * bin) / sum(mag) AS centroid FROM cells GROUP BY vec_id",
    "fn_flatness": f"WITH {_M}, {_CELLS} SELECT vec_id, exp(avg(ln(greatest(mag * mag, 1e-10)))) / avg(greatest(mag * mag, 1e-10)) AS flatness FROM cells GROUP BY vec_id",
    "fn_circular_mean": f"""WITH {_M}, {_CELLS}, sc AS (SELECT vec_id, sum(mag * sin(bin * 2 * pi() / 12)) AS s, sum(mag * cos(bin * 2 * pi() / 12)) AS c FROM cells GROUP BY vec_id)
SELECT vec_id, CASE WHEN sqrt(s * s + c * c) < 1e-6 THEN 0.5 WHEN atan2(s, c) < 0 THEN atan2(s, c) / (2 * pi()) + 1 ELSE atan2(s, c) / (2 * pi()) END AS turn FROM sc""",
    "fn_slerp": f"""WITH {_PAIR}, w AS (SELECT *, acos(greatest(-1.0, least(1.0, list_dot_product(a, b)))) AS th FROM pairs),
k AS (SELECT *, CASE WHEN abs(sin(th)) < 1e-6 THEN 0.7 ELSE sin(0.7 * th) / sin(th) END AS wa, CASE WHEN abs(sin(th)) < 1e-6 THEN 0.3 ELSE sin(0.3 * th) / sin(th) END AS wb FROM w)
SELECT vec_id, wa * wa * list_dot_product(a, a) + 2 * wa * wb * list_dot_product(a, b) + wb * wb * list_dot_product(b, b) AS norm2, wa * a[1] + wb * b[1] AS first FROM k""",
    "fn_spectral_overlap": f"""WITH {_PAIR}, z AS (SELECT vec_id, unnest(list_transform(a, lambda x: abs(x) / list_sum(list_transform(a, lambda y: abs(y))))) AS p, unnest(list_transform(b, lambda x: abs(x) / list_sum(list_transform(b, lambda y: abs(y))))) AS q FROM pairs)
SELECT vec_id, least(1.0, 2 * sum(least(p, q))) AS overlap FROM z GROUP BY vec_id""",
    "top_spectral_peaks": f"WITH {_M}, {_CELLS} SELECT vec_id, bin, mag, rn FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY mag DESC, bin)::INTEGER AS rn FROM cells WHERE bin > 2) WHERE rn <= 20",
    "fn_roughness": f"WITH {_ROUGH} SELECT * FROM rough",
    "fn_tension": f"""WITH {_ROUGH}, x AS (SELECT vec_id, roughness AS r, {_ENT} AS e, {_CLAMP.format('5 * list_max(m) / list_sum(m)')} AS c FROM rough JOIN s USING (vec_id))
SELECT vec_id, (1 - {_CLAMP.format('e')}) * r + {_CLAMP.format('e')} * e AS tension, (1 / (1 + exp(-10 * (c - 0.3)))) * r + (1 - 1 / (1 + exp(-10 * (c - 0.3)))) * e AS sure_tension FROM x""",
    "win_first_diff_flux": f"""WITH {_M}, {_CELLS.replace('SELECT vec_id', 'SELECT label, vec_id')}, sh AS (SELECT label, vec_id, bin, mag / sum(mag) OVER (PARTITION BY vec_id) AS x FROM cells),
d AS (SELECT label, vec_id, bin, greatest(0.0, x - lag(x) OVER (PARTITION BY label, bin ORDER BY vec_id)) AS up, lag(x) OVER (PARTITION BY label, bin ORDER BY vec_id) AS b FROM sh),
raw AS (SELECT label, vec_id, sum(CASE WHEN b IS NULL THEN 0.0 ELSE up END) AS raw FROM d GROUP BY ALL)
SELECT label, vec_id, CASE WHEN max(raw) OVER (PARTITION BY label) > 0 THEN raw / max(raw) OVER (PARTITION BY label) ELSE 0.0 END AS flux FROM raw""",
    "win_jsd_distance": f"""WITH RECURSIVE {_M}, {_CELLS.replace('SELECT vec_id', 'SELECT label, vec_id')}, p AS (SELECT *, mag / sum(mag) OVER (PARTITION BY vec_id) AS p, sum(mag) OVER (PARTITION BY label, bin) / sum(mag) OVER (PARTITION BY label) AS q FROM cells),
j AS (SELECT label AS track, 'all' AS stem, vec_id::INTEGER AS frame_idx, {_CLAMP.format("sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END) / ln(2)")}::DOUBLE AS jsd FROM p GROUP BY ALL),
{_fold_sql('j', {'y': ('NULL::DOUBLE', f'CASE WHEN s.y IS NULL THEN x.jsd ELSE s.y + CASE WHEN x.jsd > s.y THEN {1 - math.exp(-1 / RISE)!r}::DOUBLE ELSE {1 - math.exp(-1 / RETURN)!r}::DOUBLE END * (x.jsd - s.y) END')}, 'f')},
q AS (SELECT track, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM f WHERE i > 0 GROUP BY track)
SELECT track AS label, frame_idx::BIGINT AS vec_id, CASE WHEN hi - lo > 1e-6 THEN {_CLAMP.format('(y - lo) / (hi - lo)')} ELSE 0.0 END AS distance FROM f JOIN q USING (track) WHERE i > 0""",
    "fn_mask_active": f"WITH {_M} SELECT vec_id, len(list_filter(m, lambda x: x > 0)) AS active FROM s",
    "fn_intensity_curve": f"""WITH {_FR} SELECT track, stem, frame_idx, {_X} AS linear, pow({_X}, 2.2) AS gamma, {_CLAMP.format('1.5 * v / 250.0')} AS clipped,
  {_CLAMP.format("(CASE WHEN v > 0 THEN greatest(-40.0, 20 * log10(v / 500.0)) ELSE -40.0 END + 40) / 40")} AS gate, {_CLAMP.format(f"0.5 + 0.8 * (0.1 + {_X} * 0.8 - 0.5)")} AS staged,
  {_CLAMP.format("ln(greatest(v, 80.0) / 80.0) / ln(25.0)")} AS pitch, least(floor(12 * {_X}), 11)::INTEGER AS pitch_bin, round_even(frame_idx * 0.5, 0)::INTEGER AS half_frame FROM frames""",
    "fn_clean_curve": f"WITH {_DIRTY} SELECT track, stem, frame_idx, CASE WHEN isnan(x) THEN 0.0 WHEN x = 'inf'::DOUBLE THEN 1.0 WHEN x = '-inf'::DOUBLE THEN 0.0 ELSE {_CLAMP.format('x')} END AS clean FROM dirty",
    "flt_finite": f"WITH {_DIRTY} SELECT track, stem, avg(x) FILTER (isfinite(x)) AS mean, var_pop(x) FILTER (isfinite(x)) AS variance FROM dirty GROUP BY ALL",
    "fn_content_hash": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents",
    "fn_curve_name": f"WITH {_FR} SELECT DISTINCT 'target:' || track || ':' || stem AS name, track::VARCHAR AS target, stem AS channel FROM frames",
}
