"""Scalar rules, tags and small joins over frames, labels and activations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import aligned
from tessera.operators import activation, search
from tessera.operators.series import _FRAMES, N, SCALE, SERIES, frames, hours, target_profile
from tessera.operators.spectra import clamp
from tessera.session import materialize, table


def stage_map(position: Column, left: Column, home: Column, right: Column, intensity: Column) -> Column:
    """Position on a stage, drawn home by intensity, back in [0, 1]; 0.5 where the stage has no width."""
    place = left + position * (right - left)
    moved = home + intensity * (place - home)
    return F.when(right - left <= 0, 0.5).otherwise(clamp((moved - left) / (right - left)))


def crop_window(row: Column, col: Column, grid: int = 4, image: int = 512, least: int = 160) -> tuple[Column, Column]:
    """Left and top of a pixel box around a cell, at least ``least`` wide and inside the image."""
    cell = image // grid
    size = max(cell, least)
    at = lambda i: F.greatest(F.lit(0), F.least(F.lit(image - size), (i * cell + cell // 2 - size // 2))).cast("int")
    return at(col), at(row)


def pitch_mask(level: Column, rows: int = 8, spread: float = 0.25) -> Column:
    """Weight of each row of a mask for one of twelve pitch levels: a Gaussian around its height to nine places, the lowest at the bottom."""
    centre = 1.0 - level / 11.0
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda y: F.round(F.exp(-(y / float(rows - 1) - centre) * (y / float(rows - 1) - centre) / (2 * spread * spread)), 9))


def number_list(text: Column) -> Column:
    """Distinct whole numbers 1 to 10 among the words of a reply, points and semicolons at their ends aside."""
    words = F.transform(F.split(F.translate(text, ",", " "), r"\s+"), lambda w: F.btrim(w, F.lit(".,;")))
    found = F.transform(F.filter(words, lambda w: F.rlike(w, F.lit("^[0-9]+$"))), lambda w: w.try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.between(1, 10))))


def _aligned(s, d):
    """Catalog labels against the top terms of the sources of documents, dealt to them by id."""
    docs = search._docs(s, d)
    top = search.top_terms(docs, 5).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda z: z["term"]).alias("terms"))
    listed = top.agg(F.sort_array(F.collect_list(F.struct("source", "terms"))).alias("sources"))  # five terms of each source
    one = search.catalog(s, d).crossJoin(F.broadcast(listed)).select("id", "label", F.get("sources", F.pmod(F.col("id"), F.size("sources")).cast("int")).alias("z"))
    return one.select("id", "z.source", aligned(F.col("label"), F.col("z.terms")).alias("aligned"))


def _top_weights(s, d):
    """The 100 top items of each feature, written, and the term weights of their documents."""
    top = materialize(activation.top_items(activation.aggregate_positions(activation.activation_log(s, d)), 100), "top-items")
    return top, search.tfidf(search._docs(s, d), among=top.select(F.col("item_id").alias("doc_id")))  # 100 for each feature


def supplements(s, d):
    """(block, feature_id, terms, spatial_pattern) of every feature: top terms of the prompts of its items, and where on the grid it fires."""
    top, weights = _top_weights(s, d)
    patterns = activation.spatial_pattern(activation.region_shares(activation.heat_map(top)))
    terms = activation.feature_terms(top, weights)
    return activation.dense(patterns.hint("merge").join(terms, ["block", "feature_id"], "left"))


def _replies(s, d):
    return table(s, d, "part").select("p_partkey", number_list(F.concat(F.col("p_size"), F.lit(", x10 "), F.col("p_partkey") % 13, F.lit(" 7. end;"))).alias("numbers"))


def _no_spatial(s, d):
    """Activations without the features that have a spatial pattern."""
    stats = activation.aggregate_positions(activation.activation_log(s, d))
    spatial = activation.spatial_pattern(activation.region_shares(activation.heat_map(stats))).filter("spatial_pattern IS NOT NULL")
    return stats.hint("merge").join(spatial, ["block", "feature_id"], "left_anti").select("block", "feature_id", "item_id")


def _scaled(s, d):
    stats = activation.aggregate_positions(activation.activation_log(s, d)).groupBy("block", "feature_id").agg(F.avg("mean_value").alias("m"))
    asked = s.range(256).select((F.col("id") % 4).cast("int").alias("block"), F.expr("id div 4").cast("int").alias("feature_id"))
    return asked.hint("merge").join(stats, ["block", "feature_id"], "left").select("block", "feature_id", (2.5 * F.coalesce("m", F.lit(0.0))).alias("strength"))


def _crops(s, d):
    x, y = crop_window(F.col("grid_row"), F.col("grid_col"))
    return activation.aggregate_positions(activation.activation_log(s, d)).select("block", "feature_id", "item_id", x.alias("x"), y.alias("y"))


QUERIES = {
    "fn_stage_map": lambda s, d: frames(s, d).select(*SERIES, "frame_idx", stage_map(clamp(F.col("v") / 500.0), F.lit(-20.0), F.lit(5.0), F.lit(30.0), F.lit(0.7)).alias("staged")),
    "fn_activity_gate": lambda s, d: frames(s, d).select(*SERIES, "frame_idx", F.when(F.col("v") > 0, clamp((20 * F.log10(F.col("v") / 500.0) + 40) / 40)).otherwise(0.0).alias("gate")),
    "fn_log_pitch": lambda s, d: frames(s, d).select(*SERIES, "frame_idx", clamp(F.log(F.greatest(F.col("v"), F.lit(80.0)) / 80.0) / F.log(F.lit(25.0))).alias("pitch")),
    "fn_pitch_bin": lambda s, d: frames(s, d).select(*SERIES, "frame_idx", F.least(F.floor(12 * clamp(F.col("v") / SCALE)), F.lit(11)).cast("int").alias("bin")).withColumn("mask", pitch_mask(F.col("bin"))),
    "fn_time_to_frame": lambda s, d: table(s, d, "events").crossJoin(F.broadcast(hours(table(s, d, "events")).select("n"))).select("event_id", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(F.col("event_id") * 0.25).cast("int"))).alias("frame")),
    "fn_crop_window": _crops,
    "fn_mean_scaling": _scaled,
    "fn_parse_number_list": _replies,
    "fn_tfidf_aligns": _aligned,
    "flt_spatial_exclude": _no_spatial,
    "snk_supplement_dense": supplements,
    "agg_percentile_bundle": lambda s, d: target_profile(frames(s, d)).select(*SERIES, "p10", "p50", "p90", "dynamic_range"),
    "agg_curve_score": lambda s, d: target_profile(frames(s, d)).select(*SERIES, "score"),
    "agg_active_ratio": lambda s, d: target_profile(frames(s, d)).select(*SERIES, "active_ratio"),
    "agg_onset_density": lambda s, d: target_profile(frames(s, d)).select(*SERIES, "onset_density"),
    "agg_mean_tfidf": lambda s, d: activation.term_means(*_top_weights(s, d)),
}

_ACT = activation.STATS_SQL
_TP = f"""q AS (SELECT track, stem, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, avg(v) AS mean_v, stddev_pop(v) AS sd, count(*) FILTER (v > 0) AS n FROM frames GROUP BY ALL),
tp AS (SELECT track, stem, p10, p50, p90, p90 - p10 AS dynamic_range, 0.5 * mean_v + 0.5 * p90 AS score, active_ratio, n / {N}::DOUBLE AS onset_density FROM q JOIN (
  SELECT track, stem, avg((v > greatest(0.08, p50 + 0.1 * sd))::INT) AS active_ratio FROM frames JOIN q USING (track, stem) GROUP BY ALL) USING (track, stem))"""
_C = "greatest(0.0, least(1.0, {0}))"
_X = _C.format("v / 500.0")

ORACLE_SQL = {
    "fn_stage_map": f"WITH {_FRAMES} SELECT track, stem, frame_idx, {_C.format(f'(5.0 + 0.7 * ((-20.0 + {_X} * 50.0) - 5.0) + 20.0) / 50.0')}::DOUBLE AS staged FROM frames",
    "fn_activity_gate": f"WITH {_FRAMES} SELECT track, stem, frame_idx, CASE WHEN v > 0 THEN {_C.format('(20 * log10(v / 500.0) + 40) / 40')} ELSE 0.0 END AS gate FROM frames",
    "fn_log_pitch": f"WITH {_FRAMES} SELECT track, stem, frame_idx, {_C.format('ln(greatest(v, 80.0) / 80.0) / ln(25.0)')} AS pitch FROM frames",
    "fn_pitch_bin": f"WITH {_FRAMES} SELECT track, stem, frame_idx, least(floor(12 * {_X}), 11)::INTEGER AS bin, list_transform(range(0, 8), lambda y: round(exp(-(y / 7.0::DOUBLE - (1 - least(floor(12 * {_X}), 11) / 11.0::DOUBLE)) * (y / 7.0::DOUBLE - (1 - least(floor(12 * {_X}), 11) / 11.0::DOUBLE)) / 0.125), 9)) AS mask FROM frames",
    "fn_time_to_frame": f"WITH {_FRAMES} SELECT event_id, greatest(0, least({N} - 1, round_even(event_id * 0.25, 0)::INTEGER)) AS frame FROM events",
    "fn_crop_window": f"WITH {_ACT} SELECT block, feature_id, item_id, greatest(0, least(352, grid_col * 128 - 16))::INTEGER AS x, greatest(0, least(352, grid_row * 128 - 16))::INTEGER AS y FROM stats",
    "fn_mean_scaling": f"""WITH {_ACT}, m AS (SELECT block, feature_id, avg(mean_value) AS m FROM stats GROUP BY ALL)
SELECT block, feature_id, 2.5 * coalesce(m, 0.0) AS strength FROM (SELECT (i % 4)::INTEGER AS block, (i // 4)::INTEGER AS feature_id FROM (SELECT unnest(range(0, 256)) AS i)) LEFT JOIN m USING (block, feature_id)""",
    "fn_parse_number_list": "SELECT p_partkey, list_sort(list_distinct(list_filter([p_size::BIGINT, p_partkey % 13, 7], lambda x: x BETWEEN 1 AND 10))) AS numbers FROM part",
    "fn_tfidf_aligns": f"""WITH {search._TFIDF}, {search._CAT}, m AS (SELECT source, term, round(sum(weight) / (SELECT count(*) FROM documents x WHERE x.source = d.source), 9) AS w FROM tfidf JOIN documents d USING (doc_id) GROUP BY source, term),
top AS (SELECT source, list(term ORDER BY rn) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, term) AS rn FROM m WHERE w > 0) WHERE rn <= 5 GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM top)
SELECT id, source, len(list_filter(terms, lambda t: contains(label, lower(t)) OR len(list_filter(string_split(label, ' '), lambda w: contains(lower(t), w))) > 0)) > 0 AS aligned FROM cat JOIN numbered ON id % k = i""",
    "snk_supplement_dense": activation.supplements_sql(search._TFIDF),
    "flt_spatial_exclude": f"WITH {activation._HEAT} SELECT block, feature_id, item_id FROM stats ANTI JOIN (SELECT * FROM patterns WHERE spatial_pattern IS NOT NULL) USING (block, feature_id)",
    "agg_percentile_bundle": f"WITH {_FRAMES}, {_TP} SELECT track, stem, p10, p50, p90, dynamic_range FROM tp",
    "agg_curve_score": f"WITH {_FRAMES}, {_TP} SELECT track, stem, score FROM tp",
    "agg_active_ratio": f"WITH {_FRAMES}, {_TP} SELECT track, stem, active_ratio FROM tp",
    "agg_onset_density": f"WITH {_FRAMES}, {_TP} SELECT track, stem, onset_density FROM tp",
    "agg_mean_tfidf": f"WITH {activation.STATS_SQL}, {search._TFIDF}, {activation._TERMS} SELECT block, feature_id, term, w AS mean_weight FROM fmean WHERE w > 0",
}
