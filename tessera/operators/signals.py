"""Target signals: several channels for each stem, component and derived target of a track, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.series import _FRAMES, _SECTIONS, SERIES, _series, band_stats, boundaries, framed_events, full_grid, hours
from tessera.operators.spectra import clamp
from tessera.session import materialize, table

#: Stems that are recorded; the others are bands of them.
PHYSICAL = ("click", "purchase", "view")
#: The stem whose position follows its chroma.
OTHER = "view"
CHANNELS = ("envelope", "energy_smooth", "transient", "flux", "brightness", "sustain", "tension", "tonal_distance", "novelty_long", "pitch_confidence", "chroma_centroid")
#: Frames of a second, for densities of onsets.
FPS = 4.0
#: The least correlation of coupled targets, their number, ranks kept, the least score.
COUPLED, PARTNERS, RANKED, LEAST = 0.45, 3, 6, 0.03
#: What each section category is ranked by.
CATEGORIES = {"primary_energy": "energy_smooth", "rhythmic_hits": "transient", "texture_motion": "flux", "bright_air": "brightness", "sustain_body": "sustain"}

BY = ("track", "target")


def stem_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of each stem on the grid of all hours: required ones, optional ones (null where a stem has none) and voiced.

    The envelope is the mean value of an hour's events over 250, at most one; brightness
    comes from their largest value, flatness from the least over the largest, pitch
    confidence from their number.  The error stem has no tension.
    """
    seen = framed_events(spark, sf_dir).groupBy(*SERIES, "frame_idx").agg(F.avg("value").alias("v"), F.count("*").alias("c"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    grid = full_grid(seen, hours(table(spark, sf_dir, "events"))).hint("merge").join(seen, [*SERIES, "frame_idx"], "left")
    raw = grid.select(
        *SERIES, "frame_idx", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("c", F.lit(0)).alias("c"), clamp(F.coalesce("v", F.lit(0.0)) / 250.0).alias("envelope"),
        clamp(F.coalesce("hi", F.lit(0.0)) / 500.0).alias("brightness"), F.when(F.col("hi") > 0, F.col("lo") / F.col("hi")).otherwise(0.0).alias("flatness"),
    )
    w = _series()
    step = F.coalesce(F.col("envelope") - F.lag("envelope").over(w), F.lit(0.0))
    wide = raw.withColumns(
        {
            "energy_smooth": F.avg("envelope").over(w.rowsBetween(-2, 2)),
            "transient": F.greatest(F.lit(0.0), step),
            "flux": F.abs(step),
            "sustain": F.avg("envelope").over(w.rowsBetween(-6, 0)),
            "flash": F.max("envelope").over(w.rowsBetween(-1, 0)),
            "pitch_confidence": F.least(F.col("c") / 3.0, F.lit(1.0)),
            "pitch_normalized": clamp(F.col("v") / 500.0),
            "chroma_centroid": F.col("v") / 10.0 - F.floor(F.col("v") / 10.0),
        }
    )
    return wide.withColumns(
        {
            "tension": F.when(F.col("stem") != "error", F.least(F.lit(1.0), 4 * F.abs(F.col("energy_smooth") - F.col("sustain")))),
            "tonal_distance": 0.5 * F.col("flux"),
            "novelty_long": F.avg("flux").over(w.rowsBetween(-12, 12)),
            "voiced": F.col("c") > 0,
        }
    ).drop("c")


def hpss_ratio(wide: DataFrame) -> DataFrame:
    """(track, stem, hpss_ratio): share of transients in transients and sustain; 0.5 for silence."""
    both = F.sum("transient") + F.sum("sustain")
    return wide.groupBy(*SERIES).agg(F.round(F.when(both > 0, F.sum("transient") / both).otherwise(0.5), 9).alias("hpss_ratio"))


def _derived(wide: DataFrame) -> DataFrame:
    """Energy-weighted tension (0.5 where no stem has any) and tonal distance, and the mean of the physical stems as global."""
    def weighted(c: str, default: float) -> Column:
        w = F.when(F.col(c).isNotNull(), F.col("energy_smooth") + 0.1)
        return F.coalesce(F.sum(F.col(c) * w) / F.sum(w), F.lit(default))

    physical = F.avg(F.when(F.col("stem").isin(*PHYSICAL), F.col("energy_smooth")))
    by = wide.groupBy("track", "frame_idx").agg(weighted("tension", 0.5).alias("tension"), weighted("tonal_distance", 0.0).alias("tonal_distance"), F.coalesce(physical, F.lit(0.0)).alias("global"))
    long = by.select("track", "frame_idx", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("x")) for t in ("tension", "tonal_distance", "global")])).alias("z"))
    x = F.col("x")
    delta = clamp(F.abs(F.coalesce(x - F.lag("x").over(Window.partitionBy(*BY).orderBy("frame_idx")), F.lit(0.0))))
    flat = long.select("track", "z.target", "frame_idx", clamp(F.col("z.x")).alias("x")).withColumn("delta", delta)
    only = lambda t: F.when(F.col("target") == t, x).otherwise(0.0)
    return flat.select(
        *BY, F.lit("derived").alias("grp"), "frame_idx", x.alias("envelope"), x.alias("energy_smooth"), F.col("delta").alias("transient"), F.col("delta").alias("flux"), only("tonal_distance").alias("brightness"),
        x.alias("sustain"), only("tension").alias("tension"), only("tonal_distance").alias("tonal_distance"), x.alias("novelty_long"), F.lit(None).cast("double").alias("pitch_confidence"), F.lit(None).cast("double").alias("chroma_centroid"), F.lit(False).alias("onset"),
    )


def target_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, target, grp, frame_idx, CHANNELS, onset) for stems, harmonic and percussive components and derived targets.

    A component's curve is the energy of its stem by the stem's share of transients, or the
    rest; harmonic ones keep less of transients and flux and have no onsets, percussive ones less of the sustain.
    """
    wide = stem_frames(spark, sf_dir)
    group = F.when(F.col("stem").isin(*PHYSICAL), "physical").otherwise("subband")
    stems = wide.select("track", F.col("stem").alias("target"), group.alias("grp"), "frame_idx", *CHANNELS, F.col("voiced").alias("onset"))
    parts = wide.filter(F.col("stem").isin(*PHYSICAL)).hint("merge").join(hpss_ratio(wide), list(SERIES)).withColumn("part", F.explode(F.array(F.lit("harmonic"), F.lit("percussive"))))
    soft = F.col("part") == "harmonic"
    curve = clamp(F.col("energy_smooth") * F.when(soft, 1 - F.col("hpss_ratio")).otherwise(F.col("hpss_ratio")))
    parts = parts.withColumn("target", F.concat_ws("_", "stem", "part")).withColumn("curve", curve)
    moved = F.abs(F.coalesce(F.col("curve") - F.lag("curve").over(Window.partitionBy(*BY).orderBy("frame_idx")), F.lit(0.0)))
    parts = parts.withColumn("moved", moved).select(
        *BY, F.lit("hpss").alias("grp"), "frame_idx", F.col("curve").alias("envelope"), F.col("curve").alias("energy_smooth"),
        F.when(soft, 0.35 * F.col("transient")).otherwise(F.greatest("transient", "flash")).alias("transient"),
        F.when(soft, 0.6 * F.col("flux")).otherwise(F.greatest("flux", "moved")).alias("flux"),
        "brightness", F.when(soft, F.greatest("sustain", "curve")).otherwise(0.5 * F.col("sustain")).alias("sustain"),
        "tension", "tonal_distance", "novelty_long", "pitch_confidence", "chroma_centroid", (~soft & F.col("voiced")).alias("onset"),
    )
    return stems.unionByName(parts).unionByName(_derived(wide))


def correlations(signals: DataFrame) -> DataFrame:
    """(track, target, partner, r): Pearson correlation of the energy of each two targets of a track, both ways; 0 for flat curves."""
    x = signals.select(*BY, "frame_idx", "energy_smooth")
    a, b = x.alias("a"), x.alias("b")
    same = (F.col("a.track") == F.col("b.track")) & (F.col("a.frame_idx") == F.col("b.frame_idx")) & (F.col("a.target") < F.col("b.target"))
    r = F.corr("a.energy_smooth", "b.energy_smooth")
    pairs = a.hint("merge").join(b, same).groupBy(F.col("a.track").alias("track"), F.col("a.target").alias("target"), F.col("b.target").alias("partner")).agg(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("r"))
    return pairs.unionByName(pairs.select("track", F.col("partner").alias("target"), F.col("target").alias("partner"), "r"))


def coupled(signals: DataFrame, least: float = COUPLED, k: int = PARTNERS) -> DataFrame:
    """The k partners of each target with the largest absolute correlation from ``least`` on."""
    w = Window.partitionBy(*BY).orderBy(F.desc(F.round(F.abs("r"), 9)), "partner")
    return correlations(signals).filter(F.abs("r") >= least).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def uniqueness(signals: DataFrame) -> DataFrame:
    """(track, target, uniqueness): one less the largest absolute correlation from COUPLED on."""
    top = F.coalesce(F.max(F.when(F.abs("r") >= COUPLED, F.abs("r"))), F.lit(0.0))
    return correlations(signals).groupBy(*BY).agg(F.round(clamp(1 - top), 9).alias("uniqueness"))


def target_profiles(signals: DataFrame) -> DataFrame:
    """Thirteen statistics of each target, and the variance and range that only the tags use."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    span = lambda c: clamp(q(c)[2] - q(c)[0])
    score = lambda c: clamp(0.5 * F.avg(c) + 0.5 * q(c)[2])
    zero = F.lit(0.0)
    base = signals.groupBy(*BY, "grp").agg(
        F.avg("energy_smooth").alias("mean_energy"), F.max("energy_smooth").alias("peak_energy"), span("energy_smooth").alias("dynamic_range"),
        F.greatest(F.lit(0.08), q("energy_smooth")[1] + 0.1 * F.stddev_pop("energy_smooth")).alias("bar"),
        (F.count_if("onset") / F.greatest(F.count("*") / FPS, F.lit(0.1))).alias("onset_density"), score("transient").alias("hits"), score("flux").alias("flux_score"), score("brightness").alias("brightness_score"), score("sustain").alias("sustain_score"),
        clamp(F.coalesce(F.avg("pitch_confidence"), zero)).alias("pitch_confidence"), F.when(F.count("chroma_centroid") > 0, span("chroma_centroid")).otherwise(0.0).alias("chroma_motion"), span("brightness").alias("brightness_dynamic"), F.coalesce(F.var_pop("tension"), zero).alias("tension_variance"),
    )
    active = signals.hint("merge").join(base.select(*BY, "bar"), list(BY)).groupBy(*BY).agg(F.avg((F.col("energy_smooth") > F.col("bar")).cast("double")).alias("active_ratio"))
    joined = base.hint("merge").join(active, list(BY)).hint("merge").join(uniqueness(signals), list(BY))
    flat = F.col("dynamic_range") < 0.03
    own = F.when(flat & (F.col("peak_energy") < 0.05), 0.0).when(flat, 0.3 * F.col("uniqueness")).otherwise(F.col("uniqueness"))
    return joined.select(
        *BY, "grp", "mean_energy", "peak_energy", "dynamic_range", "active_ratio", "onset_density", F.greatest("hits", F.least(F.col("onset_density") / 3, F.lit(1.0))).alias("transient_score"),
        "flux_score", "brightness_score", "sustain_score", "pitch_confidence", "chroma_motion", "tension_variance", own.alias("uniqueness_score"), "brightness_dynamic",
    )


#: Words, uses and sources with the rules (SQL conditions on the profile) that give them, in order.
MOVEMENT = (
    ("punchy", "transient_score >= 0.45"), ("busy", "onset_density >= 1.4"), ("sparse", "active_ratio <= 0.25"), ("sustained", "sustain_score >= 0.55"), ("wide_swing", "dynamic_range >= 0.35"),
    ("changing", "flux_score >= 0.45"), ("bright", "brightness_score >= 0.6"), ("pitched", "pitch_confidence >= 0.3"), ("pitch_moving", "chroma_motion >= 0.2"), ("distinct", "uniqueness_score >= 0.6"),
)
USES = (
    ("rhythmic_hits", "transient_score >= 0.4"), ("detail_punctuation", "transient_score >= 0.4"), ("continuous_body", "sustain_score >= 0.5"), ("texture_motion", "flux_score >= 0.4"),
    ("bright_air", "brightness_score >= 0.55 OR target LIKE '%_high'"), ("primary_driver", "dynamic_range >= 0.3 AND uniqueness_score >= 0.45"), ("prompt_position", "pitch_confidence >= 0.3 OR chroma_motion >= 0.18"),
    ("section_or_harmony_arc", "tension_variance >= 0.01 OR target IN ('tension', 'tonal_distance')"),
)
AFFORDANCES = (
    ("pitch", "pitch_confidence >= 0.3"), ("chroma", "chroma_motion >= 0.18"), ("brightness", "brightness_dynamic >= 0.18"), ("tension", "tension_variance >= 0.01 OR target = 'tension'"), ("tension_global", "target = 'tension'"),
)
#: Formulas of the six driver rankings.
HIGH = "CASE WHEN target LIKE '%_high' OR brightness_score >= 0.6 THEN 1.0 ELSE 0.0 END"
SWAY = "least(tension_variance * 12.0, 1.0)"
DRIVERS = {
    "primary_driver": "0.25 * mean_energy + 0.25 * dynamic_range + 0.25 * uniqueness_score + 0.15 * sustain_score + 0.10 * active_ratio",
    "rhythmic_hits": "0.55 * transient_score + 0.20 * dynamic_range + 0.15 * uniqueness_score + 0.10 * flux_score",
    "texture_motion": "0.45 * flux_score + 0.25 * brightness_score + 0.15 * dynamic_range + 0.15 * uniqueness_score",
    "prompt_position": f"0.35 * pitch_confidence + 0.25 * chroma_motion + 0.20 * brightness_score + 0.15 * {SWAY} + 0.05 * uniqueness_score",
    "slow_arc": f"0.35 * {SWAY} + 0.25 * sustain_score + 0.25 * dynamic_range + 0.15 * uniqueness_score",
    "bright_air": f"0.40 * brightness_score + 0.30 * flux_score + 0.20 * transient_score + 0.10 * {HIGH}",
}
SOURCE = "CASE WHEN transient_score >= 0.45 THEN 'transient' WHEN flux_score >= 0.4 THEN 'flux' WHEN dynamic_range >= 0.2 THEN 'energy_smooth' ELSE 'envelope' END"


def tagged(rules: tuple, default: str) -> Column:
    """Names of the rules that hold, in order; ``default`` where none does."""
    found = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules]))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def tags(profiles: DataFrame) -> DataFrame:
    """Words, uses, preferred source and position sources of each target."""
    return profiles.select(
        *BY, tagged(MOVEMENT, "steady").alias("movement_words"), tagged(USES, "supporting_driver").alias("good_for"), F.expr(SOURCE).alias("preferred_source"), tagged(AFFORDANCES, "auto").alias("affordances")
    )


def ranked_drivers(profiles: DataFrame, k: int = RANKED) -> DataFrame:
    """The k targets of each track with the highest score in each of six rankings, with their first three movement words as reasons."""
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), clamp(F.expr(formula).cast("double")).alias("score")) for name, formula in DRIVERS.items()])
    reasons = F.array_join(F.slice(tagged(MOVEMENT, "steady"), 1, 3), "+")
    long = profiles.select(*BY, reasons.alias("reasons"), F.explode(kinds).alias("z")).select(*BY, "reasons", "z.kind", "z.score").filter(F.col("score") > LEAST)
    order = Window.partitionBy("track", "kind").orderBy(F.desc(F.round("score", 9)), "target")
    return long.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def section_targets(signals: DataFrame, sections: DataFrame, k: int = 5) -> DataFrame:
    """The k targets of each section with the highest 0.65 max + 0.35 mean of the channel of each category."""
    stats = band_stats(signals.withColumnRenamed("target", "stem"), sections, tuple(CATEGORIES.values()))
    kinds = F.array(*[F.struct(F.lit(name).alias("category"), F.col(f"mean_{c}").alias("mean_v"), F.col(f"max_{c}").alias("max_v"), F.col(f"delta_{c}").alias("delta")) for name, c in CATEGORIES.items()])
    long = stats.select("track", "section", F.col("stem").alias("target"), F.explode(kinds).alias("z")).select("track", "section", "target", "z.*")
    scored = long.withColumn("score", clamp(0.65 * F.col("max_v") + 0.35 * F.col("mean_v"))).filter(F.col("score") > LEAST)
    w = Window.partitionBy("track", "section", "category").orderBy(F.desc(F.round("score", 9)), "target")
    return scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def window_targets(signals: DataFrame, reach: int = 12, k: int = RANKED) -> DataFrame:
    """At each frame the k targets that lead each category over the coming frames, and the k of those that rise most."""
    w = Window.partitionBy(*BY).orderBy("frame_idx")
    ahead, behind = w.rangeBetween(0, reach), w.rangeBetween(-reach, 0)
    seen = signals.select(*BY, "frame_idx", *[x for c in CATEGORIES.values() for x in (F.max(c).over(ahead).alias(f"max_{c}"), F.avg(c).over(ahead).alias(f"ahead_{c}"), F.avg(c).over(behind).alias(f"behind_{c}"))])
    kinds = F.array(*[F.struct(F.lit(name).alias("category"), F.col(f"max_{c}").alias("up_max"), F.col(f"ahead_{c}").alias("up_mean"), F.col(f"behind_{c}").alias("mean")) for name, c in CATEGORIES.items()])
    long = seen.select(*BY, "frame_idx", F.explode(kinds).alias("z")).select(*BY, "frame_idx", "z.*")
    scored = long.select(*BY, "frame_idx", "category", (0.65 * F.col("up_max") + 0.35 * F.col("up_mean")).alias("score"), (F.col("up_mean") - F.col("mean")).alias("delta")).filter(F.col("score") > LEAST)
    top = lambda by, by_value: Window.partitionBy(*by).orderBy(F.desc(F.round(by_value, 9)), "target", "category")
    ranked = scored.withColumn("rn", F.row_number().over(top(("track", "frame_idx", "category"), "score"))).filter(F.col("rn") <= k)
    rising = ranked.withColumn("rn", F.row_number().over(top(("track", "frame_idx"), "delta"))).filter(F.col("rn") <= k)
    return ranked.withColumn("ranking", F.col("category")).unionByName(rising.withColumn("ranking", F.lit("rising")))


def music_window(signals: DataFrame, sections: DataFrame, reach: int = 12) -> DataFrame:
    """At each frame of a track: its section, the frames to the next, tension behind and ahead, and why one might act."""
    w = Window.partitionBy("track").orderBy("frame_idx")
    behind, ahead = w.rangeBetween(-reach, 0), w.rangeBetween(0, reach)
    x = signals.filter("target IN ('tension', 'global')").groupBy("track", "frame_idx").agg(F.max(F.when(F.col("target") == "tension", F.col("energy_smooth"))).alias("tension"), F.max(F.when(F.col("target") == "global", F.col("novelty_long"))).alias("novelty"))
    seen = x.select("track", "frame_idx", "tension", F.avg("tension").over(behind).alias("tension_recent"), F.avg("tension").over(ahead).alias("tension_upcoming"), F.max("novelty").over(ahead).alias("novelty_upcoming"))
    marks = sections.select("track", F.col("start").alias("frame_idx"), "section", "stop")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.hint("merge").join(marks, ["track", "frame_idx"], "left").withColumn("section", F.last("section", ignorenulls=True).over(upto)).withColumn("remaining", F.last("stop", ignorenulls=True).over(upto) - F.col("frame_idx")).drop("stop")
    return placed.withColumn("reasons", tagged(HINTS, "stable_window"))


#: Reasons to revise, in order.
HINTS = (("section_near", "remaining <= 8"), ("tension_rising", "tension_upcoming - tension_recent > 0.08"), ("novelty_peak", "novelty_upcoming > 0.65"))


def classified(wide: DataFrame) -> DataFrame:
    """Confidences of each stem in what it is, its dominant role and texture, its band and the weights of the motions that suit it."""
    share = lambda c, bar: F.avg((F.col(c) > bar).cast("double"))
    stats = wide.groupBy(*SERIES).agg((F.count_if("voiced") / F.greatest(F.count("*") / FPS, F.lit(0.1))).alias("onset_density"), share("pitch_confidence", 0.5).alias("melody"), share("flatness", 0.4).alias("texture"), (F.avg("brightness") * 20000).alias("hz"), F.avg("flatness").alias("flatness"), F.avg("energy_smooth").alias("mean_energy"), F.avg("pitch_confidence").alias("pitch"), F.coalesce(F.var_pop("tension"), F.lit(0.0)).alias("sway"))
    x = stats.hint("merge").join(hpss_ratio(wide), list(SERIES)).withColumn("percussive", F.col("hpss_ratio")).withColumn("harmonic", 1 - F.col("hpss_ratio")).withColumn("rhythm", clamp(F.col("onset_density") / 4))
    x = x.withColumn("harmony", F.col("harmonic") * (1 - F.col("melody")) * (1 - F.col("texture")))
    raw = {"spring": F.col("percussive"), "pitch_follow": F.col("melody") * F.col("harmonic"), "oscillator": F.col("harmony") * F.col("harmonic"), "perlin": F.col("texture") * F.col("harmonic")}
    total = sum(raw.values(), F.lit(0.0))
    x = x.withColumns({f"w_{k}": F.when(total < 0.01, 1.0 if k == "spring" else 0.0).otherwise(v / total) for k, v in raw.items()})
    best = F.greatest("rhythm", "melody", "harmony", "texture")
    role = F.when(F.col("rhythm") == best, "rhythm").when(F.col("melody") == best, "melody").when(F.col("harmony") == best, "harmony").otherwise("texture")
    band = F.when(F.col("hz") < 250, "bass").when(F.col("hz") > 4000, "high").otherwise("mid")
    return x.withColumns({"dominant_role": role, "dominant_texture": F.when(F.col("percussive") > F.col("harmonic"), "percussive").otherwise("harmonic"), "band": band})


def stem_profiles(wide: DataFrame) -> DataFrame:
    """Nine fields of each physical stem."""
    c = classified(wide.filter(F.col("stem").isin(*PHYSICAL)))
    has_pitch = F.col("pitch") > 0.3
    role = F.when((F.col("hpss_ratio") > 0.65) & (F.col("onset_density") >= 0.5), "percussive").when(has_pitch | (F.col("melody") >= 0.3), "melodic").when(F.col("harmony") >= F.col("texture"), "harmonic").otherwise("textural")
    texture = F.when(F.col("flatness") > 0.55, "noise").when(F.col("hpss_ratio") > 0.65, "percussive").when(F.col("hpss_ratio") < 0.35, "harmonic").otherwise("mixed")
    return c.select(*SERIES, role.alias("role"), texture.alias("texture_kind"), "band", "mean_energy", "hpss_ratio", has_pitch.alias("has_pitch"), (F.col("sway") > 1e-4).alias("has_tension"), "onset_density")


def overall_character(profiles: DataFrame) -> DataFrame:
    """A word for each track from its physical stems."""
    by = profiles.groupBy("track").agg(F.avg("hpss_ratio").alias("ratio"), F.avg("onset_density").alias("onsets"), F.count_if("has_pitch").alias("pitched"), F.count_if("has_tension").alias("tense"))
    word = F.when((F.col("ratio") > 0.6) & (F.col("onsets") > 1.5), "percussive_rhythmic").when(F.col("pitched") >= 2, "melodic_harmonic").when(F.col("tense") >= 2, "tense_harmonic").when(F.col("onsets") < 0.5, "sparse_textural").otherwise("mixed")
    return by.withColumn("character", word)


def effective_config(wide: DataFrame) -> DataFrame:
    """Channel, layer and spatial preset of each stem from what it is, unless chosen by hand (every third track)."""
    manual = F.col("track") % 3 == 0
    pick = lambda by_hand, derived: F.when(manual, by_hand).otherwise(derived)
    return classified(wide).select(
        *SERIES, (~manual).alias("auto"), pick("energy_smooth", F.when(F.col("percussive") > 0.6, "transient").otherwise("energy_smooth")).alias("channel"),
        pick("combined", F.when(F.col("rhythm") > 0.6, "flash").when(F.col("harmony") > 0.5, "sustain").otherwise("combined")).alias("layer"),
        pick("global", F.when(F.col("band") == "bass", "floor").when(F.col("band") == "high", "ceiling").when(F.col("melody") > 0.4, "center").otherwise("global")).alias("spatial_preset"),
    )


#: Position sources and, as SQL, their value; null where a source is not valid.
POSITIONS = {
    "auto": f"CASE WHEN stem = '{OTHER}' THEN chroma_centroid WHEN pitch_confidence > 0.3 THEN pitch_normalized ELSE brightness END",
    "pitch": "CASE WHEN pitch_confidence > 0.3 THEN pitch_normalized END",
    "brightness": "brightness",
    "chroma": "chroma_centroid",
    "tension": "tension",
    "tonal_distance": "tonal_distance",
    "none": "CAST(NULL AS DOUBLE)",
}


def sample_positions(wide: DataFrame) -> DataFrame:
    """(track, stem, frame_idx, source, position, valid) for each position source."""
    each = F.array(*[F.struct(F.lit(name).alias("source"), F.expr(rule).alias("position")) for name, rule in POSITIONS.items()])
    return wide.select(*SERIES, "frame_idx", F.explode(each).alias("z")).select(*SERIES, "frame_idx", "z.*").withColumn("valid", F.col("position").isNotNull())


def link_targets(signals: DataFrame) -> DataFrame:
    """Value of each named target at each frame; a name that is none has zero."""
    known = signals.select(*BY, "frame_idx", F.col("energy_smooth").alias("x"))
    nothing = signals.filter("target = 'global'").select("track", F.lit("unheard").alias("target"), "frame_idx", F.lit(0.0).alias("x"))
    return known.unionByName(nothing)


def _w(s, d):
    return stem_frames(s, d)


def _sig(s, d):
    """The signals, written once for the several passes over them."""
    return materialize(target_signals(s, d), "signals")


def _prof(s, d):
    return target_profiles(_sig(s, d))


def _activity(s, d):
    wide = stem_frames(s, d)
    return wide.hint("merge").join(effective_config(wide).filter("auto"), list(SERIES)).groupBy("track").agg(F.avg("energy_smooth").alias("activity"))


def _analysis(s, d):
    """Profile, tags, partners and rankings of each target."""
    signals = _sig(s, d)
    profiles = materialize(target_profiles(signals), "profiles")
    partners = coupled(signals).groupBy(*BY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "partner"))), lambda z: z["partner"]), "+").alias("partners"))
    kinds = ranked_drivers(profiles).groupBy(*BY).agg(F.array_join(F.sort_array(F.collect_set("kind")), "+").alias("rankings"))
    in_sections = section_targets(signals, boundaries(s, d)).groupBy(*BY).agg(F.count("*").alias("n_section_ranks"))
    out = profiles.drop("brightness_dynamic").hint("merge").join(tags(profiles).select(*BY, F.array_join("movement_words", "+").alias("movement_words"), F.array_join("good_for", "+").alias("good_for"), "preferred_source"), list(BY))
    for other in (partners, kinds, in_sections):
        out = out.hint("merge").join(other, list(BY), "left")
    return out.fillna("", ["partners", "rankings"]).fillna(0, ["n_section_ranks"])


QUERIES = {
    "src_curves": lambda s, d: _w(s, d).drop("v"),
    "agg_corr_matrix": lambda s, d: correlations(_sig(s, d)).withColumn("coupled", F.abs("r") >= COUPLED),
    "top_coupled": lambda s, d: coupled(_sig(s, d)),
    "agg_target_profile": _prof,
    "fn_movement_words": lambda s, d: tags(_prof(s, d)).select(*BY, "movement_words"),
    "fn_good_for": lambda s, d: tags(_prof(s, d)).select(*BY, "good_for"),
    "fn_affordances": lambda s, d: tags(_prof(s, d)).select(*BY, "affordances"),
    "fn_preferred_source": lambda s, d: tags(_prof(s, d)).select(*BY, "preferred_source"),
    "top_ranked_drivers": lambda s, d: ranked_drivers(_prof(s, d)),
    "top_section_targets": lambda s, d: section_targets(_sig(s, d), boundaries(s, d)),
    "top_window_targets": lambda s, d: window_targets(_sig(s, d)),
    "top_dominant": lambda s, d: _sig(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("track", "frame_idx").orderBy(F.desc(F.round("energy_smooth", 9)), "target"))).filter(F.col("rn") <= RANKED).select("track", "frame_idx", "target", "energy_smooth", "transient", "flux", "rn"),
    "ml_music_window": lambda s, d: music_window(_sig(s, d), boundaries(s, d)),
    "fn_classify_component": lambda s, d: classified(_w(s, d)).select(*SERIES, "percussive", "harmonic", "rhythm", "melody", "harmony", "texture", "dominant_role", "dominant_texture", "band", "w_spring", "w_pitch_follow", "w_oscillator", "w_perlin"),
    "agg_stem_profile": lambda s, d: stem_profiles(_w(s, d)),
    "agg_overall_character": lambda s, d: overall_character(stem_profiles(_w(s, d))),
    "prj_effective_config": lambda s, d: effective_config(_w(s, d)),
    "agg_overall_activity": _activity,
    "fn_sample_position": lambda s, d: sample_positions(_w(s, d)),
    "fn_link_target": lambda s, d: link_targets(_sig(s, d)),
    "ml_track_analysis": _analysis,
}

_C = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0}))"
_IN = "('click', 'purchase', 'view')"
_WIDE = f"""{_FRAMES}, obs AS (SELECT track, stem, frame_idx, avg(value) AS v, count(*) AS c, max(value) AS hi, min(value) AS lo FROM (
  SELECT user_id % 10 AS track, event_type AS stem, (floor(epoch(ts) / 3600) - h0)::INTEGER AS frame_idx, value FROM events, span) GROUP BY ALL),
raw AS (SELECT f.track, f.stem, f.frame_idx, f.v, coalesce(c, 0) AS c, {_C.format('f.v / 250.0')} AS envelope, {_C.format('coalesce(hi, 0.0) / 500.0')} AS brightness, CASE WHEN hi > 0 THEN lo / hi ELSE 0.0 END AS flatness
  FROM frames f LEFT JOIN obs o ON f.track = o.track AND f.stem = o.stem AND f.frame_idx = o.frame_idx),
steps AS (SELECT *, coalesce(envelope - lag(envelope) OVER w, 0.0) AS step, avg(envelope) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS energy_smooth, avg(envelope) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sustain,
  max(envelope) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS flash FROM raw WINDOW w AS (PARTITION BY track, stem ORDER BY frame_idx)),
wide AS (SELECT track, stem, frame_idx, v, envelope, brightness, flatness, energy_smooth, greatest(0.0, step) AS transient, abs(step) AS flux, sustain, flash, least(c / 3.0::DOUBLE, 1.0) AS pitch_confidence, {_C.format('v / 500.0')} AS pitch_normalized,
  v / 10.0::DOUBLE - floor(v / 10.0::DOUBLE) AS chroma_centroid, CASE WHEN stem <> 'error' THEN least(1.0, 4 * abs(energy_smooth - sustain)) END AS tension, 0.5 * abs(step) AS tonal_distance,
  avg(abs(step)) OVER (PARTITION BY track, stem ORDER BY frame_idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS novelty_long, c > 0 AS voiced FROM steps),
ratio AS (SELECT track, stem, round(CASE WHEN sum(transient) + sum(sustain) > 0 THEN sum(transient) / (sum(transient) + sum(sustain)) ELSE 0.5 END, 9) AS hpss_ratio FROM wide GROUP BY ALL)"""
_SIG = f"""{_WIDE}, parts0 AS (SELECT w.*, stem || '_' || part AS target, part = 'harmonic' AS soft, {_C.format("energy_smooth * CASE WHEN part = 'harmonic' THEN 1 - hpss_ratio ELSE hpss_ratio END")} AS curve
  FROM wide w JOIN ratio r USING (track, stem), (VALUES ('harmonic'), ('percussive')) p(part) WHERE stem IN {_IN}),
parts AS (SELECT *, abs(coalesce(curve - lag(curve) OVER (PARTITION BY track, target ORDER BY frame_idx), 0.0)) AS moved FROM parts0),
der0 AS (SELECT track, frame_idx, coalesce(sum(tension * (energy_smooth + 0.1)) / sum(energy_smooth + 0.1) FILTER (tension IS NOT NULL), 0.5) AS tension, sum(tonal_distance * (energy_smooth + 0.1)) / sum(energy_smooth + 0.1) AS tonal_distance,
  coalesce(avg(energy_smooth) FILTER (stem IN {_IN}), 0.0) AS glb FROM wide GROUP BY ALL),
der1 AS (SELECT track, frame_idx, 'tension' AS target, {_C.format('tension')} AS x FROM der0 UNION ALL SELECT track, frame_idx, 'tonal_distance', {_C.format('tonal_distance')} FROM der0 UNION ALL SELECT track, frame_idx, 'global', {_C.format('glb')} FROM der0),
der AS (SELECT *, {_C.format('abs(coalesce(x - lag(x) OVER (PARTITION BY track, target ORDER BY frame_idx), 0.0))')} AS delta FROM der1),
sig AS (
  SELECT track, stem AS target, CASE WHEN stem IN {_IN} THEN 'physical' ELSE 'subband' END AS grp, frame_idx, {', '.join(CHANNELS)}, voiced AS onset FROM wide
  UNION ALL SELECT track, target, 'hpss', frame_idx, curve, curve, CASE WHEN soft THEN 0.35 * transient ELSE greatest(transient, flash) END, CASE WHEN soft THEN 0.6 * flux ELSE greatest(flux, moved) END, brightness,
    CASE WHEN soft THEN greatest(sustain, curve) ELSE 0.5 * sustain END, tension, tonal_distance, novelty_long, pitch_confidence, chroma_centroid, NOT soft AND voiced FROM parts
  UNION ALL SELECT track, target, 'derived', frame_idx, x, x, delta, delta, CASE WHEN target = 'tonal_distance' THEN x ELSE 0.0 END, x, CASE WHEN target = 'tension' THEN x ELSE 0.0 END, CASE WHEN target = 'tonal_distance' THEN x ELSE 0.0 END, x, NULL, NULL, false FROM der)"""
_CORR = f"""{_SIG}, half AS (SELECT a.track, a.target, b.target AS partner, corr(a.energy_smooth, b.energy_smooth) AS r0 FROM sig a JOIN sig b ON a.track = b.track AND a.frame_idx = b.frame_idx AND a.target < b.target GROUP BY ALL),
halves AS (SELECT track, target, partner, CASE WHEN r0 IS NULL OR isnan(r0) THEN 0.0 ELSE r0 END AS r FROM half),
pairs AS (SELECT * FROM halves UNION ALL SELECT track, partner, target, r FROM halves)"""
_COUPLED = f"{_CORR}, coupled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, target ORDER BY round(abs(r), 9) DESC, partner)::INTEGER AS rn FROM pairs WHERE abs(r) >= {COUPLED}) WHERE rn <= {PARTNERS})"


def _score(c: str) -> str:
    return _C.format(f"0.5 * avg({c}) + 0.5 * quantile_cont({c}, 0.9)")


def _span(c: str) -> str:
    return _C.format(f"quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1)")


_PROFILE = f"""{_COUPLED}, uniq AS (SELECT track, target, round({_C.format(f'1 - coalesce(max(abs(r)) FILTER (abs(r) >= {COUPLED}), 0.0)')}, 9) AS uniqueness FROM pairs GROUP BY ALL),
base AS (SELECT track, target, grp, avg(energy_smooth) AS mean_energy, max(energy_smooth) AS peak_energy, {_span('energy_smooth')} AS dynamic_range, greatest(0.08, quantile_cont(energy_smooth, 0.5) + 0.1 * stddev_pop(energy_smooth)) AS bar,
  count(*) FILTER (onset) / greatest(count(*) / {FPS}, 0.1) AS onset_density, {_score('transient')} AS hits, {_score('flux')} AS flux_score, {_score('brightness')} AS brightness_score, {_score('sustain')} AS sustain_score,
  {_C.format('coalesce(avg(pitch_confidence), 0.0)')} AS pitch_confidence, CASE WHEN count(chroma_centroid) = 0 THEN 0.0 ELSE {_span('chroma_centroid')} END AS chroma_motion, {_span('brightness')} AS brightness_dynamic, coalesce(var_pop(tension), 0.0) AS tension_variance FROM sig GROUP BY ALL),
act AS (SELECT track, target, avg((energy_smooth > bar)::INT) AS active_ratio FROM sig JOIN base USING (track, target) GROUP BY ALL),
prof AS (SELECT track, target, grp, mean_energy, peak_energy, dynamic_range, active_ratio, onset_density, greatest(hits, least(onset_density / 3, 1.0)) AS transient_score, flux_score, brightness_score, sustain_score, pitch_confidence, chroma_motion, tension_variance,
  CASE WHEN dynamic_range < 0.03 AND peak_energy < 0.05 THEN 0.0 WHEN dynamic_range < 0.03 THEN 0.3 * uniqueness ELSE uniqueness END AS uniqueness_score, brightness_dynamic FROM base JOIN act USING (track, target) JOIN uniq USING (track, target))"""


def _tags_sql(rules: tuple, default: str) -> str:
    listed = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules)
    found = f"list_filter([{listed}], lambda z: z IS NOT NULL)"
    return f"CASE WHEN len({found}) = 0 THEN ['{default}'] ELSE {found} END"


_RANKS = f"""{_PROFILE}, long AS ({' UNION ALL '.join(f"SELECT track, target, array_to_string(({_tags_sql(MOVEMENT, 'steady')})[1:3], '+') AS reasons, '{k}' AS kind, ({_C.format(f)})::DOUBLE AS score FROM prof" for k, f in DRIVERS.items())}),
ranks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, kind ORDER BY round(score, 9) DESC, target)::INTEGER AS rn FROM long WHERE score > {LEAST}) WHERE rn <= {RANKED})"""
_SECTION_RANKS = f"""sec AS (SELECT s.track, s.section, f.target, {', '.join(f"avg({c}) AS mean_{c}, max({c}) AS max_{c}, arg_max({c}, frame_idx) - arg_min({c}, frame_idx) AS delta_{c}" for c in CATEGORIES.values())} FROM sig f JOIN sections s ON f.track = s.track AND f.frame_idx BETWEEN s.start AND s.stop GROUP BY ALL),
seclong AS ({' UNION ALL '.join(f"SELECT track, section, target, '{k}' AS category, mean_{c} AS mean_v, max_{c} AS max_v, delta_{c} AS delta, {_C.format(f'0.65 * max_{c} + 0.35 * mean_{c}')} AS score FROM sec" for k, c in CATEGORIES.items())}),
secranks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, section, category ORDER BY round(score, 9) DESC, target)::INTEGER AS rn FROM seclong WHERE score > {LEAST}) WHERE rn <= 5)"""
_CLASS = f"""cls0 AS (SELECT track, stem, count(*) FILTER (voiced) / greatest(count(*) / {FPS}, 0.1) AS onset_density, avg((pitch_confidence > 0.5)::INT) AS melody, avg((flatness > 0.4)::INT) AS texture, avg(brightness) * 20000 AS hz, avg(flatness) AS flatness,
  avg(energy_smooth) AS mean_energy, avg(pitch_confidence) AS pitch, coalesce(var_pop(tension), 0.0) AS sway FROM wide GROUP BY ALL),
cls1 AS (SELECT *, hpss_ratio AS percussive, 1 - hpss_ratio AS harmonic, {_C.format('onset_density / 4')} AS rhythm, (1 - hpss_ratio) * (1 - melody) * (1 - texture) AS harmony FROM cls0 JOIN ratio USING (track, stem)),
cls2 AS (SELECT *, percussive + melody * harmonic + harmony * harmonic + texture * harmonic AS total FROM cls1),
cls AS (SELECT *, CASE WHEN total < 0.01 THEN 1.0 ELSE percussive / total END AS w_spring, CASE WHEN total < 0.01 THEN 0.0 ELSE melody * harmonic / total END AS w_pitch_follow, CASE WHEN total < 0.01 THEN 0.0 ELSE harmony * harmonic / total END AS w_oscillator,
  CASE WHEN total < 0.01 THEN 0.0 ELSE texture * harmonic / total END AS w_perlin, CASE greatest(rhythm, melody, harmony, texture) WHEN rhythm THEN 'rhythm' WHEN melody THEN 'melody' WHEN harmony THEN 'harmony' ELSE 'texture' END AS dominant_role,
  CASE WHEN percussive > harmonic THEN 'percussive' ELSE 'harmonic' END AS dominant_texture, CASE WHEN hz < 250 THEN 'bass' WHEN hz > 4000 THEN 'high' ELSE 'mid' END AS band FROM cls2)"""
_STEMS = f"""{_CLASS}, stems AS (SELECT track, stem, CASE WHEN hpss_ratio > 0.65 AND onset_density >= 0.5 THEN 'percussive' WHEN pitch > 0.3 OR melody >= 0.3 THEN 'melodic' WHEN harmony >= texture THEN 'harmonic' ELSE 'textural' END AS role,
  CASE WHEN flatness > 0.55 THEN 'noise' WHEN hpss_ratio > 0.65 THEN 'percussive' WHEN hpss_ratio < 0.35 THEN 'harmonic' ELSE 'mixed' END AS texture_kind, band, mean_energy, hpss_ratio, pitch > 0.3 AS has_pitch, sway > 1e-4 AS has_tension, onset_density FROM cls WHERE stem IN {_IN})"""
_CONFIG = f"""{_CLASS}, config AS (SELECT track, stem, track % 3 <> 0 AS auto, CASE WHEN track % 3 <> 0 AND percussive > 0.6 THEN 'transient' ELSE 'energy_smooth' END AS channel,
  CASE WHEN track % 3 = 0 THEN 'combined' WHEN rhythm > 0.6 THEN 'flash' WHEN harmony > 0.5 THEN 'sustain' ELSE 'combined' END AS layer,
  CASE WHEN track % 3 = 0 THEN 'global' WHEN band = 'bass' THEN 'floor' WHEN band = 'high' THEN 'ceiling' WHEN melody > 0.4 THEN 'center' ELSE 'global' END AS spatial_preset FROM cls)"""
_CHARACTER = """chars AS (SELECT *, CASE WHEN ratio > 0.6 AND onsets > 1.5 THEN 'percussive_rhythmic' WHEN pitched >= 2 THEN 'melodic_harmonic' WHEN tense >= 2 THEN 'tense_harmonic' WHEN onsets < 0.5 THEN 'sparse_textural' ELSE 'mixed' END AS character
  FROM (SELECT track, avg(hpss_ratio) AS ratio, avg(onset_density) AS onsets, count(*) FILTER (has_pitch) AS pitched, count(*) FILTER (has_tension) AS tense FROM stems GROUP BY track))"""
_AHEAD = "PARTITION BY track, target ORDER BY frame_idx"
_UPCOMING = f"""up AS ({' UNION ALL '.join(f"SELECT track, target, frame_idx, '{k}' AS category, 0.65 * max({c}) OVER a + 0.35 * avg({c}) OVER a AS score, avg({c}) OVER a - avg({c}) OVER b AS delta FROM sig WINDOW a AS ({_AHEAD} RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING), b AS ({_AHEAD} RANGE BETWEEN 12 PRECEDING AND CURRENT ROW)" for k, c in CATEGORIES.items())}),
led AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, frame_idx, category ORDER BY round(score, 9) DESC, target, category)::INTEGER AS rn FROM up WHERE score > {LEAST}) WHERE rn <= {RANKED}),
rising AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY track, frame_idx ORDER BY round(delta, 9) DESC, target, category)::INTEGER AS rn FROM led) WHERE rn <= {RANKED})"""
_SEEN = """x AS (SELECT track, frame_idx, max(energy_smooth) FILTER (target = 'tension') AS tension, max(novelty_long) FILTER (target = 'global') AS novelty FROM sig WHERE target IN ('tension', 'global') GROUP BY ALL),
y AS (SELECT track, frame_idx, tension, avg(tension) OVER r AS tension_recent, avg(tension) OVER u AS tension_upcoming, max(novelty) OVER u AS novelty_upcoming FROM x
  WINDOW r AS (PARTITION BY track ORDER BY frame_idx RANGE BETWEEN 12 PRECEDING AND CURRENT ROW), u AS (PARTITION BY track ORDER BY frame_idx RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING)),
win AS (SELECT y.*, s.section, s.stop - y.frame_idx AS remaining FROM y JOIN sections s ON y.track = s.track AND y.frame_idx >= s.start AND y.frame_idx < s.stop)"""

ORACLE_SQL = {
    "src_curves": f"WITH {_WIDE} SELECT * EXCLUDE (v) FROM wide",
    "agg_corr_matrix": f"WITH {_CORR} SELECT *, abs(r) >= {COUPLED} AS coupled FROM pairs",
    "top_coupled": f"WITH {_COUPLED} SELECT * FROM coupled",
    "agg_target_profile": f"WITH {_PROFILE} SELECT * FROM prof",
    "fn_movement_words": f"WITH {_PROFILE} SELECT track, target, {_tags_sql(MOVEMENT, 'steady')} AS movement_words FROM prof",
    "fn_good_for": f"WITH {_PROFILE} SELECT track, target, {_tags_sql(USES, 'supporting_driver')} AS good_for FROM prof",
    "fn_affordances": f"WITH {_PROFILE} SELECT track, target, {_tags_sql(AFFORDANCES, 'auto')} AS affordances FROM prof",
    "fn_preferred_source": f"WITH {_PROFILE} SELECT track, target, {SOURCE} AS preferred_source FROM prof",
    "top_ranked_drivers": f"WITH {_RANKS} SELECT * FROM ranks",
    "top_section_targets": f"WITH {_SIG}, {_SECTIONS}, {_SECTION_RANKS} SELECT * FROM secranks",
    "top_window_targets": f"WITH {_SIG}, {_UPCOMING} SELECT *, category AS ranking FROM led UNION ALL BY NAME SELECT *, 'rising' AS ranking FROM rising",
    "top_dominant": f"WITH {_SIG} SELECT * FROM (SELECT track, frame_idx, target, energy_smooth, transient, flux, row_number() OVER (PARTITION BY track, frame_idx ORDER BY round(energy_smooth, 9) DESC, target)::INTEGER AS rn FROM sig) WHERE rn <= {RANKED}",
    "ml_music_window": f"WITH {_SIG}, {_SECTIONS}, {_SEEN} SELECT *, {_tags_sql(HINTS, 'stable_window')} AS reasons FROM win",
    "fn_classify_component": f"WITH {_WIDE}, {_CLASS} SELECT track, stem, percussive, harmonic, rhythm, melody, harmony, texture, dominant_role, dominant_texture, band, w_spring, w_pitch_follow, w_oscillator, w_perlin FROM cls",
    "agg_stem_profile": f"WITH {_WIDE}, {_STEMS} SELECT * FROM stems",
    "agg_overall_character": f"WITH {_WIDE}, {_STEMS}, {_CHARACTER} SELECT * FROM chars",
    "prj_effective_config": f"WITH {_WIDE}, {_CONFIG} SELECT * FROM config",
    "agg_overall_activity": f"WITH {_WIDE} SELECT track, avg(energy_smooth) AS activity FROM wide WHERE track % 3 <> 0 GROUP BY track",
    "fn_sample_position": f"WITH {_WIDE}, p AS ({' UNION ALL '.join(f'''SELECT track, stem, frame_idx, '{k}' AS source, {r} AS position FROM wide''' for k, r in POSITIONS.items())}) SELECT *, position IS NOT NULL AS valid FROM p",
    "fn_link_target": f"WITH {_SIG} SELECT track, target, frame_idx, energy_smooth AS x FROM sig UNION ALL SELECT track, 'unheard', frame_idx, 0.0 FROM sig WHERE target = 'global'",
    "ml_track_analysis": f"""WITH {_RANKS}, {_SECTIONS}, {_SECTION_RANKS},
p AS (SELECT track, target, string_agg(partner, '+' ORDER BY rn) AS partners FROM coupled GROUP BY ALL), k AS (SELECT track, target, string_agg(kind, '+' ORDER BY kind) AS rankings FROM ranks GROUP BY ALL),
n AS (SELECT track, target, count(*) AS n_section_ranks FROM secranks GROUP BY ALL)
SELECT prof.* EXCLUDE (brightness_dynamic), array_to_string({_tags_sql(MOVEMENT, 'steady')}, '+') AS movement_words, array_to_string({_tags_sql(USES, 'supporting_driver')}, '+') AS good_for, {SOURCE} AS preferred_source,
  coalesce(partners, '') AS partners, coalesce(rankings, '') AS rankings, coalesce(n_section_ranks, 0) AS n_section_ranks FROM prof LEFT JOIN p USING (track, target) LEFT JOIN k USING (track, target) LEFT JOIN n USING (track, target)""",
}
