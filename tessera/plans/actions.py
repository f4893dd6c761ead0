"""Control plans: parsing, normalising, validation against evidence, and the state they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize, table

#: The actions and the values that their fields may have.
ACTIONS = ("update_block_config", "set_destination", "clear_destination", "freeze_blend", "set_destination_mode", "set_destination_link", "set_reactive_config", "set_blend_position", "set_composition_config")
SPACES, SIDES, KINDS = ("latent", "prompt"), ("a", "b"), ("seed", "prompt")
MODES, REPLACE, SPATIAL, COMPOSITION = ("slider", "reactive", "linked"), ("direct", "from_blend"), ("draw", "pitch_aligned"), ("auto", "pulse", "continuous")
POSITIONS, INTENSITIES, CURVES, SILENCE = ("auto", "pitch", "brightness", "chroma", "tension", "tension_global"), ("energy_smooth", "transient", "flux", "envelope"), ("linear", "gamma", "clip"), ("drift_center", "hold_last")
STEMS = ("drums", "vocals", "bass", "other")
TARGETS = (*STEMS, *(f"{s}_{p}" for s in STEMS for p in ("harmonic", "percussive")), "drums_low", "drums_mid", "drums_high", "other_mid", "other_high", "tension", "tonal_distance", "global")
FEATURES, STAGE, DISTANCE, MASK = 5120, 50.0, 4.0, 256
STAGE_FIELDS = ("stage_left", "stage_home", "stage_right", "strength_min", "strength_max")
#: Seconds after which a plan is stale, by timing profile.
STALENESS = {"dj_calm": 12, "dj_balanced": 8, "dj_active": 4, "section_timed": 2}
DIRECTIVE = 20
#: Slots that this installation has.
BLOCKS = ("b0", "b1", "b2")

FIELDS = (
    "action string, type string, block string, feature_id double, link_target string, space string, slot string, target_slot string, destination_type string, seed double, seed_a double, seed_b double, prompt string, prompt_a string, prompt_b string, "
    "mode string, replace_mode string, spatial_mode string, position double, distance double, stage_left double, stage_home double, stage_right double, strength_min double, strength_max double, mask array<double>, "
    "position_source string, intensity_source string, intensity_curve string, silence_behavior string, intensity_gamma double, drift_ms double, blend_slew_rate double, sae_rank double, has_rank boolean, stage struct<left:double,home:double,center:double,right:double>"
)


def _cycle(n: Column, values: tuple) -> Column:
    """The value whose place is n modulo their number; None stands for a missing one."""
    return F.element_at(F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


#: What the made-up plans say, place by place; some of it is legacy, some wrong.
SAID = {
    "verb": ("update_block_config", "set_destination", "clear_destination", "freeze_blend", "set_destination_mode", "set_destination_link", "set_reactive_config", "set_blend_position", "set_composition", "set_prompt", "wave"),
    "block": ("b0", "b1", "b2", "b9"), "link_target": ("drums", "bass_harmonic", "tension", "nowhere", None), "space": ("prompt", "latent", "prompt", "void", None), "slot": ("a", "b", "c", "a", None),
    "destination_type": ("prompt_a", "seed_b", "prompt", "seed", "song", None, "prompt"), "mode": ("slider", "linked", "auto", "pulse", "spin"), "curve": ("linear", "gamma", "clip", "sharp", None), "source": ("transient", "flux", "loudness", None),
    "position_source": ("auto", "chroma", "smell", None), "silence": ("hold_last", "drift_center", "shout", None), "spatial": ("draw", "pitch_aligned", "blur", None), "replace": ("direct", "from_blend", "swap", None),
}


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, slot_owner, body, armed, connected): one JSON plan of none to three actions for each order; every 97th body is no plan."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def action(i: Column) -> Column:
        n = key * 3 + i
        verb = _cycle(n, SAID["verb"])
        old = n % 2 == 0
        stage = ((n * 7) % 140).cast("double") - 70, ((n * 5) % 120).cast("double") - 60, ((n * 11) % 140).cast("double") - 60
        seed = F.when(n % 4 < 2, (n % 1000).cast("double") + F.when(n % 7 == 0, 0.5).otherwise(0.0))
        prompt = F.when(n % 3 == 0, F.concat(F.lit("scene "), n.cast("string"))).when(n % 3 == 1, " ")
        size = F.when(n % 13 == 0, F.lit(MASK)).when(n % 17 == 0, F.lit(3))
        mask = F.when(size.isNotNull(), F.transform(F.sequence(F.lit(1), F.coalesce(size, F.lit(1))), lambda x: F.when((n % 26 == 0) & (x == 5), 1.5).otherwise(0.25)))
        return F.struct(
            F.when(~old, verb).alias("action"), F.when(old, verb).alias("type"), _cycle(n, SAID["block"]).alias("block"), F.when(n % 5 != 0, ((F.col("o_custkey") * 37 + i * 1000) % 6000).cast("double")).alias("feature_id"),
            _cycle(n, SAID["link_target"]).alias("link_target"), _cycle(n + 1, SAID["space"]).alias("space"), _cycle(n + 2, SAID["slot"]).alias("slot"), _cycle(n + 3, SAID["slot"]).alias("target_slot"), _cycle(n, SAID["destination_type"]).alias("destination_type"),
            seed.alias("seed"), F.when(n % 3 == 0, (n % 50).cast("double")).alias("seed_a"), F.when(n % 4 == 0, (n % 60).cast("double")).alias("seed_b"), prompt.alias("prompt"), F.when(n % 2 == 1, F.concat(F.lit("one "), n.cast("string"))).alias("prompt_a"), F.when(n % 3 == 1, F.concat(F.lit("two "), n.cast("string"))).alias("prompt_b"),
            _cycle(n + 1, SAID["mode"]).alias("mode"), _cycle(n, SAID["replace"]).alias("replace_mode"), _cycle(n, SAID["spatial"]).alias("spatial_mode"), F.when(n % 6 != 0, ((n * 7) % 140) / 100.0 - 0.2).alias("position"), F.when(n % 3 != 2, ((n * 3) % 80) / 10.0 - 2).alias("distance"),
            F.when(~old, stage[0]).alias("stage_left"), F.when(~old, stage[1]).alias("stage_home"), F.when(~old, stage[2]).alias("stage_right"), F.when(n % 4 == 1, stage[0]).alias("strength_min"), F.when(n % 4 == 1, stage[2]).alias("strength_max"), mask.alias("mask"),
            _cycle(n, SAID["position_source"]).alias("position_source"), _cycle(n, SAID["source"]).alias("intensity_source"), _cycle(n, SAID["curve"]).alias("intensity_curve"), _cycle(n, SAID["silence"]).alias("silence_behavior"),
            F.when(n % 4 != 0, (n % 5).cast("double") - 1).alias("intensity_gamma"), F.when(n % 5 != 0, ((n % 7) * 100).cast("double") - 100).alias("drift_ms"), F.when(n % 7 != 0, (n % 4).cast("double") - 1).alias("blend_slew_rate"),
            F.when(n % 5 != 4, (n % 6).cast("double")).alias("sae_rank"), (n % 3 == 0).alias("has_rank"), F.when(old, F.struct(stage[0].alias("left"), F.when(n % 4 == 0, stage[1]).alias("home"), F.when(n % 4 == 2, stage[1]).alias("center"), stage[2].alias("right"))).alias("stage"),
        )

    actions = F.when(key % 41 == 0, F.array().cast(f"array<struct<{_struct()}>>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), key % 3), action))
    candidates = F.array(F.struct(_cycle(key, SAID["block"]).alias("block"), ((F.col("o_custkey") * 37) % 6000).alias("id")))
    body = F.when(key % 97 == 0, F.lit("[]")).otherwise(F.to_json(F.struct(actions.alias("actions"), candidates.alias("feature_candidates"))))
    return orders.select(key.alias("plan_id"), F.col("o_custkey").alias("slot_owner"), body.alias("body"), (key % 53 != 0).alias("armed"), (key % 59 != 0).alias("connected"), (key % 5 != 0).alias("active_session"))


def _struct() -> str:
    """FIELDS as the inside of a struct type."""
    out, depth, part = [], 0, ""
    for ch in FIELDS + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def parsed(raw: DataFrame) -> DataFrame:
    """One row for each action of each plan; a body that is no plan has none."""
    actions = F.from_json("body", f"actions array<struct<{_struct()}>>")["actions"]
    keep = [c for c in ("plan_id", "slot_owner", "active_session") if c in raw.columns]
    return raw.select(*keep, F.posexplode(actions).alias("idx", "a")).select(*keep, "idx", "a.*").withColumn("action", F.coalesce("action", "type")).drop("type")


def _clamp(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def normalised(actions: DataFrame) -> DataFrame:
    """Legacy forms rewritten, one row for each action that comes of one, part from 0.

    A set_prompt becomes a destination for each prompt that it has.  A set_composition is a
    set_composition_config, after a destination for each of its whole seeds.  Destinations take side, space
    and type from each other; a stage object is spread over the stage fields.  Stage
    coordinates and distances are held in their ranges.
    """
    plain = F.when(F.col("action") == "set_composition", "set_composition_config").otherwise(F.col("action"))
    named = actions.withColumn("action", plain)
    is_prompt, is_composition = F.col("action").isin("set_prompt", "set_prompt_destinations"), F.col("action") == "set_composition_config"
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    whole = lambda c: F.when(F.col(c) == F.floor(c), F.col(c))

    def put(when: Column, space: str, side: str, kind: str, value: Column) -> Column:
        empty = F.lit(None)
        return F.when(when & value.isNotNull(), F.struct(
            F.lit("set_destination").alias("action"), F.lit(space).alias("space"), F.lit(side).alias("slot"), F.lit(kind).alias("destination_type"),
            (value if kind == "seed" else empty).cast("double").alias("seed"), (value if kind == "prompt" else empty).cast("string").alias("prompt"), F.lit(False).alias("own"),
        ))

    set_destination = F.col("action") == "set_destination"
    kind, sided = F.col("destination_type"), F.col("destination_type").isin("prompt_a", "prompt_b", "seed_a", "seed_b")
    bare = F.when(sided, F.split(kind, "_")[0]).otherwise(kind)
    side = F.when(set_destination & sided, F.coalesce("slot", F.split(kind, "_")[1])).otherwise(F.col("slot"))
    guessed = F.when((bare == "seed") | F.col("seed").isNotNull(), "latent").when((bare == "prompt") | F.col("prompt").isNotNull(), "prompt")
    space = F.when(set_destination, F.coalesce("space", guessed)).otherwise(F.col("space"))
    filled = F.when((space == "latent") | F.col("seed").isNotNull(), "seed").when((space == "prompt") | F.col("prompt").isNotNull(), "prompt")
    typed = F.when(set_destination, F.coalesce(bare, filled)).otherwise(kind)
    own = F.when(~is_prompt, F.struct(F.col("action"), space.alias("space"), side.alias("slot"), typed.alias("destination_type"), F.col("seed"), F.col("prompt"), F.lit(True).alias("own")))
    parts = F.array_compact(F.array(
        put(is_prompt, "prompt", "a", "prompt", text("prompt_a")), put(is_prompt, "prompt", "b", "prompt", text("prompt_b")),
        put(is_composition, "latent", "a", "seed", whole("seed_a")), put(is_composition, "latent", "b", "seed", whole("seed_b")), own,
    ))
    split = named.withColumn("parts", parts).drop("action", "space", "slot", "destination_type", "seed", "prompt", "prompt_a", "prompt_b", "seed_a", "seed_b")
    rows = split.select("*", F.posexplode("parts").alias("part", "p")).drop("parts")
    # Of a row that came of another only the destination's own fields are left.
    rest = [c for c in rows.columns if c not in ("plan_id", "slot_owner", "active_session", "idx", "part", "p")]
    rows = rows.select("plan_id", "slot_owner", "active_session", "idx", "part", "p.action", "p.space", "p.slot", "p.destination_type", "p.seed", "p.prompt", *[F.when(F.col("p.own"), F.col(c)).alias(c) for c in rest])
    return clamped(rows)


def clamped(actions: DataFrame) -> DataFrame:
    """Stage objects spread over the stage fields, stage coordinates held to [-50, 50] and distances to [0, 4]."""
    staged = F.col("action").isin("update_block_config", "set_reactive_config")
    spread = {"stage_left": F.col("stage.left"), "stage_home": F.coalesce("stage.home", "stage.center"), "stage_right": F.col("stage.right")}
    out = actions.withColumns({c: F.when(staged, F.coalesce(F.col(c), x)).otherwise(F.col(c)) for c, x in spread.items()}).drop("stage")
    out = out.withColumns({c: F.when(staged, _clamp(F.col(c), -STAGE, STAGE)).otherwise(F.col(c)) for c in STAGE_FIELDS})
    return out.withColumn("distance", F.when(F.col("action") == "set_composition_config", _clamp(F.col("distance"), 0.0, DISTANCE)).otherwise(F.col("distance")))


def _rules() -> list[tuple[str, str, str]]:
    """(SQL condition on a normalised action, code, path) of each broken rule, in order."""
    quoted = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    known = f"action IN {quoted(ACTIONS)}"
    block = f"action = 'update_block_config' AND block IN {quoted(BLOCKS)}"
    destination = f"action = 'set_destination' AND destination_type IN {quoted(KINDS)}"
    reactive = "action = 'set_reactive_config'"
    prompt_only = ("freeze_blend", "set_destination_mode", "set_destination_link", "set_reactive_config", "set_blend_position")
    out = [(f"NOT coalesce({known}, false)", "invalid_action", "action"), (f"action = 'update_block_config' AND NOT coalesce(block IN {quoted(BLOCKS)}, false)", "invalid_block", "block")]
    one_of = lambda when, field, values, code="invalid_value": out.append((f"{when} AND {field} IS NOT NULL AND NOT {field} IN {quoted(values)}", code, field))
    must = lambda when, field, values, code="invalid_value": out.append((f"{when} AND NOT coalesce({field} IN {quoted(values)}, false)", code, field))
    ranged = lambda when, field, lo, hi: out.append((f"{when} AND {field} IS NOT NULL AND ({field} < {lo}" + (f" OR {field} > {hi})" if hi is not None else ")"), "invalid_value", field))
    one_of(block, "link_target", TARGETS, "invalid_link_target")
    one_of(block, "spatial_mode", SPATIAL)
    for when in (block, reactive):
        one_of(when, "intensity_source", INTENSITIES)
        one_of(when, "intensity_curve", CURVES)
        out.append((f"{when} AND intensity_gamma IS NOT NULL AND intensity_gamma <= 0", "invalid_value", "intensity_gamma"))
        for a, b in (("coalesce(stage_left, strength_min)", "stage_home"), ("stage_home", "coalesce(stage_right, strength_max)"), ("coalesce(stage_left, strength_min)", "coalesce(stage_right, strength_max)")):
            out.append((f"{when} AND {a} > {b}", "invalid_stage_bounds", "stage"))
    out += [
        (f"{block} AND has_rank AND sae_rank IS NOT NULL AND NOT sae_rank IN (1, 2, 3, 4)", "invalid_value", "sae_rank"),
        (f"{block} AND feature_id IS NOT NULL AND (feature_id <> floor(feature_id) OR feature_id < 0 OR feature_id >= {FEATURES})", "invalid_feature_id", "feature_id"),
        (f"{block} AND mask IS NOT NULL AND cardinality(mask) <> {MASK}", "invalid_spatial_mask", "spatial_mask"),
        (f"{block} AND mask IS NOT NULL AND cardinality(mask) = {MASK} AND (array_min(mask) < 0 OR array_max(mask) > 1)", "invalid_spatial_mask", "spatial_mask"),
        ("action = 'freeze_blend' AND NOT active_session", "inactive_session", "context.activeSession"),
        ("action = 'set_destination_mode' AND mode = 'linked'", "invalid_value", "mode"),
        ("action = 'set_blend_position' AND coalesce(position < 0 OR position > 1, true)", "invalid_value", "position"),
        (f"{destination} AND space = 'latent' AND destination_type <> 'seed'", "invalid_value", "destination_type"),
        (f"{destination} AND space = 'prompt' AND destination_type <> 'prompt'", "invalid_value", "destination_type"),
        (f"{destination} AND destination_type = 'seed' AND coalesce(seed <> floor(seed), true)", "invalid_value", "seed"),
        (f"{destination} AND destination_type = 'seed' AND prompt IS NOT NULL", "invalid_value", "prompt"),
        (f"{destination} AND destination_type = 'prompt' AND coalesce(trim(prompt) = '', true)", "invalid_value", "prompt"),
        (f"{destination} AND destination_type = 'prompt' AND seed IS NOT NULL", "invalid_value", "seed"),
    ]
    must("action = 'set_destination'", "destination_type", KINDS)
    one_of(destination, "replace_mode", REPLACE)
    for verb in ("set_destination", "clear_destination"):
        must(f"action = '{verb}'", "space", SPACES)
        must(f"action = '{verb}'", "slot", SIDES)
    must("action = 'freeze_blend'", "target_slot", SIDES)
    for verb in prompt_only:
        must(f"action = '{verb}'", "space", SPACES)
        out.append((f"action = '{verb}' AND space = 'latent'", "invalid_value", "space"))
    must("action = 'set_destination_mode'", "mode", MODES)
    must("action = 'set_destination_link'", "link_target", TARGETS, "invalid_link_target")
    one_of(reactive, "position_source", POSITIONS)
    one_of(reactive, "silence_behavior", SILENCE)
    ranged(reactive, "drift_ms", 0, None)
    ranged(reactive, "blend_slew_rate", 0, None)
    ranged("action = 'set_composition_config'", "distance", 0, DISTANCE)
    one_of("action = 'set_composition_config'", "mode", COMPOSITION)
    return out


RULES = _rules()


def evidence(actions: DataFrame, raw: DataFrame, known: DataFrame) -> DataFrame:
    """(slot_owner, plan_id, block, feature_id) that a plan may use: known ones of search (both keys null), the owner's current ones and the plan's candidates."""
    search = known.select(F.lit(None).cast("long").alias("slot_owner"), F.lit(None).cast("long").alias("plan_id"), "block", "feature_id")
    current = config_state(actions).filter("feature_id IS NOT NULL").select("slot_owner", F.lit(None).cast("long").alias("plan_id"), "block", F.col("feature_id").cast("long").alias("feature_id"))
    listed = F.from_json("body", "feature_candidates array<struct<block:string,id:long>>")["feature_candidates"]
    own = raw.select(F.lit(None).cast("long").alias("slot_owner"), "plan_id", F.explode(listed).alias("c")).select("slot_owner", "plan_id", "c.block", F.col("c.id").alias("feature_id"))
    return search.unionByName(current).unionByName(own).filter(F.col("block").isin(*BLOCKS)).distinct()


def invented(actions: DataFrame, proof: DataFrame) -> DataFrame:
    """Features in range that no evidence of any of the three kinds knows for their block: an anti-join for each kind."""
    good = (F.col("action") == "update_block_config") & F.col("block").isin(*BLOCKS) & (F.col("feature_id") == F.floor("feature_id")) & F.col("feature_id").between(0, FEATURES - 1)
    asked = actions.filter(good).select("plan_id", "slot_owner", "idx", "part", "block", F.col("feature_id").cast("long").alias("feature_id"))
    for where, keys in (("slot_owner IS NULL AND plan_id IS NULL", []), ("slot_owner IS NOT NULL", ["slot_owner"]), ("plan_id IS NOT NULL", ["plan_id"])):
        keys = [*keys, "block", "feature_id"]
        asked = asked.hint("merge").join(proof.filter(where).select(*keys).distinct(), keys, "left_anti")
    return asked.select("plan_id", "idx", "part", "block", "feature_id")


def rejections(actions: DataFrame, raw: DataFrame, proof: DataFrame) -> DataFrame:
    """(plan_id, idx, part, code, path) of each broken rule; idx is null for rules of the plan as a whole.  A plan is accepted if it has none."""
    broken = F.array_compact(F.array(*[F.when(F.expr(rule), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for rule, code, path in RULES]))
    of_actions = actions.select("plan_id", "idx", "part", F.explode(broken).alias("r")).select("plan_id", "idx", "part", "r.code", "r.path")
    made_up = invented(actions, proof).select("plan_id", "idx", "part", F.lit("invented_feature_id").alias("code"), F.lit("feature_id").alias("path"))
    size = F.size(F.from_json("body", "actions array<struct<action:string>>")["actions"])
    rules = ((~F.col("armed"), "agent_disarmed", "context.armed"), (~F.col("connected"), "bridge_disconnected", "context.bridgeConnected"), (F.coalesce(size, F.lit(0)) <= 0, "invalid_plan", "actions"))
    whole = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for rule, code, path in rules]))
    of_plans = raw.select("plan_id", F.explode(whole).alias("r")).select("plan_id", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("int").alias("part"), "r.code", "r.path")
    return of_actions.unionByName(made_up).unionByName(of_plans)


def config_state(actions: DataFrame) -> DataFrame:
    """The configuration that updates leave in each block of each owner, in order of plan and action.

    The last value of each field counts where an update has one.  A rank counts where an update
    names it, null or not.  A target other than the one before sets the intensity source and curve
    too, as percussive targets need it, after the update's own.
    """
    order = F.struct("plan_id", "idx", "part")
    rows = actions.filter(F.col("action") == "update_block_config").filter(F.col("block").isin(*BLOCKS)).withColumn("at", order)
    percussive = F.col("link_target").startswith("drums") | F.col("link_target").endswith("_percussive")
    source = F.when(F.col("link_target").isNotNull(), F.when(percussive, "transient").otherwise("energy_smooth")).otherwise(F.col("intensity_source"))
    curve = F.when(F.col("link_target").isNotNull(), F.lit("linear")).otherwise(F.col("intensity_curve"))
    last = lambda c, value=None: F.max_by(value if value is not None else F.col(c), F.when((value if value is not None else F.col(c)).isNotNull(), F.col("at"))).alias(c)
    by = Window.partitionBy("slot_owner", "block").orderBy("plan_id", "idx", "part").rowsBetween(Window.unboundedPreceding, -1)
    moved = rows.withColumn("before", F.last("link_target", ignorenulls=True).over(by))
    changed = F.count_if(F.col("link_target").isNotNull() & ~F.col("link_target").eqNullSafe(F.col("before")))
    return moved.groupBy("slot_owner", "block").agg(
        last("feature_id"), last("link_target"), last("stage_left"), last("stage_home"), last("stage_right"), last("intensity_source", source), last("intensity_curve", curve),
        F.max_by("sae_rank", F.when(F.col("has_rank"), F.col("at"))).alias("sae_rank"), F.count_if("has_rank").alias("n_ranks"), changed.alias("n_targets"), F.count("*").alias("n_updates"),
    )


def _known(s: SparkSession, d: str) -> DataFrame:
    """What search has shown: every part's number as a feature of one block."""
    return table(s, d, "part").select(F.concat(F.lit("b"), (F.col("p_partkey") % 3).cast("string")).alias("block"), F.col("p_partkey").alias("feature_id"))


def _actions(s, d):
    return normalised(parsed(plans(s, d)))


def _written(s, d) -> tuple[DataFrame, DataFrame]:
    """Plans and their normalised actions, made and parsed once."""
    raw = materialize(plans(s, d), "plans")
    return raw, materialize(normalised(parsed(raw)), "actions")


def _invented(s, d):
    raw, actions = _written(s, d)
    return invented(actions, evidence(actions, raw, _known(s, d)))


def _rejected(s, d):
    raw, actions = _written(s, d)
    return rejections(actions, raw, evidence(actions, raw, _known(s, d)))


def base_stem(target: Column) -> Column:
    """The recorded stem that a target comes from: null for derived ones, itself where it is none of ours."""
    out = target
    for stem in reversed(STEMS):
        out = F.when(target.startswith(stem), stem).otherwise(out)
    return F.when(target.isin("tension", "global"), None).otherwise(out)


def staleness(profile: Column) -> Column:
    out = F.lit(DIRECTIVE)
    for name, seconds in STALENESS.items():
        out = F.when(profile == name, seconds).otherwise(out)
    return out


#: Modes and intensities as sessions come with them, and a timing profile where one is set.
MODES_IN, PROFILES_IN = ("dj", "directive", "dj", None), ("section_timed", None, None, None, None)
INTENSITY_IN = ("calm", None, "active", "balanced", "active")


def _profile() -> Column:
    """The timing profile of an event's session: the one set, else by mode and intensity."""
    n = F.col("event_id")
    by_mode = F.when(_cycle(n, MODES_IN) == "dj", F.concat(F.lit("dj_"), F.coalesce(_cycle(n, INTENSITY_IN), F.lit("balanced")))).otherwise("directive")
    return F.coalesce(_cycle(n, PROFILES_IN), by_mode)


SHOWN = ("plan_id", "idx", "part", "action", "block", "space", "slot", "destination_type", "seed", "prompt", "link_target", "feature_id")

QUERIES = {
    "src_plans": lambda s, d: parsed(plans(s, d)).select("plan_id", "idx", "action", "block", "space", "slot", "destination_type", "seed", "prompt", "link_target", "feature_id", F.size("mask").alias("mask_size"), "stage.center"),
    "prj_alias_normalise": lambda s, d: _actions(s, d).select(*SHOWN),
    "prj_clamp_stage": lambda s, d: _actions(s, d).select("plan_id", "idx", "part", *STAGE_FIELDS, "distance"),
    "flt_plan_valid": _rejected,
    "flt_plan_accepted": lambda s, d: plans(s, d).select("plan_id").hint("merge").join(_rejected(s, d).select("plan_id").distinct(), "plan_id", "left_anti"),
    "flt_feature_evidence": _invented,
    "agg_config_state": lambda s, d: config_state(_actions(s, d)),
    "fn_staleness_limit": lambda s, d: table(s, d, "events").select("event_id", _profile().alias("profile")).select("event_id", "profile", staleness(F.col("profile")).alias("limit_s")),
    "prj_base_stem": lambda s, d: table(s, d, "events").select("event_id", _cycle(F.col("event_id"), (*TARGETS, "kazoo", "bassoon")).alias("target")).select("event_id", "target", base_stem(F.col("target")).alias("base")),
}


def _pick(n: str, values: tuple) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[({n}) % {len(values)} + 1]"


_N = "(o_orderkey * 3 + i)"
_ACT = f"""raw AS (SELECT o_orderkey AS plan_id, o_custkey AS slot_owner, o_orderkey % 53 <> 0 AS armed, o_orderkey % 59 <> 0 AS connected, o_orderkey % 5 <> 0 AS active_session, o_orderkey % 97 = 0 AS broken, o_orderkey % 41 = 0 AS hollow,
  {_pick('o_orderkey', SAID['block'])} AS c_block, (o_custkey * 37) % 6000 AS c_id FROM orders),
n0 AS (SELECT *, {_N} AS n FROM (SELECT *, unnest(range(0, o_orderkey % 3 + 1)) AS i FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 41 <> 0)),
n1 AS (SELECT *, n % 2 = 0 AS old, ((n * 7) % 140)::DOUBLE - 70 AS sl, ((n * 5) % 120)::DOUBLE - 60 AS sh, ((n * 11) % 140)::DOUBLE - 60 AS sr FROM n0),
acts AS (SELECT o_orderkey AS plan_id, o_custkey AS slot_owner, o_orderkey % 5 <> 0 AS active_session, i::INTEGER AS idx, {_pick('n', SAID['verb'])} AS action, {_pick('n', SAID['block'])} AS block,
  CASE WHEN n % 5 <> 0 THEN ((o_custkey * 37 + i * 1000) % 6000)::DOUBLE END AS feature_id, {_pick('n', SAID['link_target'])} AS link_target, {_pick('n + 1', SAID['space'])} AS space, {_pick('n + 2', SAID['slot'])} AS slot, {_pick('n + 3', SAID['slot'])} AS target_slot,
  {_pick('n', SAID['destination_type'])} AS destination_type, CASE WHEN n % 4 < 2 THEN (n % 1000)::DOUBLE + CASE WHEN n % 7 = 0 THEN 0.5 ELSE 0.0 END END AS seed, CASE WHEN n % 3 = 0 THEN (n % 50)::DOUBLE END AS seed_a, CASE WHEN n % 4 = 0 THEN (n % 60)::DOUBLE END AS seed_b,
  CASE n % 3 WHEN 0 THEN 'scene ' || n WHEN 1 THEN ' ' END AS prompt, CASE WHEN n % 2 = 1 THEN 'one ' || n END AS prompt_a, CASE WHEN n % 3 = 1 THEN 'two ' || n END AS prompt_b, {_pick('n + 1', SAID['mode'])} AS mode, {_pick('n', SAID['replace'])} AS replace_mode, {_pick('n', SAID['spatial'])} AS spatial_mode,
  CASE WHEN n % 6 <> 0 THEN ((n * 7) % 140) / 100.0::DOUBLE - 0.2::DOUBLE END AS position, CASE WHEN n % 3 <> 2 THEN ((n * 3) % 80) / 10.0::DOUBLE - 2 END AS distance, CASE WHEN NOT old THEN sl END AS stage_left, CASE WHEN NOT old THEN sh END AS stage_home, CASE WHEN NOT old THEN sr END AS stage_right,
  CASE WHEN n % 4 = 1 THEN sl END AS strength_min, CASE WHEN n % 4 = 1 THEN sr END AS strength_max,
  CASE WHEN n % 13 = 0 THEN list_transform(range(1, {MASK + 1}), lambda x: CASE WHEN n % 26 = 0 AND x = 5 THEN 1.5 ELSE 0.25 END) WHEN n % 17 = 0 THEN [0.25, 0.25, 0.25] END AS mask,
  {_pick('n', SAID['position_source'])} AS position_source, {_pick('n', SAID['source'])} AS intensity_source, {_pick('n', SAID['curve'])} AS intensity_curve, {_pick('n', SAID['silence'])} AS silence_behavior, CASE WHEN n % 4 <> 0 THEN (n % 5)::DOUBLE - 1 END AS intensity_gamma,
  CASE WHEN n % 5 <> 0 THEN ((n % 7) * 100)::DOUBLE - 100 END AS drift_ms, CASE WHEN n % 7 <> 0 THEN (n % 4)::DOUBLE - 1 END AS blend_slew_rate, CASE WHEN n % 5 <> 4 THEN (n % 6)::DOUBLE END AS sae_rank, n % 3 = 0 AS has_rank,
  CASE WHEN old THEN sl END AS o_left, CASE WHEN old AND n % 4 = 0 THEN sh END AS o_home, CASE WHEN old AND n % 4 = 2 THEN sh END AS o_center, CASE WHEN old THEN sr END AS o_right FROM n1)"""
_SIDED = "destination_type IN ('prompt_a', 'prompt_b', 'seed_a', 'seed_b')"
_REST = "block, feature_id, link_target, target_slot, mode, replace_mode, spatial_mode, position, distance, stage_left, stage_home, stage_right, strength_min, strength_max, mask, position_source, intensity_source, intensity_curve, silence_behavior, intensity_gamma, drift_ms, blend_slew_rate, sae_rank, has_rank, o_left, o_home, o_center, o_right"
_NULLS = ", ".join(f"NULL AS {c.strip()}" for c in _REST.split(","))


def _put(when: str, order: int, space: str, side: str, kind: str, value: str) -> str:
    return f"""SELECT plan_id, slot_owner, active_session, idx, {order} AS place, 'set_destination' AS action, '{space}' AS space, '{side}' AS slot, '{kind}' AS destination_type, {value if kind == 'seed' else 'NULL'} AS seed, {value if kind == 'prompt' else 'NULL'} AS prompt, {_NULLS}
  FROM named WHERE {when} AND {value} IS NOT NULL {f"AND {value} = floor({value})" if kind == 'seed' else f"AND trim({value}) <> ''"}"""


_LIM = "CASE WHEN {0} IS NOT NULL THEN greatest({1}, least({2}, {0})) END"
_STAGED = "action IN ('update_block_config', 'set_reactive_config')"
_SPREAD = {"stage_left": "coalesce(stage_left, o_left)", "stage_home": "coalesce(stage_home, o_home, o_center)", "stage_right": "coalesce(stage_right, o_right)", "strength_min": "strength_min", "strength_max": "strength_max"}
_NORM = f"""{_ACT}, named AS (SELECT * REPLACE (CASE WHEN action = 'set_composition' THEN 'set_composition_config' ELSE action END AS action) FROM acts),
typed AS (SELECT *, CASE WHEN {_SIDED} THEN string_split(destination_type, '_')[1] ELSE destination_type END AS bare, action = 'set_destination' AS dest FROM named),
spaced AS (SELECT *, CASE WHEN dest THEN coalesce(space, CASE WHEN bare = 'seed' OR seed IS NOT NULL THEN 'latent' WHEN bare = 'prompt' OR prompt IS NOT NULL THEN 'prompt' END) ELSE space END AS space2 FROM typed),
split AS (SELECT plan_id, slot_owner, active_session, idx, 9 AS place, action, space2 AS space, CASE WHEN dest AND {_SIDED} THEN coalesce(slot, string_split(destination_type, '_')[2]) ELSE slot END AS slot,
    CASE WHEN dest THEN coalesce(bare, CASE WHEN space2 = 'latent' OR seed IS NOT NULL THEN 'seed' WHEN space2 = 'prompt' OR prompt IS NOT NULL THEN 'prompt' END) ELSE destination_type END AS destination_type, seed, prompt, {_REST} FROM spaced WHERE coalesce(action NOT IN ('set_prompt', 'set_prompt_destinations'), true)
  UNION ALL {_put("action = 'set_prompt'", 0, 'prompt', 'a', 'prompt', 'prompt_a')} UNION ALL {_put("action = 'set_prompt'", 1, 'prompt', 'b', 'prompt', 'prompt_b')}
  UNION ALL {_put("action = 'set_composition_config'", 2, 'latent', 'a', 'seed', 'seed_a')} UNION ALL {_put("action = 'set_composition_config'", 3, 'latent', 'b', 'seed', 'seed_b')}),
norm AS (SELECT * REPLACE ({', '.join(f"CASE WHEN {_STAGED} THEN {_LIM.format(x, -STAGE, STAGE)} ELSE {c} END AS {c}" for c, x in _SPREAD.items())}, CASE WHEN action = 'set_composition_config' THEN {_LIM.format('distance', 0.0, DISTANCE)} ELSE distance END AS distance),
  (row_number() OVER (PARTITION BY plan_id, idx ORDER BY place) - 1)::INTEGER AS part FROM split)"""
_IN_BLOCKS = "block IN (" + ", ".join(f"'{b}'" for b in BLOCKS) + ")"
_PERC = "(link_target LIKE 'drums%' OR link_target LIKE '%\\_percussive' ESCAPE '\\')"


def _last(c: str, value: str | None = None) -> str:
    x = value or c
    return f"arg_max({x}, struct_pack(p := plan_id, i := idx, q := part)) FILTER (({x}) IS NOT NULL) AS {c}"


_STATE = f"""upd AS (SELECT *, last_value(link_target IGNORE NULLS) OVER (PARTITION BY slot_owner, block ORDER BY plan_id, idx, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM norm WHERE action = 'update_block_config' AND {_IN_BLOCKS}),
state AS (SELECT slot_owner, block, {_last('feature_id')}, {_last('link_target')}, {_last('stage_left')}, {_last('stage_home')}, {_last('stage_right')},
  {_last('intensity_source', f"CASE WHEN link_target IS NOT NULL THEN CASE WHEN {_PERC} THEN 'transient' ELSE 'energy_smooth' END ELSE intensity_source END")}, {_last('intensity_curve', "CASE WHEN link_target IS NOT NULL THEN 'linear' ELSE intensity_curve END")},
  arg_max_null(sae_rank, struct_pack(p := plan_id, i := idx, q := part)) FILTER (has_rank) AS sae_rank, count(*) FILTER (has_rank) AS n_ranks, count(*) FILTER (link_target IS NOT NULL AND link_target IS DISTINCT FROM before) AS n_targets, count(*) AS n_updates FROM upd GROUP BY ALL)"""
_INVENTED = f"""{_STATE}, asked AS (SELECT plan_id, slot_owner, idx, part, block, feature_id::BIGINT AS feature_id FROM norm WHERE action = 'update_block_config' AND {_IN_BLOCKS} AND feature_id = floor(feature_id) AND feature_id BETWEEN 0 AND {FEATURES - 1}),
invented AS (SELECT plan_id, idx, part, block, feature_id FROM asked a WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = a.feature_id AND 'b' || (p.p_partkey % 3) = a.block)
  AND NOT EXISTS (SELECT 1 FROM state s WHERE s.slot_owner = a.slot_owner AND s.block = a.block AND s.feature_id = a.feature_id)
  AND NOT EXISTS (SELECT 1 FROM raw r WHERE NOT r.broken AND r.plan_id = a.plan_id AND r.c_block = a.block AND r.c_id = a.feature_id))"""
_REJECTED = f"""{_INVENTED}, rej AS ({' UNION ALL '.join(f"SELECT plan_id, idx, part, '{code}' AS code, '{path}' AS path FROM norm WHERE {rule.replace('cardinality(', 'len(').replace('array_min(', 'list_min(').replace('array_max(', 'list_max(')}" for rule, code, path in RULES)}
  UNION ALL SELECT plan_id, idx, part, 'invented_feature_id', 'feature_id' FROM invented UNION ALL SELECT plan_id, NULL, NULL, 'agent_disarmed', 'context.armed' FROM raw WHERE NOT armed
  UNION ALL SELECT plan_id, NULL, NULL, 'bridge_disconnected', 'context.bridgeConnected' FROM raw WHERE NOT connected UNION ALL SELECT plan_id, NULL, NULL, 'invalid_plan', 'actions' FROM raw WHERE broken OR hollow)"""
_STEM = "CASE WHEN target IN ('tension', 'global') THEN NULL " + " ".join(f"WHEN target LIKE '{s}%' THEN '{s}'" for s in STEMS) + " ELSE target END"
_LIMITS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in STALENESS.items())

ORACLE_SQL = {
    "src_plans": f"WITH {_ACT} SELECT plan_id, idx, action, block, space, slot, destination_type, seed, prompt, link_target, feature_id, len(mask)::INTEGER AS mask_size, o_center AS center FROM acts",
    "prj_alias_normalise": f"WITH {_NORM} SELECT {', '.join(SHOWN)} FROM norm",
    "prj_clamp_stage": f"WITH {_NORM} SELECT plan_id, idx, part, {', '.join(STAGE_FIELDS)}, distance FROM norm",
    "flt_plan_valid": f"WITH {_NORM}, {_REJECTED} SELECT * FROM rej",
    "flt_plan_accepted": f"WITH {_NORM}, {_REJECTED} SELECT plan_id FROM raw WHERE plan_id NOT IN (SELECT plan_id FROM rej)",
    "flt_feature_evidence": f"WITH {_NORM}, {_INVENTED} SELECT * FROM invented",
    "agg_config_state": f"WITH {_NORM}, {_STATE} SELECT * FROM state",
    "fn_staleness_limit": f"""WITH p AS (SELECT event_id, coalesce({_pick('event_id', PROFILES_IN)}, CASE WHEN {_pick('event_id', MODES_IN)} = 'dj' THEN 'dj_' || coalesce({_pick('event_id', INTENSITY_IN)}, 'balanced') ELSE 'directive' END) AS profile FROM events)
SELECT event_id, profile, CASE profile {_LIMITS} ELSE {DIRECTIVE} END AS limit_s FROM p""",
    "prj_base_stem": f"SELECT event_id, target, {_STEM} AS base FROM (SELECT event_id, {_pick('event_id', (*TARGETS, 'kazoo', 'bassoon'))} AS target FROM events)",
}
