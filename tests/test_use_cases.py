"""Small cases of use: search, picks, plans, clocks, profiles, sections, joins with hot keys."""

import json
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions.text import clean_word
from tessera.operators import activation, follow, labels, profile, rules, search, series, signals
from tessera.plans import actions
from tessera.session import checkpoint_root, join_counted
from tessera.streaming import telemetry

CATALOG = [
    (1, "glittering sparkles and highlights", "pattern", 35.0), (2, "glittering sparkles and highlights", "pattern", 34.0), (3, "dark shadow dramatic lighting", "lighting", 30.0),
    (4, "turtle shell reptile texture", "texture", 28.0), (5, "striped giraffe animal print", "pattern", 32.0), (6, "soft floral dress pattern", "pattern", 22.0),
]


@pytest.fixture(scope="module")
def shelf(spark):
    return spark.createDataFrame([("b0", i, label, c, "high", x) for i, label, c, x in CATALOG], "block string, id long, label string, category string, confidence string, mean_activation double")


def test_search_finds_the_phrase_and_no_label_twice(spark, shelf):
    asked = spark.createDataFrame([(0, "sparkle glitter")], "query_id int, phrase string")
    found = search.hybrid(asked, shelf, 6, semantic=False).orderBy("rn").collect()
    assert found[0].id == 1 and found[0].lexical == 1.0 and found[0].fallback == "semantic disabled"
    everything = search.hybrid(asked, shelf, 6).collect()
    assert {r.id for r in everything} == {1, 3, 4, 5, 6} and all(r.fallback is None for r in everything)
    left = shelf.filter("id <> 1")
    assert search.hybrid(asked, left, 6, semantic=False).first().id == 2


def test_a_pick_skips_labels_that_are_nearly_one_taken(spark):
    long = "one two three four five six seven"
    rows = spark.createDataFrame([("b", 1, long + " eight", 0.9), ("b", 2, long, 0.8), ("b", 3, "one two three four five six other", 0.7), ("b", 4, long.upper() + " EIGHT", 0.95)], "block string, id long, label string, score double")
    assert [r.id for r in search.diverse(rows, ["block"], 3).orderBy("rn").collect()] == [4, 3]
    assert [r.id for r in search.diverse(rows, ["block"], 1).collect()] == [4]


def test_a_pick_is_full_wherever_there_are_enough_labels(spark):
    alike = [(1, i, "high", 50.0, f"small blue anvil of tin and brass number x{'' if i % 2 else ' y'}") for i in range(200)]
    odd = [(1, 1000 + i, "low", 1.0, f"word{i} other{i}") for i in range(20)]
    shelf = spark.createDataFrame([(b, i, f"{t} {i // 100}" if i < 1000 else t, 100.0 - i / 100) for b, i, _, _, t in alike + odd], "block long, id long, label string, score double")
    picked = search.diverse(shelf, ["block"], 8, pool=2).orderBy("rn").collect()
    assert [r.rn for r in picked] == list(range(1, 9)) and picked[0].id == 0
    assert [r.id for r in picked] == [r.id for r in search.diverse(shelf, ["block"], 8).orderBy("rn").collect()]
    few = search.diverse(shelf.filter("id < 1003"), ["block"], 8, pool=1).collect()
    assert {r.id for r in few} >= {1000, 1001, 1002}


def test_search_without_tokens_in_a_category_and_at_a_temperature(spark):
    rows = [("b", i, f"label number{i}", "tools" if i % 2 else "toys", ["high", "medium"][i % 2], float(i)) for i in range(40)]
    shelf = spark.createDataFrame(rows, "block string, id long, label string, category string, confidence string, mean_activation double")
    asked = spark.createDataFrame([(0, "of the"), (1, "")], "query_id int, phrase string")
    for semantic in (True, False):
        found = search.hybrid(asked, shelf, 8, semantic).collect()
        assert [sum(r.query_id == q for r in found) for q in (0, 1)] == [8, 8]
        assert {r.id for r in found if r.query_id == 0} == {24, 26, 28, 30, 32, 34, 36, 38}
        assert {r.fallback for r in found if r.query_id == 1} == {"empty query" if semantic else "semantic disabled"}
    used = shelf.filter("id > 30")
    tools = search.hybrid(asked, shelf, 8, category=" Tools ", avoid=used).filter("query_id = 0").collect()
    assert {r.id for r in tools} == {15, 17, 19, 21, 23, 25, 27, 29}
    draws = [tuple(r.id for r in search.hybrid(asked.filter("query_id = 0"), shelf, 8, temperature=t, seed=s).orderBy("rn").collect()) for t, s in ((0.0, "a"), (0.9, "a"), (0.9, "a"), (0.9, "b"))]
    assert draws[1] == draws[2] and len({*draws}) == 3 and all(len(d) == 8 for d in draws)


@pytest.mark.parametrize("divergence", [0.0, 0.5, 0.75, 1.0])
def test_bucket_counts_fill_the_palette(divergence):
    for per_block in (1, 8, 24, 39, 90):
        counts = search.bucket_counts(per_block, divergence)
        assert sum(counts.values()) == max(8, min(per_block, 40)) and all(n >= 0 for n in counts.values())


def test_off_items_are_all_silent_ones_of_a_dense_feature(spark):
    fired = [(0, 7, i) for i in (0, 1, 3)] + [(0, 8, i) for i in range(5)] + [(1, 9, 2)]
    stats = spark.createDataFrame(fired, "block int, feature_id int, item_id long")
    rows = activation.off_items(stats, 5).collect()
    assert {(r.feature_id, r.item_id) for r in rows if r.feature_id != 9} == {(7, 2), (7, 4)}
    nine = [r.item_id for r in rows if r.feature_id == 9]
    assert len(set(nine)) == 3 and 2 not in nine and set(nine) <= set(range(5))


def test_sections_of_a_novelty_curve():
    curve = np.zeros(31)
    curve[10], curve[22] = 1.0, 0.9
    assert profile.section_starts(curve) == [0, 10, 22]
    assert profile.section_starts(np.ones(9)) == [0] and profile.section_starts(np.zeros(2)) == [0]


def test_peaks_match_plain_definitions():
    rng = np.random.default_rng(3)
    for _ in range(100):
        x = rng.integers(0, 9, 40) / 8.0
        got = profile.find_peaks(x, 0.3, 3, 0.25)
        tops = [(i + j) // 2 for i in range(1, 39) for j in range(i, 39) if (x[i : j + 1] == x[i]).all() and x[i - 1] < x[i] and x[j + 1] < x[i]]
        tops = [p for p in tops if x[p] >= 0.3]
        kept = []
        for p in sorted(tops, key=lambda p: (-x[p], p)):
            if all(abs(p - q) >= 3 for q in kept):
                kept.append(p)

        def base(side, p):
            run = [x[p]]
            for v in side:
                if v > x[p]:
                    break
                run.append(v)
            return min(run)

        assert got == sorted(p for p in kept if x[p] - max(base(x[:p][::-1], p), base(x[p + 1 :], p)) >= 0.25)


def test_a_rising_curve_is_stable_then_rising(spark):
    curve = spark.createDataFrame([(1, "view", float(i), series.SCALE * i / 9) for i in range(10)], "track long, stem string, t double, v double")
    rows = series.arc(curve, 4).orderBy("t").collect()
    assert [r.trend for r in rows] == ["stable", "rising", "rising", "rising"] and [round(r.level, 6) for r in rows] == [0.0, 0.333333, 0.666667, 1.0]


def test_empty_windows_take_the_line_at_their_middle(spark):
    curve = spark.createDataFrame([(1, "view", 0.0, 10.0), (1, "view", 20.0, 30.0)], "track long, stem string, t double, v double")
    cuts = spark.createDataFrame([(1, 0, 5, 0), (1, 5, 15, 1), (1, 15, 21, 2)], "track long, start int, stop int, section int")
    rows = {r.section: r for r in series.windowed(curve, cuts).collect()}
    assert (rows[0].mean_v, rows[1].mean_v, rows[2].mean_v) == (10.0, 20.0, 30.0) and all(r.delta == 0 for r in rows.values())


def wide_frames(spark, stem, **channels):
    base = {"v": 100.0, "envelope": 0.5, "energy_smooth": 0.75, "transient": 0.0, "flux": 0.0, "brightness": 0.02, "flatness": 0.1, "sustain": 0.0, "flash": 0.5, "pitch_confidence": 0.0, "pitch_normalized": 0.0, "chroma_centroid": 0.0, "tonal_distance": 0.0, "novelty_long": 0.0}
    rows = [(1, stem, i, *({**base, **{k: f(i) if callable(f) else f for k, f in channels.items()}}.values()), i / 96.0, i % 8 == 0) for i in range(97)]
    return spark.createDataFrame(rows, "track long, stem string, frame_idx int, " + ", ".join(f"{c} double" for c in base) + ", tension double, voiced boolean")


def test_a_stem_of_hits_is_percussive(spark):
    hits = wide_frames(spark, "click", transient=lambda i: float(i % 8 == 0), sustain=0.02)
    row = signals.stem_profiles(hits).first()
    assert (row.role, row.texture_kind, row.band, row.has_pitch, row.has_tension) == ("percussive", "percussive", "mid", False, True) and abs(row.mean_energy - 0.75) < 1e-9


def test_tags_of_a_profile(spark):
    names = ("mean_energy", "peak_energy", "dynamic_range", "active_ratio", "onset_density", "transient_score", "flux_score", "brightness_score", "sustain_score", "pitch_confidence", "chroma_motion", "tension_variance", "uniqueness_score", "brightness_dynamic")
    rows = [(1, "view", "physical", *(0.8 if n == "pitch_confidence" else 0.3 if n == "active_ratio" else 0.0 for n in names)), (1, "click_percussive", "hpss", *(0.9 if n == "transient_score" else 0.3 if n == "active_ratio" else 0.0 for n in names)), (1, "tension", "derived", *(0.3 if n == "active_ratio" else 0.0 for n in names))]
    found = {r.target: r for r in signals.tags(spark.createDataFrame(rows, "track long, target string, grp string, " + ", ".join(f"{n} double" for n in names))).collect()}
    assert "prompt_position" in found["view"].good_for and found["view"].affordances == ["pitch"] and found["view"].movement_words == ["pitched"]
    assert found["click_percussive"].preferred_source == "transient" and found["click_percussive"].movement_words == ["punchy"]
    assert found["tension"].affordances == ["tension", "tension_global"] and found["tension"].good_for == ["section_or_harmony_arc"]


def test_number_lists_and_words(spark):
    df = spark.createDataFrame([("3, 10. x7 11 0 3;", "(Eyes),", "the")], "a string, b string, c string")
    row = df.select(rules.number_list(F.col("a")).alias("n"), clean_word(F.col("b")).alias("w"), clean_word(F.col("c")).alias("s")).first()
    assert (row.n, row.w, row.s) == ([3, 10], "eyes", None)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"label": "cat eyes", "category": "animal", "confidence": "high"}', ("cat eyes", "animal", "high", "json")),
        ('```json\n{"label": "fur"}\n```', ("fur", "unknown", "medium", "json")),
        ("- label: red door\n- category: object", ("red door", "object", "medium", "line")),
        ("**Label**: 'sky'\nconfidence: low", ("sky", "unknown", "low", "line")),
        ("\n\n just a line \nmore", ("just a line", "unknown", "low", "first")),
        ("", ("", "unknown", "low", "first")),
    ],
)
def test_replies_are_parsed(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "raw string").select(labels.parse_annotation(F.col("raw")).alias("x")).select("x.*").first()
    assert (row.label, row.category, row.confidence, row.source) == want


def plan(spark, *acts, candidates=()):
    body = json.dumps({"actions": list(acts), "feature_candidates": list(candidates)})
    return spark.createDataFrame([(1, 5, body, True, True, True)], "plan_id long, slot_owner long, body string, armed boolean, connected boolean, active_session boolean")


def codes(spark, *acts, candidates=()):
    raw = plan(spark, *acts, candidates=candidates)
    rows = actions.normalised(actions.parsed(raw))
    known = spark.createDataFrame([("b0", 42)], "block string, feature_id long")
    nothing = rows.limit(0)
    return sorted((r.code, r.path) for r in actions.rejections(rows, raw, actions.evidence(nothing, raw, known)).collect())


def test_plans_are_split_clamped_and_judged(spark):
    two = actions.normalised(actions.parsed(plan(spark, {"type": "set_prompt", "prompt_a": "x", "prompt_b": "y"}, {"action": "set_composition", "seed_a": 3, "distance": 9}, {"action": "set_destination", "destination_type": "seed_b", "seed": 4}))).orderBy("idx", "part").collect()
    assert [(r.action, r.space, r.slot, r.destination_type) for r in two] == [
        ("set_destination", "prompt", "a", "prompt"), ("set_destination", "prompt", "b", "prompt"), ("set_destination", "latent", "a", "seed"), ("set_composition_config", None, None, None), ("set_destination", "latent", "b", "seed")
    ]
    assert two[3].distance == 4.0
    assert codes(spark, {"action": "update_block_config", "block": "b0", "feature_id": 42, "stage": {"left": -90, "center": 0, "right": 10}}) == []
    assert codes(spark, {"action": "update_block_config", "block": "b0", "feature_id": 43}) == [("invented_feature_id", "feature_id")]
    assert codes(spark, {"action": "update_block_config", "block": "b0", "feature_id": 43}, candidates=[{"block": "b0", "id": 43}]) == []
    assert codes(spark, {"action": "update_block_config", "block": "b0", "feature_id": 9000}) == [("invalid_feature_id", "feature_id")]
    assert codes(spark, {"action": "update_block_config", "block": "zz"}, {"action": "nonsense"}) == [("invalid_action", "action"), ("invalid_block", "block")]
    assert codes(spark, {"action": "set_blend_position", "space": "latent", "position": 2}) == [("invalid_value", "position"), ("invalid_value", "space")]
    assert codes(spark, {"action": "update_block_config", "block": "b1", "stage_left": 5, "stage_home": 1, "stage_right": 0})[0][0] == "invalid_stage_bounds"
    assert codes(spark) == [("invalid_plan", "actions")]


def test_a_rank_of_null_counts_only_where_it_is_named(spark):
    rows = [(1, 0, 2.0, True), (2, 0, None, False), (3, 0, None, True)]
    fields = actions.normalised(actions.parsed(plan(spark, {"action": "update_block_config", "block": "b0"})))
    for upto, want in ((1, 2.0), (2, 2.0), (3, None)):
        made = None
        for plan_id, part, rank, named in rows[:upto]:
            one = fields.withColumns({"plan_id": F.lit(plan_id).cast("long"), "part": F.lit(part), "sae_rank": F.lit(rank).cast("double"), "has_rank": F.lit(named)})
            made = one if made is None else made.unionByName(one)
        assert actions.config_state(made).first().sae_rank == want


def test_the_clock_takes_half_of_a_drift():
    state = telemetry.clock_step((0.0, -1.0, False, 0), "view", 10.0, 100.0)
    assert state == (10.0, 100.0, True, 1)
    state = telemetry.clock_step(state, "view", 11.5, 101.0)  # predicted 11.0
    assert state[:2] == (10.0, 99.75)
    assert telemetry.clock_step(state, telemetry.PAUSE, 0.0, 0.0)[2] is False
    assert telemetry.clock_step(state, telemetry.SEEK, 3.0, 120.0)[:2] == (3.0, 120.0)


def test_surprise_jumps_and_fades():
    state = telemetry.surprise_step((0.0, 0.0), 0.9, 1.0)
    assert state == (0.9, 1.0)
    assert abs(telemetry.surprise_step(state, 0.1, 2.0)[0] - 0.57) < 1e-12 and telemetry.surprise_step(state, 0.1, 9.0)[0] == 0.0


def test_moving_averages_go_on_from_batch_to_batch(spark):
    rng = random.Random(5)
    values = [(s, i, rng.random()) for s in (1, 2) for i in range(40)]
    want = {}
    for s, _, x in values:
        want[s] = x if s not in want else 0.85 * want[s] + 0.15 * x
    whole = telemetry.ema_step(spark.createDataFrame(values, "k long, i long, x double"), "k", "x", ["i"]).collect()
    assert all(abs(r["shift"] + r["factor"] * r["first"] - want[r["k"]]) < 1e-12 for r in whole)
    first = telemetry.ema_step(spark.createDataFrame([v for v in values if v[1] < 15], "k long, i long, x double"), "k", "x", ["i"]).collect()
    later = telemetry.ema_step(spark.createDataFrame([v for v in values if v[1] >= 15], "k long, i long, x double"), "k", "x", ["i"]).collect()
    before = {r["k"]: r["shift"] + r["factor"] * r["first"] for r in first}
    assert all(abs(r["shift"] + r["factor"] * before[r["k"]] - want[r["k"]]) < 1e-12 for r in later)


def test_clusters_of_near_vectors_are_found(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3, 64))
    rows = [(i, int(i % 3), (centres[i % 3] + 0.2 * rng.normal(size=64)).tolist()) for i in range(45)] + [(100 + i, 9, rng.normal(size=64).tolist()) for i in range(3)]
    found = {r.vec_id: r.cluster for r in follow.density_clusters(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 0.4).collect()}
    assert [found[i] for i in range(45)] == [i % 3 for i in range(45)] and all(found[100 + i] == -1 for i in range(3))


def test_joins_with_hot_keys_lose_nothing(spark):
    keys = [0] * 3000 + list(range(1, 2600))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    counted = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low"))
    got = join_counted(rows, counted, "k", "n", "probe", share=0.001)
    assert sorted(got.columns) == ["i", "k", "low", "n"]
    lows = {}
    for i, k in enumerate(keys):
        lows.setdefault(k, i)
    assert {(r.k, r.i, r.low) for r in got.collect()} == {(k, i, lows[k]) for i, k in enumerate(keys)} and got.count() == len(keys)
    some = join_counted(rows, counted.filter("n > 1"), ["k"], "n", "probe")
    assert some.count() == 3000


def test_no_local_folder_is_shared_on_a_cluster():
    class Context:
        master = "spark://elsewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


def test_the_entry_works_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "tessera.llm.registry", None)
    monkeypatch.setattr(__spark_entry__, "_llm", __spark_entry__._llm)
    for name in [n for n in sys.modules if n.startswith("tessera.llm")]:
        monkeypatch.setitem(sys.modules, name, None)
    assert "top_feature_items" in __spark_entry__.queries() and not any(n.startswith("op1_") for n in __spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
