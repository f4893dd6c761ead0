"""Annotator labels: agreement, fusion, cleaning, validation and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import MARKS, THEME_STOPWORDS, aligned, clean_word, cosine, hashed_vector, hashed_vector_sql
from tessera.session import delete_at_exit, scratch_path, table

#: Marks of model chatter in labels, order of trust.
ARTIFACT = r"(?i)^(Looking at|I need to|Let me|I'll |Based on|Analyzing|The (image|feature))"
ANNOTATORS = ("a0", "a1", "a2")
AGREE, DISAGREE = 0.7, 0.65
#: Marks of reasoning in place of a label, and its length from which it is no label.
CHATTER_START, CHATTER, CHATTER_CHARS = "looking at", ("i need to", "i can see", "the first 3", "reference images"), 80
#: The one block in which places on the image name features, and the patterns that count there.
STRUCTURAL_BLOCK = "Brand#13"
STRUCTURAL = ("center", "top", "bottom", "left", "right", "top-left", "top-right", "bottom-left", "bottom-right", "horizontal-band", "vertical-band", "border", "corners")
DIMS = 32


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of three annotators for each part, as (block, feature_id, annotator, label, category, confidence).

    Missing fields take their defaults: "", unknown and low.
    """
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name, kind = F.lower("p_name"), F.lower("p_type")
    says = {
        "a0": (k % 7 != 0, name),
        "a1": (k % 5 != 0, F.when(k % 4 == 0, kind).otherwise(name)),
        "a2": (k % 3 != 0, F.when(k % 10 == 5, F.lit("spatial: center")).when(k % 6 == 1, F.concat(F.lit("Looking at "), name)).when(k % 2 == 0, name).otherwise(kind)),
    }
    rows = F.array(*[F.struct(F.lit(a).alias("annotator"), F.when(has, label).alias("label"), has.alias("has")) for a, (has, label) in says.items()])
    seen = part.select(F.col("p_brand").alias("block"), k.alias("feature_id"), kind.alias("category"), F.explode(rows).alias("x")).filter("x.has")
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit(None).cast("string")), (F.col("feature_id") % 3 + 1).cast("int"))
    return seen.select("block", "feature_id", "x.annotator", F.coalesce("x.label", F.lit("")).alias("label"), F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce(confidence, F.lit("low")).alias("confidence"))


def write_annotations(spark: SparkSession, sf_dir: str) -> str:
    """JSON lines of each annotator in a folder of its own: seq, feature_id, block and what was said; default fields are left out, and some features are said twice."""
    rows = annotations(spark, sf_dir)
    unless = lambda c, default: F.when(F.col(c) != default, F.col(c)).alias(c)
    last = rows.select("annotator", F.lit(1).alias("seq"), "block", "feature_id", unless("label", ""), unless("category", "unknown"), unless("confidence", "low"))
    first = last.filter("feature_id % 11 = 0").withColumn("seq", F.lit(0)).withColumn("label", F.lit("an earlier label"))
    path = scratch_path(spark, "annotations")
    first.unionByName(last).write.partitionBy("annotator").json(path)
    delete_at_exit(spark, path)
    return path


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of all folders below ``path``: of repeated lines of a feature the last (the largest seq) counts; blank lines and absent folders give nothing."""
    lines = spark.read.schema("annotator string, seq long, block string, feature_id long, label string, category string, confidence string").json(path).filter("feature_id IS NOT NULL")
    last = lines.groupBy("block", "feature_id", "annotator").agg(F.max_by(F.struct("label", "category", "confidence"), "seq").alias("x"))
    return last.select("block", "feature_id", "annotator", F.coalesce("x.label", F.lit("")).alias("label"), F.coalesce("x.category", F.lit("unknown")).alias("category"), F.coalesce("x.confidence", F.lit("low")).alias("confidence"))


def wide_labels(labels: DataFrame) -> DataFrame:
    """One row for each feature with the three labels side by side, null where one is missing."""
    return labels.groupBy("block", "feature_id").agg(
        *[F.max(F.when(F.col("annotator") == a, F.col("label"))).alias(a) for a in ANNOTATORS], F.max("category").alias("category")
    )


def supplemented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, feature_id, terms, spatial_pattern, mean_activation, cv) of every part: words of its type as terms, and a place for every eighth."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    terms = F.when(k % 9 != 0, F.split(F.lower("p_type"), " "))
    return p.select(F.col("p_brand").alias("block"), k.alias("feature_id"), terms.alias("terms"), F.when(k % 8 == 0, "center").alias("spatial_pattern"), F.col("p_size").cast("double").alias("mean_activation"), (F.col("p_retailprice") / 1000.0).alias("cv"))


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature with what the annotators said of it, its supplements and its statistics; what is missing is null."""
    wide = wide_labels(annotations(spark, sf_dir))
    return supplemented(spark, sf_dir).hint("merge").join(wide, ["block", "feature_id"], "left")


def pair_similarity(wide: DataFrame) -> DataFrame:
    """Cosine of the vectors of each pair of labels; null where one is missing."""
    pairs = (("a0", "a1"), ("a0", "a2"), ("a1", "a2"))
    vectors = wide.withColumns({f"v_{a}": hashed_vector(F.col(a), DIMS) for a in ANNOTATORS})
    return vectors.withColumns({f"sim_{x}_{y}": F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), cosine(F.col(f"v_{x}"), F.col(f"v_{y}"))) for x, y in pairs}).drop(*[f"v_{a}" for a in ANNOTATORS])


def fuse_labels(features: DataFrame, agree: float = AGREE) -> DataFrame:
    """One label for each feature of ``assembled``.

    In the structural block a place on the image is the label.  Otherwise: none without
    labels; that of the more trusted of the pair that agrees best above ``agree`` (3-way if
    the agreeing pairs hold three labels); the first that a term backs; the first.  Trust
    goes in the order a0, a1, a2.  Empty labels don't count.
    """
    said = features.withColumns({a: F.nullif(F.col(a), F.lit("")) for a in ANNOTATORS})
    scored = pair_similarity(said)
    s = {p: F.coalesce(F.col(f"sim_{p}"), F.lit(-1.0)) for p in ("a0_a1", "a0_a2", "a1_a2")}
    best = F.greatest(*s.values())
    n_agree = sum((F.when(x > agree, 1).otherwise(0) for x in s.values()), F.lit(0))
    agreed = F.when((s["a0_a1"] == best) | (s["a0_a2"] == best), F.col("a0")).otherwise(F.col("a1"))
    guess = F.coalesce("a0", "a1", "a2")
    backed = F.coalesce(*[F.when(aligned(F.col(a), F.col("terms")), F.col(a)) for a in ANNOTATORS])
    place = (F.col("block") == STRUCTURAL_BLOCK) & F.coalesce(F.lower(F.trim("spatial_pattern")).isin(*STRUCTURAL), F.lit(False))
    method = (
        F.when(place, "spatial_analysis").when(guess.isNull(), "no_vlm_data").when(n_agree >= 2, "vlm_consensus_3way").when(best > agree, "vlm_consensus_2way").when(backed.isNotNull(), "vlm_tfidf_aligned").otherwise("best_guess")
    )
    label = F.when(place, F.concat(F.lit("spatial: "), "spatial_pattern")).when(guess.isNull(), "unlabeled").when(best > agree, agreed).otherwise(F.coalesce(backed, guess))
    category = F.when(place, "spatial").when(guess.isNull(), "unknown").otherwise(F.coalesce("category", F.lit("unknown")))
    confidence = F.when(method.isin("spatial_analysis", "vlm_consensus_3way", "vlm_consensus_2way"), "high").when(method == "vlm_tfidf_aligned", "medium").otherwise("low")
    return scored.select("block", "feature_id", label.alias("label"), category.alias("category"), confidence.alias("confidence"), method.alias("method"), "a0", "a1", "a2", F.slice("terms", 1, 5).alias("terms"), "spatial_pattern", F.round("mean_activation", 2).alias("mean_activation"), F.round("cv", 4).alias("cv"))


def is_bad_label(label: Column, block: Column) -> Column:
    """Model chatter, no label at all, or a place on the image in the structural block."""
    return F.coalesce(F.rlike(label, F.lit(ARTIFACT)) | (label == "") | (label == "unlabeled") | ((block == STRUCTURAL_BLOCK) & label.startswith("spatial:")), F.lit(True))


def is_chatter(label: Column) -> Column:
    """Chain-of-thought text in place of a label."""
    low = F.lower(label)
    out = low.startswith(CHATTER_START) | (F.length(label) > CHATTER_CHARS)
    for x in CHATTER:
        out = out | F.contains(low, F.lit(x))
    return out


def replace_bad_labels(labels: DataFrame, trusted: str = "a0", judged: str = "a2") -> DataFrame:
    """Bad labels of one annotator replaced by the trusted one's, with the reason."""
    bad = labels.filter(F.col("annotator") == judged).select("block", "feature_id", "label")
    good = labels.filter(F.col("annotator") == trusted).select("block", "feature_id", F.col("label").alias("fallback"))
    joined = bad.hint("merge").join(good, ["block", "feature_id"], "left")
    reason = F.when(~is_bad_label(F.col("label"), F.col("block")), "kept").when(F.col("fallback").isNull(), "missing_fallback").otherwise("replaced")
    return joined.select("block", "feature_id", F.when(is_bad_label(F.col("label"), F.col("block")), F.coalesce("fallback", "label")).otherwise(F.col("label")).alias("label"), reason.alias("reason"))


def shares(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of each combination of keys and their share of all rows."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("total")).alias("share"))


def rolled_up(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of each combination of keys and of its totals from the right, with the level (the number of keys totalled) and the share of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    counted = rows.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return counted.crossJoin(F.broadcast(total)).select(*keys, "level", "n", (F.col("n") / F.col("total")).alias("share"))


def calibrate(wide: DataFrame) -> DataFrame:
    """Accuracy of a0-a1 agreement against equal labels at thresholds .5 to .9; the best is the lowest of ties."""
    scored = pair_similarity(wide).filter("sim_a0_a1 IS NOT NULL")
    levels = F.array(*[F.lit(x / 10) for x in range(5, 10)])
    by = scored.select(F.explode(levels).alias("threshold"), "sim_a0_a1", "a0", "a1")
    out = by.groupBy("threshold").agg(F.avg(((F.col("sim_a0_a1") > F.col("threshold")) == (F.col("a0") == F.col("a1"))).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    best = F.row_number().over(Window.orderBy(F.desc("accuracy"), "threshold"))  # five rows
    return out.withColumn("is_best", best == 1)


def truth_match(wide: DataFrame) -> DataFrame:
    """How a0's label meets the truth (the category): equal, substring, keyword, similar or none."""
    a, b = F.col("a0"), F.col("category")
    words = F.arrays_overlap(F.split(a, " "), F.split(b, " "))
    rule = F.when(a == b, "equal").when(F.contains(a, b) | F.contains(b, a), "substring").when(words, "keyword").when(cosine(hashed_vector(a, DIMS), hashed_vector(b, DIMS)) > 0.6, "similar").otherwise("none")
    return wide.filter("a0 IS NOT NULL").select("block", "feature_id", rule.alias("rule"))


def factor_labels(labels: DataFrame, least: int = 3) -> DataFrame:
    """(block, factor, label, category, n): a name for each factor of ``labels``(block, factor, feature_id, weight, label, category).

    It is the word that at least ``least`` of its labels share, most frequent, then
    longest, then first; otherwise the first label, by weight, that is no chatter, and
    without one "unlabeled".  The category is that of the feature of most weight.
    """
    word = F.explode(F.array_distinct(F.array_compact(F.transform(F.split(F.lower("label"), r"\s+"), clean_word))))
    words = labels.select("block", "factor", "feature_id", word.alias("word"))
    counted = words.groupBy("block", "factor", "word").agg(F.count_distinct("feature_id").alias("n")).filter(F.col("n") >= least)
    order = Window.partitionBy("block", "factor").orderBy(F.desc("n"), F.desc(F.length("word")), "word")
    top = counted.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("block", "factor", "word")
    rank = F.struct(-F.col("weight"), F.col("feature_id"))
    plain = F.when(~is_chatter(F.col("label")) & (F.col("label") != ""), rank)
    own = labels.groupBy("block", "factor").agg(F.min_by("label", plain).alias("own"), F.min(plain).alias("seen"), F.min_by("category", rank).alias("category"), F.count("*").alias("n"))
    return own.hint("merge").join(top, ["block", "factor"], "left").select("block", "factor", F.coalesce("word", F.when(F.col("seen").isNotNull(), F.col("own")), F.lit("unlabeled")).alias("label"), "category", "n")


def _field(text: Column, name: str) -> Column:
    """What stands after "name:" on a line, with or without a bullet or stars, quotes at its ends aside; null if nothing does."""
    found = F.regexp_extract(text, rf"(?im)(?:[-*]\s*)?(?:\*\*)?{name}(?:\*\*)?\s*:\s*(.+)$", 1)
    return F.nullif(F.btrim(F.btrim(found), F.lit("\"'")), F.lit(""))


def parse_annotation(raw: Column) -> Column:
    """(label, category, confidence, source) of a reply: JSON in or out of code fences, "label: x" lines, or the first line up to 100 characters.

    Without a confidence the first two count as medium, a bare line as low.
    """
    text = F.btrim(raw, F.lit(" \t\r\n"))
    bare = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    label = F.get_json_object(bare, "$.label")
    line = _field(text, "label")
    first = F.substring(F.btrim(F.get(F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != ""), F.lit(0))), 1, 100)
    pick = lambda name, default: F.when(label.isNotNull(), F.coalesce(F.get_json_object(bare, f"$.{name}"), F.lit(default))).when(line.isNotNull(), F.coalesce(_field(text, name), F.lit(default)))
    return F.struct(
        F.coalesce(label, line, first, F.lit("")).alias("label"),
        F.coalesce(pick("category", "unknown"), F.lit("unknown")).alias("category"),
        F.coalesce(pick("confidence", "medium"), F.lit("low")).alias("confidence"),
        F.when(label.isNotNull(), "json").when(line.isNotNull(), "line").otherwise("first").alias("source"),
    )


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one annotator has not done yet is appended to what is written of it; the whole is read back."""
    every = annotations(spark, sf_dir).filter("annotator = 'a2'")
    done = every.hint("merge").join(annotations(spark, sf_dir).filter("annotator = 'a1'").select("block", "feature_id"), ["block", "feature_id"], "left_semi")
    path = scratch_path(spark, "resume")
    done.withColumn("run", F.lit(0)).write.parquet(path)
    delete_at_exit(spark, path)
    written = spark.read.parquet(path).select("block", "feature_id")
    every.hint("merge").join(written, ["block", "feature_id"], "left_anti").withColumn("run", F.lit(1)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _ann(s, d):
    return annotations(s, d)


def _wide(s, d):
    return wide_labels(annotations(s, d))


def _replies(s, d):
    p = table(s, d, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit('```json\n{"label": "'), name, F.lit('", "category": "'), "p_type", F.lit('"}\n```')))
        .when(k % 4 == 1, F.concat(F.lit("Here it is\n- Label: "), name, F.lit("\n- confidence: high\nfine")))
        .when(k % 4 == 2, F.concat(F.lit("**label**: '"), name, F.lit("'")))
        .otherwise(F.concat(F.lit("\n"), name, F.lit(" seen\nmore")))
    )
    return p.select(k.alias("feature_id"), parse_annotation(raw).alias("x")).select("feature_id", "x.*")


def _factors(s, d):
    """Factors of up to ten features: those of most weight of each block and size."""
    p = table(s, d, "part").select(F.col("p_brand").alias("block"), F.col("p_size").alias("factor"), F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("weight"))
    order = Window.partitionBy("block", "factor").orderBy(F.desc("weight"), "feature_id")
    top = p.withColumn("rn", F.row_number().over(order)).filter("rn <= 10").drop("rn")
    said = annotations(s, d).filter("annotator = 'a2'").select("block", "feature_id", "label", "category")
    return top.hint("merge").join(said, ["block", "feature_id"])


QUERIES = {
    "src_annotations": lambda s, d: read_annotations(s, write_annotations(s, d)),
    "join_label_assembly": assembled,
    "join_agreement": lambda s, d: _wide(s, d).filter("a0 IS NOT NULL AND a1 IS NOT NULL").select("block", "feature_id", "a0", "a1"),
    "set_common": lambda s, d: _ann(s, d).filter("annotator = 'a0'").select("feature_id").intersect(_ann(s, d).filter("annotator = 'a1'").select("feature_id")),
    "join_pending": lambda s, d: _ann(s, d).filter("annotator = 'a0'").select("feature_id").hint("merge").join(_ann(s, d).filter("annotator = 'a1'").select("feature_id"), "feature_id", "left_anti"),
    "snk_resume_append": resume,
    "ml_disagreement": lambda s, d: pair_similarity(_wide(s, d)).filter(F.col("sim_a0_a1") < DISAGREE).select("block", "feature_id", "sim_a0_a1"),
    "ml_label_fusion": lambda s, d: fuse_labels(assembled(s, d)),
    "fn_cosine": lambda s, d: pair_similarity(_wide(s, d)).select("block", "feature_id", "sim_a0_a1", "sim_a0_a2", "sim_a1_a2"),
    "flt_bad_label": lambda s, d: _ann(s, d).filter(is_bad_label(F.col("label"), F.col("block"))).select("block", "feature_id", "annotator", "label"),
    "flt_cot_label": lambda s, d: _ann(s, d).filter(is_chatter(F.col("label"))).select("block", "feature_id", "annotator", "label"),
    "join_fallback_replace": lambda s, d: replace_bad_labels(_ann(s, d)),
    "agg_method_mix": lambda s, d: rolled_up(fuse_labels(assembled(s, d)), "block", "confidence", "method"),
    "agg_accuracy": lambda s, d: truth_match(_wide(s, d)).agg(F.avg((F.col("rule") != "none").cast("double")).alias("accuracy"), F.count("*").alias("n")).withColumn("passed", F.col("accuracy") >= 0.75),
    "join_truth": lambda s, d: truth_match(_wide(s, d)),
    "fn_label_match": lambda s, d: shares(truth_match(_wide(s, d)), "rule"),
    "ml_calibrate": lambda s, d: calibrate(_wide(s, d)),
    "ml_factor_label": lambda s, d: factor_labels(_factors(s, d)),
    "fn_clean_word": lambda s, d: _ann(s, d).filter("annotator = 'a2'").select("feature_id", F.explode(F.split("label", " ")).alias("raw")).select("feature_id", clean_word(F.col("raw")).alias("word")).filter("word IS NOT NULL"),
    "fn_parse_annotation": _replies,
}

def _dot(a: str, b: str) -> str:
    return f"CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) > 1e-8 THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0.0 END"


def _sims(source: str, name: str, keep: str) -> str:
    """CTE ``name``: the labels of ``source`` with the cosines of their vectors."""
    vectors = ", ".join(f"{hashed_vector_sql(f'coalesce({a}, {chr(39) * 2})', DIMS)} AS v_{a}" for a in ANNOTATORS)
    sims = ", ".join(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {_dot(f'v_{x}', f'v_{y}')} END AS sim_{x}_{y}" for x, y in (("a0", "a1"), ("a0", "a2"), ("a1", "a2")))
    return f"{name}_v AS MATERIALIZED (SELECT {keep}, a0, a1, a2, {vectors} FROM {source}), {name} AS (SELECT {keep}, a0, a1, a2, {sims} FROM {name}_v)"


_ANN = """ann AS (
  SELECT p_brand AS block, p_partkey AS feature_id, annotator, label, lower(p_type) AS category,
         CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT *, 'a0' AS annotator, lower(p_name) AS label FROM part WHERE p_partkey % 7 <> 0
        UNION ALL SELECT *, 'a1', CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE lower(p_name) END FROM part WHERE p_partkey % 5 <> 0
        UNION ALL SELECT *, 'a2', CASE WHEN p_partkey % 10 = 5 THEN 'spatial: center' WHEN p_partkey % 6 = 1 THEN 'Looking at ' || lower(p_name) WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE lower(p_type) END
        FROM part WHERE p_partkey % 3 <> 0))"""
_ONLY = f"""{_ANN}, wide AS (
  SELECT block, feature_id, max(label) FILTER (annotator = 'a0') AS a0, max(label) FILTER (annotator = 'a1') AS a1,
         max(label) FILTER (annotator = 'a2') AS a2, max(category) AS category FROM ann GROUP BY ALL)"""
_WIDE = f"{_ONLY}, {_sims('wide', 'sims', 'block, feature_id, category')}"
_ARTIFACT_SQL = ARTIFACT.removeprefix("(?i)").replace("'", "''")
_BAD = f"(regexp_matches(label, '{_ARTIFACT_SQL}', 'i') OR label IN ('', 'unlabeled') OR (block = '{STRUCTURAL_BLOCK}' AND label LIKE 'spatial:%'))"
_CHATTER_SQL = f"(lower({{0}}) LIKE '{CHATTER_START}%' OR length({{0}}) > {CHATTER_CHARS} OR regexp_matches(lower({{0}}), '{'|'.join(CHATTER)}'))"
_SUPP = """supp AS (SELECT p_brand AS block, p_partkey AS feature_id, CASE WHEN p_partkey % 9 <> 0 THEN string_split(lower(p_type), ' ') END AS terms, CASE WHEN p_partkey % 8 = 0 THEN 'center' END AS spatial_pattern,
  p_size::DOUBLE AS mean_activation, p_retailprice / 1000.0::DOUBLE AS cv FROM part),
every AS (SELECT s.*, a0, a1, a2, category FROM supp s LEFT JOIN wide w ON s.block = w.block AND s.feature_id = w.feature_id)"""


def _backed(a: str) -> str:
    return f"CASE WHEN len(list_filter(terms[1:5], lambda t: contains(lower({a}), t) OR len(list_filter(string_split(lower({a}), ' '), lambda w: w <> '' AND contains(t, w))) > 0)) > 0 THEN {a} END"


_FUSED = f"""{_ONLY}, {_SUPP}, stated AS (SELECT * EXCLUDE (a0, a1, a2), nullif(a0, '') AS a0, nullif(a1, '') AS a1, nullif(a2, '') AS a2 FROM every),
{_sims('stated', 'sims2', 'block, feature_id, category, terms, spatial_pattern, mean_activation, cv')}, best AS (
  SELECT *, greatest(coalesce(sim_a0_a1, -1), coalesce(sim_a0_a2, -1), coalesce(sim_a1_a2, -1)) AS b,
    (coalesce(sim_a0_a1, -1) > 0.7)::INT + (coalesce(sim_a0_a2, -1) > 0.7)::INT + (coalesce(sim_a1_a2, -1) > 0.7)::INT AS n,
    coalesce({', '.join(_backed(a) for a in ANNOTATORS)}) AS al, coalesce(a0, a1, a2) AS guess, block = '{STRUCTURAL_BLOCK}' AND coalesce(spatial_pattern IN {STRUCTURAL!r}, false) AS place FROM sims2),
methods AS (SELECT *, CASE WHEN place THEN 'spatial_analysis' WHEN guess IS NULL THEN 'no_vlm_data' WHEN n >= 2 THEN 'vlm_consensus_3way' WHEN b > 0.7 THEN 'vlm_consensus_2way' WHEN al IS NOT NULL THEN 'vlm_tfidf_aligned' ELSE 'best_guess' END AS method FROM best),
fused AS (SELECT block, feature_id, method, a0, a1, a2, terms[1:5] AS terms, spatial_pattern, round(mean_activation, 2) AS mean_activation, round(cv, 4) AS cv, CASE WHEN place THEN 'spatial' WHEN guess IS NULL THEN 'unknown' ELSE coalesce(category, 'unknown') END AS category,
  CASE WHEN place THEN 'spatial: ' || spatial_pattern WHEN guess IS NULL THEN 'unlabeled' WHEN b > 0.7 THEN CASE WHEN coalesce(sim_a0_a1, -1) = b OR coalesce(sim_a0_a2, -1) = b THEN a0 ELSE a1 END ELSE coalesce(al, guess) END AS label,
  CASE WHEN method IN ('spatial_analysis', 'vlm_consensus_3way', 'vlm_consensus_2way') THEN 'high' WHEN method = 'vlm_tfidf_aligned' THEN 'medium' ELSE 'low' END AS confidence FROM methods)"""
_TRUTH = f"""{_ONLY}, truth_v AS MATERIALIZED (SELECT block, feature_id, a0, category, {hashed_vector_sql('a0', DIMS)} AS va, {hashed_vector_sql('category', DIMS)} AS vc FROM wide WHERE a0 IS NOT NULL), truth AS (
  SELECT block, feature_id, CASE WHEN a0 = category THEN 'equal' WHEN contains(a0, category) OR contains(category, a0) THEN 'substring'
    WHEN list_has_any(string_split(a0, ' '), string_split(category, ' ')) THEN 'keyword' WHEN {_dot('va', 'vc')} > 0.6 THEN 'similar' ELSE 'none' END AS rule
  FROM truth_v)"""
_CLEAN = f"trim(lower({{0}}), '{MARKS.replace(chr(39), chr(39) * 2)}')"
_THEME_STOP = "(" + ", ".join(f"'{w}'" for w in THEME_STOPWORDS) + ")"

ORACLE_SQL = {
    "src_annotations": f"WITH {_ANN} SELECT * FROM ann",
    "join_label_assembly": f"WITH {_ONLY}, {_SUPP} SELECT * FROM every",
    "join_agreement": f"WITH {_WIDE} SELECT block, feature_id, a0, a1 FROM wide WHERE a0 IS NOT NULL AND a1 IS NOT NULL",
    "set_common": f"WITH {_ANN} SELECT feature_id FROM ann WHERE annotator = 'a0' INTERSECT SELECT feature_id FROM ann WHERE annotator = 'a1'",
    "join_pending": f"WITH {_ANN} SELECT feature_id FROM ann WHERE annotator = 'a0' AND feature_id NOT IN (SELECT feature_id FROM ann WHERE annotator = 'a1')",
    "snk_resume_append": f"WITH {_ANN} SELECT *, (feature_id NOT IN (SELECT feature_id FROM ann WHERE annotator = 'a1'))::INTEGER AS run FROM ann WHERE annotator = 'a2'",
    "ml_disagreement": f"WITH {_WIDE} SELECT block, feature_id, sim_a0_a1 FROM sims WHERE sim_a0_a1 < 0.65",
    "ml_label_fusion": f"WITH {_FUSED} SELECT * FROM fused",
    "fn_cosine": f"WITH {_WIDE} SELECT block, feature_id, sim_a0_a1, sim_a0_a2, sim_a1_a2 FROM sims",
    "flt_bad_label": f"WITH {_ANN} SELECT block, feature_id, annotator, label FROM ann WHERE {_BAD}",
    "flt_cot_label": f"WITH {_ANN} SELECT block, feature_id, annotator, label FROM ann WHERE {_CHATTER_SQL.format('label')}",
    "join_fallback_replace": f"""WITH {_ANN} SELECT block, feature_id, CASE WHEN {_BAD} THEN coalesce(g.fallback, label) ELSE label END AS label,
  CASE WHEN NOT {_BAD} THEN 'kept' WHEN g.fallback IS NULL THEN 'missing_fallback' ELSE 'replaced' END AS reason
FROM ann LEFT JOIN (SELECT block, feature_id, label AS fallback FROM ann WHERE annotator = 'a0') g USING (block, feature_id) WHERE annotator = 'a2'""",
    "agg_method_mix": f"WITH {_FUSED} SELECT block, confidence, method, grouping(block, confidence, method)::INTEGER AS level, count(*) AS n, count(*) / (SELECT count(*) FROM fused) AS share FROM fused GROUP BY ROLLUP (block, confidence, method)",
    "agg_accuracy": f"WITH {_TRUTH} SELECT avg((rule <> 'none')::INT) AS accuracy, count(*) AS n, avg((rule <> 'none')::INT) >= 0.75 AS passed FROM truth",
    "join_truth": f"WITH {_TRUTH} SELECT * FROM truth",
    "fn_label_match": f"WITH {_TRUTH} SELECT rule, count(*) AS n, count(*) / (SELECT count(*) FROM truth) AS share FROM truth GROUP BY rule",
    "ml_calibrate": f"""WITH {_WIDE}, acc AS (
  SELECT t / 10.0::DOUBLE AS threshold, avg(((sim_a0_a1 > t / 10.0::DOUBLE) = (a0 = a1))::INT) AS accuracy, count(*) AS n
  FROM sims, (SELECT unnest(range(5, 10)) AS t) WHERE sim_a0_a1 IS NOT NULL GROUP BY t)
SELECT *, row_number() OVER (ORDER BY accuracy DESC, threshold) = 1 AS is_best FROM acc""",
    "ml_factor_label": f"""WITH {_ANN}, f AS (SELECT t.block, t.factor, t.feature_id, t.weight, a.label, a.category FROM (
  SELECT p_brand AS block, p_size AS factor, p_partkey AS feature_id, p_retailprice AS weight, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) t
  JOIN ann a ON t.block = a.block AND t.feature_id = a.feature_id AND a.annotator = 'a2' WHERE rn <= 10),
words AS (SELECT DISTINCT block, factor, feature_id, {_CLEAN.format('w')} AS word FROM (SELECT *, unnest(string_split(lower(label), ' ')) AS w FROM f)),
top AS (SELECT block, factor, word FROM (SELECT *, row_number() OVER (PARTITION BY block, factor ORDER BY n DESC, length(word) DESC, word) AS rn FROM (
  SELECT block, factor, word, count(DISTINCT feature_id) AS n FROM words WHERE length(word) > 2 AND word NOT IN {_THEME_STOP} GROUP BY ALL HAVING n >= 3)) WHERE rn = 1),
own AS (SELECT block, factor, arg_min(label, struct_pack(w := -weight, f := feature_id)) FILTER (NOT {_CHATTER_SQL.format('label')} AND label <> '') AS own, arg_min(category, struct_pack(w := -weight, f := feature_id)) AS category, count(*) AS n FROM f GROUP BY ALL)
SELECT block, factor, coalesce(word, own, 'unlabeled') AS label, category, n FROM own LEFT JOIN top USING (block, factor)""",
    "fn_clean_word": f"WITH {_ANN} SELECT * FROM (SELECT feature_id, {_CLEAN.format('w')} AS word FROM (SELECT feature_id, unnest(string_split(label, ' ')) AS w FROM ann WHERE annotator = 'a2')) WHERE length(word) > 2 AND word NOT IN {_THEME_STOP}",
    "fn_parse_annotation": """SELECT p_partkey AS feature_id, CASE WHEN p_partkey % 4 < 3 THEN p_name ELSE p_name || ' seen' END AS label, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE 'unknown' END AS category,
  CASE p_partkey % 4 WHEN 1 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'json' WHEN 3 THEN 'first' ELSE 'line' END AS source FROM part""",
}
