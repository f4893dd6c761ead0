"""Sparse activation logs: scan, aggregate, rank, sample and map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import delete_at_exit, materialize, scratch_path, table

GRID, BLOCKS = 4, 4


def activation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse activations (block, item_id, position, feature_id, value) of the embedding table.

    An item is a run of sixteen vectors, a position its cell in a 4x4 grid, and the
    ten largest entries of a vector, ties to the smaller index, are the active features.
    """
    vectors = table(spark, sf_dir, "embeddings")
    ranked = F.slice(
        F.array_sort(
            F.transform("embedding", lambda v, i: F.struct((-F.greatest(v.cast("double"), F.lit(0.0))).alias("neg"), i.alias("feature_id")))
        ),
        1,
        10,
    )
    return (
        vectors.select(
            (F.col("label") % 4).cast("int").alias("block"),
            F.expr("vec_id div 16").alias("item_id"),
            (F.col("vec_id") % 16).cast("int").alias("position"),
            F.explode(ranked).alias("a"),
        )
        .select("block", "item_id", "position", F.col("a.feature_id").cast("int").alias("feature_id"), (-F.col("a.neg")).alias("value"))
    )


def aggregate_positions(log: DataFrame) -> DataFrame:
    """Per (block, item, feature): sum, max and mean over positions and the cell of the first maximum."""
    return (
        log.groupBy("block", "item_id", "feature_id")
        .agg(
            F.sum("value").alias("sum_value"),
            F.max("value").alias("max_value"),
            F.avg("value").alias("mean_value"),
            F.min_by("position", F.struct(-F.col("value"), F.col("position"))).alias("cell"),
        )
        .withColumn("grid_row", F.expr(f"cell div {GRID}").cast("int"))
        .withColumn("grid_col", (F.col("cell") % GRID).cast("int"))
        .drop("cell")
    )


def top_items(stats: DataFrame, k: int = 10) -> DataFrame:
    """The k items with the largest mean of each (block, feature), ties to the smaller item."""
    order = Window.partitionBy("block", "feature_id").orderBy(F.desc("mean_value"), "item_id")
    return stats.withColumn("rank_pos", F.row_number().over(order) - 1).filter(F.col("rank_pos") < k)


LOG_SQL = """log AS (
  SELECT block, item_id, position, feature_id, value FROM (
    SELECT (label % 4)::INTEGER AS block, vec_id // 16 AS item_id, (vec_id % 16)::INTEGER AS position,
           i::INTEGER - 1 AS feature_id, greatest(embedding[i]::DOUBLE, 0.0) AS value,
           row_number() OVER (PARTITION BY vec_id ORDER BY greatest(embedding[i]::DOUBLE, 0.0) DESC, i) AS rn
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
  WHERE rn <= 10)"""
STATS_SQL = f"""{LOG_SQL}, stats AS (
  SELECT block, item_id, feature_id, sum(value) AS sum_value, max(value) AS max_value, avg(value) AS mean_value,
         (arg_min(position, struct_pack(v := -value, p := position)) // 4)::INTEGER AS grid_row,
         (arg_min(position, struct_pack(v := -value, p := position)) % 4)::INTEGER AS grid_col
  FROM log GROUP BY ALL)"""

def feature_variation(stats: DataFrame, zero_mean: str = "one") -> DataFrame:
    """Coefficient of variation of each feature's means; a mean of zero divides by one, or gives 0.0 (``zero_mean="zero"``)."""
    by = stats.groupBy("block", "feature_id").agg(
        F.count("*").alias("n_items"), F.avg("mean_value").alias("avg_mean"), F.stddev_pop("mean_value").alias("spread")
    )
    safe = F.when(F.col("avg_mean") > 0, F.col("spread") / F.col("avg_mean"))
    return by.withColumn("cv", F.coalesce(safe, F.col("spread") if zero_mean == "one" else F.lit(0.0)))


def metric_value(metric: str) -> Column:
    """The ranking value of an activation: mean, max, sum, or adaptive (mean if over half the maximum, else maximum)."""
    if metric == "adaptive":
        return F.when(F.col("mean_value") > 0.5 * F.col("max_value"), F.col("mean_value")).otherwise(F.col("max_value"))
    return F.col(f"{metric}_value")


def hashed(*parts: Column) -> Column:
    """A 32-bit draw from the MD5 of the parts: the same on every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def mid_range_items(stats: DataFrame, k: int = 10, take: int = 3, flat: float = 0.5, seed: int = 42) -> DataFrame:
    """For flat features with more than k items, ``take`` hashed draws from the ranks [0.4n, 0.6n)."""
    by = Window.partitionBy("block", "feature_id")
    ranked = stats.withColumn("rank_pos", F.row_number().over(by.orderBy(F.desc("mean_value"), "item_id")) - 1).withColumn("n", F.count("*").over(by))
    flat_ones = feature_variation(stats).filter(F.col("cv") < flat).select("block", "feature_id")
    middle = ranked.filter((F.col("n") > k) & (F.col("rank_pos") >= F.floor(0.4 * F.col("n"))) & (F.col("rank_pos") < F.floor(0.6 * F.col("n"))))
    draw = hashed(F.lit(seed), F.col("block"), F.col("feature_id"), F.col("item_id"))
    chosen = middle.hint("merge").join(flat_ones, ["block", "feature_id"], "left_semi").withColumn("draw", F.row_number().over(by.orderBy(draw, "item_id")))
    return chosen.filter(F.col("draw") <= take).select("block", "feature_id", "item_id", "rank_pos")


def off_items(stats: DataFrame, n_items: int, take: int = 3, seed: int = 7) -> DataFrame:
    """``take`` items on which a feature did not fire, drawn without replacement; all of them if there are no more.

    Neither the complement nor candidates are built: ``take`` different ranks among a feature's
    silent items are drawn (each next range has one place more; a rank that is taken gives way
    to the new place), and the silent item of rank k is k plus the number of firing items a, numbered i in order,
    with a - i <= k.
    """
    by = Window.partitionBy("block", "feature_id")
    fired = stats.select("block", "feature_id", F.col("item_id").alias("a")).distinct().withColumn("i", F.row_number().over(by.orderBy("a")) - 1)
    silent = F.lit(n_items).cast("long") - F.count("*")
    features = fired.groupBy("block", "feature_id").agg(silent.alias("silent")).filter("silent > 0")
    first = F.greatest(F.col("silent") - take, F.lit(0).cast("long"))

    def draw(taken: Column, j: Column) -> Column:
        rank = F.pmod(hashed(F.lit(seed), F.col("block"), F.col("feature_id"), j), j + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, rank), j).otherwise(rank)))

    ranks = F.aggregate(F.sequence(first, F.col("silent") - 1), F.array().cast("array<long>"), draw)
    asked = features.select("block", "feature_id", F.posexplode(ranks).alias("draw", "k"))
    below = asked.hint("merge").join(fired, ["block", "feature_id"]).groupBy("block", "feature_id", "draw", "k").agg(F.count_if(F.col("a") - F.col("i") <= F.col("k")).alias("before"))
    return below.select("block", "feature_id", (F.col("k") + F.col("before")).alias("item_id"), (F.col("draw") + 1).alias("draw"))


def heat_map(stats: DataFrame, k: int = 100) -> DataFrame:
    """Sum of mean activations in each grid cell over a feature's top items; cells outside the grid are dropped."""
    top = top_items(stats, k).filter((F.col("grid_row") >= 0) & (F.col("grid_row") < GRID) & (F.col("grid_col") >= 0) & (F.col("grid_col") < GRID))
    return top.groupBy("block", "feature_id", "grid_row", "grid_col").agg(F.sum("mean_value").alias("heat"))


#: Regions of the grid by quarters and halves of its sides.
REGIONS = {
    "center": "grid_row BETWEEN 1 AND 2 AND grid_col BETWEEN 1 AND 2",
    "top": "grid_row = 0",
    "bottom": "grid_row = 3",
    "left_side": "grid_col = 0",
    "right_side": "grid_col = 3",
    "top_band": "grid_row < 2",
    "bottom_band": "grid_row >= 2",
    "left_band": "grid_col < 2",
    "right_band": "grid_col >= 2",
    "corners": "grid_row IN (0, 3) AND grid_col IN (0, 3)",
    "border": "NOT (grid_row BETWEEN 1 AND 2 AND grid_col BETWEEN 1 AND 2)",
}
#: Under this largest share a map is even; then the first rule that holds names the pattern.
EVEN = "greatest(center, top, bottom, left_side, right_side, corners) < 0.35"
SPATIAL_RULES = (
    ("center", "center > 0.5"), ("corners", "corners > 0.4"), ("top", "top > 0.35"), ("bottom", "bottom > 0.35"), ("left", "left_side > 0.35"), ("right", "right_side > 0.35"),
    ("horizontal-band", "abs(top_band - bottom_band) > 0.3"), ("vertical-band", "abs(left_band - right_band) > 0.3"), ("border", "border > 0.65"),
)


def region_shares(heat: DataFrame) -> DataFrame:
    """Share of a feature's heat in each region of the grid; features without heat are left out."""
    total = F.sum("heat")
    shares = heat.groupBy("block", "feature_id").agg(total.alias("total"), *[(F.sum(F.when(F.expr(where), F.col("heat")).otherwise(0.0)) / total).alias(name) for name, where in REGIONS.items()])
    return shares.filter("total >= 1e-6").drop("total")


def spatial_pattern(shares: DataFrame) -> DataFrame:
    """The first spatial rule that holds, or null, as for an even map."""
    pattern = F.lit(None).cast("string")
    for name, rule in reversed(SPATIAL_RULES):
        pattern = F.when(F.expr(rule), F.lit(name)).otherwise(pattern)
    return shares.select("block", "feature_id", F.when(F.expr(f"NOT ({EVEN})"), pattern).alias("spatial_pattern"))


def top_codes(vectors: DataFrame, n_features: int = 16, k: int = 3) -> DataFrame:
    """Linear projection of each vector on fixed weights cos(i * j), the k largest kept and clipped at zero."""
    feature = F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("feature_id")
    score = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * F.cos((i * F.col("feature_id")).cast("double"))), F.lit(0.0), lambda a, b: a + b)
    scored = vectors.select("vec_id", "embedding", feature).select("vec_id", "feature_id", score.alias("score"))
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "feature_id")
    return scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).select("vec_id", "feature_id", F.greatest("score", F.lit(0.0)).alias("code"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_positions(activation_log(spark, d))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("prompt"))


def _n_items(spark: SparkSession, d: str) -> int:
    return (table(spark, d, "embeddings").agg(F.max(F.expr("vec_id div 16"))).first()[0] or 0) + 1


def _quality_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as captions: trimmed, five words or more, 200 characters or fewer, nine tenths ASCII."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("caption", F.btrim("raw"))
    ascii_share = F.length(F.regexp_replace("caption", r"[^\x00-\x7F]", "")) / F.length("caption")
    return lines.filter((F.length("caption") > 0) & (F.length("caption") <= 200) & (F.size(F.split("caption", r"\s+")) >= 5) & (ascii_share >= 0.9)).select("doc_id", "line", "caption")


def _dedup_captions(spark: SparkSession, d: str, n: int = 500) -> DataFrame:
    """The first ``n`` distinct captions in scan order, with the share of scanned lines that passed."""
    passed = _quality_prompts(spark, d)
    first = passed.groupBy("caption").agg(F.min(F.struct("doc_id", "line")).alias("at"))
    rate = passed.agg(F.count("*").alias("passed")).crossJoin(table(spark, d, "documents").agg(F.sum(F.size(F.split("text", "\n"))).alias("scanned")))
    top = first.select("caption", "at.doc_id", "at.line").orderBy("doc_id", "line").limit(n)
    return top.crossJoin(F.broadcast(rate)).select("caption", "doc_id", "line", (F.col("passed") / F.col("scanned")).alias("pass_rate"))


def write_log(spark: SparkSession, d: str) -> str:
    """The activation log as JSON lines, one for each item: id, prompt (absent if there is none) and an array for each block that fired.

    A grid place of zero and a block without activations are left out of the file.
    """
    stats = _stats(spark, d)
    zero = lambda c: F.when(F.col(c) != 0, F.col(c))
    entry = F.struct(F.col("feature_id").alias("f"), F.col("mean_value").alias("mean"), F.col("max_value").alias("max"), F.col("sum_value").alias("sum"), zero("grid_row").alias("row"), zero("grid_col").alias("col"))
    items = stats.groupBy(F.col("item_id").alias("id")).agg(*[F.collect_list(F.when(F.col("block") == b, entry)).alias(f"b{b}") for b in range(BLOCKS)])
    present = items.select("id", *[F.when(F.size(f"b{b}") > 0, F.col(f"b{b}")).alias(f"b{b}") for b in range(BLOCKS)])
    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("prompt"))
    path = scratch_path(spark, "log")
    present.hint("merge").join(prompts, "id", "left").write.json(path)
    delete_at_exit(spark, path)
    return path


LOG_ENTRY = "array<struct<f:int,mean:double,max:double,sum:double,row:int,col:int>>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, prompt, block, feature_id, mean_value, max_value, sum_value, grid_row, grid_col) of a log; absent blocks have no rows, absent places are 0."""
    log = spark.read.schema("id long, prompt string, " + ", ".join(f"b{b} {LOG_ENTRY}" for b in range(BLOCKS))).json(path)
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.col(f"b{b}").alias("entries")) for b in range(BLOCKS)])
    flat = log.select(F.col("id").alias("item_id"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.explode(blocks).alias("z")).select("item_id", "prompt", "z.block", F.explode("z.entries").alias("e"))
    return flat.select(
        "item_id", "prompt", "block", F.col("e.f").alias("feature_id"), F.col("e.mean").alias("mean_value"), F.col("e.max").alias("max_value"), F.col("e.sum").alias("sum_value"),
        F.coalesce("e.row", F.lit(0)).alias("grid_row"), F.coalesce("e.col", F.lit(0)).alias("grid_col"),
    )


def dense(found: DataFrame) -> DataFrame:
    """A row for every block and every feature from 0 to the largest, with its terms (none: empty) and pattern (none: null)."""
    size = found.agg(F.max("feature_id").alias("top"))
    ids = found.select("block").distinct().crossJoin(F.broadcast(size)).select("block", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("feature_id"))
    return ids.hint("merge").join(found, ["block", "feature_id"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def term_means(stats: DataFrame, weights: DataFrame, top: int = 100) -> DataFrame:
    """(block, feature_id, term, mean_weight): mean weight of terms over the prompts of each feature's top items, absent terms counting zero."""
    items = top_items(stats, top).select("block", "feature_id", F.col("item_id").alias("doc_id"))
    sizes = items.groupBy("block", "feature_id").agg(F.count("*").alias("n"))
    sums = items.hint("merge").join(weights, "doc_id").groupBy("block", "feature_id", "term").agg(F.sum("weight").alias("s"))
    mean = sums.hint("merge").join(sizes, ["block", "feature_id"]).withColumn("mean_weight", F.round(F.col("s") / F.col("n"), 9))
    return mean.filter("mean_weight > 0").select("block", "feature_id", "term", "mean_weight")


def feature_terms(stats: DataFrame, weights: DataFrame, k: int = 10, top: int = 100) -> DataFrame:
    """(block, feature_id, terms): the k terms with the largest mean weight over the prompts of each feature's top items, best first."""
    order = Window.partitionBy("block", "feature_id").orderBy(F.desc("mean_weight"), "term")
    best = term_means(stats, weights, top).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    return best.groupBy("block", "feature_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda z: z["term"]).alias("terms"))


def feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """One record for each feature, written in a folder for each block and read back: its ON items by rank, OFF and middle items, the metric and the variation."""
    stats = materialize(_stats(spark, d), "stats")
    lists = lambda rows, order, name: rows.groupBy("block", "feature_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "item_id"))), lambda z: z["item_id"]).alias(name))
    out = feature_variation(stats).select("block", "feature_id", "cv")
    for rows, order, name in ((top_items(stats), "rank_pos", "on_items"), (off_items(stats, _n_items(spark, d)), "draw", "off_items"), (mid_range_items(stats), "item_id", "mid_items")):
        out = out.hint("merge").join(lists(rows, order, name), ["block", "feature_id"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<long>")))
    path = scratch_path(spark, "sets")
    out.withColumn("metric", F.lit("mean")).write.partitionBy("block").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, n_items): a row for each referenced item, written and read back, and how many there are."""
    items = materialize(_referenced(spark, d), "manifest")
    return items.crossJoin(F.broadcast(items.agg(F.count("*").alias("n_items"))))  # one row


def _referenced(spark: SparkSession, d: str) -> DataFrame:
    """Items that stand in an ON, OFF or middle list of any feature."""
    stats = _stats(spark, d)
    parts = (top_items(stats), mid_range_items(stats), off_items(stats, _n_items(spark, d)))
    out = parts[0].select("item_id")
    for part in parts[1:]:
        out = out.union(part.select("item_id"))
    return out.distinct()


def _complement(spark: SparkSession, d: str) -> DataFrame:
    """All items without those on which the rarest feature of each block fired."""
    stats = _stats(spark, d)
    counts = stats.groupBy("block", "feature_id").agg(F.count("*").alias("n"))
    rarest = counts.groupBy("block").agg(F.min_by("feature_id", F.struct("n", "feature_id")).alias("feature_id"))  # one row a block
    items = table(spark, d, "embeddings").select(F.expr("vec_id div 16").alias("item_id")).distinct()
    return items.crossJoin(F.broadcast(rarest)).select("block", "feature_id", "item_id").exceptAll(stats.select("block", "feature_id", "item_id"))


def detection(spark: SparkSession, d: str) -> DataFrame:
    """Sensitivity, specificity and their mean of a judge that was shown each feature's ON and OFF items; passed from 0.70 on.

    The judge's answers are hashed: right on eight of ten.  Rates are over five places of each class for each feature.
    """
    stats = _stats(spark, d)
    shown = top_items(stats, 5).select("block", "feature_id", "item_id", F.lit(True).alias("on_item")).unionByName(off_items(stats, _n_items(spark, d), 5).select("block", "feature_id", "item_id", F.lit(False).alias("on_item")))
    right = hashed(F.lit("judge"), F.col("block"), F.col("feature_id"), F.col("item_id")) % 10 < 8
    sums = shown.agg(F.count_if(right & F.col("on_item")).alias("hit"), F.count_if(right & ~F.col("on_item")).alias("passed_over"), F.count_distinct("block", "feature_id").alias("n"))
    out = sums.select((F.col("hit") / (5 * F.col("n"))).alias("sensitivity"), (F.col("passed_over") / (5 * F.col("n"))).alias("specificity"))
    return out.withColumn("balanced", (F.col("sensitivity") + F.col("specificity")) / 2).withColumn("passed", F.col("balanced") >= 0.70)


QUERIES = {
    "src_activation_log": lambda s, d: read_log(s, write_log(s, d)).drop("prompt"),
    "src_rankings_prompts": lambda s, d: read_log(s, write_log(s, d)).select("block", "feature_id", "item_id", "mean_value", "prompt"),
    "src_sparse_matrix": lambda s, d: _stats(s, d).select("block", "item_id", "feature_id", F.greatest(metric_value("adaptive"), F.lit(0.0)).alias("cell_value")),
    "agg_position_to_feature": lambda s, d: _stats(s, d),
    "top_feature_items": lambda s, d: top_items(_stats(s, d)),
    "agg_index_stats": lambda s, d: _stats(s, d).groupBy("block").agg(F.count_distinct("feature_id").alias("n_features"), F.count("*").alias("n_entries")),
    "agg_cv": lambda s, d: feature_variation(_stats(s, d)),
    "agg_flat_count": lambda s, d: feature_variation(_stats(s, d)).agg(F.count_if(F.col("cv") < 0.5).alias("n_flat"), F.avg("cv").alias("mean_cv")),
    "top_mid_range": lambda s, d: mid_range_items(_stats(s, d)),
    "join_off_sample": lambda s, d: off_items(_stats(s, d), _n_items(s, d)),
    "agg_heatmap": lambda s, d: heat_map(_stats(s, d)),
    "join_top_items_heat": lambda s, d: _stats(s, d).hint("merge").join(top_items(_stats(s, d), 5).select("block", "feature_id", "item_id"), ["block", "feature_id", "item_id"], "left_semi").select("block", "feature_id", "item_id", "grid_row", "grid_col"),
    "join_top_items_prompts": lambda s, d: top_items(_stats(s, d), 5).hint("merge").join(_prompts(s, d), "item_id").select("block", "feature_id", "item_id", F.length("prompt").alias("prompt_chars")),
    "agg_region_fractions": lambda s, d: region_shares(heat_map(_stats(s, d))),
    "fn_classify_spatial": lambda s, d: spatial_pattern(region_shares(heat_map(_stats(s, d)))),
    "top_k_codes": lambda s, d: top_codes(table(s, d, "embeddings")),
    "flt_prompt_quality": _quality_prompts,
    "flt_dedup_limit": _dedup_captions,
    "snk_feature_sets": feature_sets,
    "agg_balanced_accuracy": detection,
    "snk_manifest": manifest,
    "set_referenced": _referenced,
    "set_complement": _complement,
}

_CV = f"""{STATS_SQL}, cv AS (
  SELECT block, feature_id, count(*) AS n_items, avg(mean_value) AS avg_mean, stddev_pop(mean_value) AS spread,
         coalesce(CASE WHEN avg(mean_value) > 0 THEN stddev_pop(mean_value) / avg(mean_value) END, stddev_pop(mean_value)) AS cv
  FROM stats GROUP BY ALL),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY block, feature_id ORDER BY mean_value DESC, item_id) - 1)::INTEGER AS rank_pos,
         count(*) OVER (PARTITION BY block, feature_id) AS n FROM stats),
mid AS (
  SELECT block, feature_id, item_id, rank_pos FROM (
    SELECT ranked.*, row_number() OVER (PARTITION BY block, feature_id ORDER BY ('0x' || substr(md5(concat_ws('|', 42, block, feature_id, item_id)), 1, 8))::BIGINT, item_id) AS draw
    FROM ranked SEMI JOIN (SELECT * FROM cv WHERE cv < 0.5) c USING (block, feature_id)
    WHERE n > 10 AND rank_pos >= floor(0.4 * n) AND rank_pos < floor(0.6 * n)) WHERE draw <= 3)"""
_HEAT = f"""{STATS_SQL}, heat AS (
  SELECT block, feature_id, grid_row, grid_col, sum(mean_value) AS heat FROM (
    SELECT *, row_number() OVER (PARTITION BY block, feature_id ORDER BY mean_value DESC, item_id) AS rn FROM stats)
  WHERE rn <= 100 GROUP BY ALL),
shares AS (SELECT block, feature_id, {', '.join(f"sum(CASE WHEN {w} THEN heat ELSE 0 END) / sum(heat) AS {n}" for n, w in REGIONS.items())} FROM heat GROUP BY ALL HAVING sum(heat) >= 1e-6),
patterns AS (SELECT block, feature_id, CASE WHEN {EVEN} THEN NULL {' '.join(f"WHEN {r} THEN '{n}'" for n, r in SPATIAL_RULES)} END AS spatial_pattern FROM shares)"""
def _off(take: int) -> str:
    """CTE off{take} over the CTE stats: the draws of off_items, unrolled."""
    h = "('0x' || substr(md5(concat_ws('|', 7, block, feature_id, {0})), 1, 8))::BIGINT % ({0} + 1)"
    out = [f"o{take}_0 AS (SELECT block, feature_id, n - m AS silent, []::BIGINT[] AS ranks FROM (SELECT block, feature_id, count(*) AS m FROM stats GROUP BY ALL), (SELECT max(vec_id // 16) + 1 AS n FROM embeddings) WHERE n > m)"]
    for i in range(take):
        j = f"(silent - {take - i})"
        rank = h.format(j)
        out.append(f"o{take}_{i + 1} AS (SELECT block, feature_id, silent, CASE WHEN {j} < 0 THEN ranks WHEN list_contains(ranks, {rank}) THEN list_append(ranks, {j}) ELSE list_append(ranks, {rank}) END AS ranks FROM o{take}_{i})")
    out.append(f"off{take} AS (SELECT d.block, d.feature_id, k + count(*) FILTER (a - i <= k) AS item_id, d.draw FROM (SELECT block, feature_id, unnest(ranks) AS k, unnest(range(1, len(ranks) + 1))::INTEGER AS draw FROM o{take}_{take}) d JOIN (SELECT block, feature_id, item_id AS a, row_number() OVER (PARTITION BY block, feature_id ORDER BY item_id) - 1 AS i FROM stats) f ON d.block = f.block AND d.feature_id = f.feature_id GROUP BY d.block, d.feature_id, d.draw, d.k)")
    return ", ".join(out)


_REF = "SELECT item_id FROM ranked WHERE rank_pos < 10 UNION SELECT item_id FROM mid UNION SELECT item_id FROM off3"
_TERMS = """ftop AS (SELECT block, feature_id, item_id AS doc_id, count(*) OVER (PARTITION BY block, feature_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY block, feature_id ORDER BY mean_value DESC, item_id) AS rn FROM stats) WHERE rn <= 100),
fmean AS (SELECT block, feature_id, term, round(sum(weight) / any_value(n), 9) AS w FROM ftop JOIN tfidf USING (doc_id) GROUP BY ALL),
fterms AS (SELECT block, feature_id, list(term ORDER BY rn) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY block, feature_id ORDER BY w DESC, term) AS rn FROM fmean WHERE w > 0) WHERE rn <= 10 GROUP BY ALL)"""
_CAPTIONS = r"""captions AS (
  SELECT doc_id, line, trim(raw) AS caption FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line FROM documents)
  WHERE length(trim(raw)) BETWEEN 1 AND 200 AND len(regexp_split_to_array(trim(raw), '\s+')) >= 5
    AND length(regexp_replace(trim(raw), '[^\x00-\x7F]', '', 'g')) / length(trim(raw)) >= 0.9)"""

ORACLE_SQL = {
    "src_activation_log": f"WITH {STATS_SQL} SELECT * FROM stats",
    "src_rankings_prompts": f"WITH {STATS_SQL} SELECT block, feature_id, item_id, mean_value, coalesce(CASE WHEN doc_id % 5 <> 0 THEN text END, '') AS prompt FROM stats LEFT JOIN documents ON doc_id = item_id",
    "src_sparse_matrix": f"WITH {STATS_SQL} SELECT block, item_id, feature_id, greatest(CASE WHEN mean_value > 0.5 * max_value THEN mean_value ELSE max_value END, 0.0) AS cell_value FROM stats",
    "agg_position_to_feature": f"WITH {STATS_SQL} SELECT * FROM stats",
    "top_feature_items": f"""WITH {STATS_SQL}
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY block, feature_id ORDER BY mean_value DESC, item_id) - 1)::INTEGER AS rank_pos
               FROM stats) WHERE rank_pos < 10""",
    "agg_index_stats": f"WITH {STATS_SQL} SELECT block, count(DISTINCT feature_id) AS n_features, count(*) AS n_entries FROM stats GROUP BY block",
    "agg_cv": f"WITH {_CV} SELECT * FROM cv",
    "agg_flat_count": f"WITH {_CV} SELECT count(*) FILTER (cv < 0.5) AS n_flat, avg(cv) AS mean_cv FROM cv",
    "top_mid_range": f"WITH {_CV} SELECT * FROM mid",
    "join_off_sample": f"WITH {STATS_SQL}, {_off(3)} SELECT * FROM off3",
    "agg_balanced_accuracy": f"""WITH {STATS_SQL}, {_off(5)}, shown AS (SELECT block, feature_id, item_id, true AS on_item FROM (SELECT *, row_number() OVER (PARTITION BY block, feature_id ORDER BY mean_value DESC, item_id) AS rn FROM stats) WHERE rn <= 5
  UNION ALL SELECT block, feature_id, item_id, false FROM off5),
r AS (SELECT *, ('0x' || substr(md5(concat_ws('|', 'judge', block, feature_id, item_id)), 1, 8))::BIGINT % 10 < 8 AS ok FROM shown),
t AS (SELECT count(*) FILTER (ok AND on_item) / (5 * count(DISTINCT (block, feature_id))) AS sensitivity, count(*) FILTER (ok AND NOT on_item) / (5 * count(DISTINCT (block, feature_id))) AS specificity FROM r)
SELECT *, (sensitivity + specificity) / 2 AS balanced, (sensitivity + specificity) / 2 >= 0.70 AS passed FROM t""",
    "agg_heatmap": f"WITH {_HEAT} SELECT * FROM heat",
    "join_top_items_heat": f"""WITH {STATS_SQL} SELECT block, feature_id, item_id, grid_row, grid_col FROM (
  SELECT *, row_number() OVER (PARTITION BY block, feature_id ORDER BY mean_value DESC, item_id) AS rn FROM stats) WHERE rn <= 5""",
    "join_top_items_prompts": f"""WITH {STATS_SQL} SELECT block, feature_id, item_id, length(text)::INTEGER AS prompt_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY block, feature_id ORDER BY mean_value DESC, item_id) AS rn FROM stats) JOIN documents ON doc_id = item_id WHERE rn <= 5""",
    "agg_region_fractions": f"WITH {_HEAT} SELECT * FROM shares",
    "fn_classify_spatial": f"WITH {_HEAT} SELECT * FROM patterns",
    "top_k_codes": """WITH scored AS (
  SELECT vec_id, f::INTEGER AS feature_id, list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * cos(i * f))) AS score
  FROM embeddings, (SELECT unnest(range(0, 16)) AS f))
SELECT vec_id, feature_id, greatest(score, 0.0) AS code FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, feature_id) AS rn FROM scored) WHERE rn <= 3""",
    "flt_prompt_quality": f"WITH {_CAPTIONS} SELECT * FROM captions",
    "flt_dedup_limit": f"""WITH {_CAPTIONS}, rate AS (SELECT (SELECT count(*) FROM captions) / (SELECT sum(len(string_split(text, chr(10)))) FROM documents) AS pass_rate),
first AS (SELECT caption, m.d AS doc_id, m.l AS line FROM (SELECT caption, min(struct_pack(d := doc_id, l := line)) AS m FROM captions GROUP BY caption) ORDER BY 2, 3 LIMIT 500)
SELECT * FROM first, rate""",
    "snk_feature_sets": f"""WITH {_CV}, {_off(3)}, o AS (SELECT block, feature_id, list(item_id ORDER BY rank_pos) AS on_items FROM ranked WHERE rank_pos < 10 GROUP BY ALL),
f AS (SELECT block, feature_id, list(item_id ORDER BY draw) AS off_items FROM off3 GROUP BY ALL), m AS (SELECT block, feature_id, list(item_id ORDER BY item_id) AS mid_items FROM mid GROUP BY ALL)
SELECT cv.block, cv.feature_id, cv, coalesce(on_items, []::BIGINT[]) AS on_items, coalesce(off_items, []::BIGINT[]) AS off_items, coalesce(mid_items, []::BIGINT[]) AS mid_items, 'mean' AS metric FROM cv
LEFT JOIN o USING (block, feature_id) LEFT JOIN f USING (block, feature_id) LEFT JOIN m USING (block, feature_id)""",
    "snk_manifest": f"WITH {_CV}, {_off(3)} SELECT item_id, count(*) OVER () AS n_items FROM ({_REF})",
    "set_referenced": f"WITH {_CV}, {_off(3)} {_REF}",
    "set_complement": f"""WITH {STATS_SQL}, r AS (SELECT block, arg_min(feature_id, struct_pack(n := n, f := feature_id)) AS feature_id FROM (SELECT block, feature_id, count(*) AS n FROM stats GROUP BY ALL) GROUP BY block)
SELECT block, feature_id, item_id FROM (SELECT DISTINCT vec_id // 16 AS item_id FROM embeddings), r EXCEPT SELECT block, feature_id, item_id FROM stats""",
}


def supplements_sql(tfidf: str) -> str:
    """SQL of the dense supplements, given the CTEs of TF-IDF weights."""
    return f"""WITH {_HEAT}, {tfidf}, {_TERMS}, g AS (SELECT block, unnest(range(0, (SELECT max(feature_id) FROM shares) + 1))::INTEGER AS feature_id FROM (SELECT DISTINCT block FROM shares))
SELECT block, feature_id, spatial_pattern, coalesce(CASE WHEN p.block IS NOT NULL THEN terms END, []::VARCHAR[]) AS terms FROM g LEFT JOIN patterns p USING (block, feature_id) LEFT JOIN fterms USING (block, feature_id)"""
