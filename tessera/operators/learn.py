"""Factorisation and clustering of features, on long sparse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.embedders import HashedTrigrams
from tessera.functions.text import hashed_vector_sql
from tessera.operators.activation import STATS_SQL, activation_log, aggregate_positions, hashed
from tessera.session import materialize, table

RANK, ROUNDS = 4, 8
EPS = 1e-9


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, feature, x): mean activation of each feature on each item."""
    stats = aggregate_positions(activation_log(spark, sf_dir))
    return stats.groupBy(F.col("item_id").alias("item"), F.col("feature_id").alias("feature")).agg(F.avg("mean_value").alias("x"))


def nmf(cells: DataFrame, rank: int = RANK, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors W(item, k, w) and H(feature, k, h) by multiplicative updates on the long table.

    A round is joins on the item or the feature and sums; the only thing gathered is
    the rank-by-rank Gram matrix.  Absent cells are zeros.  Starts are hashed from the ids.
    """
    ks = F.explode(F.sequence(F.lit(0), F.lit(rank - 1))).alias("k")
    start = lambda c: (0.1 + F.pmod(hashed(F.col(c), F.col("k")), F.lit(1000)) / 1000.0)
    w = cells.select("item").distinct().select("item", ks).withColumn("w", start("item"))
    h = cells.select("feature").distinct().select("feature", ks).withColumn("h", start("feature"))

    def update(x: DataFrame, own: DataFrame, key: str, value: str, other: DataFrame, okey: str, ovalue: str) -> DataFrame:
        top = x.hint("merge").join(other, okey).groupBy(key, "k").agg(F.sum(F.col("x") * F.col(ovalue)).alias("top"))
        listed = other.groupBy(okey).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", ovalue))), lambda z: z[ovalue]).alias("v"))  # rank numbers a row
        products = F.flatten(F.transform("v", lambda p: F.transform("v", lambda q: p * q)))
        gram = listed.select(F.posexplode(products).alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"))
        table_ = {(r["i"] // rank, r["i"] % rank): r["g"] for r in gram.collect()}  # rank squared numbers
        rows = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", value))).alias("v"))
        below = F.array(*[F.aggregate(F.zip_with(F.transform("v", lambda z: z[value]), F.array(*[F.lit(float(table_[i, j])) for j in range(rank)]), lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z) for i in range(rank)])
        flat = rows.select(key, F.posexplode(F.zip_with(F.transform("v", lambda z: z[value]), below, lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("k", "z"))
        out = flat.hint("merge").join(top, [key, "k"], "left")
        return out.select(key, "k", (F.col("z.p") * F.coalesce("top", F.lit(0.0)) / (F.col("z.q") + EPS)).alias(value))

    for _ in range(rounds):
        h = materialize(update(cells, h, "feature", "h", w, "item", "w"), "nmf-h")
        w = materialize(update(cells, w, "item", "w", h, "feature", "h"), "nmf-w")
    return w, h


def nmf_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of the factorisation over all cells, absent ones as zero, with the rank used and the sums that give it.

    The error is |X|^2 - 2 <X, WH> + <W'W, HH'>, so that no cell that is zero is looked at.
    """
    cells = materialize(matrix(spark, sf_dir), "cells")
    w, h = nmf(cells)
    fit = cells.hint("merge").join(w, "item").hint("merge").join(h, ["feature", "k"]).agg(F.sum(F.col("x") * F.col("w") * F.col("h")).alias("cross"))
    square = cells.agg(F.sum(F.col("x") * F.col("x")).alias("square"))

    def gram(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        listed = df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value))), lambda z: z[value]).alias("v"))
        return listed.select(F.posexplode(F.flatten(F.transform("v", lambda p: F.transform("v", lambda q: p * q)))).alias("i", "g")).groupBy("i").agg(F.sum("g").alias(name))

    both = gram(w, "item", "w", "gw").hint("merge").join(gram(h, "feature", "h", "gh"), "i").agg(F.sum(F.col("gw") * F.col("gh")).alias("model"))
    one = square.crossJoin(fit).crossJoin(both)
    return one.select("square", "cross", "model", (F.col("square") - 2 * F.col("cross") + F.col("model")).alias("loss"))


def factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, largest and number of positive item weights of each factor, its feature of most weight, and its number by mean weight; factors without features are left out."""
    w, h = nmf(materialize(matrix(spark, sf_dir), "cells"))
    stats = w.groupBy("k").agg(F.avg("w").alias("mean_w"), F.max("w").alias("max_w"), F.count_if(F.col("w") > 0).alias("n_active"))
    top = h.filter("h >= 1e-6").groupBy("k").agg(F.max_by("feature", F.struct("h", -F.col("feature"))).alias("top_feature"), F.count("*").alias("n_features"))
    order = Window.orderBy(F.desc(F.round("mean_w", 9)), "k")  # a row for each factor
    return stats.hint("merge").join(top, "k").withColumn("factor", F.row_number().over(order) - 1)


def factor_features(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The ten features of most weight of each factor, weights of 1e-6 or more."""
    _, h = nmf(materialize(matrix(spark, sf_dir), "cells"))
    order = Window.partitionBy("k").orderBy(F.desc("h"), "feature")
    return h.filter("h >= 1e-6").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


#: Ids of vectors are below this.
MOST_ID = 1_000_000_000


def source_hashes(vectors: DataFrame) -> DataFrame:
    """(label, source_hash, n): sum of the hashes of the ids of each label's vectors, and their number; no ids are gathered."""
    each = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("long")
    return vectors.groupBy("label").agg(F.sum(each).alias("source_hash"), F.count("*").alias("n"))


def checked_vectors(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether ids are unique and in range and dimensions equal, and whether all sources are those of a manifest (label, source_hash, n)."""
    counts = vectors.agg(
        F.count("*").alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.min("vec_id").alias("least_id"), F.max("vec_id").alias("most_id"), F.min(F.size("embedding")).cast("long").alias("least_dim"), F.max(F.size("embedding")).cast("long").alias("most_dim")
    ).withColumn("valid", (F.col("n") == F.col("n_ids")) & (F.col("least_dim") == F.col("most_dim")) & (F.col("least_id") >= 0) & (F.col("most_id") < MOST_ID))
    kept = manifest.select("label", F.struct("source_hash", "n").alias("kept"))
    fresh = source_hashes(vectors).hint("merge").join(kept, "label", "left").agg(F.count("*").alias("n_sources"), F.count_if(F.struct("source_hash", "n") == F.col("kept")).alias("n_fresh"))
    return counts.crossJoin(F.broadcast(fresh)).withColumn("fresh", F.col("n_sources") == F.col("n_fresh"))  # one row


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors against a manifest that was written before those with a vec_id of 96 modulo 97 came."""
    vectors = table(spark, sf_dir, "embeddings")
    return checked_vectors(vectors, materialize(source_hashes(vectors.filter("vec_id % 97 <> 96")), "manifest"))


QUERIES = {
    "ml_nmf": nmf_loss,
    "agg_factor_stats": factor_summary,
    "top_factor_features": factor_features,
    "ml_embed_text": lambda s, d: HashedTrigrams(16).embed(table(s, d, "part").select("p_partkey", "p_name"), F.col("p_name"), "v").select("p_partkey", "v"),
    "src_vectors": _vectors,
}


def _nmf_sql(rank: int = RANK, rounds: int = ROUNDS) -> str:
    """CTEs cells, w and h: the same updates as ``nmf``, one pair of queries a round."""
    ks = f"(SELECT unnest(range(0, {rank})) AS k)"
    start = "0.1 + ('0x' || substr(md5(concat_ws('|', {0}, k)), 1, 8))::BIGINT % 1000 / 1000.0::DOUBLE"
    out = [f"cells AS MATERIALIZED (SELECT item_id AS item, feature_id AS feature, avg(mean_value) AS x FROM stats GROUP BY ALL)", f"w0 AS MATERIALIZED (SELECT item, k, {start.format('item')} AS w FROM (SELECT DISTINCT item FROM cells), {ks})", f"h0 AS MATERIALIZED (SELECT feature, k, {start.format('feature')} AS h FROM (SELECT DISTINCT feature FROM cells), {ks})"]

    def update(name: str, own: str, key: str, value: str, other: str, okey: str, ovalue: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT o.{key}, o.k, o.{value} * coalesce(t.top, 0.0) / (b.below + {EPS}) AS {value} FROM {own} o
  LEFT JOIN (SELECT {key}, k, sum(x * {ovalue}) AS top FROM cells JOIN {other} USING ({okey}) GROUP BY ALL) t ON o.{key} = t.{key} AND o.k = t.k
  JOIN (SELECT p.{key}, g.k, sum(p.{value} * g.g) AS below FROM {own} p JOIN (SELECT a.k, c.k AS k2, sum(a.{ovalue} * c.{ovalue}) AS g FROM {other} a JOIN {other} c USING ({okey}) GROUP BY ALL) g ON p.k = g.k2 GROUP BY ALL) b ON o.{key} = b.{key} AND o.k = b.k)"""

    for i in range(rounds):
        out.append(update(f"h{i + 1}", f"h{i}", "feature", "h", f"w{i}", "item", "w"))
        out.append(update(f"w{i + 1}", f"w{i}", "item", "w", f"h{i + 1}", "feature", "h"))
    return ", ".join([STATS_SQL, *out, f"w AS (SELECT * FROM w{rounds})", f"h AS (SELECT * FROM h{rounds})"])


_NMF = _nmf_sql()

ORACLE_SQL = {
    "ml_nmf": f"""WITH {_NMF}, s AS (SELECT sum(x * x) AS square FROM cells), c AS (SELECT sum(x * w * h) AS cross_ FROM cells JOIN w USING (item) JOIN h USING (feature, k)),
gw AS (SELECT a.k, b.k AS k2, sum(a.w * b.w) AS g FROM w a JOIN w b USING (item) GROUP BY ALL), gh AS (SELECT a.k, b.k AS k2, sum(a.h * b.h) AS g FROM h a JOIN h b USING (feature) GROUP BY ALL), m AS (SELECT sum(gw.g * gh.g) AS model FROM gw JOIN gh USING (k, k2))
SELECT square, cross_ AS "cross", model, square - 2 * cross_ + model AS loss FROM s, c, m""",
    "agg_factor_stats": f"""WITH {_NMF}, s AS (SELECT k, avg(w) AS mean_w, max(w) AS max_w, count(*) FILTER (w > 0) AS n_active FROM w GROUP BY k), t AS (SELECT k, arg_max(feature, struct_pack(h := h, f := -feature)) AS top_feature, count(*) AS n_features FROM h WHERE h >= 1e-6 GROUP BY k)
SELECT s.*, top_feature, n_features, (row_number() OVER (ORDER BY round(mean_w, 9) DESC, k) - 1)::INTEGER AS factor FROM s JOIN t USING (k)""",
    "top_factor_features": f"WITH {_NMF} SELECT * FROM (SELECT feature, k, h, row_number() OVER (PARTITION BY k ORDER BY h DESC, feature)::INTEGER AS rn FROM h WHERE h >= 1e-6) WHERE rn <= 10",
    "ml_embed_text": f"SELECT p_partkey, {hashed_vector_sql('lower(p_name)')} AS v FROM part",
    "src_vectors": """WITH c AS (SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(vec_id) AS least_id, max(vec_id) AS most_id, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim FROM embeddings),
h AS (SELECT count(*) AS n_sources, count(*) FILTER (late = 0) AS n_fresh FROM (SELECT label, count(*) FILTER (vec_id % 97 = 96) AS late FROM embeddings GROUP BY label))
SELECT *, n = n_ids AND least_dim = most_dim AND least_id >= 0 AND most_id < 1000000000 AS valid, n_sources = n_fresh AS fresh FROM c, h""",
}
