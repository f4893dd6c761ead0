"""Artifacts around the tables: JSON maps, supplements, manifests, cache validity, palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.functions.text import hashed_vector, hashed_vector_sql
from tessera.operators.series import _FRAMES, SERIES, observed_frames
from tessera.session import delete_at_exit, scratch_path, table

#: What a caller asks for: version, sample rate, parts of a series.
VERSION, RATE, PARTS = 3, 44_100, 4


def curated_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, name, feature_id, label, category): features of curated maps, read as JSON of blocks that hold a name and a map of features."""
    p = table(spark, sf_dir, "part")
    entry = F.struct(F.col("p_partkey").cast("string").alias("key"), F.struct(F.lower("p_name").alias("label"), F.lower("p_type").alias("category")).alias("value"))
    blocks = p.groupBy("p_brand", (F.col("p_size") % 5).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("features"))
    body = F.to_json(F.map_from_arrays(F.array("p_brand"), F.array(F.struct(F.concat(F.lit("part "), F.col("part")).alias("name"), "features"))))
    path = scratch_path(spark, "curated")
    blocks.select(body.alias("value")).write.text(path)
    delete_at_exit(spark, path)
    kind = "map<string,struct<name:string,features:map<string,struct<label:string,category:string>>>>"
    read = spark.read.text(path).select(F.from_json("value", kind).alias("m"))
    each = read.select(F.explode("m").alias("block", "x")).select("block", "x.name", F.explode("x.features").alias("feature_id", "f"))
    return each.select("block", "name", F.col("feature_id").cast("long").alias("feature_id"), "f.label", "f.category")


def supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five top terms of each source, written as JSON and read back with a fixed schema; empty where there are none."""
    docs = search._docs(spark, sf_dir)
    terms = search.top_terms(docs, 5).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]).alias("terms"))
    path = scratch_path(spark, "supplements")
    terms.write.json(path)
    delete_at_exit(spark, path)
    read = spark.read.schema("source string, terms array<string>").json(path)
    return read.select("source", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each block as vectors of length one, written with the block's manifest: model, dimension, number and a hash of its labels.

    Returns the manifest with the sum of all entries of the vectors that were read back.
    """
    rows = search.catalog(spark, sf_dir).select("block", "id", "label", hashed_vector(F.col("label"), 16).alias("v")).withColumn("v", search.unit(F.col("v")))
    path = scratch_path(spark, "embeddings")
    rows.write.partitionBy("block").parquet(path)
    delete_at_exit(spark, path)
    read = spark.read.parquet(path)
    each = F.conv(F.substring(F.md5(F.concat_ws("|", "block", "id", "label")), 1, 8), 16, 10).cast("long")
    entries = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return read.groupBy("block").agg(F.lit("trigrams").alias("model"), F.count("*").alias("n"), F.max(F.size("v")).cast("long").alias("dimension"), F.sum(each).alias("source_hash"), F.sum(entries).alias("entries"))


def content_hashes(seen: DataFrame) -> DataFrame:
    """(track, stem, content_hash): a hash of a series' name and of the sum of the hashes of its frames and their values in thousandths."""
    each = F.conv(F.substring(F.md5(F.concat_ws("|", "frame_idx", F.round(F.col("v") * 1000).cast("long"))), 1, 8), 16, 10).cast("long")
    sums = seen.groupBy(*SERIES).agg(F.sum(each).alias("sum"))
    return sums.select(*SERIES, F.substring(F.sha2(F.concat_ws("|", *SERIES, "sum"), 256), 1, 16).alias("content_hash"))


def cache_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a cached series may be used or not: the hash of its content, version, level, coupling and rate must be those asked for, and its parts be there.

    The cache is written in a folder for each content hash and read back.  Every fourth
    track is written by an older version, every fifth at another rate, and the first stem of
    every seventh lacks its last part.  One frame of each ninth track has changed since, so that nothing is cached for its content.
    """
    seen = observed_frames(spark, sf_dir)
    cached = seen.filter("NOT (track % 9 = 4 AND frame_idx % 50 = 0)")
    kept = cached.hint("merge").join(content_hashes(cached), list(SERIES)).withColumn("version", F.when(F.col("track") % 4 == 1, VERSION - 1).otherwise(VERSION)).withColumn("rate", F.when(F.col("track") % 5 == 2, 22_050).otherwise(RATE)).withColumn("level", F.lit("full")).withColumn("part", F.col("frame_idx") % PARTS)
    path = scratch_path(spark, "curves")
    kept.filter("NOT (track % 7 = 3 AND stem = 'click' AND part = 3)").write.partitionBy("content_hash").parquet(path)
    delete_at_exit(spark, path)
    stored = spark.read.parquet(path).groupBy("content_hash").agg(F.max("version").alias("version"), F.max("rate").alias("rate"), F.max("level").alias("level"), F.count_distinct("part").alias("parts"), F.count("*").alias("n"))
    asked = content_hashes(seen)
    reason = F.when(F.col("version").isNull(), "absent").when(F.col("version") != VERSION, "version").when(F.col("level") != "full", "level").when(F.col("rate") != RATE, "rate").when(F.col("parts") < PARTS, "incomplete").otherwise("ok")
    return asked.hint("merge").join(stored, "content_hash", "left").select(*SERIES, "content_hash", F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason"))


QUERIES = {
    "src_curated_map": curated_map,
    "src_supplements": supplements,
    "snk_embeddings": embedded,
    "snk_curves_cache": cache_validity,
}
_H = "('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::BIGINT"
def _contents(source: str, name: str) -> str:
    each = _H.format("frame_idx, round(v * 1000)::BIGINT")
    return f"{name} AS (SELECT track, stem, substr(sha256(concat_ws('|', track, stem, sum({each})::BIGINT)), 1, 16) AS content_hash FROM {source} GROUP BY track, stem)"


ORACLE_SQL = {
    "src_curated_map": "SELECT p_brand AS block, 'part ' || (p_size % 5) AS name, p_partkey AS feature_id, lower(p_name) AS label, lower(p_type) AS category FROM part",
    "src_supplements": f"""WITH {search._TFIDF}, m AS (SELECT source, term, round(sum(weight) / (SELECT count(*) FROM documents x WHERE x.source = d.source), 9) AS w FROM tfidf JOIN documents d USING (doc_id) GROUP BY source, term)
SELECT source, list(term ORDER BY rn) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, term) AS rn FROM m WHERE w > 0) WHERE rn <= 5 GROUP BY source""",
    "snk_embeddings": f"""WITH {search._CAT}, v AS (SELECT block, id, label, {hashed_vector_sql('label', 16)} AS v FROM cat)
SELECT block, 'trigrams' AS model, count(*) AS n, max(len(v)) AS dimension, sum({_H.format('block, id, label')})::BIGINT AS source_hash, sum(list_sum(v) / sqrt(list_dot_product(v, v))) AS entries FROM v GROUP BY block""",
    "snk_curves_cache": f"""WITH {_FRAMES}, {_contents('seen', 'now')}, {_contents("(SELECT * FROM seen WHERE NOT (track % 9 = 4 AND frame_idx % 50 = 0))", 'old')},
s AS (SELECT track, stem, count(*) AS n, count(DISTINCT frame_idx % 4) AS parts FROM seen WHERE NOT (track % 7 = 3 AND stem = 'click' AND frame_idx % 4 = 3) GROUP BY track, stem)
SELECT a.track, a.stem, a.content_hash, CASE WHEN b.stem IS NULL THEN 0 ELSE coalesce(n, 0) END AS n,
  CASE WHEN b.stem IS NULL OR n IS NULL THEN 'absent' WHEN a.track % 4 = 1 THEN 'version' WHEN a.track % 5 = 2 THEN 'rate' WHEN parts < 4 THEN 'incomplete' ELSE 'ok' END AS reason
FROM now a LEFT JOIN old b USING (content_hash) LEFT JOIN s ON s.track = a.track AND s.stem = a.stem""",
}
