"""Session helpers: table loading and cutting of lineage through shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of numbers that ``few_or_merge`` broadcasts at most, whatever the data: a few MB.
FEW = 20_000


def build_session(app: str = "tessera", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the tests and the bench share."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zone-less timestamps become session timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    Where none is named, a local master gets a temporary one; any other raises, since
    executors on other machines could not read it.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete a scratch folder when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame as Parquet into the shared checkpoint folder and read it back.

    This cuts lineage, survives lost executors and gives later joins true sizes.  The
    folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP_KEY, None)
    if before is not None:  # the shuffle files of a written table are of no more use
        spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP_KEY, before)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], count: str, label: str | None, share: float = 0.0005) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key, in which ``count`` says how many of ``rows`` have the key.

    Keys that hold more than ``share`` of all rows, so fewer than 1 / ``share`` of them,
    go by broadcast and never meet in one task; the others are sort-merge joined.  A
    table of no more keys than that is broadcast whole.  ``rows`` should be a written
    table, as it is read twice; ``counted`` is written here unless ``label`` is None.
    """
    counted = counted if label is None else materialize(counted, label)
    sums = counted.agg(F.count("*").alias("keys"), F.sum(count).alias("total"), F.max(count).alias("most")).first()
    limit = share * (sums["total"] or 0)
    if sums["keys"] * share <= 1:
        return rows.join(F.broadcast(counted), key)
    if sums["most"] <= limit:
        return rows.hint("merge").join(counted, key)
    heavy, light = counted.filter(F.col(count) > limit), counted.filter(F.col(count) <= limit)
    dealt = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").hint("merge").join(light, key)
    return dealt.unionByName(rest)


def few_or_merge(few: DataFrame) -> DataFrame:
    """The written table ``few`` of narrow rows with its strategy as the right side of a join: broadcast up to FEW rows, else merge.

    A broadcast spares the shuffle of both sides, and so the driver the bookkeeping of its tasks.
    """
    return F.broadcast(few) if few.count() <= FEW else few.hint("merge")


def join_salted(rows: DataFrame, counted: DataFrame, key: str, count: str, by: str, label: str, each: int = 500) -> DataFrame:
    """``join_counted`` where ``counted`` is too wide to broadcast: a key of many rows meets in several tasks.

    A key is dealt into as many parts as it has ``each`` rows, by the hash of ``by``; the row of ``counted`` goes to
    all of them.  Only keys and numbers of parts are broadcast.
    """
    wide = materialize(counted.withColumn("parts", F.ceil(F.col(count) / each)), label)
    dealt = join_counted(rows, wide.select(key, count, "parts"), key, count, None).withColumn("part", F.pmod(F.xxhash64(by), F.col("parts"))).drop(count, "parts")
    spread = wide.drop(count).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return dealt.hint("merge").join(spread, [key, "part"]).drop("part")


def earlier_values(rows: DataFrame, key: str, order: list[str], value: str, lags: int, count: str, label: str, most: int = 1000) -> DataFrame:
    """``rows`` with earlier, the up to ``lags`` values before each row among those of its key, the nearest first.

    ``count`` is a column of the number of rows of the key.  A key of up to ``most`` is put in order by one task; a
    larger one is cut by range into parts, which are put in order each and then learn the last values of the parts before.
    """
    def before(window) -> Column:
        return F.array_compact(F.array(*[F.lag(value, i).over(window) for i in range(1, lags + 1)]))

    light, heavy = rows.filter(F.col(count) <= most), rows.filter(F.col(count) > most)
    plain = light.withColumn("earlier", before(Window.partitionBy(key).orderBy(*order)))
    dealt = materialize(heavy.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), label)
    place = F.row_number().over(Window.partitionBy(key, "part").orderBy(*[F.desc(c) for c in order]))
    last = dealt.select(key, "part", value, place.alias("place")).filter(F.col("place") <= lags)
    last = last.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("place", value)))[value].alias("last"))
    parts = Window.partitionBy(key).orderBy("part")
    none = F.array().cast(last.schema["last"].dataType)
    ahead = last.select(key, "part", F.concat(*[F.coalesce(F.lag("last", i).over(parts), none) for i in range(1, lags + 1)]).alias("ahead"))
    inside = dealt.withColumn("inside", before(Window.partitionBy(key, "part").orderBy(*order)))
    cut = inside.hint("merge").join(ahead, [key, "part"]).withColumn("earlier", F.slice(F.concat("inside", "ahead"), 1, lags)).drop("part", "inside", "ahead")
    return plain.unionByName(cut)
