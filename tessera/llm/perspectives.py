"""Chat formatting: one rendering of a dialogue for each participant, with masks of what that one says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
#: Turns of one output row; a longer dialogue goes on in the next.
SEGMENT_TURNS = 512


def _safe(text):
    """Text in which nothing reads as a template mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _numbered(turns: DataFrame, size: int) -> DataFrame:
    """``turns``(conv_id, turn, role, text) with ordinal, the place of each in its dialogue from 0.

    Rows are counted by turn and by the first digits of their hash, these counts are
    summed up in ranges of ``size`` turn numbers, and those by dialogue, so that no window
    holds the texts of more than one turn number's share.
    """
    rows = materialize(turns.withColumn("tie", F.md5(F.concat_ws("|", "role", "text"))).withColumn("part", F.substring("tie", 1, 2)), "turns")
    unit, ahead = ["conv_id", "turn", "part"], (Window.unboundedPreceding, -1)
    units = rows.groupBy(*unit).agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("turn") / size))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "range").orderBy("turn", "part").rowsBetween(*ahead)), F.lit(0))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(*ahead)), F.lit(0))
    ranges = units.groupBy("conv_id", "range").agg(F.sum("n").alias("n")).select("conv_id", "range", before.alias("before"))
    offsets = units.withColumn("inside", inside).hint("merge").join(ranges, ["conv_id", "range"]).select(*unit, (F.col("before") + F.col("inside")).alias("offset"))
    place = F.row_number().over(Window.partitionBy(*unit).orderBy("tie", "role", "text")) - 1
    return rows.withColumn("place", place).hint("merge").join(offsets, unit).select("conv_id", "role", "text", (F.col("offset") + F.col("place")).alias("ordinal"))


def rotate_perspectives(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Each dialogue rendered once for every participant.

    Returns conv_id, perspective, segment, start, n_turns, n_own_turns, rendered and mask.  A
    rendering is whole: a dialogue of more than ``segment_turns`` turns is stored in
    consecutive segments, 0 up, whose texts side by side are the rendering; start is the
    place of the segment in it.  mask has the spans first-last of code points of the whole
    rendering that count for training, the speaker's own
    texts with their closing mark, ends exclusive, comma-joined.  In a perspective its speaker is
    the assistant, every other one a named user; system turns stay system turns and
    have no perspective.

    Turns are ordered by turn, those of one turn number by a hash of role and text, so that
    even very many of them are never gathered in one task.
    Rows without conv_id or turn belong to no dialogue and are left out; a null
    role is the participant "unknown", a null text is empty; repeated rows count once.
    Template marks inside texts and names are broken up, line ends in names are spaces.  Dialogues of system turns
    only, and empty tables, give no rows; other columns are ignored.
    """
    name = F.trim(F.regexp_replace(F.col("role").cast("string"), r"[\x00-\x1F\x7F]+", " "))
    turns = (
        conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
        .select(
            "conv_id", F.col("turn").cast("long").alias("turn"),
            _safe(F.coalesce(F.when(name == "", None).otherwise(name), F.lit("unknown"))).alias("role"),
            _safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        )
        .distinct()
    )
    placed = _numbered(turns, segment_turns).withColumn("segment", F.expr(f"ordinal div {segment_turns}"))
    segments = materialize(placed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("ordinal", "role", "text"))).alias("turns")), "segments")

    def size(t):
        """Code points of a turn of another speaker."""
        shown = F.when(t["role"] == SYSTEM, F.lit(len(SYSTEM))).otherwise(F.length(t["role"]) + len("user name="))
        return (shown + F.length(t["text"]) + len(OPEN) + len(CLOSE) + 2).cast("long")

    sizes = segments.select("conv_id", "segment", F.aggregate(F.transform("turns", size), F.lit(0).cast("long"), lambda a, b: a + b).alias("size"))
    spoken = segments.select("conv_id", "segment", F.explode("turns.role").alias("perspective")).filter(F.col("perspective") != SYSTEM).groupBy("conv_id", "perspective", "segment").agg(F.count("*").alias("n_own"))
    people = spoken.select("conv_id", "perspective").distinct()
    views = sizes.hint("merge").join(people, "conv_id").hint("merge").join(spoken, ["conv_id", "perspective", "segment"], "left")
    shorter = F.coalesce("n_own", F.lit(0)) * (F.length("perspective") + len("user name=") - len("assistant"))
    past = Window.partitionBy("conv_id", "perspective").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    views = views.select("conv_id", "perspective", "segment", F.coalesce(F.sum(F.col("size") - shorter).over(past), F.lit(0)).alias("start"))

    def pieces(t):
        own = t["role"] == F.col("perspective")
        who = F.when(own, F.lit("assistant")).when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.struct(F.concat(F.lit(OPEN), who, F.lit("\n")).alias("head"), t["text"].alias("body"), own.alias("own"))

    shown = segments.hint("merge").join(views, ["conv_id", "segment"]).withColumn("p", F.transform("turns", pieces))
    empty = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, p):
        first = acc["at"] + F.length(p["head"])
        last = first + F.length(p["body"]) + len(CLOSE)
        return F.struct((last + 1).alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.concat_ws("-", first, last)))).otherwise(acc["spans"]).alias("spans"))

    return shown.select(
        "conv_id", "perspective", "segment", "start",
        F.size("p").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda p: p["own"])).cast("long").alias("n_own_turns"),
        F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("p", empty, step)["spans"], ",").alias("mask"),
    )


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op6_perspective_rotation": op6_perspective_rotation}
ORACLE_SQL = {
    "op6_perspective_rotation": r"""
WITH named AS (
  SELECT conv_id, turn, trim(regexp_replace(role, '[\x00-\x1F\x7F]+', ' ', 'g')) AS name, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
turns AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(nullif(name, ''), 'unknown'), '<|', '< |') AS role, replace(text, '<|', '< |') AS text FROM named),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(concat_ws('|', role, text)), role, text) - 1 AS ordinal FROM turns),
shown AS (
  SELECT conv_id, perspective, ordinal // 512 AS segment, ordinal, text, role = perspective AS own,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM ordered JOIN people USING (conv_id)),
placed AS (
  SELECT *, sum(length(head) + length(text) + 11) OVER w - length(text) - 11 AS first
  FROM shown WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY ordinal))
SELECT conv_id, perspective, segment, min(first - length(head))::BIGINT AS start, count(*) AS n_turns, count(*) FILTER (own) AS n_own_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY ordinal) AS rendered,
       coalesce(string_agg(first::BIGINT || '-' || (first + length(text) + 10)::BIGINT, ',' ORDER BY ordinal) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective, segment""",
}
