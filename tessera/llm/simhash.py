"""SimHash near-duplicates: fingerprints, ball hashing within a Hamming radius, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.graph import connected_components
from tessera.llm.text import sliced, texts, whole_row
from tessera.session import join_counted, materialize

#: A-Z to a-z, nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Fingerprints whose variants one task emits, at most about.
TASK_PRINTS = 200_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a text; repeats count, ties give 0, no words give 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = max(1, len(words) - width + 1)
    stops = (ends - 1)[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), stops.tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded scratch for very long texts
        block = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes))))


def with_fingerprint(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long, one row for each document row."""

    def run(batches):
        for batch in sliced(batches):
            prints = np.array([fingerprint(t, width) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """XOR masks of all 64-bit words within ``radius`` bits of zero, as signed longs."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def linked_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) whose closure joins all distinct fingerprints at ``radius`` or fewer bits.

    Each fingerprint emits the words within half the radius of it.  Two fingerprints
    within an even radius share such a word, and any two that share one are within the
    radius, so a link to the least fingerprint of each word loses nothing and no group
    is expanded into pairs.  Links are verified by their bit count.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // TASK_PRINTS))
    variants = prints.repartition(tasks, "fp").select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    # Distinct fingerprints share a word with few others: a set is bounded by the size of the ball.
    shared = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    return (
        shared.select("a", F.explode("members").alias("b"))
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .distinct()
    )


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Near-duplicate class of each document: doc_id, fp (signed long), component_id.

    Documents link when their fingerprints differ in ``radius`` bits or fewer;
    component_id is the smallest doc_id reachable, the document itself included.
    Equal fingerprints are one class from the start, so copies are never paired.
    A null or empty text has fingerprint zero and links like any other; a row with a
    null doc_id gets the class of its fingerprint but never names one (component_id
    is null if no other row is in it).  Repeated rows give repeated results.  An empty
    table gives no rows.  Columns other than doc_id and text are ignored.
    """
    rows = materialize(with_fingerprint(docs, width), "prints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")), "classes")
    roots = connected_components(linked_fingerprints(classes.select("fp"), radius))
    rooted = materialize(classes.hint("merge").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_prints"))
    labels = join_counted(rooted, named, "root", "n_prints", "named").select("fp", "component_id", "n_rows")
    return join_counted(rows, labels, "fp", "n_rows", "labels").select("doc_id", "fp", "component_id")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone``(gone_id); their columns may have any names."""
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("own_id"))
    return rows.hint("merge").join(gone, F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")


def keep_first(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The documents whose doc_id is the smallest of their class, all their columns kept.

    Of repeated rows with one doc_id, all stay; rows with a null doc_id stay.
    """
    return without(docs, simhash_components(docs, width, radius).filter("doc_id > component_id").select(F.col("doc_id").alias("gone_id")).distinct())


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
