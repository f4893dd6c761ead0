"""Substring dedup: Rabin-Karp hashes of all fixed-length word windows, counted in Spark."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import Rolling, WordHashes, covered, mixed, sliced, sliding_min, texts
from tessera.session import join_counted, materialize

#: Words of the short windows whose least hash names the group that a long window is counted in.
ANCHOR_WORDS = 8


def _window_hashes(words: list[bytes], window: int, hashes: WordHashes, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash, second hash) of each window; equal windows have equal anchors, other windows another pair of hashes."""
    h = hashes.of(words)
    short = min(ANCHOR_WORDS, window)
    return sliding_min(rolling.windows(h, short), window - short + 1), rolling.windows(h, window), rolling.windows(mixed(~h), window)


def _anchors_of(window: int):
    def run(batches):
        hashes, rolling, short = WordHashes(), Rolling(), min(ANCHOR_WORDS, window)
        for batch in sliced(batches):
            found, sizes = [], []
            for text in texts(batch.column(2)):
                words = text.split()
                if len(words) < window:
                    sizes.append(0)
                    continue
                least = sliding_min(rolling.windows(hashes.of(words), short), window - short + 1)
                found.append(np.unique(least))
                sizes.append(len(found[-1]))
            at = np.repeat(np.arange(batch.num_rows), sizes)
            anchors = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(anchors.view(np.int64))],
                ["doc_id", "text_key", "anchor"],
            )

    return run


def _windows_of(window: int):
    def run(batches):
        hashes, rolling = WordHashes(), Rolling()
        for batch in sliced(batches):
            for doc_id, key, wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), texts(batch.column(2))):
                anchors, windows, second = _window_hashes(text.split(), window, hashes, rolling)
                mine = np.sort(wanted.values.to_numpy(zero_copy_only=False).view(np.uint64))
                at = np.minimum(np.searchsorted(mine, anchors), len(mine) - 1)
                starts = np.flatnonzero(mine[at] == anchors)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, doc_id, np.int64)), pa.array(np.full(n, key, np.int64)), pa.array(windows[starts].view(np.int64)), pa.array(second[starts].view(np.int64)), pa.array(starts.astype(np.int32))],
                    ["doc_id", "text_key", "hash", "second", "start"],
                )

    return run


def _cut(window: int):
    def run(batches):
        for batch in sliced(batches):
            kept, digests, sizes, removed, spans = [], [], [], [], []
            for whole, starts, text in zip(batch.column(2).to_pylist(), batch.column(3), texts(batch.column(1))):
                words = text.split()
                n = len(words)
                if whole and n >= window:
                    gone = np.ones(n, bool)
                elif starts.is_valid:
                    gone = covered(starts.values.to_numpy(zero_copy_only=False), window, n)
                else:
                    gone = np.zeros(n, bool)
                out = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g])
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
                kept.append(out)
                digests.append(hashlib.sha256(out).hexdigest())
                sizes.append(n)
                removed.append(int(gone.sum()))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in edges])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"],
            )

    return run


def remove_repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove each word in a window of ``window`` words that also starts in a document with a smaller doc_id.

    Returns per document row: doc_id, n_words, n_removed, spans (maximal removed word
    intervals, both ends inclusive), kept_text (kept words joined by one space) and
    kept_sha256 of it.  Words are maximal runs without space or \\x09-\\x0D.

    Every window has a Rabin-Karp hash.  Its anchor, the least hash of its 8-word
    windows, is a function of its words; a first count over anchors, about one for
    twenty windows, shows which windows cannot repeat in another document, and only
    the others are shuffled and counted by two hashes of their own, 128 bits together, so
    that windows of other words don't meet.  Documents whose whole
    texts repeat an earlier one go at once: all their windows start there.

    Windows are judged on the input.  A null or empty text, or one of fewer than
    ``window`` words, loses nothing.  Rows with a null doc_id neither lose words nor
    take them from others; repeated rows with one doc_id don't repeat each other.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_key", F.xxhash64("text"))
    known = rows.filter("doc_id IS NOT NULL")

    digests = materialize(known.select("doc_id", "text_key", F.md5("text").alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).filter("first_id < last_id")
    copies = materialize(join_counted(digests, first, "digest", "n", "firsts").filter("doc_id > first_id").select("doc_id", "text_key").distinct(), "copies")

    anchors = known.select("doc_id", "text_key", "text").mapInArrow(_anchors_of(window), "doc_id long, text_key long, anchor long")
    anchors = materialize(anchors.hint("merge").join(copies, ["doc_id", "text_key"], "left_anti"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("anchor", "n")
    wanted = materialize(join_counted(anchors, shared, "anchor", "n", "shared").groupBy("doc_id", "text_key").agg(F.collect_list("anchor").alias("anchors")), "wanted")
    windows = materialize(
        known.hint("merge").join(wanted, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "anchors")
        .mapInArrow(_windows_of(window), "doc_id long, text_key long, hash long, second long, start int"),
        "windows",
    )
    both = ["hash", "second"]
    counted = windows.groupBy(*both).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select(*both, "lo", "n")
    repeats = materialize(
        join_counted(windows, counted, both, "n", "counted").filter("doc_id > lo").groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts")),
        "repeats",
    )

    marks = copies.withColumn("whole", F.lit(True)).withColumn("starts", F.lit(None).cast("array<int>")).unionByName(repeats.withColumn("whole", F.lit(False)))
    return (
        rows.hint("merge").join(marks, ["doc_id", "text_key"], "left").select("doc_id", "text", "whole", "starts")
        .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept_text string, kept_sha256 string")
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL = {
    "op3_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS win
  FROM words, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS s) WHERE len(w) >= 50),
hits AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS lo FROM starts) WHERE doc_id > lo),
gone AS (
  SELECT DISTINCT doc_id, s + o AS p FROM hits, (SELECT unnest(range(0, 50)) AS o)),
places AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM words),
judged AS (
  SELECT places.*, gone.p IS NOT NULL AS g FROM places LEFT JOIN gone ON places.doc_id = gone.doc_id AND places.p = gone.p),
sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (g) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (NOT g) AS kept,
         count(*) FILTER (first_gone) AS n_spans
  FROM (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY p), false) AS first_gone FROM judged)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::INTEGER AS n_spans
FROM documents d LEFT JOIN sums USING (doc_id)""",
}
