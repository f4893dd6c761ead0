"""K-d tree sharding: weighted median splits over metadata, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import join_counted, materialize

SHARDS = 24
#: Bins of a node in one pass of the median search: what the driver sees of it.
BINS = 4096
#: Low bits of a code, which deal the rows of a group of equal texts.
PIECE_BITS = 12
#: Rows numbered in one window partition, about.
SLOT_ROWS = 20_000
DIMENSIONS = ("length", "source", "lang", "doc_id")


@dataclass
class Node:
    """``shards`` shards from ``first`` on; split by ``dim`` below ``cut`` once it is known."""

    first: int
    shards: int
    dim: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def open(self) -> list[Node]:
        if self.left and self.right:
            return self.left.open() + self.right.open()
        return [self] if self.shards > 1 else []

    def column(self) -> Column:
        """The first shard of the leaf that a row falls into."""
        if self.left and self.right:
            return F.when(F.col(f"code{self.dim}") < F.lit(self.cut), self.left.column()).otherwise(self.right.column())
        return F.lit(self.first)


def _slim(docs: DataFrame) -> DataFrame:
    """One row for each document: sizes, checksum, digest and metadata, without the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text).alias("digest"),
        F.length(text).alias("chars"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source") if "source" in docs.columns else F.lit("").alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang") if "lang" in docs.columns else F.lit("").alias("lang"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with one code for each dimension: 30 bits of the value, 20 of the text's hash, 12 of the doc_id's.

    Equal texts take the least source, language and doc_id among them, so that they
    stand side by side.
    """
    groups = rows.groupBy("digest").agg(
        F.sum("size").alias("group_size"), F.min("source").alias("g_source"), F.min("lang").alias("g_lang"), F.min("doc_id").alias("g_id"), F.min("chars").alias("g_chars"), F.count("*").alias("n")
    )
    groups = materialize(groups, "groups")
    total = groups.agg(F.min("g_id").alias("a"), F.max("g_id").alias("b"), F.max(F.log1p("g_chars")).alias("c")).first()
    top = (1 << 30) - 1
    value = {
        "length": F.log1p("g_chars") / F.lit(max(total["c"] or 0.0, 1e-9)),
        "source": F.crc32(F.col("g_source").cast("binary")) / F.lit(2.0**32),
        "lang": F.crc32(F.col("g_lang").cast("binary")) / F.lit(2.0**32),
        "doc_id": (F.coalesce("g_id", F.lit(total["a"] or 0)) - F.lit(total["a"] or 0)) / F.lit(float(max((total["b"] or 0) - (total["a"] or 0), 1))),
    }
    low = F.shiftleft(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)), PIECE_BITS) + F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << PIECE_BITS))
    codes = {f"code{i}": F.shiftleft(F.floor(value[d] * top).cast("long"), 32) + low for i, d in enumerate(DIMENSIONS)}
    return join_counted(rows.select("doc_id", "size", "text_crc32", "digest"), groups, "digest", "n", None).select("doc_id", "size", "text_crc32", "digest", *[c.alias(n) for n, c in codes.items()])


def _medians(rows: DataFrame, nodes: list[Node], where: Column, spans: dict[int, tuple[int, int, int]], shard: float) -> None:
    """Set the cut of each node at the code where the weight left of it is nearest its share.

    ``spans`` has (weight, least code, largest code) of each node.  A pass sums the
    weights of BINS bins of each node and goes on inside the bin of the median, until
    that bin holds one group of equal texts.  The cut stands beside the group, and goes through it only
    if the group weighs more than a ``shard``.
    """
    search = {}  # weight below, weight wanted, least, largest, bits set aside
    for n in nodes:
        weight, least, largest = spans[n.first]
        search[n.first] = (0, weight * (n.shards // 2) / n.shards, least >> PIECE_BITS, largest >> PIECE_BITS, PIECE_BITS)
    live = {n.first: n for n in nodes}
    while live:
        code, low, high, step = (F.lit(None).cast("long") for _ in range(4))
        for first, n in live.items():
            here, (_, _, lo, hi, bits) = F.col("node") == first, search[first]
            code = F.when(here, F.shiftright(f"code{n.dim}", bits)).otherwise(code)
            low, high = F.when(here, F.lit(lo)).otherwise(low), F.when(here, F.lit(hi)).otherwise(high)
            step = F.when(here, F.lit((hi - lo) // BINS + 1)).otherwise(step)
        seen = rows.select(where.alias("node"), "*").filter(F.col("node").isin(list(live))).select("node", "size", code.alias("code"), low.alias("low"), high.alias("high"), step.alias("step"))
        cells = (
            seen.filter("code BETWEEN low AND high")
            .groupBy("node", F.expr("(code - low) div step").alias("bin"))
            .agg(F.sum("size").alias("w"), F.min("code").alias("a"), F.max("code").alias("b"))
            .collect()  # BINS rows for each of fewer than SHARDS nodes
        )
        for first in list(live):
            n, (below, target, _, _, bits) = live[first], search[first]
            mine = sorted((c for c in cells if c["node"] == first), key=lambda c: c["bin"])
            if not mine:
                live.pop(first)  # no rows: any cut will do
                continue
            for c in mine:
                if below + c["w"] >= target or c is mine[-1]:
                    break
                below += c["w"]
            under, over = target - below, below + c["w"] - target
            if c["a"] < c["b"]:
                search[first] = (below, target, c["a"], c["b"], bits)
            elif bits and c["w"] > shard:
                search[first] = (below, target, c["a"] << bits, ((c["a"] + 1) << bits) - 1, 0)
            else:
                n.cut = (c["a"] if under < over else c["a"] + 1) << bits
                live.pop(first)


def kd_tree(rows: DataFrame, shards: int) -> Node:
    """Split ``rows``(size, code0..) level by level along each node's widest dimension."""
    root, shard = Node(0, shards), 0.0
    while nodes := root.open():
        where = root.column()
        aggs = [x for i in range(len(DIMENSIONS)) for x in (F.min(f"code{i}").alias(f"a{i}"), F.max(f"code{i}").alias(f"b{i}"))]
        found = {r["node"]: r for r in rows.groupBy(where.alias("node")).agg(F.sum("size").alias("w"), *aggs).collect()}
        shard = shard or sum(r["w"] for r in found.values()) / shards
        spans = {}
        for n in nodes:
            r = found.get(n.first)
            width = [((r[f"b{i}"] >> 32) - (r[f"a{i}"] >> 32)) if r else 0 for i in range(len(DIMENSIONS))]
            n.dim = width.index(max(width))
            spans[n.first] = (r["w"], r[f"a{n.dim}"], r[f"b{n.dim}"]) if r else (0, 0, 0)
        _medians(rows, nodes, where, spans, shard)
        for n in nodes:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
    return root


def shard_by_kd_tree(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal documents into ``shards`` shards of near equal bytes by a k-d tree over metadata.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, digest, shard
    (0 up) and slot (0 up without gaps in a shard), one row for each document row.

    The dimensions are log length, source, language and doc_id, each scaled to the
    table's range; a node is split along its widest one at the weighted median, by
    passes of bounded histograms, until each leaf is one shard.  Equal texts share
    their place in all dimensions and so their shard; a cut goes through a group only if
    the group alone is larger than a shard.  Sizes differ by the groups and rows on the cuts.

    A null text counts as empty, a null source or language as "", a null doc_id as
    the least one.  Missing source or lang columns, extra columns, repeated rows and an
    empty table are fine; no rows give no rows.
    """
    rows = materialize(_placed(materialize(_slim(docs), "slim")), "placed")
    tree = kd_tree(rows, shards)
    n_rows = rows.count()
    buckets = max(1, -(-n_rows // (SLOT_ROWS * shards)))
    dealt = rows.select("doc_id", "size", "text_crc32", "digest", tree.column().alias("shard")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    dealt = materialize(dealt, "dealt")
    before = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest"))
    return (
        dealt.withColumn("place", place).hint("merge").join(before.select("shard", "bucket", "offset"), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))
    )


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_kd_tree(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_kd_sharding": op4_kd_sharding}
ORACLE_SQL: dict[str, str] = {}
