"""Prefix trie of conversations: identical ones collapse into weighted sequences, whose prefixes are counted."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import join_counted, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A node: the two halves of the digest of its turns, and their number.
NODE = ["k1", "k2", "depth"]
#: Turns that a conversation can take from its donor, less one, and conversations that share a donor.
HEADS, FAMILY = 4, 20
AHEAD = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, ordinal, digest, words): each turn's place in its conversation from 0, and a digest of role and text.

    Turns stand by turn, nulls first, then by digest.  Equal rows of an input partition are one row
    with their number until they are placed.  The order is cut by range into parts, so that a conversation of very
    many turns lies in many: places are counted inside a part, then over the parts of a conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.spark_partition_id().alias("origin"),
    )
    unit = ["conv_id", "turn", "digest", "words", "origin"]
    units = materialize(turns.groupBy(*unit).agg(F.count("*").alias("n")), "units")
    order = ["turn", "digest", "origin"]
    dealt = materialize(units.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(*AHEAD)), F.lit(0))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*AHEAD)), F.lit(0))
    parts = dealt.groupBy("conv_id", "part").agg(F.sum("n").alias("n")).select("conv_id", "part", before.alias("before"))
    placed = dealt.withColumn("inside", inside).hint("merge").join(parts, ["conv_id", "part"])
    each = placed.select("conv_id", "part", F.explode(F.sequence(F.col("before") + F.col("inside"), F.col("before") + F.col("inside") + F.col("n") - 1)).alias("ordinal"), "digest", "words")
    return materialize(each, "turns")


def with_shared_heads(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns, conversations): each conversation begins with the first turns of its donor and goes on with its own.

    The donor of c is c - c % ``family``, and h = crc32(c in decimal) % ``heads`` turns are taken, or all if
    it has fewer, none if there is no donor; c's own first h turns go.  Returns
    (conv_id, part, pos, digest, words, length) and (conv_id, length); a conversation may be left without turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = F.when(F.col("ordinal") < heads - 1, F.struct("ordinal", "digest", "words"))
    known = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("head")).withColumn("h", h), "conversations")
    donors = known.select(F.col("conv_id").alias("donor"), F.col("head").alias("given"))
    taken = F.slice(F.coalesce("given", F.array().cast(known.schema["head"].dataType)), F.lit(1), F.col("h"))
    plans = known.withColumn("donor", F.col("conv_id") - F.col("conv_id") % family).hint("merge").join(donors, "donor", "left").select("conv_id", "n", "h", taken.alias("taken"))
    plans = materialize(plans.withColumn("length", F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))), "plans")
    begun = plans.select("conv_id", F.lit(-1).alias("part"), "length", F.posexplode("taken").alias("pos", "t")).select("conv_id", "part", F.col("pos").cast("long").alias("pos"), "t.digest", "t.words", "length")
    own = join_counted(turns, plans.select("conv_id", "n", "h", F.size("taken").alias("n_taken"), "length"), "conv_id", "n", "own").filter("ordinal >= h")
    own = own.select("conv_id", "part", (F.col("ordinal") - F.col("h") + F.col("n_taken")).alias("pos"), "digest", "words", "length")
    return materialize(begun.unionByName(own), "rebuilt"), plans.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, part, depth, k1, k2, q1, q2, words, length): the node of each beginning of each conversation, and its parent.

    A node's digest is the exclusive or of those of its turns with their places, 128 bits, and so
    a running aggregate: over the turns of a part, then over the parts of a conversation.
    """
    dealt = turns.withColumns({"d1": F.xxhash64(F.lit(1), "pos", "digest"), "d2": F.xxhash64(F.lit(2), "digest", "pos")})
    keys = ["conv_id", "part"]
    inner, outer = Window.partitionBy(*keys).orderBy("pos").rowsBetween(*SO_FAR), Window.partitionBy("conv_id").orderBy("part").rowsBetween(*AHEAD)
    parts = dealt.groupBy(*keys).agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    parts = parts.select(*keys, *[F.coalesce(F.bit_xor(f"d{i}").over(outer), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)])
    run = dealt.withColumns({f"i{i}": F.bit_xor(f"d{i}").over(inner) for i in (1, 2)}).hint("merge").join(parts, keys)
    k1, k2 = (F.col(f"i{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2))
    return run.select(*keys, (F.col("pos") + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("d1")).alias("q1"), k2.bitwiseXOR(F.col("d2")).alias("q2"), "words", "length")


def _blocks(batches):
    """Runs of one node in sorted rows (k1, k2, depth, conv_id), as decimal ids joined by commas."""
    for batch in batches:
        rows = batch.to_pydict()
        out: dict[str, list] = {c: [] for c in (*NODE, "first", "ids")}
        nodes, at = list(zip(*(rows[c] for c in NODE))), 0
        for i in range(1, len(nodes) + 1):
            if i == len(nodes) or nodes[i] != nodes[at]:
                for c, v in zip(out, (*nodes[at], rows["conv_id"][at], ",".join(map(str, rows["conv_id"][at:i])))):
                    out[c].append(v)
                at = i
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))


def _digests(batches):
    """SHA-256 of each node's blocks, which come one after the other."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    node, state = None, hashlib.sha256()
    for batch in batches:
        rows, done = batch.to_pydict(), []
        for *key, ids in zip(*(rows[c] for c in (*NODE, "ids"))):
            if key != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*done))) if done else {c: [] for c in schema.names}, schema=schema)
    if node:
        yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(schema.names, (*node, state.hexdigest()))}, schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256): SHA-256 of the ascending ids, joined by commas, of the conversations that end at a node.

    Ids are sorted over the cluster and joined in blocks; a node's blocks then stream through the hash
    in their order, so that no list of ids is held, however many conversations are the same.
    """
    sorted_ends = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    blocks = sorted_ends.select(*NODE, "conv_id").mapInArrow(_blocks, "k1 long, k2 long, depth long, first long, ids string")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "k1 long, k2 long, depth long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (as of ``with_shared_heads``) of ``conversations`` (conv_id, length).

    Returns conv_id (the smallest of the node's conversations), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256; (conv_id, depth) names a node.

    Identical conversations are one sequence with a weight and a list of ends, and stand for the smallest of their
    ids.  Sequences that no other one extends, found by an anti-join with all proper prefixes, are the leaves.
    Weights and leaves are summed up by prefix; each node's saving is added to all prefixes of
    the sequence that stands for it.  No tree is walked: the number of steps does not depend on its depth.
    """
    begun = materialize(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("long")
    root = [zero.alias("k1"), zero.alias("k2"), zero.alias("depth")]
    ends = materialize(begun.filter("depth = length").select(*NODE, "conv_id").union(conversations.filter("length = 0").select(*root, "conv_id")), "ends")
    collapsed = materialize(ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "sequences")
    proper = begun.filter("depth < length").select(*NODE).union(conversations.filter("length > 0").select(*root)).distinct()
    proper = materialize(proper, "proper")
    leaves = collapsed.hint("merge").join(proper, NODE, "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    inner = collapsed.hint("merge").join(proper, NODE, "left_semi").withColumn("leaf", zero)
    sequences = materialize(leaves.union(inner).select("conv_id", "weight", "leaf", F.col("depth").alias("n")), "leaves")

    weighted = join_counted(begun.drop("length"), sequences, "conv_id", "n", None).drop("n")
    top = sequences.select("conv_id", F.lit(-2).alias("part"), *root, *[F.lit(None).cast("long").alias(q) for q in ("q1", "q2")], zero.alias("words"), "weight", "leaf")
    weighted = materialize(weighted.unionByName(top), "weighted")
    nodes = weighted.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves")
    )
    nodes = materialize(nodes, "nodes")

    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    valued = weighted.select("conv_id", "part", *NODE).hint("merge").join(own, ["conv_id", "depth"], "left")
    valued = materialize(valued.select("conv_id", "part", *NODE, F.coalesce("saving", zero).alias("saving")), "savings")
    inside = F.sum("saving").over(Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(*SO_FAR))
    after = F.coalesce(F.sum("saving").over(Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(*AHEAD)), zero)
    parts = valued.groupBy("conv_id", "part").agg(F.sum("saving").alias("saving")).select("conv_id", "part", after.alias("after"))
    below = valued.withColumn("inside", inside).hint("merge").join(parts, ["conv_id", "part"])
    saved = below.groupBy(*NODE).agg(F.sum(F.col("inside") + F.col("after")).alias("saved_tokens"))

    up = ["q1", "q2", "above"]
    linked = nodes.filter("depth > 0").withColumn("above", F.col("depth") - 1)
    children = materialize(linked.groupBy(*up).agg(F.count("*").alias("n_children")), "children")
    parents = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("depth").alias("above"), F.col("conv_id").alias("parent_conv_id")).hint("merge").join(children, up)
    named = join_counted(linked, parents, up, "n_children", "parents").select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_leaves")
    named = named.union(nodes.filter("depth = 0").select(*NODE, "conv_id", F.lit(None).cast("long"), "n_convs", "n_leaves"))
    counts = children.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.col("above").alias("depth"), "n_children")
    found = named.hint("merge").join(saved, NODE, "left").hint("merge").join(counts, NODE, "left").hint("merge").join(end_digests(ends), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The prefix trie of conversations that share their beginnings by families (``with_shared_heads``, ``trie``).

    Turns are ordered by turn, nulls first, those of one number by a digest of role and text; a null role or
    text is empty.  Rows without a conv_id belong to no conversation and are left out.  Repeated rows are turns
    of their own.  Other columns are ignored.  ``heads`` of 1 leaves all conversations as they are.  A table
    without conversations has no nodes, not even the root.
    """
    return trie(*with_shared_heads(ordered_turns(conversations), family, heads))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE_SQL = {
    "op11_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, md5(length(role) || ':' || role || text)) AS turns,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
           list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns FROM whole a LEFT JOIN whole b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (
  SELECT conv_id, d, len(turns) = d AS ends, md5(turns[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(turns[1:d - 1]::VARCHAR) END AS above,
         CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words, turns
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saving,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, d),
counted AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.above = n.node AND c.d = n.d + 1) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.node = n.above AND p.d = n.d - 1),
below AS (
  SELECT DISTINCT p.node, p.d, c.node AS low, c.d AS low_d, c.n_children, c.saving
  FROM prefixes p JOIN prefixes q ON q.conv_id = p.conv_id AND q.d >= p.d JOIN counted c ON c.node = q.node AND c.d = q.d),
sums AS (SELECT node, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM below GROUP BY node, d)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN sums USING (node, d)""",
}
