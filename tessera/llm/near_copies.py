"""Near copies by shingles of five words: candidates from SimHash balls and MinHash bands, verified by Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.graph import connected_components
from tessera.llm.simhash import LOWER, fingerprint, linked_fingerprints, without
from tessera.llm.text import Rolling, WordHashes, sliced, texts
from tessera.session import earlier_values, few_or_merge, join_counted, join_salted, materialize

#: Words of a shingle, and the Jaccard similarity of two shingle sets from which texts are near copies.
WIDTH = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares none of 16 bands of four with a chance of (1 - 0.8 ** 4) ** 16 = 0.0002.
BANDS, ROWS = 16, 4
#: Members before it in a band that a text is compared with at first, besides the first one; what that leaves apart goes to ``near_roots``.
LAGS = 4
#: Members of a shingle that the first round of the rest compares with all others, how many times more the next ones, and how many meet in one task.
MORE, FACTOR, PART = 16, 16, 1000
#: Shingles that are hashed at one time.
BLOCK = 4096

_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(words: list[bytes], hashes: WordHashes, rolling: Rolling, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles of lower-cased words; a shorter text is one shingle."""
    return np.unique(rolling.windows(hashes.of(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """One signed key for each band of the MinHash of a set; none for an empty set."""
    if not len(found):
        return []
    folded = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), BLOCK):
        np.minimum(least, (folded[at : at + BLOCK] * FACTORS + TERMS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _sketches(batches):
    hashes, rolling = WordHashes(), Rolling()
    for batch in sliced(batches):
        digests, prints, keys = [], [], []
        for text in texts(batch.column(2)):
            words = text.translate(LOWER).split()
            digests.append(xxhash.xxh64_intdigest(b" ".join(words)))
            prints.append(fingerprint(text))
            keys.append(bands(shingles(words, hashes, rolling)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "text_key", "node", "fp", "bands"],
        )


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verify(batches):
    hashes, rolling = WordHashes(), Rolling()
    for batch in sliced(batches):
        sets = [[shingles(t.translate(LOWER).split(), hashes, rolling) for t in texts(batch.column(c))] for c in (2, 3)]
        near = pa.array([similarity(a, b) >= SIMILARITY for a, b in zip(*sets)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(near)


def band_members(nodes: DataFrame) -> DataFrame:
    """(key, node, next, n, leader): the nodes of each band that has several, the key of a node's next band, the band's size and least node."""
    keyed = materialize(nodes.select("node", "bands", F.posexplode("bands").alias("i", "key")).select("node", "key", F.get("bands", (F.col("i") + 1) % BANDS).alias("next")), "bands")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1")
    return materialize(join_counted(keyed, sizes, "key", "n", "sizes"), "members")


def candidates(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes(node, fp, bands)`` that may be near copies, at most LAGS + 1 for each node and band; the first to be compared.

    Nodes within two bits of one another's fingerprint are linked as in op8.  In each band
    a node is compared with the least member and the LAGS before it; a band's members are in
    the order of their next band, so those that share that too are neighbours, and each
    band gives other neighbours.  Bands of up to LAGS + 1 members are compared in full; of the others
    ``near_roots`` compares what is not in one class by then.
    """
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "least")
    same = join_counted(nodes.select("fp", "node"), least.filter("n > 1"), "fp", "n", "twins").select(F.col("least").alias("a"), F.col("node").alias("b"))
    balls = linked_fingerprints(least.select("fp"))
    balls = balls.hint("merge").join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").hint("merge").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    placed = earlier_values(members, "key", ["next", "node"], "node", LAGS, "n", "placed")
    banded = placed.select("node", F.explode(F.concat(F.array("leader"), "earlier")).alias("a")).select("a", F.col("node").alias("b"))
    pairs = same.union(balls).union(banded).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted``(first_id, text_key, node, ...) without the first two, and the text of each node."""
    asked = materialize(wanted.withColumnRenamed("first_id", "doc_id"), "wanted")
    kept = [c for c in asked.columns if c not in ("doc_id", "text_key")]
    return docs.join(few_or_merge(asked), ["doc_id", "text_key"]).select(*kept, "text").dropDuplicates(["node"])


def near_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the written ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of SIMILARITY or more."""
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
    wanted = nodes.select("node", "first_id", "text_key").join(few_or_merge(named), "node")
    held = materialize(texts_of(docs, wanted), "held")
    left, right = (held.select(F.col("node").alias(k), F.col("text").alias(f"{k}_text")) for k in "ab")
    counts = pairs.groupBy("a").agg(F.count("*").alias("n_others"))
    led = join_salted(pairs, left.hint("merge").join(counts, "a"), "a", "n_others", "b", "leaders")
    both = led.hint("merge").join(right, "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(_verify, "a long, b long")


def _sets(batches):
    hashes, rolling = WordHashes(), Rolling()
    for batch in sliced(batches):
        found = [shingles(t.translate(LOWER).split(), hashes, rolling).view(np.int64) for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with root, the class of their node: that of the written ``roots(node, root)``, else the node itself."""
    return rows.join(few_or_merge(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))


def mixed(rows: DataFrame, key: str, label: str) -> DataFrame:
    """The written ``rows(key, root)`` whose key has members of several classes, with df, its number of members."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select(key, "df")
    return join_counted(rows, sizes, key, "df", label)


def crowded_prefixes(docs: DataFrame, nodes: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(shingle, node, n, rest): the first shingles of the texts in crowded bands that hold several classes; None if there are none.

    Of two sets of a similarity of four fifths, each lacks at most a fifth of its n shingles in the other.  So in any order of all shingles they share
    one of their first n - ceil(0.8 n) + 1.  Shingles that stand in one class only come first, as no pair that is still sought shares them; then the rarest.
    ``rest`` counts the shingles of the text from this one on: what it can share at most with a text whose first shared shingle it is.
    """
    inside = materialize(with_roots(members.filter(F.col("n") > LAGS + 1).select("key", "node"), roots), "inside")
    crowd = materialize(mixed(inside, "key", "mixed-bands").select("node", "root").distinct(), "crowd")
    if crowd.isEmpty():
        return None
    found = texts_of(docs, nodes.select("node", "first_id", "text_key").join(few_or_merge(crowd.select("node")), "node")).select("node", "text").mapInArrow(_sets, "node long, shingles array<long>")
    sets = materialize(found, "sets")
    each = materialize(sets.join(few_or_merge(crowd), "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    known = mixed(each, "shingle", "mixed-shingles").select("node", "n", "shingle", "df")
    own = Window.partitionBy("node")
    placed = known.withColumn("place", F.row_number().over(own.orderBy("df", "shingle"))).withColumn("held", F.count("*").over(own))
    rest = F.col("held") - F.col("place") + 1
    return materialize(placed.withColumn("rest", rest).filter(5 * rest >= 4 * F.col("n")).select("shingle", "node", "n", "rest"), "prefixes")


def may_be_near(x_root: str, y_root: str) -> str:
    """Condition on x_n, x_rest, y_n, y_rest of two members of a shingle: of different classes, and near copies if all the rest is shared."""
    return f"{x_root} <> {y_root} AND 9 * least(x_rest, y_rest) >= 4 * (x_n + y_n)"


def pairs_with_hubs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) as in ``pairs_between`` of each member of a shingle with the one that can share the most: one for each row.

    In a group of near copies of one text that is the one with the fewest changes, to which all others may link.
    """
    hubs = rows.groupBy("shingle").agg(F.max(F.struct("rest", (-F.col("n")).alias("less"), "node", "root")).alias("hub"), F.count("*").alias("df"))
    hubs = hubs.select("shingle", "df", F.col("hub.node").alias("y"), (-F.col("hub.less")).alias("y_n"), F.col("hub.rest").alias("y_rest"), F.col("hub.root").alias("y_root"))
    named = rows.select("shingle", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("rest").alias("x_rest"), F.col("root").alias("x_root"))
    met = join_counted(named, hubs, "shingle", "df", "hubs").filter(may_be_near("x_root", "y_root"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def pairs_between(rows: DataFrame, tried: int, upto: int) -> DataFrame:
    """Pairs (a, b) of different classes among rows(shingle, node, n, rest, root, df) that share a shingle and whose sizes and rest allow the similarity.

    The first shingle that two texts share bounds what they share, so that a pair that fails at one shingle is not near or meets at an earlier one.

    One of them is from about the ``tried``-th up to about the ``upto``-th of its shingle in the order of a hash, the other not before.  Members meet in
    squares of about PART by PART.
    """
    place = F.pmod(F.xxhash64(F.lit("place"), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("df")
    spread = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    some, every = F.ceil((F.least(F.col("df"), F.lit(upto)) - tried) / F.lit(PART)), F.ceil((F.col("df") - tried) / F.lit(PART))
    rows = rows.filter(F.col("df") > tried).withColumn("at", place).filter(F.col("at") >= tried)
    x = rows.filter(F.col("at") < upto).select("shingle", F.pmod(F.xxhash64("node"), some).alias("i"), spread(every).alias("j"), F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("rest").alias("x_rest"), F.col("root").alias("x_root"))
    y = rows.select("shingle", F.pmod(F.xxhash64("node"), every).alias("j"), spread(some).alias("i"), F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("rest").alias("y_rest"), F.col("root").alias("y_root"))
    met = x.hint("merge").join(y, ["shingle", "i", "j"]).filter(may_be_near("x_root", "y_root"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_roots(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are linked: all pairs of similarity SIMILARITY or more that share a band are in one class.

    Where a crowded band holds several classes after the first links, its texts are compared by shared first shingles, at first with one text of each
    shingle (``pairs_with_hubs``), then in rounds of FACTOR times as many members; a shingle leaves once its members are of one class.
    """
    members = band_members(nodes)
    links = materialize(near_links(docs, nodes, materialize(candidates(nodes, members), "pairs")), "near-links")
    roots = connected_components(links)
    prefixes = crowded_prefixes(docs, nodes, members, roots)
    tried, upto = 0, 0
    while prefixes is not None:
        rooted = materialize(with_roots(prefixes.select("shingle", "node", "n", "rest"), roots), "rooted-prefixes")
        prefixes = materialize(mixed(rooted, "shingle", "mixed-prefixes"), "mixed")
        most = prefixes.agg(F.max("df")).first()[0]
        if most is None or tried >= most:
            break
        pairs = pairs_between(prefixes, tried, upto) if upto else pairs_with_hubs(prefixes)
        more = materialize(near_links(docs, nodes, materialize(pairs, "pairs")), "near-links")
        if not more.isEmpty():
            stars = roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
            roots = connected_components(stars.unionByName(more))
        tried, upto = upto, upto * FACTOR or MORE
    return roots


def near_components(docs: DataFrame) -> DataFrame:
    """Class of near copies of each document row with a doc_id: doc_id, component_id.

    Texts of the same lower-cased words are one class from the start.  Others link
    when their sets of five-word shingles have a Jaccard similarity of 0.8 or more,
    which is verified for each link; component_id is the smallest doc_id reachable.
    Texts without words, null ones included, are one class.
    """
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    sketches = materialize(rows.select("doc_id", "text_key", "text").mapInArrow(_sketches, "doc_id long, text_key long, node long, fp long, bands array<long>"), "sketches")
    nodes = materialize(sketches.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("n_rows"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).select("node", "first.*", "n_rows", "fp", "bands").withColumnRenamed("doc_id", "first_id"), "nodes")
    rooted = materialize(with_roots(nodes.select("node", "first_id", "n_rows"), near_roots(rows, nodes)), "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_nodes"))
    labels = join_counted(rooted, named, "root", "n_nodes", "named").select("node", "component_id", "n_rows")
    return join_counted(sketches.select("doc_id", "node"), labels, "node", "n_rows", "labels").select("doc_id", "component_id")


def keep_first_near(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is the smallest of their class of near copies, all their columns kept.

    Of repeated rows with one doc_id, all stay; rows with a null doc_id stay.
    """
    return without(docs, near_components(docs).filter("doc_id > component_id").select(F.col("doc_id").alias("gone_id")).distinct())
