"""Hard-negative mining: bounds from segment means and deviations sift rows before they are scored exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Positives of an anchor, negatives of a positive, and the share of the positive's score that a negative must reach.
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
#: Vectors become whole numbers: floor(SCALE * x), held within LIMIT so that scores fit a long.
SCALE, LIMIT = 256, 1 << 25
#: Segments of a vector by level: each level splits those before.
LEVELS = (1, 4, 16)
#: Anchors that a task has in memory, those compared with a batch at one time, and rows of such a batch.
BLOCK, TILE, ROWS = 32_768, 512, 4096
NONE = np.iinfo(np.int64).min
PREPARED = "vec_id long, label long, vector array<int>, means array<double>, deviations array<double>"
FOUND = "anchor_id long, slot int, score long, vec_id long"


def edges(dims: int, parts: int) -> np.ndarray:
    """First components of ``parts`` segments of nearly equal size; fewer for short vectors."""
    return np.unique(np.linspace(0, dims, min(parts, max(dims, 1)), endpoint=False).astype(int))


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row, the levels side by side."""
    means, deviations = [], []
    for parts in LEVELS:
        at = edges(vectors.shape[1], parts)
        sizes = np.diff(np.append(at, vectors.shape[1]))
        mean = np.add.reduceat(vectors, at, axis=1) / sizes
        square = np.add.reduceat((vectors - np.repeat(mean, sizes, axis=1)) ** 2, at, axis=1) / sizes
        means.append(mean)
        deviations.append(np.sqrt(square))
    return np.hstack(means), np.hstack(deviations)


def _matrix(column: pa.ListArray, kind: type, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; shorter rows end in zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    if len(flat) == len(sizes) * width and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _summarise(width: int):
    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column(2), np.float64, width)
            if not width or not len(vectors):
                means = deviations = np.zeros((len(vectors), 0))
            else:
                means, deviations = summaries(vectors)
            lists = [pa.array(list(x), pa.list_(kind)) for x, kind in ((vectors.astype(np.int32), pa.int32()), (means, pa.float64()), (deviations, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["vec_id", "label", "vector", "means", "deviations"])

    return run


def prepared(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, vector, means, deviations) of the rows that take part, and the number of components."""
    whole = F.transform("vector", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    fit = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('Infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector").filter(fit).withColumn("vector", whole)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")
    one = materialize(one, "vectors")
    width = one.agg(F.max(F.size("vector"))).first()[0] or 0
    by_label = one.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id")
    return materialize(by_label.mapInArrow(_summarise(width), PREPARED), "summaries"), width


class Block:
    """Anchors with their vectors, summaries and bands: slot j seeks the best scores from low[j] to high[j].

    ``same`` seeks rows of the anchor's label, else those of others.  Unused slots have an empty band.
    """

    def __init__(self, rows: pa.Table, width: int, low: np.ndarray, high: np.ndarray, same: bool, most: int):
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0)
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.vectors = _matrix(column("vector"), np.float64, width)
        self.means, self.deviations = (_matrix(column(c), np.float64) for c in ("means", "deviations"))
        self.low, self.high, self.same, self.most, self.width = low, high, same, most, width


class Search:
    """Best rows of the anchors of a block so far."""

    def __init__(self, block: Block):
        self.block = block
        n, slots = block.low.shape
        self.scores = np.full((n, slots, block.most), NONE)
        self.ids = np.full((n, slots, block.most), NONE)
        self.seen = self.scored = 0
        at, self.levels = 0, []
        for parts in LEVELS:
            sizes = np.diff(np.append(e := edges(block.width, parts), block.width))
            self.levels.append((slice(at, at + len(e)), np.sqrt(sizes)))
            at += len(e)

    def add(self, ids, labels, vectors, means, deviations) -> None:
        """Take in a batch of rows."""
        for at in range(0, len(self.block.ids), TILE):
            self._tile(np.arange(at, min(at + TILE, len(self.block.ids))), ids, labels, vectors, means, deviations)

    def _needed(self, anchors: np.ndarray) -> np.ndarray:
        """Least score that a row needs to come in, by anchor and slot: that of the band, and of the last one held."""
        return np.maximum(self.block.low[anchors], self.scores[anchors, :, -1])

    def _tile(self, anchors, ids, labels, vectors, means, deviations) -> None:
        b, rows = self.block, np.arange(len(ids))
        alike = b.labels[anchors][:, None] == labels
        open_ = alike & (b.ids[anchors][:, None] != ids) if b.same else ~alike
        self.seen += int(open_.sum())
        need, most = self._needed(anchors), b.high[anchors]
        live = need <= most
        open_ &= live.any(axis=1)[:, None]
        floor, ceiling = np.where(live, need, np.iinfo(np.int64).max).min(axis=1).astype(float), np.where(live, most, NONE).max(axis=1).astype(float)
        for level, root in self.levels:
            keep_a, keep_r = open_.any(axis=1), open_.any(axis=0)
            anchors, rows, open_ = anchors[keep_a], rows[keep_r], open_[np.ix_(keep_a, keep_r)]
            floor, ceiling = floor[keep_a], ceiling[keep_a]
            if not open_.size:
                return
            middle = (b.means[anchors, level] * root) @ (means[rows, level] * root).T
            spread = (b.deviations[anchors, level] * root) @ (deviations[rows, level] * root).T
            spread += 1e-9 * (np.abs(middle) + spread) + 1.0  # rounding
            open_ &= (middle + spread >= floor[:, None]) & (middle - spread <= ceiling[:, None])
        keep_a, keep_r = open_.any(axis=1), open_.any(axis=0)
        anchors, rows, open_ = anchors[keep_a], rows[keep_r], open_[np.ix_(keep_a, keep_r)]
        if open_.size:
            self.scored += int(open_.sum())
            self._keep(anchors, ids[rows], open_, exact(b.vectors[anchors], vectors[rows]))

    def _keep(self, anchors, ids, open_, scores) -> None:
        b = self.block
        need, high = self._needed(anchors), b.high[anchors]
        for slot in range(b.low.shape[1]):
            fits = open_ & (scores >= need[:, slot, None]) & (scores <= high[:, slot, None])
            if len(ids) > b.most:  # of more than enough, only those that reach the last place
                last = np.partition(np.where(fits, scores, NONE), len(ids) - b.most, axis=1)[:, len(ids) - b.most]
                fits &= scores >= last[:, None]
            a, r = np.nonzero(fits)
            if not len(a):
                continue
            held = np.unique(a)
            who = np.concatenate([a, np.repeat(held, b.most)])
            value = np.concatenate([scores[a, r], self.scores[anchors[held], slot].ravel()])
            name = np.concatenate([ids[r], self.ids[anchors[held], slot].ravel()])
            order = np.lexsort((name, np.where(value == NONE, np.iinfo(np.int64).max, -value), who))
            who, value, name = who[order], value[order], name[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            first = place < b.most
            self.scores[anchors[who[first]], slot, place[first]] = value[first]
            self.ids[anchors[who[first]], slot, place[first]] = name[first]

    def found(self) -> pa.RecordBatch:
        a, slot, _ = at = np.nonzero(self.scores != NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.block.ids[a]), pa.array(slot.astype(np.int32)), pa.array(self.scores[at]), pa.array(self.ids[at])], ["anchor_id", "slot", "score", "vec_id"])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; by floating point where all sums are exact in it."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _search(block):
    def run(batches):
        search = Search(block.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                vectors = _matrix(rows.column(2), np.float64, search.block.width)
                search.add(rows.column(0).to_numpy(), rows.column(1).to_numpy(), vectors, *(_matrix(rows.column(c), np.float64) for c in (3, 4)))
        yield search.found()

    return run


def best_in_bands(rows: DataFrame, block: Block) -> DataFrame:
    """(anchor_id, slot, score, vec_id): the first ``block.most`` rows for each band of each anchor of a block.

    Each task reads its rows once and holds the best for all anchors of the block; what the tasks found is merged by Spark.
    """
    sent = rows.sparkSession.sparkContext.broadcast(block)
    found = rows.mapInArrow(_search(sent), FOUND)
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= block.most)


def mine_hard_negatives(vectors: DataFrame, every: int = 100, block: int = BLOCK) -> DataFrame:
    """Hard negatives of the rows of ``vectors``(vec_id, label, vector) whose vec_id is divisible by ``every``.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor its POSITIVES
    best other rows of the same label, and for each of them the NEGATIVES best rows of other labels whose score
    is from LOW to HIGH percent of the positive's.  A score is the inner product of the vectors in whole numbers, floor(SCALE * x); higher
    ones come first, ties by smaller vec_id.  Without a row in its band a positive has none.

    A vector's segments have means and deviations; over a segment of n components the product of two vectors is
    n * mean * mean, give or take n * deviation * deviation.  A row is scored exactly only if no level of
    segments, 1, 4, 16, proves it worse than what is held, or outside of all bands.  Nothing is approximate.

    The anchors go to the tasks in blocks of about ``block``, whose size bounds what is broadcast and what a task
    holds; each block is one pass over all rows, by label, for positives and one for negatives.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part.  Rows
    of one vec_id count once, the one with the smallest label, then vector.  Shorter vectors count as followed by zeros;
    components beyond LIMIT / SCALE count as that.  Other columns are ignored; an empty table gives no rows.
    """
    rows, width = prepared(vectors)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    n_blocks = max(1, math.ceil(anchors.count() / block))
    out = []
    for k in range(n_blocks):
        mine = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == k).orderBy("vec_id").toArrow()
        n = mine.num_rows
        free = Block(mine, width, np.full((n, 1), NONE + 1), np.full((n, 1), np.iinfo(np.int64).max), True, POSITIVES)
        positives = materialize(best_in_bands(rows, free).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")), "positives")
        known = positives.toArrow()
        at = np.searchsorted(mine.column("vec_id").to_numpy(), known.column("anchor_id").to_numpy())
        score, slot = known.column("positive_score").to_numpy(), known.column("slot").to_numpy()
        low, high = np.full((n, POSITIVES), 1), np.full((n, POSITIVES), 0)
        high[at, slot] = score
        low[at, slot] = [-(-LOW * s // HIGH) for s in score.tolist()]
        negatives = best_in_bands(rows, Block(mine, width, low, high, False, NEGATIVES)).select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out.append(materialize(negatives.hint("merge").join(positives, ["anchor_id", "slot"]), "negatives"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine_hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", label.alias("label"), F.col("embedding").alias("vector")))


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL = {
    "op13_hard_negatives": """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""",
}
