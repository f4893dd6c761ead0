"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import BASE, WordHashes, mixed, sliced, whole_row
from tessera.session import materialize

#: Places of a seed's words: four in a row, and four of five, which outlive an edit at every fourth word.
PATTERNS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4))
SEED_WORDS = 4
#: A shorter item is one seed by itself.
SHORT = {n: tuple(range(n)) for n in range(1, SEED_WORDS)}
#: Seeds that name an item of which each stands in very many: so many, the rarest.
NAMING = 3
#: Seed hits on diagonals this close are one passage; words added around a passage.
BAND = 12
MARGIN = 8
#: A seed is rare if at most this many documents, or this share of them, have it.
RARE_DOCS = 50
RARE_SHARE = 0.001
#: A seed names items if at most this many items, or this share of them, have it.
RARE_ITEMS = 50
ITEM_SHARE = 0.001
#: Least alignment score as a share of the item's words (match 1, mismatch and gap -1).
THRESHOLD = 0.4
#: About this many words of items are sent to the executors at a time; a longer item goes alone.
BLOCK_WORDS = 400_000

#: ASCII characters that are no letters or digits part words; other characters are kept.
PARTS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(PARTS).split()


def seeds_of(words: np.ndarray, patterns: tuple[tuple[int, ...], ...] = PATTERNS) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of each pattern at each place of a sequence of word hashes."""
    seeds, places = [], []
    for pattern in patterns:
        n = len(words) - pattern[-1]
        if n > 0:
            total = np.full(n, sum(1 << i for i in pattern), np.uint64)
            for at in pattern:
                total = total * np.uint64(BASE) + words[at : at + n]
            seeds.append(mixed(total))
            places.append(np.arange(n))
    return (np.concatenate(seeds), np.concatenate(places)) if seeds else (np.empty(0, np.uint64), np.empty(0, np.int64))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(score, end) of the best local alignment: match 1, mismatch -1, gap -1; end is a place in the passage."""
    n = len(passage)
    steps = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, 1, -1))
        row = np.maximum.accumulate(new + steps) - steps  # a gap along the passage costs its length
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


class Items:
    """Word hashes of a block of distinct test items, and the seeds that name few of them."""

    def __init__(self, words: list[np.ndarray], most_items: float) -> None:
        self.words = words
        #: What is sought in texts: the patterns, and the lengths of shorter items that there are.
        self.patterns = (*PATTERNS, *(SHORT[n] for n in sorted({len(w) for w in words} & set(SHORT))))
        found = [seeds_of(w, (SHORT[len(w)],) if len(w) in SHORT else PATTERNS) for w in words]
        item = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
        place = np.concatenate([p for _, p in found]) if found else np.empty(0, np.int64)
        seeds = np.concatenate([g for g, _ in found]) if found else np.empty(0, np.uint64)
        order = np.lexsort((item, seeds))
        seeds, item, place = seeds[order], item[order], place[order]
        self.all_seeds, group = np.unique(seeds, return_inverse=True)
        first = np.ones(len(seeds), bool)
        first[1:] = (seeds[1:] != seeds[:-1]) | (item[1:] != item[:-1])
        held = np.bincount(group, first, minlength=len(self.all_seeds))[group]
        by_item = np.lexsort((place, held, item))
        rank = np.empty(len(item), np.int64)
        rank[by_item] = np.arange(len(item)) - np.searchsorted(item[by_item], item[by_item])
        few = held <= most_items
        named = np.zeros(len(words), bool)
        named[item[few]] = True
        naming = few | ~named[item] & (rank < NAMING)
        self.seeds, self.item, self.place = seeds[naming], item[naming], place[naming]
        sizes = np.array([len(w) for w in words], np.int64)
        # How far an item reaches before and after a place with the seed, at most.
        self.before, self.after = np.zeros(len(self.all_seeds), np.int64), np.zeros(len(self.all_seeds), np.int64)
        np.maximum.at(self.before, group, place)
        np.maximum.at(self.after, group, sizes[item] - place)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, number of the seed, seed) of each seed of an item found in a text."""
        grams, places = seeds_of(words, self.patterns)
        if not len(self.all_seeds) or not len(grams):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(self.all_seeds, grams), len(self.all_seeds) - 1)
        good = self.all_seeds[at] == grams
        return places[good], at[good], grams[good]


HITS = "doc_id long, text_key long, places array<int>, seeds array<long>, start int, words array<long>"
LEAKS = "doc_id long, text_key long, item int, score int, last_word int"


def _found(items: list[np.ndarray], most_items: float):
    """The seed hits of each text that has one, and its words as far as an item may reach."""

    def run(batches):
        block, hashes = Items(items, most_items), WordHashes()
        for batch in sliced(batches):
            rows: dict[str, list] = {k: [] for k in ("at", "places", "seeds", "start", "words")}
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = hashes.of(plain_words(text))
                places, numbers, seeds = block.hits(words)
                if not len(places):
                    continue
                lo = max(0, int((places - block.before[numbers]).min()) - MARGIN)
                hi = min(len(words), int((places + block.after[numbers]).max()) + MARGIN)
                rows["at"].append(i)
                rows["places"].append(places - lo)
                rows["seeds"].append(seeds.view(np.int64))
                rows["start"].append(lo)
                rows["words"].append(words[lo:hi].view(np.int64))
            at = pa.array(rows["at"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(rows["places"], pa.list_(pa.int32())), pa.array(rows["seeds"], pa.list_(pa.int64())), pa.array(rows["start"], pa.int32()), pa.array(rows["words"], pa.list_(pa.int64()))],
                ["doc_id", "text_key", "places", "seeds", "start", "words"],
            )

    return run


def passages(items: Items, places: np.ndarray, seeds: np.ndarray, frequent: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(item, least diagonal, largest diagonal) of the groups of hits on near diagonals that are worth an alignment.

    One hit of a rare seed is enough; hits of frequent seeds must cover ``threshold`` of the item's words.
    An item of fewer than SEED_WORDS words needs a rare seed: a frequent word or phrase is no copy of it.
    """
    lo, hi = np.searchsorted(items.seeds, seeds, "left"), np.searchsorted(items.seeds, seeds, "right")
    count = hi - lo
    hit = np.repeat(np.arange(len(seeds)), count)
    entry = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    item, inside = items.item[entry], items.place[entry]
    diagonal, rare = places[hit] - inside, ~np.isin(seeds, frequent)[hit]
    order = np.lexsort((diagonal, item))
    item, inside, diagonal, rare = item[order], inside[order], diagonal[order], rare[order]
    edges = np.flatnonzero((np.diff(item) != 0) | (np.diff(diagonal) > BAND)) + 1
    out = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(item)]):
        if a == b:
            continue
        size = len(items.words[item[a]])
        if not rare[a:b].any():
            if size < SEED_WORDS:
                continue
            held = np.zeros(size, bool)
            for k in range(SEED_WORDS):
                held[np.minimum(inside[a:b] + k, size - 1)] = True
            if held.sum() < threshold * size:
                continue
        out.append((int(item[a]), int(diagonal[a]), int(diagonal[b - 1])))
    return out


def _scored(items: list[np.ndarray], most_items: float, frequent: np.ndarray, threshold: float):
    """Leaks among the hits of each text."""

    def run(batches):
        block = Items(items, most_items)
        for batch in sliced(batches):
            rows: dict[str, list] = {k: [] for k in ("at", "item", "score", "last")}
            starts = batch.column(4).to_pylist()
            for i in range(batch.num_rows):
                places, seeds, words = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3, 5))
                words = words.view(np.uint64)
                found = []
                for k, least, most in passages(block, places.astype(np.int64), seeds.view(np.uint64), frequent, threshold):
                    lo, hi = max(0, least - MARGIN), min(len(words), most + len(items[k]) + MARGIN)
                    score, end = align(items[k], words[lo:hi])
                    if score >= (threshold * len(items[k]) if len(items[k]) >= SEED_WORDS else len(items[k])):
                        found.append((k, score, lo + end))
                for k, score, end in found:
                    rows["at"].append(i)
                    rows["item"].append(k)
                    rows["score"].append(score)
                    rows["last"].append(starts[i] + end)
            at = pa.array(rows["at"], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(rows[c], pa.int32()) for c in ("item", "score", "last"))], ["doc_id", "text_key", "item", "score", "last_word"])

    return run


def _item_words(batches):
    hashes = WordHashes()
    for batch in sliced(batches):
        words = [hashes.of(plain_words(t)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold a copy of a test item: doc_id, text_key, item_id, score, item_words, last_word.

    Word n-grams, with and without a gap, that a document shares with an item seed
    passages.  Of seeds in more than RARE_ITEMS items and ITEM_SHARE of all an item keeps
    the NAMING rarest.  A passage with a seed that is rare among the
    documents too, or whose seeds cover ``threshold`` of the item's words, is aligned with the
    whole item by Smith-Waterman.  A pair is a leak if the score reaches ``threshold`` of the item's
    words, so edited and paraphrased copies count.  An item of fewer than SEED_WORDS words leaks where all
    of its words stand in a row and do so in few documents.  The best passage of each pair is
    returned.  last_word is the place after the passage's last aligned word.

    Items of equal words are one, under their smallest item_id.  They are sent to the executors in blocks of about BLOCK_WORDS words, a proven bound; a
    larger benchmark takes more passes over the documents.  Words are lower-cased runs
    of letters and digits.  Null and empty texts, items without
    words and rows with a null doc_id or item_id find nothing; repeated documents or
    items give a pair once.  Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    words = materialize(items.mapInArrow(_item_words, "item_id long, words array<long>").filter(F.size("words") > 0).withColumn("content", F.sha2(F.to_json("words"), 256)), "items")
    sized = materialize(words.groupBy("content").agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"), F.size(F.first("words")).alias("n")), "contents")
    sums = sized.agg(F.count("*").alias("items"), F.sum("n").alias("words")).first()
    blocks = -(-(sums["words"] or 0) // BLOCK_WORDS)
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("content"), F.lit(max(1, blocks))))
    most_docs = max(float(RARE_DOCS), RARE_SHARE * rows.count()) if blocks else 0.0
    most_items = max(float(RARE_ITEMS), ITEM_SHARE * sums["items"])
    leaks = None
    for block in range(blocks):
        mine = dealt.filter(F.col("block") == block).orderBy("content").select("item_id", "words").collect()  # about BLOCK_WORDS words
        if not mine:
            continue
        block_words = [np.array(r["words"], np.int64).view(np.uint64) for r in mine]
        hits = materialize(rows.mapInArrow(_found(block_words, most_items), HITS), "hits")
        counts = hits.select(F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").count().filter(F.col("count") > most_docs)
        frequent = np.array([r["seed"] for r in counts.select("seed").collect()], np.int64).view(np.uint64)  # seeds of this block
        found = hits.mapInArrow(_scored(block_words, most_items, frequent, threshold), LEAKS)
        names = spark.createDataFrame([(i, r["item_id"], len(r["words"])) for i, r in enumerate(mine)], "item int, item_id long, item_words int")
        named = materialize(found, "scored").join(F.broadcast(names), "item").drop("item")  # three numbers for each item of this block
        leaks = named if leaks is None else leaks.unionByName(named)
    if leaks is None:
        return spark.createDataFrame([], "doc_id long, text_key long, item_id long, score int, item_words int, last_word int")
    best = leaks.groupBy("doc_id", "text_key", "item_id", "item_words").agg(F.max(F.struct("score", "last_word")).alias("best"))
    return best.select("doc_id", "text_key", "item_id", "best.score", "item_words", "best.last_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that leak a test item; all their columns stay, null ids too."""
    found = find_leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_key"))
    return rows.hint("merge").join(found, (F.col("own_id") == F.col("leak_id")) & (F.col("own_key") == F.col("leak_key")), "left_anti").select("row.*")


def op9_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "score", "item_words", (F.col("score") / F.col("item_words")).alias("similarity"), "last_word")


QUERIES = {"op9_seed_alignment": op9_seed_alignment}
ORACLE_SQL: dict[str, str] = {}
