"""Line dedup by pairwise alignment: shared lines and pairs of lines name partners, each is aligned in full."""

from __future__ import annotations

import heapq
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.line_align import align, longest_increasing  # noqa: F401
from tessera.llm.text import sliced, texts, whole_row
from tessera.session import earlier_values, few_or_merge, join_counted, join_salted, materialize

#: A line in more documents than this, and than this share of all, is frequent: alone it deletes nothing, unless it is long.
RARE_DOCS = 20
RARE_SHARE = 0.002
#: Words of the shortest rare line that deletes alone, and of the shortest frequent one.
RARE_WORDS = 5
LONG_WORDS = 20

#: Further holders of a key that the first round of the rest takes, how many times more the next ones, and how many meet in one task.
MORE, FACTOR, PART = 16, 16, 1000

HALVES = struct.Struct("<qq")
LINES = "doc_id long, text_key long, hashes array<long>, keys array<long>, words array<int>, numbers array<int>, total int"


def line_hashes(text: bytes) -> tuple[list[int], list[tuple[int, int]], list[int]]:
    """(number, the two signed halves of XXH3-128, words) of each line with a word; white space at the ends is set aside."""
    numbers, hashes, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        if line := line.strip():
            numbers.append(i)
            hashes.append(HALVES.unpack(xxhash.xxh3_128_digest(line)))
            words.append(len(line.split()))
    return numbers, hashes, words


def _lines(batches):
    for batch in sliced(batches):
        hashes, keys, words, numbers, totals = [], [], [], [], []
        for text in texts(batch.column(2)):
            n, h, w = line_hashes(text)
            numbers.append(n)
            hashes.append([a for a, _ in h])
            keys.append([b for _, b in h])
            words.append(w)
            totals.append(text.count(b"\n") + 1)
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(words, ints), pa.array(numbers, ints), pa.array(totals, pa.int32())],
            ["doc_id", "text_key", "hashes", "keys", "words", "numbers", "total"],
        )


def deleted_lines(hashes: list[int], keys: list[int], words: list[int], rare: set[int], partner: list[int]) -> list[int]:
    """Places of the lines that go: blocks of a document aligned with consecutive lines of its partner.

    ``rare`` are the keys of the document's rare lines of RARE_WORDS words or more.
    """
    alone = {p for p, k in enumerate(keys) if k in rare or words[p] >= LONG_WORDS or len(hashes) == 1}
    aligned = align(hashes, partner, alone)
    gone: list[int] = []
    block: list[int] = []
    for p in [*sorted(aligned), None]:
        if block and (p is None or p != block[-1] + 1 or aligned[p] != aligned[block[-1]] + 1):
            if len(block) > 1 or block[0] in alone:
                gone.extend(block)
            block = []
        if p is not None:
            block.append(p)
    return gone


def _align(batches):
    for batch in sliced(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in range(3, 8)))
        gone = pa.array([deleted_lines(h, k, w, set(r), p) for h, k, w, r, p in rows], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), gone], ["doc_id", "text_key", "partner", "gone"])


def _masks(batches):
    for batch in sliced(batches):
        keep = []
        for numbers, total, gone in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6))):
            dropped, places = dict.fromkeys(numbers, False), set(gone)
            for p in places:
                dropped[numbers[p]] = True
            mask, last = [True] * total, False
            for i in range(total):
                last = dropped.get(i, last)  # a blank line goes with the line before it
                mask[i] = not last
            keep.append(mask)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(keep, pa.list_(pa.bool_()))], ["doc_id", "text_key", "n_deleted", "partners", "keep"])


def line_keys(lines: DataFrame) -> DataFrame:
    """(doc_id, text_key, key, always, line): each distinct line of a document, pair of adjacent lines, and the whole text.

    ``always`` marks keys that delete if an earlier document has them, ``line`` lines that do so only if they are rare.
    With a column ``kept``, a boolean for each line, only keys of a line that is kept, and no whole text.
    """
    n = F.size("keys")
    some = "kept" in lines.columns

    def single(h, i):
        words = F.get("words", i)
        key = F.struct(h.alias("key"), ((words >= LONG_WORDS) | (n == 1)).alias("always"), (words >= RARE_WORDS).alias("line"))
        return F.when(F.get("kept", i), key) if some else key

    def pair(h, i):
        key = F.struct(F.xxhash64(h, F.get("keys", i + 1)).alias("key"), F.lit(True).alias("always"), F.lit(False).alias("line"))
        return F.when(F.get("kept", i) | F.get("kept", i + 1), key) if some else key

    singles = F.transform("keys", single)
    pairs = F.transform(F.slice("keys", 1, F.greatest(n - 1, F.lit(0))), pair)
    if some:
        left = F.array_distinct(F.array_compact(F.concat(singles, pairs)))
        return lines.select("doc_id", "text_key", F.explode(left).alias("k")).select("doc_id", "text_key", "k.*")
    whole = F.array(F.struct(F.xxhash64(F.lit("whole"), "keys").alias("key"), F.lit(True).alias("always"), F.lit(False).alias("line")))
    keys = F.array_distinct(F.concat(singles, pairs, whole))
    return lines.filter(n > 0).select("doc_id", "text_key", F.explode(keys).alias("k")).select("doc_id", "text_key", "k.*")


def covering(firsts: list[int], earlier: list[int | None]) -> list[int]:
    """Documents that hold all keys, each of which the first or the other holder will do: those of most keys first."""
    held: dict[int, set[int]] = {}
    for i, pair in enumerate(zip(firsts, earlier)):
        for d in set(pair) - {None}:
            held.setdefault(d, set()).add(i)
    heap = [(-len(v), d) for d, v in held.items()]
    heapq.heapify(heap)
    left, chosen = set(range(len(firsts))), []
    while left:
        count, d = heapq.heappop(heap)
        new = held[d] & left
        if len(new) == -count:
            chosen.append(d)
            left -= new
        elif new:
            heapq.heappush(heap, (-len(new), d))
    return sorted(chosen)


def _covered(batches):
    for batch in sliced(batches):
        partners = [covering(f, e) for f, e in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(partners, pa.list_(pa.int64()))], ["doc_id", "text_key", "rare", "partners"])


def shared_keys(lines: DataFrame) -> DataFrame:
    """Keys of each document that others have too: doc_id, text_key, key, always, line, docs (its holders) and first (the least of them)."""
    keys = materialize(line_keys(lines), "keys")
    held = keys.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    return materialize(join_counted(keys, held, "key", "docs", "held"), "shared")


def partners_of(shared: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text_key, rare, partners): the earlier documents to align each document with first, and its rare lines.

    A key that deletes has two holders to choose from: the first one, and the one just
    before the document.  Partners are the holders of most keys, until each key has one.
    """
    rare = F.col("line") & (F.col("docs") <= limit)
    placed = earlier_values(shared, "key", ["doc_id", "text_key"], "doc_id", 1, "docs", "holders")
    named = placed.select("doc_id", "text_key", "key", "first", (rare & ~F.col("always")).alias("rare"), (rare | F.col("always")).alias("deletes"), F.get("earlier", F.lit(0)).alias("previous"))
    named = named.filter("deletes AND first < doc_id")
    earlier = F.when(F.col("previous") < F.col("doc_id"), F.col("previous"))
    choice = named.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(F.col("rare"), F.col("key"))).alias("rare"), F.collect_list(F.struct("first", earlier.alias("earlier"))).alias("holders")
    )
    return choice.select("doc_id", "text_key", "rare", "holders.first", "holders.earlier").mapInArrow(_covered, "doc_id long, text_key long, rare array<long>, partners array<long>")


def _kept(batches):
    for batch in sliced(batches):
        masks = []
        for keys, gone in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            mask = [True] * len(keys)
            for p in gone or ():
                mask[p] = False
            masks.append(mask)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(masks, pa.list_(pa.bool_()))], ["doc_id", "text_key", "keys", "words", "kept"])


def open_keys(work: DataFrame, gone: DataFrame, shared: DataFrame, limit: int, few: bool = False) -> DataFrame:
    """(doc_id, text_key, key, docs): keys that delete and of which a line is left; ``few`` says that they may be few enough to broadcast."""
    mine = ["doc_id", "text_key"]
    masked = work.select(*mine, "keys", "words").hint("merge").join(gone, mine, "left").mapInArrow(_kept, "doc_id long, text_key long, keys array<long>, words array<int>, kept array<boolean>")
    left = line_keys(masked.filter("exists(kept, x -> x)"))
    deletes = shared.filter(F.col("always") | (F.col("line") & (F.col("docs") <= limit))).filter("first < doc_id")
    left = left.select(*mine, "key")
    return deletes.select(*mine, "key", "docs").join(few_or_merge(materialize(left, "left-keys")) if few else left.hint("merge"), [*mine, "key"])


def other_partners(left: DataFrame, holders: DataFrame, tried: int, upto: int) -> DataFrame:
    """(doc_id, text_key, partner): earlier holders(key, partner, docs) of the keys that are left, in the order of a hash: from about the ``tried``-th up to about the ``upto``-th.

    Holders of a key meet its documents in parts of about PART of them; the written ``left`` goes to all holders if it is small.
    """
    parts = F.ceil(F.least(F.col("docs"), F.lit(upto)) / F.lit(PART))
    place = F.pmod(F.xxhash64(F.lit("place"), "partner"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("docs")
    some = holders.filter(place >= tried).filter(place < upto).select("key", "partner", F.pmod(F.xxhash64("partner"), parts).alias("part"))
    if left.count() <= session.FEW:
        met = some.join(F.broadcast(left.filter(F.col("docs") > tried).select("doc_id", "text_key", "key")), "key")
        return met.filter("partner < doc_id").select("doc_id", "text_key", "partner").distinct()
    asked = left.filter(F.col("docs") > tried).select("doc_id", "text_key", "key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return asked.hint("merge").join(some, ["key", "part"]).filter("partner < doc_id").select("doc_id", "text_key", "partner").distinct()


def aligned_deletions(docs: DataFrame, rare_docs: int = RARE_DOCS) -> DataFrame:
    """Per document row: all columns of ``docs``, keep (one boolean for each line, null if all stay), n_deleted, partners.

    A document is aligned in full with the earlier ones that ``partners_of`` names, by
    patience (``line_align``), repeated lines included; where a key that deletes keeps a line, with all
    other earlier holders of it in turn (``other_partners``), until it goes or none is left.  So a line goes
    if alignment with any earlier document deletes it.  Aligned blocks go
    from the later document if they have two lines, a rare line of RARE_WORDS words, a line
    of LONG_WORDS words, or are the whole document; a line is frequent in more than
    ``rare_docs`` documents and RARE_SHARE of all.  So a short frequent line that stands alone stays.
    Lines compare without white space at their ends; blank ones go with the line above.

    A null or empty text loses nothing.  Rows with a null doc_id are left as they are.
    Repeated rows with one doc_id don't delete each other.  Other columns pass through,
    whatever their names; an empty table gives no rows.
    """
    row = whole_row(docs)
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    known = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text_key", "text")
    lines = materialize(known.mapInArrow(_lines, LINES), "lines")
    limit = max(rare_docs, int(RARE_SHARE * lines.count()))
    mine = ["doc_id", "text_key"]
    shared = shared_keys(lines)
    work = materialize(lines.hint("merge").join(partners_of(shared, limit), mine).dropDuplicates(mine), "work")
    theirs = lines.select(F.col("doc_id").alias("partner"), F.col("hashes").alias("partner_hashes"))

    def gone_by(pairs: DataFrame, among: DataFrame) -> DataFrame:
        asked = materialize(among.select(*mine, "hashes", "keys", "words", "rare").join(pairs, mine), "asked")
        counts = asked.groupBy("partner").agg(F.count("*").alias("n_asking"))
        both = join_salted(asked, theirs.hint("merge").join(counts, "partner"), "partner", "n_asking", "doc_id", "partners")
        found = both.select(*mine, "partner", "hashes", "keys", "words", "rare", "partner_hashes").mapInArrow(_align, "doc_id long, text_key long, partner long, gone array<int>")
        return materialize(found.filter("size(gone) > 0"), "gone")

    def merged(each: DataFrame) -> DataFrame:
        return each.groupBy(*mine).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.sort_array(F.collect_set("partner")).alias("partners"))

    each = gone_by(work.select(*mine, F.explode("partners").alias("partner")).hint("merge"), work)
    left = materialize(open_keys(work, merged(each).select(*mine, "gone"), shared, limit), "open-keys")
    if not left.isEmpty():
        # Of documents of the same lines the first stands for all; all that follows holds only what is left.
        originals = lines.groupBy(F.xxhash64("keys"), F.size("keys")).agg(F.min(F.struct(*mine)).alias("first")).select("first.*")
        rest = materialize(shared.join(few_or_merge(left.select("key")), "key", "left_semi"), "rest")
        holders = materialize(rest.hint("merge").join(originals, mine, "left_semi").select("key", F.col("doc_id").alias("partner"), "docs"), "holders")
        few = materialize(work.join(few_or_merge(left.select(*mine)), mine, "left_semi"), "few")
        own = materialize(each.join(few_or_merge(left.select(*mine)), mine, "left_semi"), "own")
        most, tried, upto = left.agg(F.max("docs")).first()[0], 0, MORE
        while most and tried < most:  # each round leaves fewer keys, and takes more of their holders
            pairs = materialize(other_partners(left, holders, tried, upto), "others")
            tried, upto = upto, upto * FACTOR
            if not pairs.isEmpty():
                more = gone_by(few_or_merge(pairs), few)
                each, own = each.unionByName(more), own.unionByName(more)
                left = materialize(open_keys(few, merged(own).select(*mine, "gone"), rest, limit, few=True), "open-keys")
                most = left.agg(F.max("docs")).first()[0]
    gone = merged(each)
    found = materialize(
        work.select(*mine, "numbers", "total").hint("merge").join(gone, mine)
        .select(*mine, F.size("gone").cast("long").alias("n_deleted"), "partners", "numbers", "total", "gone")
        .mapInArrow(_masks, "doc_id long, text_key long, n_deleted long, partners array<long>, keep array<boolean>"),
        "deletions",
    )
    marked = rows.select("row", "doc_id", "text_key").hint("merge").join(found, ["doc_id", "text_key"], "left")
    return marked.select("row", "keep", F.coalesce("n_deleted", F.lit(0).cast("long")).alias("n_deleted"), F.coalesce("partners", F.array().cast("array<long>")).alias("partners"))


def kept_text(text, keep):
    """The text without its deleted lines; null stays null."""
    return F.when(keep.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.get(keep, i)), "\n"))


def dedup_lines(docs: DataFrame, rare_docs: int = RARE_DOCS) -> DataFrame:
    """``docs`` with the deleted blocks cut from text, and n_chars, if there is one, counted anew.

    Documents of which no line is left are gone; documents that had none to begin with stay.
    """
    found = aligned_deletions(docs, rare_docs)
    text = kept_text(F.col("row.text").cast("string"), F.col("keep"))
    out = found.select("row", "n_deleted", text.alias("kept")).filter("n_deleted = 0 OR kept RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[F.coalesce(fresh[c], F.col("row").getField(c)).alias(c) if c == "n_chars" else fresh[c].alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = aligned_deletions(docs)
    text = kept_text(F.col("row.text"), F.col("keep"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size(F.split("row.text", "\n")).cast("long").alias("n_lines"), "n_deleted", "partners", F.sha2(text, 256).alias("kept_sha256"))


QUERIES = {"op2_line_alignment": op2_line_alignment}
ORACLE_SQL: dict[str, str] = {}
