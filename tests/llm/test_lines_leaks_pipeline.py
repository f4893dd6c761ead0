import random

import numpy as np

import corpus_pipeline
from tessera.llm import decontaminate, line_dedup
from tessera.llm.registry import queries

from .helpers import CLASH, documents, prose


def test_longest_increasing_is_longest():
    rng = random.Random(3)
    for _ in range(50):
        xs = [rng.randrange(30) for _ in range(rng.randrange(12))]
        got = line_dedup.longest_increasing(xs)
        assert all(xs[a] < xs[b] for a, b in zip(got, got[1:]))
        best = [1] * len(xs)
        for i in range(len(xs)):
            best[i] = 1 + max((best[j] for j in range(i) if xs[j] < xs[i]), default=0)
        assert len(got) == max(best, default=0)


def test_aligned_blocks_go_from_the_later_document(spark):
    rng = random.Random(5)
    a = [prose(rng, 8) for _ in range(6)]
    own = prose(rng, 9)
    docs = documents(spark, [(1, "\n".join(a)), (2, "\n".join([own, *a[2:5], "", "tail of its own here"])), (3, "\n".join(a)), (4, None), (5, ""), (None, "\n".join(a))], CLASH)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {1: "\n".join(a), 2: own + "\n" + "tail of its own here", 4: None, 5: "", None: "\n".join(a)}
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_a_short_frequent_line_alone_stays_and_long_passages_go(spark):
    rng = random.Random(6)
    notice, passage = "all rights are kept here", prose(rng, 60)
    docs = documents(spark, [(i, "\n".join([prose(rng, 12), notice, prose(rng, 12), passage])) for i in range(40)])
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert all(notice in t for t in out.values())
    assert [i for i, t in sorted(out.items()) if passage in t] == [0]


def test_frequent_lines_between_anchors_are_aligned(spark):
    rng = random.Random(8)
    common = "the same short line again"
    a = [prose(rng, 8), common, prose(rng, 8)]
    docs = documents(spark, [(0, common + "\n" + prose(rng, 8)), (1, "\n".join(a)), (2, "\n".join([prose(rng, 7), *a]))])
    out = {r.doc_id: r for r in line_dedup.aligned_deletions(docs).selectExpr("row.doc_id", "n_deleted", "partners").collect()}
    assert out[2].n_deleted == 3


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(documents(spark, []).limit(0)).count() == 0


def brute_local(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_scores_match_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
        assert decontaminate.align(a, b)[0] == brute_local(a.tolist(), b.tolist())


def test_copies_edits_and_clean_documents(spark):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (15, 30, 55)]
    bench = spark.createDataFrame([(10, items[0], "q"), (11, items[1], "q"), (12, items[2], "q"), (13, None, "q"), (None, items[0], "q"), (14, "two words", "q"), (12, items[2], "q")], "item_id long, text string, doc_id string")
    edited = items[2].split(" ")
    edited[10], edited[25], edited[40] = "changed", "other", "new"
    del edited[33]
    docs = documents(
        spark,
        [prose(rng, 80), prose(rng, 40) + " " + items[0].upper() + ". " + prose(rng, 50), prose(rng, 20) + "\n" + " ".join(edited) + " " + prose(rng, 9), items[1], " ".join(items[2].split(" ")[:12]) + " " + prose(rng, 50), None, "", (None, items[0])],
        CLASH,
    )
    found = {(r.doc_id, r.item_id): r.score / r.item_words for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(found) == {(1, 10), (2, 12), (3, 11)}
    assert found[1, 10] == found[3, 11] == 1 and 0.8 < found[2, 12] < 1
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id is None or r.doc_id for r in kept.collect()) == [0, True, 4, 5, 6] or {r.doc_id for r in kept.collect()} == {0, 4, 5, 6, None}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_an_edit_at_every_fourth_word_is_still_a_leak(spark):
    rng = random.Random(13)
    item = prose(rng, 40)
    edited = " ".join("edit%d" % i if i % 4 == 3 else w for i, w in enumerate(item.split(" ")))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.find_leaks(documents(spark, [prose(rng, 30) + " " + edited, prose(rng, 90)]), bench).collect()
    assert [(r.doc_id, r.score >= 19) for r in found] == [(0, True)]


def bench_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def leaks(spark, docs, items):
    return {(r.doc_id, r.item_id): (r.score, r.item_words) for r in decontaminate.find_leaks(documents(spark, docs), bench_of(spark, items)).collect()}


def test_many_copies_of_one_passage_are_all_found(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(decontaminate, "RARE_DOCS", 5)  # every seed of the passages is frequent
    item, four = prose(rng, 30), "four words only here"
    edited = item.split(" ")
    edited[9], edited[20] = "changed", "other"
    docs = [prose(rng, 10) + " " + (item, " ".join(edited), four)[i % 3] + " " + prose(rng, 10) for i in range(30)]
    assert set(leaks(spark, docs, [item, four])) == {(i, int(i % 3 == 2)) for i in range(30)}


def test_an_opening_of_many_items_names_none_of_them(spark, monkeypatch):
    rng = random.Random(14)
    monkeypatch.setattr(decontaminate, "RARE_ITEMS", 10)
    opening = prose(rng, 12)
    items = [f"{opening} {prose(rng, 8)}" for _ in range(30)] + [opening]
    docs = [prose(rng, 20) + " " + opening + " " + prose(rng, 20) for _ in range(20)] + [prose(rng, 9) + " " + items[4] + " " + prose(rng, 9)]
    found = leaks(spark, docs, items)
    sure = {(i, 30) for i in range(21)} | {(20, 4)}  # the opening as an item of its own is looked up as a whole
    assert sure <= set(found) and len(found) < len(sure) + 20  # of 600 pairs; a few tails begin with the document's next word
    assert found[20, 4] == (20, 20)


def test_items_of_one_to_three_words(spark, monkeypatch):
    rng = random.Random(18)
    monkeypatch.setattr(decontaminate, "RARE_DOCS", 5)
    items = ["zyzzyva", "quokka ramble", "vexil lorry umbra", "common words", "the"]
    docs = [prose(rng, 20) + f" {x} " + prose(rng, 20) for x in ("Zyzzyva!", "quokka ramble", "quokka far ramble", "vexil, lorry umbra", "vexil lorry", *["common words"] * 9, *["the"] * 9)]
    assert set(leaks(spark, docs, items)) == {(0, 0), (1, 1), (3, 2)}  # whole, and where few documents have them


def test_an_edited_copy_of_an_item_of_common_seeds(spark, monkeypatch):
    """Items that are cut from one text share all of their seeds with many others."""
    rng = random.Random(20)
    monkeypatch.setattr(decontaminate, "RARE_ITEMS", 3)
    words = prose(rng, 40).split(" ")
    items = [" ".join(words[i : i + 30]) for i in range(10)]
    edited = words[3:33]
    edited[20] = "edited"
    found = leaks(spark, [prose(rng, 30) + " " + " ".join(edited) + " " + prose(rng, 30), prose(rng, 60)], items)
    assert (0, 3) in found and found[0, 3] == (28, 30) and all(d == 0 for d, _ in found)


def test_the_threshold_is_of_the_whole_item(spark):
    rng = random.Random(15)
    words = prose(rng, 1200).split(" ")
    found = leaks(spark, [prose(rng, 30) + " " + " ".join(words[400:570]), " ".join(words[300:900]), " ".join(words)], [" ".join(words)])
    assert set(found) == {(1, 0), (2, 0)} and found[1, 0][1] == 1200 and found[2, 0] == (1200, 1200)


def test_leaks_match_brute_force(spark):
    rng = random.Random(16)
    items = [prose(rng, rng.randrange(4, 30)) for _ in range(12)] + [None, "a b", ""]
    docs = []
    for _ in range(40):
        words = rng.choice(items[:12]).split(" ")
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice(([], ["edit"], [words[at], "more"]))
        docs.append(" ".join([prose(rng, rng.randrange(5, 30)), *words[: rng.randrange(1, 40)], prose(rng, rng.randrange(5, 30))]))
    want, plain = {}, decontaminate.plain_words
    for i, text in enumerate(docs):
        for k, item in enumerate(items[:12]):
            score = brute_local(plain(item), plain(text))
            if score >= 0.4 * len(plain(item)):
                want[i, k] = score
    found = leaks(spark, docs, items)
    assert all(want[p] == score for p, (score, _) in found.items())
    missed = set(want) - set(found)
    assert len(missed) <= 0.1 * len(want), missed  # pairs without three words of four or five in common places
    assert all(want[p] < 0.7 * len(plain(items[p[1]])) for p in missed)


def test_leaks_under_clashing_columns(spark):
    rng = random.Random(17)
    item = prose(rng, 20)
    docs = documents(spark, [item, prose(rng, 30)], ("_leak_id", "leak_id", "leak_key", "own_id", "own_key", "row", "_gone", "gone_id"))
    kept = decontaminate.drop_leaks(docs, bench_of(spark, [item]))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_pipeline_stages_keep_the_schema_and_whole_texts(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "piece_encoding"]
    assert queries()["pipeline"] is corpus_pipeline.run
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == n and all(r.lossless for r in out)
