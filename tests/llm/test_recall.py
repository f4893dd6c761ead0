"""How much of what comparison with everything finds the candidate searches find."""

import random
from collections import defaultdict

import pytest

from tessera.llm import line_dedup, near_copies
from tests.llm.helpers import documents, prose
from tests.llm.test_near_copies import set_of


def linked_pairs(spark, texts):
    """Pairs of texts in one class, and those that brute force links."""
    found = {r.doc_id: r.component_id for r in near_copies.near_components(documents(spark, texts)).collect()}
    sets = [set_of(t) for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return want, sum(found[i] == found[j] for i, j in want), found


def test_near_copies_among_texts_of_one_template(spark):
    """Texts that share half of their shingles fill the same bands; among them are pairs of near copies."""
    rng = random.Random(41)
    words = prose(rng, 160).split(" ")
    texts = []
    for i in range(300):
        own = list(words)
        for at in rng.sample(range(len(own)), 9):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
        if i % 3 == 0:
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    want, found, classes = linked_pairs(spark, texts)
    assert len(want) >= 100 and found >= 0.98 * len(want), (found, len(want))


def missed_lines(rows, got):
    """(found, missed, extra) lines against alignment of each of the (doc_id, text) with all earlier documents that share a line."""
    hashed = {i: line_dedup.line_hashes(t.encode()) for i, t in rows}
    holders = defaultdict(set)
    for i, (_, h, _) in hashed.items():
        for _, key in h:
            holders[key].add(i)
    limit = max(line_dedup.RARE_DOCS, int(line_dedup.RARE_SHARE * len(rows)))
    found = missed = extra = 0
    for i, (numbers, h, words) in hashed.items():
        keys = [b for _, b in h]
        rare = {k for k, w in zip(keys, words) if w >= line_dedup.RARE_WORDS and len(holders[k]) <= limit}
        want = set()
        for j in {j for k in keys for j in holders[k] if j < i}:
            want |= {numbers[p] for p in line_dedup.deleted_lines([a for a, _ in h], keys, words, rare, [a for a, _ in hashed[j][1]])}
        found, missed, extra = found + len(want & got[i]), missed + len(want - got[i]), extra + len(got[i] - want)
    return found, missed, extra


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_lines_that_all_earlier_documents_delete(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text")
    got = {}
    for r in line_dedup.aligned_deletions(docs).selectExpr("row.doc_id AS i", "row.text AS t", "keep").collect():
        lines, gone = r.t.split("\n"), set() if r.keep is None else {p for p, k in enumerate(r.keep) if not k}
        got[r.i] = {p for p in gone if lines[p].strip()}
    found, missed, extra = missed_lines([(r.doc_id, r.text) for r in docs.collect()], got)
    assert extra == 0 and found > 100 and found >= 0.95 * (found + missed), (found, missed, extra)


def test_a_block_that_only_a_middle_holder_aligns_goes(spark):
    """First and latest holder have the block before other shared lines that stand after it here; one between has it alone."""
    rng = random.Random(43)
    block, long = [prose(rng, 3), prose(rng, 3)], [prose(rng, 9) for _ in range(6)]
    own = [prose(rng, 30) for _ in range(40)]
    crossed = lambda i: "\n".join([own[i], *block, own[i + 20], *long])
    texts = [crossed(0), *("\n".join([own[i], *block]) for i in range(1, 5)), crossed(5), "\n".join([*long, own[10], *block, own[11]])]
    got = {}
    for row in line_dedup.aligned_deletions(documents(spark, texts)).selectExpr("row.doc_id AS i", "keep").collect():
        got[row.i] = set() if row.keep is None else {p for p, k in enumerate(row.keep) if not k}
    found, missed, extra = missed_lines(list(enumerate(texts)), got)
    assert missed == extra == 0 and found and got[6] == {0, 1, 2, 3, 4, 5, 7, 8}, (found, missed, extra, got)
