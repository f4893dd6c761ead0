import random
import re

import corpus_pipeline
from tessera import session
from tessera.llm import near_copies, simhash

from .helpers import CLASH, documents, prose, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def set_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(texts):
    sets = [set_of(t) for t in texts]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return sorted(i for i, r in enumerate(root) if i == r)


def edited(rng, text, n):
    words = text.split(" ")
    for at in rng.sample(range(0, len(words), 12), n):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def near_texts():
    rng = random.Random(21)
    base = [prose(rng, rng.randrange(130, 260)) for _ in range(20)]
    return [*sample_texts(), *base, *(edited(rng, t, n) for t in base for n in (1, 2, 3)), *(t.upper() for t in base[:3]), *(edited(rng, t, 9) for t in base)]


def test_stage_drops_what_brute_force_drops(spark):
    texts = near_texts()
    docs = documents(spark, texts, CLASH)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    expected = brute_kept(texts)
    assert sorted(r.doc_id for r in kept.collect()) == expected
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) != expected  # two bits of 64 miss edited copies


def test_small_sides_are_broadcast_and_large_ones_merged_alike(spark, monkeypatch):
    texts = near_texts()
    seen, choose = [], near_copies.few_or_merge
    monkeypatch.setattr(near_copies, "few_or_merge", lambda few: seen.append(few.count()) or choose(few))
    few = sorted(r.doc_id for r in near_copies.keep_first_near(documents(spark, texts)).collect())
    assert seen and max(seen) <= session.FEW
    monkeypatch.setattr(session, "FEW", 0)
    assert sorted(r.doc_id for r in near_copies.keep_first_near(documents(spark, texts)).collect()) == few == brute_kept(texts)


def test_stage_keeps_null_ids_and_repeats(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "something else entirely now")]
    kept = near_copies.keep_first_near(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 3), (False, 9), (True, 0)]
    assert near_copies.keep_first_near(documents(spark, []).limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(22)
    base = prose(rng, 200)
    docs = documents(spark, [base, *(edited(rng, base, 2) for _ in range(80))])
    assert [r.doc_id for r in near_copies.keep_first_near(docs).collect()] == [0]


def template_texts(n=240):
    """Texts with three quarters of their words in common; each has one near copy among the others."""
    rng = random.Random(71)
    template, out = prose(rng, 240), []
    for _ in range(n // 2):
        text = f"{template} {' '.join(f'own{rng.randrange(10**9)}' for _ in range(90))}"
        words = text.split(" ")
        out.append(text)
        words[250 + rng.randrange(80)] = f"edit{rng.randrange(10**6)}"
        for at in rng.sample(range(4, 240, 12), 2):
            words[at] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words))
    rng.shuffle(out)
    return out


def test_all_members_of_a_crowded_band_are_compared(spark, monkeypatch):
    texts = template_texts()
    sets = [set_of(t) for t in texts]
    expected = [j for j, b in enumerate(sets) if not any(len(a & b) >= 0.8 * len(a | b) for a in sets[:j])]
    assert len(expected) == len(texts) // 2
    assert sorted(r.doc_id for r in near_copies.keep_first_near(documents(spark, texts)).collect()) == expected
    # Unrelated pairs of copies that share nothing but one band, so that the first links join none of them; rounds and squares of few members.
    monkeypatch.setattr(near_copies, "MORE", 1)
    monkeypatch.setattr(near_copies, "FACTOR", 2)
    monkeypatch.setattr(near_copies, "PART", 3)
    rng = random.Random(72)
    base = [prose(rng, 120) for _ in range(15)]
    docs = documents(spark, [*base, *(edited(rng, t, 1) for t in base)])
    rows = docs.selectExpr("doc_id", "xxhash64(text) AS text_key", "text")
    nodes = rows.selectExpr("doc_id AS node", "doc_id AS first_id", "text_key", "xxhash64(doc_id) AS fp", "array(7L) AS bands")
    found = {r.node: r.root for r in near_copies.near_roots(rows, nodes).collect()}
    assert found == {i: i % 15 for i in range(30)}


def test_a_shared_shingle_names_no_pair_that_lacks_too_much(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i, 100, 100 if i == 7 else 85, i, 90) for i in range(90)], "shingle long, node long, n int, rest int, root long, df long")
    assert near_copies.pairs_between(rows, 0, 256).count() == 0
    hubs = spark.createDataFrame([(1, i, 100, 100 if i == 7 else 89 - i % 2, i) for i in range(90)], "shingle long, node long, n int, rest int, root long")
    assert sorted(map(tuple, near_copies.pairs_with_hubs(hubs).collect())) == sorted((min(i, 7), max(i, 7)) for i in range(0, 90, 2))
    # Copies of one text, many of them too far from it: as brute force, and pairs in proportion to the texts.
    rng = random.Random(73)
    base = prose(rng, 200)
    texts = [edited(rng, base, n) for n in (2, 3, 4, 5, 6, 7) for _ in range(25)]
    compared, links = [], near_copies.near_links
    monkeypatch.setattr(near_copies, "near_links", lambda docs, nodes, pairs: compared.append(pairs.count()) or links(docs, nodes, pairs))
    kept = [r.doc_id for r in near_copies.keep_first_near(documents(spark, texts)).collect()]
    sets, root = [set_of(x) for x in texts], list(range(len(texts)))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert sorted(kept) == sorted({*root})
    assert 0 < sum(compared[1:]) < 5 * len(texts)
