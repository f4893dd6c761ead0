import hashlib
import re

import pytest
import xxhash

from tessera.llm import simhash, substring
from tessera.functions import graph
from tessera.functions.graph import connected_components

from .helpers import CLASH, documents, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_match_brute_force(spark):
    texts = sample_texts()
    docs = documents(spark, [*texts, texts[2] + " end"], CLASH)
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect()}
    prints = {i: print_of(t) for i, t in enumerate([*texts, texts[2] + " end"])}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert found == {i: (prints[i], root[i]) for i in prints}


def test_keep_first_keeps_columns_null_ids_and_repeats(spark):
    docs = documents(spark, [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "something else entirely now")], ("fp",))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 3), (False, 9), (True, 0)]


def test_empty_tables(spark):
    empty = documents(spark, []).limit(0)
    assert simhash.simhash_components(empty).count() == 0
    assert substring.remove_repeated_windows(empty).count() == 0


def test_chain_of_links_is_one_component(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    roots = {r.root for r in connected_components(links).collect()}
    assert roots == {0}


def test_stars_are_told_without_a_further_round(spark, monkeypatch):
    """A round costs the driver several jobs: links that are stars take none, others none beyond the round that made them stars."""
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(label) or write(df, label))
    stars = spark.range(300).selectExpr("id - id % 10 AS a", "id AS b")
    assert {(r.node, r.root) for r in connected_components(stars).collect()} == {(i, i - i % 10) for i in range(300)}
    assert written == ["links", "least"]
    written.clear()
    pairs = [(5, 9), (9, 7), (7, 5), (9, 20), (30, 31), (31, 32), (40, 40), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {5: 5, 7: 5, 9: 5, 20: 5, 30: 30, 31: 30, 32: 30}
    assert written.count("least") <= 3


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.linked_fingerprints(spark.createDataFrame([(1,)], "fp long"), 3)


@pytest.mark.parametrize("window", [5, 50])
def test_windows_match_brute_force(spark, window):
    texts = sample_texts(2)
    found = {r.doc_id: r for r in substring.remove_repeated_windows(documents(spark, texts, CLASH), window).collect()}
    words = {i: WORD.findall(t or "") for i, t in enumerate(texts)}
    first = {}
    for i in sorted(words, reverse=True):
        for s in range(len(words[i]) - window + 1):
            first[tuple(words[i][s : s + window])] = i
    for i, w in words.items():
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for p in range(s, s + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        r = found[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), kept)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert sorted(p for s in r.spans for p in range(s.first, s.last + 1)) == sorted(gone)


def test_rows_without_id_and_repeated_rows_lose_nothing(spark):
    text = sample_texts()[0]
    rows = substring.remove_repeated_windows(documents(spark, [(None, text), (4, text), (4, text)])).collect()
    assert [r.n_removed for r in rows] == [0, 0, 0]
