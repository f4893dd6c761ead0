"""Steps whose cost a row was too large for large tables: what they give, and that the costly form is gone."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.functions.embedders import HashedTrigrams, Precomputed
from tessera.functions.text import hashed_vector
from tessera.operators import search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_vectors_are_counted_by_batch(spark):
    texts = ["small blue anvil", "", "a", "ab", None, "abc", "éà\U0001f600x", "aaaa" * 50]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", hashed_vector(F.col("t"), 16).alias("v"))
    assert "array_remove" not in plan(got)
    for i, v in map(tuple, got.collect()):
        want = [0.0] * 16
        for at in range(max(1, len(texts[i]) - 2) if texts[i] is not None else 0):
            want[int(hashlib.md5(texts[i][at : at + 3].encode()).hexdigest()[:8], 16) % 16] += 1
        assert v == want


def test_nearest_scores_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 40)
    monkeypatch.setattr(search, "ASK_BLOCK", 2)
    rng = random.Random(51)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(300)]  # many ties
    rows[50], rows[51], rows[7] = (50, [0.0] * 4), (51, [0.0] * 4), (7, None)
    found = search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert "MapInArrow" in plan(found)
    got = sorted(map(tuple, found.select("query_id", "rn", "vec_id", "cosine").collect()))

    def unit(v):
        n = 0.0
        for x in v:
            n += x * x
        return [x / n**0.5 for x in v] if n else v

    want = []
    for q, v in rows[::50]:
        if any(v):
            each = [(-round(sum(a * b for a, b in zip(unit(w), unit(v))), 9) + 0.0, i) for i, w in rows if w is not None and i != q]
            want += [(q, rn, i, -c) for rn, (c, i) in enumerate(sorted(each)[:5], 1)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]


def test_terms_are_counted_where_documents_are_read(spark):
    rows = [(1, "red red blue a1 of", "s"), (2, "blue green", "s"), (3, "green red", "t"), (3, "green x1", "t"), (4, None, "t"), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.term): round(r.weight, 9) for r in search.tfidf(docs, stop_words=("of",)).collect()}
    once = {(r.doc_id, r.term): round(r.weight, 9) for r in search.tfidf(docs.filter("text <> 'green x1'").replace("green red", "green green red x1"), stop_words=("of",)).collect()}
    assert got.keys() == once.keys() == {(1, "red"), (1, "blue"), (2, "blue"), (2, "green"), (3, "green"), (3, "red")}
    assert abs(sum(w * w for (d, _), w in got.items() if d == 3) - 1) < 1e-6
    assert "Window" not in plan(search.tfidf(docs)) and "Join" not in plan(search.source_weights(docs))


def test_terms_are_not_written_and_only_wanted_documents_are_weighed(spark, monkeypatch):
    from tessera.operators import rules

    rows = [(1, "red red blue x of éà_1", "s"), (2, "blue ÉÀ_1 green", "s"), (3, "green-red\ngreen", "t"), (4, None, "t"), (5, "", None), (6, "red", None), (7, "blue", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    assert "terms" not in plan(search.source_weights(docs)) and "regexp" not in plan(search.source_weights(docs))
    weights = sorted(map(tuple, search.source_weights(docs).collect()), key=str)
    assert {(d, w) for d, _, w, _ in weights} == {(1, "red"), (1, "blue"), (1, "éà_1"), (2, "blue"), (2, "éà_1"), (2, "green"), (3, "green"), (3, "red"), (6, "red"), (7, "blue")}
    some = search.tfidf(docs, among=spark.createDataFrame([(1,), (3,), (3,), (99,)], "doc_id long"))
    assert sorted(map(tuple, some.collect())) == sorted((d, w, x) for d, _, w, x in weights if d in (1, 3))
    monkeypatch.setattr(search, "SOURCES", 1)
    n = {"s": 2, "t": 2, "u": 1}
    want = {}
    for _, source, term, x in weights:
        if source:
            want[source, term] = want.get((source, term), 0) + x / n[source]
    got = {(r.source, r.term): r.mean_weight for r in search.top_terms(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert search.top_terms(docs.limit(0)).count() == 0
    assert "LeftSemi" in plan(rules.QUERIES["agg_mean_tfidf"](spark, "/root/testdata/sf0.001"))


def test_plans_are_parsed_once(spark):
    from tessera.plans import actions

    for name in ("flt_plan_valid", "flt_feature_evidence"):
        assert "array<struct<action:string,type" not in plan(actions.QUERIES[name](spark, "/root/testdata/sf0.001")) and "to_json" not in plan(actions.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_a_search_shuffles_only_the_tokens_asked_for_and_scores_in_batches(spark):
    rows = spark.createDataFrame([("b", 1, "small blue anvil"), ("b", 2, "red bolts"), ("c", 3, None), ("c", 4, "blue")], "block string, id long, label string")
    asked = spark.createDataFrame([(0, "blue bolts"), (1, "zz")], "query_id int, phrase string")
    found = search.semantic_hits(asked, rows, 5)
    assert "MapInArrow" in plan(found) and "zip_with" not in plan(found)
    vectors = {r.id: r.v for r in HashedTrigrams(search.DIMS).embed(rows, F.col("label"), "v").collect()}
    phrases = {r.query_id: r.v for r in HashedTrigrams(search.DIMS).embed(asked, F.col("phrase"), "v").collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    want = {(q, i): round(cosine(v, p), 9) for q, p in phrases.items() for i, v in vectors.items() if v is not None}
    assert {(r.query_id, r.id): r.semantic for r in found.collect()} == want
    assert {r.token for r in search.catalog_tokens(rows, asked.selectExpr("'blue' AS token")).collect()} == {"blue"}
    odd = Precomputed(spark.createDataFrame([("blue", [1.0, None]), ("red bolts", [3.0]), ("small blue anvil", [0.0, 0.0]), ("zz", [1.0, 2.0])], "text string, vector array<double>"))
    assert {(r.query_id, r.id): r.semantic for r in search.semantic_hits(asked, rows, 5, odd).collect()} == {(q, i): 0.0 for q in (0, 1) for i in (1, 2, 4)}
