"""Joins and windows over hot keys give what plain ones give."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import session


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, rng.randrange(4, 60)]), i) for i in range(900)], "k long, v long").repartition(5)


def test_salted_join_is_a_join(uncoalesced):
    left = session.materialize(rows(uncoalesced), "rows")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    got = session.join_salted(left, right, "k", "n", "v", "right", each=20)
    want = left.join(right.drop("n"), "k")
    assert sorted(map(tuple, got.select("k", "v", "total").collect())) == sorted(map(tuple, want.select("k", "v", "total").collect()))


@pytest.mark.parametrize("lags,most", [(1, 10), (3, 10), (3, 10_000)])
def test_earlier_values_cross_the_parts_of_a_hot_key(uncoalesced, lags, most):
    left = session.materialize(rows(uncoalesced), "rows")
    counted = left.join(left.groupBy("k").agg(F.count("*").alias("n")), "k")
    got = session.earlier_values(counted, "k", ["v"], "v", lags, "n", "dealt", most)
    held: dict = {}
    want = {}
    for k, v in sorted(map(tuple, left.collect())):
        want[v] = held.setdefault(k, [])[: -lags - 1 : -1]
        held[k] = [*held[k], v]
    assert {r.v: r.earlier for r in got.collect()} == want
