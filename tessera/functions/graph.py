"""Connected components of a linked graph by iterated minimum labels in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import join_counted, materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links(a, b)``; root is the smallest node reachable.

    Alternates large-star and small-star steps: each round keeps one link of a node to
    a smaller one, so no star is expanded into pairs, and the links of a node with very
    many are never brought together in one task.  Each step is written to the
    shared checkpoint folder.  Self links, nulls and repeated links are ignored; an
    empty graph gives no rows.  Raises if ``max_rounds`` rounds don't settle.
    """
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        if least.filter("m < u AND n > 1").isEmpty():  # all that have a smaller neighbour have only that one: stars, and m is the root
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = materialize(join_counted(both.filter("v > u"), least, "u", "n", None).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        if low.filter("n > 1").isEmpty():  # one smaller neighbour each: the small star changes nothing
            edges = large
            continue
        small = (
            join_counted(large, low, "u", "n", None)
            .select(F.expr("inline(array(struct(v AS u, m AS v), struct(u AS u, m AS v)))"))
            .filter("u <> v")
            .distinct()
        )
        edges = materialize(small, "star")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
