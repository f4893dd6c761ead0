"""The prefix trie against a walk over all conversations, and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, length long, depth string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def brute(rows, family=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - c % family, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * words(node[-1][1]) if node else 0
    for node in members:
        if not children[node]:
            for d in range(len(node) + 1):
                leaves[node[:d]] += 1
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c in who if built[c] == node)).encode()).hexdigest())
        for node, who in members.items()
    )


def got(found):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in found.collect())


def sample(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", "c", "", None, "long " * 5, "über wort"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, seed):
    rows = sample(seed)
    assert got(prefix_trie.conversation_trie(frame(spark, rows))) == brute(rows)


def test_one_conversation_and_one_sequence_hold_most_rows(spark):
    """A third of all rows in one conversation, a third of all conversations the same."""
    rng = random.Random(5)
    rows = [(7, t, "user", f"turn {t % 50}") for t in range(1500)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 600) for t in range(2)]
    rows += [(c, t, "user", rng.choice("abc")) for c in range(1000, 1400) for t in range(4)]
    dealt = frame(spark, rows).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert prefix_trie.ordered_turns(dealt).filter("conv_id = 7").select("part").distinct().count() > 1
        assert got(prefix_trie.conversation_trie(dealt)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "x")] * 40 + [(1, 0, "user", "y"), (2, None, None, None), (2, None, None, None), (3, 0, "user", "x"), (None, 0, "user", "x"), (21, 5, "a", "b"), (20, 1, "q", "r")]
    assert got(prefix_trie.conversation_trie(frame(spark, rows).repartition(3))) == brute(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    lone = next(c for c in range(1, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "gone")]
    assert got(prefix_trie.conversation_trie(frame(spark, rows))) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_heads_can_be_left_alone(spark):
    rows = sample(9, 40)
    assert got(prefix_trie.conversation_trie(frame(spark, rows), heads=1)) == brute(rows, heads=1)


def test_empty_table(spark):
    empty = frame(spark, [(1, 0, "a", "b")]).limit(0)
    assert prefix_trie.conversation_trie(empty).count() == 0
    nameless = frame(spark, [(1, 0, "a", "b")]).withColumn("conv_id", F.lit(None).cast("long"))
    assert prefix_trie.conversation_trie(nameless).count() == 0
