"""Small inputs with nulls, repeats, empty and long texts and clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and thin ster ouble tion wher hand reed onal ight amber crow delta ember frost glide haven inlet".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", str(rng.randrange(99))]) for _ in range(n))


def documents(spark, texts, extra=()):
    """Rows of documents from texts (or (id, text) pairs), with further columns whose names clash with internal ones."""
    rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
    schema = DOC + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), *("x" for _ in extra)) for i, t in rows], schema)


CLASH = ("text_key", "hash", "row", "bucket", "node", "kept", "digest", "shard", "anchors", "rule", "gone_id", "own_id", "leak_id", "leak_key", "own_key", "fetched_at")


def sample_texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(12)]
    lines = ["\n".join(prose(rng, rng.randrange(6, 30)) for _ in range(8)) for _ in range(6)]
    near = base[0].split(" ")
    near[30] = "edited"
    return [*base, *lines, base[0], base[0], " ".join(near), "\n".join([*lines[0].split("\n")[:4], prose(rng, 12), *lines[1].split("\n")[3:]]), "", None, " \n\t ", "one two", base[3] + "\n" + base[4], "word " * 4000, base[5][:200] + " " + base[6]]
