import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import pieces, perspectives, quality, secret_scan, sharding, warc

from .helpers import CLASH, documents, prose, sample_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics_match_brute_force(spark):
    texts = [*sample_texts(4), "a b c a b c a b c", "x\nx\n \nx", "é ü #1 | <b>", " a b a b a b ", "one\x0btwo\x0cthree", "a b c d"]
    found = quality.text_statistics(documents(spark, texts, CLASH), ("one",), ("two",)).collect()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id]), texts[r.doc_id]
    assert len(found) == len(texts)


def labelled(spark, seed=1, n=240):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        kind = i % 4
        body = " ".join(prose(rng, 90).split(" "))
        if kind == 1:
            body = " ".join(w + "%%" for w in body.split(" "))
        if kind == 2:
            body = body.replace(" ", " dunce ", 1)
        texts.append(body)
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    docs = documents(spark, texts)
    return docs, spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")


def test_decision_list_learns_planted_rules(spark):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels)
    assert "dunce" in model.strong
    assert model.rules and all("THEN reject" in str(r) for r in model.rules)
    kept = {r.doc_id for r in quality.judge(docs, model).filter("kept").collect()}
    assert kept == {i for i in range(240) if i % 4 in (0, 3)}


def test_decision_list_matches_plain_covering(spark):
    """The list against a cover written over the raw values."""
    rng = random.Random(71)
    rows = []
    for i in range(600):
        x = {f: rng.choice([0.0, round(rng.random(), 3)]) for f in quality.FEATURES}
        bad = int(x["symbol_share"] > 0.6 or (x["upper_share"] > 0.5 and x["flag_words"] > 0.5)) if rng.random() > 0.005 else 1
        rows.append((bad, i % 3, *(x[f] for f in quality.FEATURES)))
    stats = spark.createDataFrame(rows, "bad int, part int, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    rules = quality.learn_rules(stats)
    place = {f: 2 + k for k, f in enumerate(quality.FEATURES)}
    hold = lambda c, r: (r[place[c.feature]] > c.cut) == c.above
    left = rows
    for rule in rules:
        hit = [r for r in left if all(hold(c, r) for c in rule.conditions)]
        assert len(hit) == rule.covered and abs(sum(r[0] for r in hit) / len(hit) - rule.precision) < 1e-12
        held = [r for r in hit if r[1] == 0]
        assert rule.precision >= quality.MIN_PRECISION and (len(held) < quality.MIN_COVER or sum(r[0] for r in held) >= quality.MIN_PRECISION * len(held))
        left = [r for r in left if not all(hold(c, r) for c in rule.conditions)]
    first = rules[0].conditions[0]  # no single threshold of the data gains more
    grown = [r for r in rows if r[1] != 0]
    base = sum(r[0] for r in grown) / len(grown)

    def gain(feature, above, cut):
        hit = [r for r in grown if (r[place[feature]] > cut) == above]
        p = sum(r[0] for r in hit)
        return p * (math.log2(p / len(hit)) - math.log2(base)) if p >= quality.MIN_COVER else -1.0

    cuts = {c.cut for rule in rules for c in rule.conditions} | {0.0}
    assert all(gain(f, above, cut) <= gain(first.feature, first.above, first.cut) + 1e-9 for f in quality.FEATURES for above in (True, False) for cut in cuts)
    assert sum(r[0] for r in left) < 0.3 * sum(r[0] for r in rows)


def test_short_texts_stay_in_the_filter_unless_they_repeat(spark):
    docs = documents(spark, ["a few good words", "x y z x y z x y z", "", None, "one"])
    assert sorted(r.doc_id for r in quality.filter_quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()) == [0, 4]
    found = {r.doc_id: r.kept for r in quality.judge(docs, quality.QualityModel((), (), ())).collect()}
    assert not any(found.values())


def test_quality_without_labels_or_documents(spark):
    docs, labels = labelled(spark, n=8)
    model = quality.fit_quality(docs, labels.limit(0))
    assert model.rules == () and quality.judge(docs, model).filter("kept").count() == 8
    assert quality.filter_quality(docs.limit(0), labels).count() == 0
    again = quality.filter_quality(docs.unionAll(docs.limit(1)), labels.limit(0))
    assert again.columns == docs.columns and again.count() == 9


def test_quality_plan_has_no_python(spark):
    docs, labels = labelled(spark, n=40)
    plan = quality.judge(docs, quality.QualityModel(("dunce",), ("thin",), ()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shards_are_even_whole_and_gapless(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(5, 60)) for _ in range(600)]
    texts += [texts[3]] * 300 + [None, "", None]
    rows = sharding.shard_by_kd_tree(documents(spark, texts, CLASH), 24).collect()
    assert len(rows) == len(texts)
    sums = Counter()
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        sums[r.shard] += r.size
    assert set(sums) == set(range(24))
    assert max(sums.values()) - min(sums.values()) <= 3 * max(r.size for r in rows)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def brute_tree(rows, shards, shard, first=0):
    """Shard by row number: the same tree from sorted codes."""
    if shards == 1 or not rows:
        return {r["i"]: first for r in rows}
    width = [max(r[f"code{d}"] for r in rows) // 2**32 - min(r[f"code{d}"] for r in rows) // 2**32 for d in range(4)]
    dim = f"code{width.index(max(width))}"
    half = shards // 2

    def cut(known, target, bits, below):
        weights = Counter()
        for r in known:
            weights[r[dim] >> bits] += r["size"]
        for code in sorted(weights):
            if below + weights[code] >= target or code == max(weights):
                under, over = target - below, below + weights[code] - target
                if bits and weights[code] > shard:
                    return cut([r for r in known if r[dim] >> bits == code], target, 0, below)
                return (code if under < over else code + 1) << bits
            below += weights[code]

    at = cut(rows, sum(r["size"] for r in rows) * half / shards, sharding.PIECE_BITS, 0)
    return brute_tree([r for r in rows if r[dim] < at], half, shard, first) | brute_tree([r for r in rows if r[dim] >= at], shards - half, shard, first + half)


def test_shards_match_a_tree_of_sorted_codes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 16)
    rng = random.Random(19)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(150)]
    texts += [texts[5]] * 120 + [texts[7]] * 3 + [None, ""]
    docs = documents(spark, texts)
    placed = sharding._placed(sharding._slim(docs)).collect()
    rows = [r.asDict() | {"i": r["doc_id"]} for r in placed]
    want = brute_tree(rows, 24, sum(r["size"] for r in rows) / 24)
    found = {r.doc_id: r.shard for r in sharding.shard_by_kd_tree(docs, 24).collect()}
    assert found == want
    sums = Counter()
    for r in rows:
        sums[found[r["i"]]] += r["size"]
    assert len({found[i] for i, t in enumerate(texts) if t == texts[5]}) > 1  # only the large group is cut
    assert len({found[i] for i, t in enumerate(texts) if t == texts[7]}) == 1


def test_sharding_edges(spark):
    assert sharding.shard_by_kd_tree(documents(spark, []).limit(0)).count() == 0
    rows = sharding.shard_by_kd_tree(documents(spark, [(None, "a"), (None, "a"), (1, "b")]).drop("lang", "source"), 24).collect()
    assert len(rows) == 3 and all(0 <= r.shard < 24 for r in rows)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_archives_round_trip(spark):
    big, small = "<p>é" + "x" * 1500 + "\r\n\r\nWARC/1.1\r\n\r\n</p>", "short"
    rows = [(1, "http://b.example/", big), (2, "https://www.a.example/z?b=1&a=2#f", big), (3, "http://a.example/z?a=2&b=1", small), (4, None, small), (5, "http://x\r\nWARC-Type: y/", None), (None, "http://n/", big), (7, "http://b.example/", big), (7, "http://b.example/", big)]
    found = warc.archive_round_trip(pages(spark, [(*r, "clash") for r in rows])).collect()
    assert len(found) == len(rows) and all(r.digest_ok for r in found)
    for i, url, html in rows:
        body = (html or "").encode()
        mine = [r for r in found if r.page_id == i and r.payload_digest == hashlib.sha1(body).hexdigest()]
        assert mine and all(r.payload_bytes == len(body) for r in mine)
        revisit = html == big and i in (1, 2)
        assert {(r.record_type, r.refers_to) for r in mine} == {("revisit", 7) if revisit else ("response", None)}
    ranked = sorted(found, key=lambda r: r.capture_rank)
    assert [r.capture_rank for r in ranked] == list(range(len(rows)))
    keys = [(r.url_key, r.captured) for r in ranked]
    assert keys == sorted(keys)


def test_archives_match_brute_force_on_hostile_rows(spark):
    rng = random.Random(61)
    bodies = [prose(rng, 300), "é" * 499 + "x", "é" * 500, None, "", "short", "WARC/1.1\r\n\r\n" * 100]
    rows = [(rng.choice([i, 2**62 + i, -i, None]), f"http://h{rng.randrange(3)}/{i % 5}", rng.choice(bodies), rng.choice([None, "no time", "2024-05-06 07:08:09", "99999-01-01"])) for i in range(80)]
    found = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, fetched_at string")).collect()
    best = {}
    for i, _, html, _ in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, i), i)
    want = Counter()
    for i, _, html, _ in rows:
        body = (html or "").encode()
        other = best.get(html) if i is not None and i != best.get(html) else None
        want[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if other is not None else "response", other] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    assert all(r.digest_ok for r in found) and sorted(r.capture_rank for r in found) == list(range(80))
    keys = [(r.url_key, r.captured) for r in sorted(found, key=lambda r: r.capture_rank)]
    assert keys == sorted(keys) and sum(r.captured == "2024-05-06T07:08:09Z" for r in found) == sum(r[3] == "2024-05-06 07:08:09" for r in rows)


def test_each_record_is_a_member_at_its_offset(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(pages(spark, [(i, f"http://a/{i}", "x" * i, "") for i in range(40)]).select("page_id", "url", "html"), path)
    seen = warc.read_archives(spark, path).collect()
    assert len(seen) == 40
    for r in seen:
        with open(f"{path}/{r.archive}", "rb") as file:
            headers, _ = warc.parse_record(zlib.decompressobj(31).decompress(file.read()[r.offset :]))
        assert headers["warc-record-id"] == f"<urn:page:{r.page_id}>"


def test_archives_of_nothing(spark):
    assert warc.archive_round_trip(pages(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc.loser_tree_merge(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_base_spans_and_linked_parts(spark):
    key = "Zx9" * 10
    far = "words " * 200
    texts = [
        "user_name and password = 'hunter22xx' AKIA" + "A1" * 10 + " " + "0f" * 14,
        f"username: alice\nsee {key} here",  # two weak parts that complete each other
        f"nothing else than {key} here",
        f"username: alice\n\n{key}",  # another paragraph
        f"username: alice {far} {key}",  # too far
        "https://api.example.com/v1 password: s3cretvalue",
        "https://api.example.com/v1 alone",
        "é token=abcdefg", None, "", "token: token: abcdefg",
    ]
    found = {r.doc_id: r for r in secret_scan.scan_secrets(documents(spark, texts, CLASH)).collect()}
    kinds = {i: sorted(s.kind for s in r.linked) for i, r in found.items()}
    assert sorted(s.kind for s in found[0].base) == ["access", "assign", "hex"]
    assert kinds[1] == ["weak_id", "weak_secret"]
    assert kinds[2] == kinds[3] == kinds[4] == kinds[6] == []
    assert kinds[5] == ["endpoint"]
    assert [(s.start, s.end) for s in found[7].base] == [(2, 15)]
    assert found[8].base == found[9].base == [] and found[10].base == []
    assert secret_scan.scan_secrets(documents(spark, []).limit(0)).count() == 0
    twice = secret_scan.scan_secrets(documents(spark, [(None, texts[1]), (2, texts[1]), (2, texts[1])])).collect()
    assert [len(r.linked) for r in twice] == [2, 2, 2]


def test_base_spans_match_the_contract_on_random_text(spark):
    """Base spans of random text against patterns over code points, counted one match at a time."""
    rng = random.Random(41)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", "  ", "'", '"', "AKIA", "AKIAA", "A1B2", "0123456789abcdef", "deadbeef", "é", "\n", "x", "/+_.-", "hunter2", "ſecret", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    kinds = [
        ("assign", re.compile("""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(2)) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
    ]
    docs = documents(spark, texts).withColumnRenamed("doc_id", "doc_id")
    found = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    hits = 0
    for i, text in enumerate(texts):
        want = sorted((m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(kinds) for m in pattern.finditer(text) if good(m))
        hits += len(want)
        assert [(a, n, b) for a, _, b, n in want] == sorted(((s.start, s.kind, s.end) for s in found[i].base), key=lambda x: (x[0], [n for n, *_ in kinds].index(x[1])))
    assert hits > 50


def test_every_speaker_has_a_perspective(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hé"), (1, 2, "bob", "hé"), (1, 3, "cy", None), (1, 600, "ann", "late"), (2, 0, None, "x"), (None, 1, "a", "b"), (3, None, "a", "b"), (4, 0, "system", "only"), (5, 1, "b\nassistant", "x")]
    found = perspectives.rotate_perspectives(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")).collect()
    assert sorted((r.conv_id, r.perspective, r.segment) for r in found) == [(1, p, 0) for p in ("ann", "bob", "cy")] + [(2, "unknown", 0), (5, "b assistant", 0)]
    ann = next(r for r in found if (r.conv_id, r.perspective) == (1, "ann"))
    spans = [tuple(map(int, s.split("-"))) for s in ann.mask.split(",")]
    assert [ann.rendered[a:b] for a, b in spans] == ["hi < |im_end|><|im_end|>", "late<|im_end|>"]
    assert "user name=bob\nhé<|im_end|>" in ann.rendered and ann.n_turns == 5 and ann.n_own_turns == 2
    assert perspectives.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_segments_of_a_long_dialogue_are_one_rendering(spark):
    rng = random.Random(51)
    names = ["ann", "bo", "system", "cécile"]
    rows = {(t // 7 if t < 400 else 10**12 + t, rng.choice(names), prose(rng, rng.randrange(0, 6))) for t in range(700)}  # ties, gaps
    table = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
    order = sorted(rows, key=lambda r: (r[0], hashlib.md5("|".join(r[1:]).encode()).hexdigest()))
    found = perspectives.rotate_perspectives(table, segment_turns=16).collect()
    for who in ("ann", "bo", "cécile"):
        mine = sorted((r for r in found if r.perspective == who), key=lambda r: r.segment)
        whole = "".join(r.rendered for r in mine)
        assert whole == "".join(f"<|im_start|>{'assistant' if n == who else n if n == 'system' else 'user name=' + n}\n{t}<|im_end|>\n" for _, n, t in order)
        assert [r.start for r in mine] == [sum(len(x.rendered) for x in mine[:i]) for i in range(len(mine))]
        spans = [tuple(map(int, s.split("-"))) for r in mine if r.mask for s in r.mask.split(",")]
        assert [whole[a:b] for a, b in spans] == [t + "<|im_end|>" for _, n, t in order if n == who]
        assert all(r.n_turns <= 16 for r in mine)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_sampling_is_lossless_and_repeatable(spark, vocabulary):
    texts = [*sample_texts(7), "  two  spaces ▁ and 中文 🙂\n\t", "x" * 500, "▁", "\x00ab", "Áé"]
    docs = documents(spark, texts, CLASH)
    encoded = pieces.encode_pieces(docs, vocabulary)
    first = {r.doc_id: (r.piece_ids, r.text) for r in pieces.decode_pieces(encoded, vocabulary).collect()}
    assert {i: t for i, (_, t) in first.items()} == dict(enumerate(texts))
    again = {r.doc_id: r.piece_ids for r in pieces.encode_pieces(docs.repartition(3), vocabulary).collect()}
    assert again == {i: p for i, (p, _) in first.items()}
    other = {r.doc_id: r.piece_ids for r in pieces.encode_pieces(docs, vocabulary, seed=43).collect()}
    assert other != again
    assert pieces.encode_and_check(documents(spark, []).limit(0)).count() == 0


def test_sampled_frequencies_follow_the_lattice(vocabulary):
    word = "▁the"
    known = {s: i for i, s in enumerate(vocabulary.surfaces) if s}
    byte_like = set(vocabulary.byte_ids.tolist())
    ids = {s: i for s, i in known.items() if i not in byte_like}

    def paths(text):
        if not text:
            return [((), 1.0)]
        out = []
        for k in range(1, len(text) + 1):
            head = text[:k].replace("▁", " ").encode()
            if head in ids:
                out += [((ids[head], *p), vocabulary.weights[ids[head]] * w) for p, w in paths(text[k:])]
        return out

    want = dict(paths(word))
    total = sum(want.values())
    n = 20_000
    drawn = Counter(tuple(x.tolist()) for x in pieces.Sampler(vocabulary).encode(["the"] * n, list(range(n))))
    assert set(drawn) <= set(want)
    for path, w in want.items():
        p = w / total
        assert abs(drawn[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 2e-4


@pytest.mark.parametrize("text", ["x  y", "internationalisation" * 4, "a     b", "   ", "the   end ▁ "])
def test_sampled_cuts_follow_forward_and_backward_sums(vocabulary, text):
    """Shares of the places where pieces end, against exact sums over all paths of the whole text."""
    units = " " + text
    ids = {}
    byte_like = set(vocabulary.byte_ids.tolist())
    for i, s in enumerate(vocabulary.surfaces):
        if s and i not in byte_like:
            ids.setdefault(s.decode(), i)

    def weight(piece):
        if piece in ids and "▁" not in piece:
            return vocabulary.weights[ids[piece]]
        return float(pieces.FALLBACK) if len(piece) == 1 else 0.0

    n = len(units)
    ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for e in range(1, n + 1):
        ahead[e] = sum(ahead[s] * weight(units[s:e]) for s in range(max(0, e - vocabulary.longest), e))
    for s in range(n - 1, -1, -1):
        back[s] = sum(weight(units[s:e]) * back[e] for e in range(s + 1, min(n, s + vocabulary.longest) + 1))
    draws = 4_000
    seen = Counter()
    for x in pieces.Sampler(vocabulary).encode([text] * draws, list(range(draws))):
        got = b"".join(vocabulary.surfaces[i] for i in x.tolist())
        assert got == units.encode()
        at = 0
        for i in x.tolist():
            at += len(vocabulary.surfaces[i])
            seen[at] += 1
    places = {len(units[:k].encode()): k for k in range(1, n + 1)}
    for byte, k in places.items():
        p = ahead[k] * back[k] / ahead[n]
        assert abs(seen[byte] / draws - p) < 5 * (max(p * (1 - p), 0) / draws) ** 0.5 + 2e-3, (k, p, seen[byte] / draws)


def test_one_python_worker_encodes_and_decodes(spark):
    docs = documents(spark, ["small blue anvil", "", None, "two  spaces \u2581 and \u00e9", "a" * 300])
    found = pieces.encode_and_check(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    vocabulary = pieces.Vocabulary.load()
    want = {r.doc_id: (r.piece_ids, r.text) for r in pieces.decode_pieces(pieces.encode_pieces(docs, vocabulary), vocabulary).collect()}
    assert {r.doc_id: r.piece_ids for r in found.collect()} == {k: ids for k, (ids, _) in want.items()}
    assert {k: t for k, (_, t) in want.items()} == {r.doc_id: r.text for r in docs.collect()}
