"""Personal data against plain patterns in Python, checks of single kinds, and scores."""

import hashlib
import random
import re
import time

import pytest

from tessera.llm import personal_data as pd_
from tests.llm.helpers import CLASH, documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    order = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda s: (s[1], order[s[0]]))


def scan(spark, texts):
    rows = pd_.find_personal_data(documents(spark, texts)).collect()
    return {r.doc_id: ([(s.kind, s.start, s.end, s.score) for s in r.base], [(s.kind, s.start, s.end, s.score) for s in r.scored]) for r in rows}


def jumble(rng):
    parts = ["a.b+c@d.e", "@", ".", "+", "x@y", "1.2.3.4", "300.1.2.3", "000255.0.1.02", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-0199", "+49-30-1234567", " ", "é", "😀", "-", "(", ")", "7", "12", "user_x%", "@mail.example.org", "\n", "AB", "a@b.c+d@e.f.g"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))


def test_base_spans_follow_the_patterns(spark):
    rng = random.Random(3)
    texts = [jumble(rng) for _ in range(800)] + ["", None]
    found = scan(spark, texts)
    for i, t in enumerate(texts):
        assert [s[:3] for s in sorted(found[i][0], key=lambda s: (s[1], pd_.BASE.index(s[0])))] == brute(t), t


def test_digest_and_counts(spark, tmp_path):
    texts = ["mail x@y.zz or 10.0.0.1, card 4111 1111 1111 1111", None, "clean words only"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pd_.op12_personal_data(spark, str(tmp_path)).collect()}
    want = ",".join(":".join(map(str, s)) for s in brute(texts[0]))
    assert rows[0].spans == want and rows[0].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (1, 1, 1, 0)
    assert rows[1].spans == rows[2].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def iban(country, body):
    turned = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{body}"


@pytest.mark.parametrize("country,body", [("DE", "370400440532013000"), ("GB", "WEST12345698765432"), ("NO", "86011117947")])
def test_account_numbers_need_their_checksum(spark, country, body):
    number = iban(country, body)
    spaced = " ".join(number[i : i + 4] for i in range(0, len(number), 4))
    wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
    texts = [f"pay to {number}.", f"é {spaced} AND MORE", f"pay to {wrong}.", f"invoice {number}", f"x{number}", number + "7"]
    found = {i: [s[:3] for s in v[1]] for i, v in scan(spark, texts).items()}
    assert found == {0: [("iban", 7, 7 + len(number))], 1: [("iban", 2, 2 + len(spaced))], 2: [], 3: [], 4: [], 5: []}


def test_words_near_by_bear_out_weak_spans(spark):
    far = "tel " + "x" * 50
    texts = ["call 212-555-0147 now", "about 212-555-0147 things", "SSN: 123-45-6789", "123-45-6789", "ssn 666-45-6789", "routing 021000021", "routing 021000022", f"{far} 212-555-0147", "hotel 212-555-0147", "call +1 212-555-0147"]
    found = {i: [(s[0], s[3]) for s in v[1]] for i, v in scan(spark, texts).items()}
    assert found == {0: [("local_phone", 0.7)], 1: [], 2: [("ssn", 0.7)], 3: [], 4: [], 5: [("routing", 0.8)], 6: [], 7: [], 8: [], 9: []}


def test_words_move_base_scores_but_never_drop(spark):
    found = scan(spark, ["build 1.2.3.4", "server 1.2.3.4", "so 1.2.3.4"])
    assert [found[i][0][0][3] for i in range(3)] == [0.2, 0.8, 0.5]


def test_very_long_texts(spark):
    """Runs that Java's matcher would recurse into or try again from each start; many hits in one text."""
    texts = ["1" * 200_000, "a" * 300_000, "a@b" + ".c" * 50_000, "1-" * 100_000, "+1" + "(" * 200_000, "x@y.zz 1.2.3.4 " * 20_000, "A1" * 100_000]
    began = time.time()
    found = scan(spark, texts)
    assert time.time() - began < 60
    for i in (2, 5):
        assert [s[:3] for s in sorted(found[i][0], key=lambda s: s[1])] == brute(texts[i])
    assert not any(found[i][0] or found[i][1] for i in (0, 1, 3, 4, 6))


def test_rows_and_columns(spark):
    docs = documents(spark, [(1, "x@y.zz"), (1, "x@y.zz"), (None, "x@y.zz")], extra=(*CLASH, "base", "scored", "has_digit", "email", "`a.b`"))
    rows = pd_.find_personal_data(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and all(len(r.base) == 1 for r in rows)
    assert pd_.find_personal_data(docs.limit(0)).count() == 0
    plan = pd_.find_personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
