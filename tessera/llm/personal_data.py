"""Personal data: patterns propose spans, checksums confirm them, words near by move their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order of ties: those always reported, then those that their score must bear out.
BASE = ("email", "ip", "card", "phone")
SCORED = ("iban", "ssn", "local_phone", "routing")
#: Patterns of all kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    "routing": r"[0-9]{9}",
}
#: The same for Java's matcher, which recurses into repeated groups and tries each start of a long run: runs are
#: taken whole, and a run is entered at its beginning or where the last match ended.
LINEAR = PATTERNS | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
}
#: What a text must hold for a kind to be sought at all.
MARKS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a span by its pattern and checksum, the step for words near by, and what a span of SCORED must reach.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4, "routing": 0.5}
STEP, BAR = 0.3, 0.7
#: Words that speak for each kind, and those that speak against any.
HINTS = {
    "email": ("contact", "email", "mail"),
    "ip": ("address", "host", "ip", "server"),
    "card": ("card", "credit", "mastercard", "payment", "visa"),
    "phone": ("call", "cell", "fax", "mobile", "phone", "tel"),
    "iban": ("account", "bank", "iban"),
    "ssn": ("security", "social", "ssn"),
    "local_phone": ("call", "cell", "fax", "mobile", "phone", "tel"),
    "routing": ("aba", "bank", "routing"),
}
AGAINST = ("build", "invoice", "isbn", "order", "release", "sku", "version")
#: Code points on each side in which such words count; they end at the next candidate of the same kind.
NEAR = 40
#: Characters of an account number by country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}
#: One part of an address, at most 255.
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
#: Area, group and serial numbers that are given to nobody.
NO_SSN = r"^(?:000|666|9)|^...-00|0000$"
#: Candidates whose places are summed up at one time.
BLOCK = 256
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def luhn(text: Column) -> Column:
    """Whether the digits of a text pass Luhn's check: every second one from the right counts twice, less 9 above 9."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return _sum(F.transform(F.reverse(_digits(text)), doubled)) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number without spaces leaves 1: its first four characters go last, letters count 10 to 35."""
    turned = F.concat(F.substring(number, 5, 64), F.substring(number, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _routing(text: Column) -> Column:
    """Whether nine digits, weighted 3, 7 and 1 in turn, sum up to a multiple of ten above 0."""
    total = _sum(F.transform(_digits(text), lambda d, i: d * F.when(i % 3 == 0, 3).when(i % 3 == 1, 7).otherwise(1)))
    return (total % 10 == 0) & (total > 0)


def _alone(before: Column, after: Column, marks: str = "") -> Column:
    """Whether no letter, digit or mark joins a candidate on either side."""
    return ~before.rlike(f"[A-Za-z0-9{marks}]$") & ~after.rlike("^[A-Za-z0-9]")


def sought(text: Column, has_digit: Column, kind: str) -> tuple[Column, Column]:
    """(hits, gaps): all leftmost matches of a kind in a text, and what lies around them; both empty where a mark is missing."""
    holds = has_digit if kind != "email" else F.lit(True)
    holds = holds & F.contains(text, F.lit(MARKS[kind])) if kind in MARKS else holds
    none = F.array().cast("array<string>")
    return F.when(holds, F.regexp_extract_all(text, F.lit(LINEAR[kind]), F.lit(0))).otherwise(none), F.when(holds, F.split(text, LINEAR[kind], -1)).otherwise(none)


def placed(hits: Column, gaps: Column) -> Column:
    """array<struct(at, hit, before, after)>: each hit with its place in code points and the NEAR code points around it.

    The sizes of gaps and hits are summed up by blocks of BLOCK hits, then within each block, so
    that the work stays near linear however many there are.
    """
    n = F.size(hits)
    n_blocks = F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = F.zip_with(F.slice(gaps, F.lit(1), n), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x["gap"] + x["hit"]))
    offsets = F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))

    def inside(block: Column, offset: Column) -> Column:
        start = F.struct(offset.alias("next"), F.array().cast("array<int>").alias("at"))
        step = lambda a, x: F.struct((a["next"] + x["gap"] + x["hit"]).alias("next"), F.concat(a["at"], F.array(a["next"] + x["gap"])).alias("at"))
        return F.aggregate(block, start, step)["at"]

    def around(hit: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        before = F.substr(gap, F.greatest(F.length(gap) - (NEAR - 1), F.lit(1)), F.lit(NEAR))
        return F.struct(hit.alias("hit"), before.alias("before"), F.substring(F.get(gaps, i + 1), 1, NEAR).alias("after"))

    places = F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), n_blocks), inside))
    both = F.zip_with(places, F.transform(hits, around), lambda at, c: F.struct(at.alias("at"), c["hit"].alias("hit"), c["before"].alias("before"), c["after"].alias("after")))
    return F.when(n > 0, both).otherwise(F.array().cast("array<struct<at:int,hit:string,before:string,after:string>>"))


def score(kind: str, before: Column, after: Column) -> Column:
    """What pattern and checksum give a span, moved by the words near by; 0 to 1."""
    near = F.lower(F.concat_ws(" ", before, after))
    has = lambda words: near.rlike(rf"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)")
    moved = F.lit(SCORES[kind]) + F.when(has(HINTS[kind]), STEP).otherwise(0.0) - F.when(has(AGAINST), STEP).otherwise(0.0)
    return F.round(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)), 2)


def _iban_size(hit: Column) -> Column:
    sizes = F.create_map(*[F.lit(x) for pair in IBAN_SIZES.items() for x in pair])
    return F.try_element_at(sizes, F.substring(hit, 1, 2))


def _iban_end(hit: Column) -> Column:
    """Code points of a candidate up to the last character of an account number of its country; null if it is too short."""
    bare = lambda k: F.length(F.replace(F.substr(hit, F.lit(1), k), F.lit(" "), F.lit("")))
    return F.get(F.filter(F.sequence(F.lit(1), F.length(hit)), lambda k: bare(k) >= _iban_size(hit)), F.lit(0))


def confirmed(kind: str, c: Column) -> Column:
    """Whether a candidate passes the checks of its kind."""
    hit, digits = c["hit"], F.length(F.regexp_replace(c["hit"], "[^0-9]", ""))
    match kind:
        case "ip":
            return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
        case "card":
            return F.when(digits.between(12, 19), luhn(hit)).otherwise(False)
        case "phone":
            return digits.between(9, 15)
        case "iban":
            end = _iban_end(hit)
            rest = F.concat(F.substr(hit, end + 1, F.length(hit)), c["after"])
            number = F.replace(F.substr(hit, F.lit(1), end), F.lit(" "), F.lit(""))
            return F.when(end.isNotNull(), _alone(c["before"], rest) & mod97(number)).otherwise(False)
        case "ssn":
            return _alone(c["before"], c["after"], "-") & ~hit.rlike(NO_SSN)
        case "local_phone":
            return _alone(c["before"], c["after"], "+") & ~c["before"].rlike(r"[0-9)][\x20.-]$")
        case "routing":
            return _alone(c["before"], c["after"], "-") & _routing(hit)
    return F.lit(True)


def _spans(kind: str, found: Column) -> Column:
    """The confirmed candidates of a kind as SPAN."""
    size = _iban_end if kind == "iban" else F.length
    shown = lambda c: F.struct(F.lit(kind).alias("kind"), c["at"].alias("start"), (c["at"] + size(c["hit"])).alias("end"), score(kind, c["before"], c["after"]).alias("score"))
    return F.transform(F.filter(found, lambda c: confirmed(kind, c)), shown).cast(SPAN)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of each whole text: doc_id, base and scored spans (kind, start, end, score).

    A kind's candidates are the leftmost matches of its pattern that do not overlap.  Checks
    confirm them: Luhn for cards, mod 97 for account numbers, 3-7-1 sums for bank routing numbers,
    ranges and digit counts for the others; a match that fails is dropped and not tried anew.
    A span's score comes from its kind and moves by STEP for words that speak for or against it within
    NEAR code points.  Base spans (BASE) are all reported with their score, those of SCORED only from
    BAR on: account numbers unless words speak against them, the others if words speak for them.  Spans of
    different kinds may overlap.  Offsets count code points, ends are exclusive.

    Everything is Spark SQL on one pass without a shuffle.  A null or empty text has no spans.
    One row for each document row, a null doc_id included; repeated rows repeat their
    results.  Other columns are ignored; an empty table gives no rows.
    """
    kinds = (*BASE, *SCORED)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("has_digit", F.col("text").rlike("[0-9]"))
    pairs = {k: sought(F.col("text"), F.col("has_digit"), k) for k in kinds}
    rows = rows.select("doc_id", *[p.alias(f"{n}_{k}") for k, both in pairs.items() for n, p in zip(("hits", "gaps"), both)])
    rows = rows.select("doc_id", *[placed(F.col(f"hits_{k}"), F.col(f"gaps_{k}")).alias(k) for k in kinds])
    rows = rows.select("doc_id", F.concat(*[_spans(k, F.col(k)) for k in BASE]).alias("base"), F.concat(*[_spans(k, F.col(k)) for k in SCORED]).alias("scored"))
    return rows.select("doc_id", "base", F.filter("scored", lambda s: s["score"] >= BAR).alias("scored"))


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*BASE, *SCORED)) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.element_at(rank, s["kind"]).alias("r"), s["end"].alias("b"), s.alias("s"))))
    return F.transform(keyed, lambda s: s["s"])


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = found.select("doc_id", in_order(F.col("base")).alias("base"), in_order(F.concat("base", "scored")).alias("spans"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("percent"),
    )


def _sql() -> str:
    """The query in DuckDB's SQL, over the same patterns and tables of values."""
    words = lambda w: rf"(?:^|[^a-z])(?:{'|'.join(w)})(?:[^a-z]|$)"
    by_kind = lambda values: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
    kinds = " UNION ALL ".join(f"SELECT row, doc_id, '{k}' AS kind, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM docs" for k, p in PATTERNS.items())
    digits = "list_transform(string_split(regexp_replace(hit, '[^0-9]', '', 'g'), ''), lambda c: c::INT)"
    alone = lambda marks="": f"NOT regexp_matches(before, '[A-Za-z0-9{marks}]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END"
    rank = by_kind({k: i for i, k in enumerate((*BASE, *SCORED))})
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({kinds}),
each AS (SELECT row, doc_id, kind, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM found),
located AS (
  SELECT row, doc_id, kind, hits[i] AS hit, right(gaps[i], {NEAR}) AS before, left(gaps[i + 1], {NEAR}) AS after,
         (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::INT AS place
  FROM each),
sized AS (
  SELECT *, length(regexp_replace(hit, '[^0-9]', '', 'g')) AS n_digits, {digits} AS digits,
         CASE WHEN kind = 'iban' THEN list_filter(range(1, length(hit) + 1), lambda k: length(replace(hit[1:k], ' ', '')) >= map_extract(MAP {{{', '.join(f"'{k}': {v}" for k, v in IBAN_SIZES.items())}}}, hit[1:2])[1])[1] ELSE length(hit) END AS size,
         lower(before || ' ' || after) AS near
  FROM (SELECT * FROM located WHERE kind NOT IN ('card') OR length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 12 AND 19)),
numbered AS (SELECT *, string_split(replace(hit[5:size], ' ', '') || replace(hit[1:4], ' ', ''), '') AS turned FROM (SELECT * REPLACE (CASE WHEN kind = 'iban' THEN size ELSE length(hit) END AS size) FROM sized) WHERE size IS NOT NULL),
checked AS (
  SELECT *, CASE kind
    WHEN 'ip' THEN regexp_matches(hit, '^{PART}(?:\\.{PART}){{3}}$')
    WHEN 'card' THEN list_sum(list_transform(list_reverse(digits), lambda d, j: CASE WHEN j % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0
    WHEN 'phone' THEN n_digits BETWEEN 9 AND 15
    WHEN 'iban' THEN NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(hit[size + 1:] || after, '^[A-Za-z0-9]')
      AND list_reduce(list_prepend(0, list_transform(turned, lambda c: CASE WHEN kind = 'iban' THEN {value} ELSE 0 END)), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1
    WHEN 'ssn' THEN {alone('-')} AND NOT regexp_matches(hit, '{NO_SSN}')
    WHEN 'local_phone' THEN {alone('+')} AND NOT regexp_matches(before, '[0-9)][\x20.-]$')
    WHEN 'routing' THEN {alone('-')} AND list_sum(list_transform(digits, lambda d, j: d * CASE j % 3 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END)) BETWEEN 1 AND 999
      AND list_sum(list_transform(digits, lambda d, j: d * CASE j % 3 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END)) % 10 = 0
    ELSE true END AS ok,
    round(least(greatest({by_kind(SCORES)} + CASE WHEN regexp_matches(near, {by_kind({k: f"'{words(w)}'" for k, w in HINTS.items()})}) THEN {STEP} ELSE 0 END
      - CASE WHEN regexp_matches(near, '{words(AGAINST)}') THEN {STEP} ELSE 0 END, 0), 1), 2) AS score
  FROM numbered),
spans AS (SELECT row, kind, place AS first, place + size AS last, score, {rank} AS rank FROM checked WHERE ok AND (kind IN {BASE} OR score >= {BAR})),
texts AS (
  SELECT row, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
         string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank, last) FILTER (kind IN {BASE}) AS base,
         string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank, last) AS spans,
         string_agg(round(score * 100)::INT, ',' ORDER BY first, rank, last) AS percent
  FROM spans GROUP BY row)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(percent, '') AS percent
FROM docs LEFT JOIN texts USING (row)"""


QUERIES = {"op12_personal_data": op12_personal_data}
ORACLE_SQL = {"op12_personal_data": _sql()}
