"""Secret scan: fixed patterns, and multipart credentials linked within a scope."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import sliced, texts
from tessera.session import materialize

#: Kinds in the order of ties: the base first, then those reported only when linked.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: What must stand near a weak candidate of each role for it to be reported.
NEEDS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
#: Code points between two parts of one credential, at most; parts also share a paragraph.
REACH = 400

ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
WEAK_ID = re.compile(rb"""(?<![A-Za-z0-9])(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""")
WEAK_SECRET = re.compile(rb"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(rb"""(?<![A-Za-z0-9])(?i:https?|ftp|s3|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\x00-\x20"'<>\x7f]+|(?<![A-Za-z0-9])(?i:host|endpoint|server|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}""")
SCOPE_END = re.compile(rb"\n[ \t\r]*\n")

SPAN = "kind:string,start:int,end:int,scope:int"


def spans_of(text: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, weak) spans of a whole text in bytes; weak ones that overlap a base span are left out."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    weak = [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    weak += [("weak_id", m.start(), m.end()) for m in WEAK_ID.finditer(text)]
    weak += [("weak_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text)]
    if base and weak:
        ends = sorted((s, e) for _, s, e in base)
        starts = np.array([s for s, _ in ends])
        reach = np.maximum.accumulate(np.array([e for _, e in ends]))
        before = np.searchsorted(starts, [e for _, _, e in weak], side="left")
        weak = [w for w, b in zip(weak, before.tolist()) if b == 0 or reach[b - 1] <= w[1]]
    return base, weak


def _scan(batches):
    for batch in sliced(batches):
        out: dict[str, list] = {"base": [], "weak": []}
        for text in texts(batch.column(3)):
            base, weak = spans_of(text)
            if base or weak:
                places = None if text.isascii() else np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                at = (lambda i: i) if places is None else (lambda i, p=places: int(p[i]))
                cuts = np.array([m.start() for m in SCOPE_END.finditer(text)], np.int64)
                scope = np.searchsorted(cuts, [s for _, s, _ in base + weak], side="left").tolist()
                rows = [{"kind": k, "start": at(s), "end": at(e), "scope": c} for (k, s, e), c in zip(base + weak, scope)]
                base, weak = rows[: len(base)], rows[len(base) :]
            out["base"].append(base)
            out["weak"].append(weak)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out["base"], kind), pa.array(out["weak"], kind)], ["own_id", "doc_id", "text_key", "base", "weak"])


def linked_weak_spans(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, text_key, linked): the weak spans that have a complementary part near.

    An interval join by buckets of ``reach`` code points: a part stands in the buckets it
    touches, a candidate asks those within ``reach`` of it, and a left semi join ends
    at the first match, so no pairs are made.
    """
    rows = scanned.filter("size(weak) > 0").dropDuplicates(["doc_id", "text_key"])
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    spans = rows.select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("s"))
    parts = spans.select(
        "doc_id", "text_key", F.col("s.scope").alias("scope"), F.element_at(role, F.col("s.kind")).alias("role"), F.col("s.start").alias("p_start"), F.col("s.end").alias("p_end"),
        F.explode(F.sequence(F.expr(f"s.start div {reach}"), F.expr(f"(s.end - 1) div {reach}"))).alias("bucket"),
    )
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asks = (
        rows.select("doc_id", "text_key", F.explode("weak").alias("s"))
        .select("doc_id", "text_key", "s", F.explode(F.element_at(needs, F.element_at(role, F.col("s.kind")))).alias("role"))
        .select("doc_id", "text_key", "s", "role", F.col("s.scope").alias("scope"), F.explode(F.sequence(F.expr(f"greatest(s.start - {reach}, 0) div {reach}"), F.expr(f"(s.end + {reach}) div {reach}"))).alias("bucket"))
    )
    a, p = asks.alias("a"), parts.alias("p")
    near = (F.col("p.p_start") - F.col("a.s.end") <= reach) & (F.col("a.s.start") - F.col("p.p_end") <= reach)
    same = [F.col(f"a.{c}") == F.col(f"p.{c}") for c in ("doc_id", "text_key", "scope", "role", "bucket")]
    hit = a.hint("merge").join(p, [*same, near], "left_semi")
    return hit.groupBy("doc_id", "text_key").agg(F.collect_set("s").alias("linked"))


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Secrets of each whole text: doc_id, base and linked spans (kind, start, end, scope).

    Base spans follow fixed patterns.  Weak candidates are names of users or clients,
    mixed-case keys and endpoints; one is reported only where a complementary part
    (a secret for an identifier or an endpoint, either of those for a secret) stands in
    the same paragraph within ``reach`` code points.  Offsets count code points, ends are
    exclusive.  A null or empty text has no spans.  One row for each document row;
    rows with a null doc_id are scanned like any other; repeated rows repeat their results.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    # Links depend on the text only: a null id may share the number 0, since the key of the text stands beside it.
    scanned = materialize(rows.mapInArrow(_scan, f"own_id long, doc_id long, text_key long, base array<struct<{SPAN}>>, weak array<struct<{SPAN}>>"), "scanned")
    linked = linked_weak_spans(scanned, reach)
    return scanned.hint("merge").join(linked, ["doc_id", "text_key"], "left").select(
        F.col("own_id").alias("doc_id"), "base", F.coalesce("linked", F.array().cast(f"array<struct<{SPAN}>>")).alias("linked")
    )


def span_string(spans):
    """kind:start:end by start, then kind, then end; comma-joined."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.element_at(rank, s["kind"]).alias("r"), s["end"].alias("b"), s["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")


def op10_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(span_string("base"), 256).alias("base_sha256"),
        span_string(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


QUERIES = {"op10_credential_linking": op10_credential_linking}
ORACLE_SQL: dict[str, str] = {}
