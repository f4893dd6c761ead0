"""WARC archives: deduplicated writing, reading back, and a merged capture index."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.text import sliced, texts
from tessera.session import delete_at_exit, join_counted, materialize, scratch_path

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
#: Payload bytes of one archive file, and index rows of one merge task, at most about.
ARCHIVE_BYTES = 32_000_000
MERGE_ROWS = 50_000
#: Capture time of pages that have none: EPOCH and page_id seconds, modulo about 30 years.
EPOCH = 1_704_067_200
EPOCH_SPAN = 1_000_000_000
#: A gzip member of nothing stands between two records, which are members of their own.
EMPTY = gzip.compress(b"", mtime=0)
UNPACK_BYTES = 65_536
CRLF = "\r\n"


def _with_payload(pages: DataFrame) -> DataFrame:
    own = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(EPOCH_SPAN)))
    fetched = F.try_to_timestamp(F.col("fetched_at").cast("string")) if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    captured = F.when(F.year(fetched).between(1, 9999), fetched).otherwise(own)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
        F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))


def _decided(rows: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to, ...) of the pages that revisit another."""
    large = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).filter("page_id IS NOT NULL").select("page_id", "payload_digest", "url", "captured")
    large = materialize(large, "large")
    best = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url", "captured")).alias("first"), F.min("page_id").alias("least"), F.count("*").alias("n")).filter("least < first.page_id")
    return (
        join_counted(large.select("page_id", "payload_digest"), best, "payload_digest", "n", "best").filter("page_id < first.page_id")
        .select("page_id", "payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"), F.col("first.captured").alias("refers_date"))
        .dropDuplicates(["page_id", "payload_digest"])
    )


def _one_line(value: Column) -> Column:
    """A header value without line ends and other control characters, percent-encoded."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F\x7F]", "%20")


def _record() -> Column:
    """Text of one WARC/1.1 record with the two line ends that close it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), _one_line(F.col("refers_url")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Date: "), F.col("refers_date"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF))


def _packed(batches):
    for batch in sliced(batches):
        members = [gzip.compress(x, 6, mtime=0) for x in texts(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record for each row of ``pages``(page_id, url, html) as WARC/1.1 files below ``path``.

    Each record is a gzip member of its own.  Spark's text writer sets the members side by side;
    what it puts after each is an empty member.  Records are dealt by a hash of page and payload into files of
    about ARCHIVE_BYTES of payload.
    Of payloads that are equal and have REVISIT_BYTES or more, the record with the
    largest page_id holds the payload; the others are revisit records that refer to it.
    The capture time is ``fetched_at`` where it can be read and otherwise EPOCH and page_id seconds.
    """
    rows = _with_payload(pages)
    decided = materialize(_decided(rows), "revisits")
    total = rows.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES))
    dealt = rows.repartition(files, "page_id", "payload_digest")
    joined = dealt.hint("merge").join(decided, ["page_id", "payload_digest"], "left")
    members = joined.select(_record().alias("record")).mapInArrow(_packed, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query; scheme, www and fragment aside."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/").lower()
    return key + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")


def members_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member that has content."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts, start = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if at >= len(data):
                raise ValueError(f"the gzip member at byte {start} is cut off")
            chunk = view[at : at + UNPACK_BYTES]
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        if content := b"".join(parts):
            yield start, content


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, by its Content-Length."""
    head_end = data.find(b"\r\n\r\n")
    if head_end < 0 or not data.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    lines = data[:head_end].decode("utf-8").split(CRLF)
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:] if ": " in line)}
    end = head_end + 4 + int(headers["content-length"])
    if data[end:] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return headers, data[head_end + 4 : end]


CAPTURE = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured string, archive string, offset long, digest_ok boolean"
)


def _page_number(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return None if digits in ("", "none") else int(digits)


def _read(batches):
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("url", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("digest_ok", pa.bool_()),
    ])
    for batch in batches:
        for i in range(batch.num_rows):
            name, run = batch.column(0)[i].as_py().rsplit("/", 1)[-1], []
            for offset, record in members_of(batch.column(1)[i].as_py()):
                h, block = parse_record(record)
                http, _, payload = block.partition(b"\r\n\r\n")
                said = int(http.rsplit(b"Content-Length: ", 1)[1])
                kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                ok = kind == "revisit" or (len(payload) == said and hashlib.sha1(payload).hexdigest() == digest)
                url = h.get("warc-target-uri", "")
                run.append((_page_number(h["warc-record-id"]), said, digest, kind, _page_number(h.get("warc-refers-to")), url, url_key(url), h["warc-date"], name, offset, ok))
            run.sort(key=capture_order)  # an archive is one sorted run
            for at in range(0, len(run), 5_000):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in run[at : at + 5_000]], schema)


def capture_order(row: tuple) -> tuple:
    """Order of captures: URL key, time, page_id (null first), place in the archives."""
    return row[6], row[7], -1 if row[0] is None else row[0], row[8], row[9]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below ``path``, each archive sorted as one run; response payloads are checked by digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_read, CAPTURE)


def loser_tree_merge(runs: list[list], key: Callable) -> Iterator:
    """Merge sorted runs with a tournament tree of losers: one path of log2(k) matches for each row."""
    k = len(runs)
    if not k:
        return
    places = [0] * k
    heads: list = [(0, key(r[0])) if r else (1, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return x[0] < y[0] or (x[0] == y[0] == 0 and (x[1], a) < (y[1], b)) or (x[0] == y[0] == 1 and a < b)

    # Play all matches once from the leaves up; node n has children 2n and 2n + 1, leaves k..2k-1.
    winner, losers = list(range(-k, k)), [0] * k
    for n in range(k - 1, 0, -1):
        a, b = winner[2 * n], winner[2 * n + 1]
        winner[n], losers[n] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while heads[top][0] == 0:
        yield runs[top][places[top]]
        places[top] += 1
        heads[top] = (0, key(runs[top][places[top]])) if places[top] < len(runs[top]) else (1, None)
        n = (top + k) // 2
        while n:
            if beats(losers[n], top):
                losers[n], top = top, losers[n]
            n //= 2


def _merge(batches):
    """Rows of one key range, which come archive by archive in order: merge the fragments of the archives' runs."""
    runs: list[list[tuple]] = []
    schema, archive = None, None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[8] != archive:
                archive = row[8]
                runs.append([])
            runs[-1].append(row)
    if schema is None:
        return
    out: list[tuple] = []
    place = 0
    out_schema = pa.schema([*schema, pa.field("range_place", pa.int64())])
    for row in loser_tree_merge(runs, capture_order):
        out.append((*row, place))
        place += 1
        if len(out) == 5_000:
            yield pa.RecordBatch.from_pylist([dict(zip(out_schema.names, r)) for r in out], out_schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(out_schema.names, r)) for r in out], out_schema)


def merged_index(captures: DataFrame) -> DataFrame:
    """All captures in one global order of (URL key, time, page_id), with capture_rank from 0.

    The key space, page_id included, is dealt into ranges of about MERGE_ROWS rows, so that
    one URL with many captures spans ranges; each range merges its fragments of the
    archives' runs with a loser tree.  Ranks add the sizes of the ranges before.
    """
    spark = captures.sparkSession
    captures = materialize(captures, "runs")
    ranges = max(1, -(-captures.count() // MERGE_ROWS), spark.sparkContext.defaultParallelism)
    order = ["url_key", "captured", "page_id", "offset"]
    dealt = captures.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "offset").sortWithinPartitions("archive", *order)
    merged = dealt.mapInArrow(_merge, f"{CAPTURE}, range_place long").withColumn("range_id", F.spark_partition_id())
    merged = materialize(merged, "merged")
    # Sizes are summed up in groups of ranges, then over the groups, so that no window grows with the captures by more than their root.
    group = F.expr(f"range_id div {max(1, int(ranges**0.5))}")
    ahead = (Window.unboundedPreceding, -1)
    sizes = merged.groupBy("range_id").agg(F.count("*").alias("n")).withColumn("group", group)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("range_id").rowsBetween(*ahead)), F.lit(0).cast("long")))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("group").rowsBetween(*ahead)), F.lit(0).cast("long")).alias("ahead"))
    before = inside.hint("merge").join(groups, "group").select("range_id", F.col("n"), (F.col("ahead") + F.col("inside")).alias("before"))
    ranked = join_counted(merged, before, "range_id", "n", "places")
    return ranked.withColumn("capture_rank", F.col("before") + F.col("range_place")).drop("before", "range_id", "range_place", "n")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back and merge their capture index.

    Returns CAPTURE and capture_rank, one row for each row of pages.  A null html is an
    empty payload, a null url an empty one; a null page_id is written as none, never takes part in
    revisits and reads back as null.  Repeated rows are repeated records with equal
    decisions.  A fetched_at that is null, no time or outside the years 1 to 9999 counts as missing.  Line ends in a url are percent-encoded.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    own = path or scratch_path(spark, "warc")
    write_archives(pages, own)
    if not path:
        delete_at_exit(spark, own)
    return merged_index(read_archives(spark, own))


def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_rank", "digest_ok")


QUERIES = {"op5_warc_index_merge": op5_warc_index_merge}
ORACLE_SQL: dict[str, str] = {}
