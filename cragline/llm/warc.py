"""WARC archives: writing pages as segmented records, and reassembling them.

Writing is SQL only. The payload goes into an HTTP message with chunked transfer framing; a message longer than
SEGMENT_BYTES is cut into a first record and ``continuation`` records, which name the first one as their origin, carry
their segment number, and on the last the total length. Of pages with equal payloads the one with the smallest id is
written in full, the others as ``revisit`` records that refer to it. The text writer stores one record a line, with the
record separator of the format as the line separator, in gzip files of MAX_RECORDS records at most.

Reading takes each file as one binary row, parses its records in a task, and returns whole records at once. Only
segments are shuffled: grouped by origin, ordered by number, checked against the total length, and decoded.

Scale: finding equal payloads shuffles 20-byte digests, pre-aggregated; only the revisits are joined back by page, so a
payload shared by a third of all pages meets in no task. Files are cut at MAX_RECORDS, and a record is bounded by
SEGMENT_BYTES, so a reading task holds at most the product.

Defined results: null html is an empty payload; null ids sort last and equal each other; rows alike in id and payload are
alike in type; an empty table gives an empty result; a record that breaks the format, or segments that do not add up,
raise an error; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cragline.session import scratch_path

SEGMENT_BYTES = 4 * 1024
CHUNK_BYTES = 1024
#: Records in a file at most: 1,000 segments of 4 KiB are 4 MB.
MAX_RECORDS = 1000
SEPARATOR = "\r\n\r\n"

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()), T.StructField("target_uri", T.StringType()),
        T.StructField("segments", T.IntegerType()), T.StructField("payload", T.BinaryType()),
    ]
)
_PART = T.StructType(
    [
        *RECORD.fields[:7], T.StructField("origin", T.StringType()), T.StructField("number", T.IntegerType()),
        T.StructField("total", T.LongType()), T.StructField("block", T.BinaryType()), RECORD.fields[7],
    ]
)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five bytes (ten hex digits) are eight base-32 digits."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _raw(data: Column) -> Column:
    """Bytes as a string, for functions that take strings only; nothing is validated or changed."""
    return data.cast("string")


def _chunked(payload: Column) -> Column:
    """Chunked transfer framing of a binary payload."""
    starts = F.when(F.octet_length(payload) > 0, F.sequence(F.lit(0), F.octet_length(payload) - 1, F.lit(CHUNK_BYTES)))
    chunks = F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda at: F.concat(
            F.lower(F.hex(F.least(F.lit(CHUNK_BYTES), F.octet_length(payload) - at))), F.lit("\r\n"),
            _raw(F.substring(payload, at + 1, F.lit(CHUNK_BYTES))), F.lit("\r\n"),
        ),
    )
    return F.concat(F.array_join(chunks, ""), F.lit("0\r\n\r\n"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Writes pages, fetched at date, as gzip-compressed WARC files under path."""
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", base32_sha1(F.col("payload")))
    keys = base.select("id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = keys.join(firsts, "digest").where("NOT (id <=> first)").distinct()
    again = again.select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    marked = base.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    marked = marked.withColumn("revisit", F.col("again_digest").isNotNull())

    def head(fields: list[tuple[str, Column]], block: Column) -> Column:
        """A record: version, the fields that are not null, length and block."""
        lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields]
        return F.concat(
            F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block
        )

    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("digest"))
    message = F.when(
        F.col("revisit"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n")),
    ).otherwise(
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n"), _chunked(F.col("payload")))
    )
    blocks = marked.select("id", "url", "digest", "revisit", "first", urn.alias("urn"), message.cast("binary").alias("message"))
    blocks = blocks.withColumn("total", F.octet_length("message").cast("long"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(SEGMENT_BYTES))).alias("at")).drop("payload")
    number = (F.col("at") / SEGMENT_BYTES).cast("int") + 1
    block = _raw(F.substring(F.col("message"), (F.col("at") + 1).cast("int"), F.lit(SEGMENT_BYTES)))
    cut = F.col("total") > SEGMENT_BYTES
    is_first, is_last = F.col("at") == 0, F.col("at") + SEGMENT_BYTES >= F.col("total")
    fields = [
        ("WARC-Type", F.when(~is_first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", F.when(is_first, F.concat("urn", F.lit(">"))).otherwise(F.concat(F.col("urn"), F.lit(":"), number.cast("string"), F.lit(">")))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        ("WARC-Page-ID", F.coalesce(F.col("id").cast("string"), F.lit("null"))),
        ("WARC-Payload-Digest", F.when(is_first, F.concat(F.lit("sha1:"), F.col("digest")))),
        ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(":"), F.col("digest"), F.lit(">")))),
        ("WARC-Segment-Number", F.when(cut, number)),
        ("WARC-Segment-Origin-ID", F.when(~is_first, F.concat("urn", F.lit(">")))),
        ("WARC-Segment-Total-Length", F.when(cut & is_last, F.col("total"))),
        ("Content-Type", F.when(is_first, "application/http;msgtype=response")),
    ]
    records = blocks.select(head(fields, block).alias("value"))
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + 4, int(fields["Content-Length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, data[start : start + size]
        at = start + size + 4


def decode_chunked(body: bytes) -> bytes:
    """The payload of a chunked message body."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        at = end + 4 + size


def decode_message(message: bytes, digest: str, revisit: bool) -> tuple[int, str, bytes | None]:
    """(payload bytes, digest, payload) of an HTTP message; a revisit has no payload but says its length."""
    head, _, body = message.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    if revisit:
        return int(fields["Content-Length"]), digest, None
    payload = decode_chunked(body) if fields.get("Transfer-Encoding") == "chunked" else body
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found != digest:
        raise ValueError(f"payload digest {found} is not {digest}")
    return len(payload), found, payload


def _number(text: str | None) -> int | None:
    return None if text in (None, "null") else int(text)


def _parts(data: bytes, keep_payload: bool) -> Iterator[dict]:
    for fields, block in parse_records(data):
        kind = fields["WARC-Type"]
        row = {
            "page_id": _number(fields["WARC-Page-ID"]), "target_uri": fields.get("WARC-Target-URI"), "record_type": kind, "segments": 1,
            "payload_digest": fields.get("WARC-Payload-Digest", "sha1:")[5:],
            "refers_to": _number(fields["WARC-Refers-To"].split(":")[2]) if "WARC-Refers-To" in fields else None,
        }
        if "WARC-Segment-Number" in fields:
            total = fields.get("WARC-Segment-Total-Length")
            yield row | {
                "origin": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "number": int(fields["WARC-Segment-Number"]),
                "total": total and int(total), "block": block,
            }
        else:
            size, digest, payload = decode_message(block, row["payload_digest"], kind == "revisit")
            yield row | {"payload_bytes": size, "payload_digest": digest, "payload": payload if keep_payload else None}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of WARC files under path, as RECORD; payload is null for revisits, or throughout if not kept."""
    from pyspark.sql.pandas.types import to_arrow_schema

    part_schema, record_schema = to_arrow_schema(_PART), to_arrow_schema(RECORD)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for data in batch.column(0):
                    data = data.as_py()
                    yield from _parts(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data, keep_payload)

        yield from _batches(rows(), part_schema, 256)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    every = sorted(row["parts"], key=lambda p: p["number"])
                    last = every[-1]["number"]
                    copies = max(1, len(every) // last)  # repeated rows share their record's id
                    parts = every[::copies]
                    message = b"".join(p["block"] for p in parts)
                    if [p["number"] for p in every] != [n for n in range(1, last + 1) for _ in range(copies)] or parts[-1]["total"] != len(message):
                        raise ValueError(f"segments of {row['origin']} do not add up to their total length")
                    size, digest, payload = decode_message(message, parts[0]["payload_digest"], False)
                    yield from copies * [{
                        "page_id": parts[0]["page_id"], "payload_bytes": size, "payload_digest": digest, "record_type": parts[0]["record_type"],
                        "refers_to": None, "target_uri": parts[0]["target_uri"], "segments": len(parts), "payload": payload if keep_payload else None,
                    }]

        yield from _batches(rows(), record_schema, 64)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = files.mapInArrow(parse, _PART)
    whole = parts.where("origin IS NULL").select(*RECORD.names)
    fields = ("number", "total", "block", "page_id", "payload_digest", "record_type", "target_uri")
    cut = parts.where("origin IS NOT NULL").groupBy("origin").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    return whole.unionByName(cut.mapInArrow(assemble, RECORD))


def op3(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("segments").cast("long").alias("segments")
    )


#: In DuckDB: digests, first pages and lengths straight from the table.
ORACLE = r"""
WITH base AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hexed FROM pages
), digested AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload,
         list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hexed, 1 + 10 * (i // 8)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT), 1)), 'string_agg', '') AS payload_digest
  FROM base
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM digested
), messages AS (
  SELECT *, 72 + 5 + payload_bytes
            + list_sum(list_transform(range(0, payload_bytes, 1024), lambda p: 4 + length(format('{:x}', least(1024, payload_bytes - p)))))::BIGINT AS framed
  FROM firsts
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       CASE WHEN page_id <> first_id OR payload_bytes = 0 THEN 1 ELSE ceil(framed / 4096.0) END::BIGINT AS segments
FROM messages
"""
