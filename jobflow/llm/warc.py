"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing is Spark's own text writer: a record is one value (header lines, blank line, payload) and
the line separator is the blank pair that ends a record, so files are splittable work, committed
by Spark's protocol, and a lost executor's half-written file never becomes visible.

Reading takes whole files (the writer bounds their records). A record is checked by its
version line, its length, the end mark behind its block, and its digest. When a check fails, the
reader searches the next gzip member or version line, goes on from there, and logs the bytes
between as a quarantined gap with the reason. Gzip files hold a member per record.

Nulls: a null html is an empty payload, a null url an empty target, a null page_id the text
``null``. Equal small payloads stay responses. Repeated ids each write a record. Empty tables
give no files and no rows.
"""

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.llm.common import written
from jobflow.llm.registry import query
from jobflow.session import scratch_path

END = "\r\n\r\n"
VERSION = "WARC/1.1"
REVISIT_BYTES = 1000
FILE_RECORDS = 2000
RECORD_SCHEMA = (
    "file string, offset bigint, record_type string, record_id string, target string, payload_digest string,"
    " refers_to string, payload binary, gap_bytes bigint, gap_reason string"
)
_STEP = 1 << 16
_MEMBER, _LINE = b"\x1f\x8b\x08", re.compile(rb"WARC/[01]\.[0-9]\r?\n")


def archive_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, record): the text of one record per page.

    Of equal payloads of ``least`` bytes or more the largest page_id is the response. The groups
    are reduced to (digest, largest id, count) before the shuffle; only digests that repeat are
    joined back, so common payloads cost no more than rare ones.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
                        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    keys = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    keys = written(keys, "payloads")
    rows = rows.join(keys, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    page, none = F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("")
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A")),
        F.lit("WARC-Date: 2024-01-31T00:00:00Z"), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("bytes")).cast("string")),
    ]
    body = F.when(revisit, none).otherwise(F.col("html"))
    return rows.select("page_id", F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body).alias("record"))


def write_archive(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write record texts as archive files of at most ``file_records`` records."""
    records.select(F.col("record").alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", file_records).text(path)


def _headers(block: bytes) -> dict:
    fields = {}
    for line in block.decode("utf-8", "replace").split("\n")[1:]:
        name, _, value = line.strip("\r").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _bare(value: str | None) -> str | None:
    return value.removeprefix("<urn:page:").removesuffix(">") if value else None


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` of plain bytes and the offset behind it; ValueError says what is wrong."""
    import hashlib

    if not _LINE.match(data, at):
        raise ValueError("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise ValueError("no end of header")
    fields = _headers(data[at:head])
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no length")
    start, stop = head + 4, head + 4 + int(length)
    if stop > len(data):
        raise ValueError("block is cut off")
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("no end mark behind the block")
    payload, kind = data[start:stop], fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind != "revisit" and digest and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("digest differs")
    return {"record_type": kind, "record_id": _bare(fields.get("warc-record-id")), "target": fields.get("warc-target-uri"),
            "payload_digest": digest, "refers_to": _bare(fields.get("warc-refers-to")), "payload": payload}, stop + 4


def _member(data: bytes, at: int) -> tuple[dict, int]:
    """The record in the gzip member at ``at`` and the offset behind the member."""
    unzip, parts, till = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof and till < len(data):
            parts.append(unzip.decompress(data[till:till + _STEP]))
            till = min(till + _STEP, len(data))
    except zlib.error as e:
        raise ValueError("member is damaged") from e
    if not unzip.eof:
        raise ValueError("member is cut off")
    plain = b"".join(parts)
    record, end = _record(plain, 0)
    if end != len(plain):
        raise ValueError("more than a record in a member")
    return record, till - len(unzip.unused_data)


def salvage(data: bytes):
    """Records and gaps of one file, in order: dicts with ``offset``, and for a gap ``gap_bytes``
    and ``gap_reason``."""
    at, size = 0, len(data)
    while at < size:
        try:
            record, end = (_member if data.startswith(_MEMBER, at) else _record)(data, at)
            yield record | {"offset": at}
            at = end
        except ValueError as e:
            line, member = _LINE.search(data, at + 1), data.find(_MEMBER, at + 1)
            found = [x for x in (line.start() if line else -1, member) if x >= 0]
            end = min(found, default=size)
            yield {"offset": at, "gap_bytes": end - at, "gap_reason": str(e)}
            at = end


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files below ``path``, and a row with ``gap_bytes`` per quarantined gap.

    Neighbouring gaps are logged one by one: each names the check that failed there.
    """
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def parse(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for row in salvage(content.as_py()):
                    rows.append({"file": file.as_py()} | row)
                    held += len(row.get("payload") or b"")
                    if held > 1 << 22 or len(rows) >= 2000:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def _batch(rows, names) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "gap_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND first <> page_id THEN first END AS refers_to
FROM m
"""


@query("op10_warc", OP10_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back; sizes of revisits come from the records they name."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "archive")
    write_archive(archive_records(pages), path)
    back = read_archive(spark, path).where("gap_bytes IS NULL").select(
        F.col("record_id").try_cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("bytes"),
        "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
    back = written(back, "records")
    named = written(back.where("record_type = 'revisit'").select(
        F.col("refers_to").alias("page_id")).distinct(), "named")
    full = back.where("record_type = 'response'").join(named, "page_id", "left_semi").groupBy(
        F.col("page_id").alias("refers_to")).agg(F.max("bytes").alias("full"))  # an id may have several rows
    full = written(full, "full")
    return back.join(full, "refers_to", "left").select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to")
