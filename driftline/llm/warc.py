"""WARC archives: writing deduplicated records and reading them back in sequence.

Writer: payloads are equal when their SHA-1 is; of the records of one payload that
with the largest id is a response and the others are revisit records, which hold the
HTTP header block only.  Each record is a gzip member of its own.  Archives are binary
rows of about ARCHIVE_BYTES, kept as a Parquet table in the shared folder, since only
Spark's own readers and writers reach every store; `archive_files` gives the same rows
for .warc.gz files.

Reader: inflates an archive member by member in steps of STEP bytes, so that no more
than one record is held, frames each block by its Content-Length, whatever the record's
type and the case of its header names, and verifies block and payload digests that are
given; a wrong digest or frame raises ValueError.

Defined cases: null html is an empty payload; a null id is written as `null` and never
chosen over another id; rows that repeat the chosen id are responses all; an empty table gives no
archive and no rows; a very long html is one record; columns beside id, url and html,
whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

ARCHIVE_BYTES = 8 << 20
STEP = 64 << 10
#: Payloads from this size on are deduplicated.
MIN_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member with a WARC record; a revisit record holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(archive: bytes, step: int = STEP) -> Iterator[bytes]:
    """Each gzip member's content, inflated incrementally."""
    view, at = memoryview(archive), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a gzip member")
            part = view[at : at + step]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def fields_of(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
        else:
            raise ValueError(f"bad header line {line[:80]!r}")
    return out


def verify(label: str | None, data: bytes, what: str) -> None:
    """Checks a digest label such as sha1:BASE32 or sha256:hex; none, or one of an unknown kind, is not checked."""
    kind, _, digest = (label or "").partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5") or not digest:
        return
    raw = hashlib.new(kind, data).digest()
    if digest.lower() != raw.hex() and digest.upper().rstrip("=") != base64.b32encode(raw).decode().rstrip("="):
        raise ValueError(f"bad {what} digest")


def parse(member: bytes) -> dict:
    """A record's fields (names in lower case), block and payload, framed by Content-Length, digests verified where they are given.

    The payload of a request or response is what follows the HTTP header, that of a revisit isn't there,
    that of other records is the block.  payload_bytes is the payload's length, for a revisit the one its HTTP header tells, if any.
    """
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = fields_of(lines[1:])
    name = fields.get("warc-record-id")
    if not fields.get("content-length", "").isdigit():
        raise ValueError(f"no length in {name}")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"bad frame in {name}")
    verify(fields.get("warc-block-digest"), block, f"block ({name})")
    kind, http = fields.get("warc-type", ""), None
    if fields.get("content-type", "").lower().startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        http = fields_of(top.decode("latin-1").split("\r\n")[1:])
    else:
        body = block
    size = int(http["content-length"]) if http and http.get("content-length", "").isdigit() else None
    if kind == "revisit":
        return {"fields": fields, "payload": None, "payload_bytes": size}
    if kind == "response" and size is not None and "transfer-encoding" not in http and size != len(body):
        raise ValueError(f"bad payload length in {name}")
    verify(fields.get("warc-payload-digest"), body, f"payload ({name})")
    return {"fields": fields, "payload": body, "payload_bytes": len(body)}


def uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def of_uri(text: str | None) -> int | None:
    name = text[len("<urn:page:") : -1] if text else "null"
    return None if name == "null" else int(name)


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, record_type, refers_to: what to write for each page."""
    src = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("sha", F.unhex(F.sha1("payload")))
    # decided on (id, digest) alone; then joined back by both, so that the payloads of a popular page are spread by id
    narrow = src.where(F.length("payload") >= min_bytes).select("page_id", "sha")
    several = narrow.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to")
    again = written(narrow.join(small(written(several)), "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).distinct().select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "refers_to"))
    out = src.join(small(again), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    return out.select("page_id", "url", "payload", F.when(F.col("_sha").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to")


def write_archives(plan: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The archives, as a table (content binary, records long) in the shared folder."""

    def write(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "record_type", "refers_to")]
                held.append(record(row[3], uri(row[0]), " ".join(row[1].split()), row[2], uri(row[4])))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"content": [b"".join(held)], "records": [len(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"content": [b"".join(held)], "records": [len(held)]})

    return written(plan.mapInArrow(write, "content binary, records long"), "none")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """.warc.gz files as rows for read_archives.  A file is one row, since gzip members have no index: of 2 GB at most, Spark's bound for a value."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of any type: record_id, target_uri, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits, or if not asked for).

    Fields that a record doesn't have are null.  A revisit whose response is in the same archive must have its payload digest.
    """
    schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for batch in batches:
            for content in batch.column("content"):
                rows, size, digests, revisits = [], 0, {}, []
                for member in members(content.as_buffer()):
                    r = parse(member)
                    f = r["fields"]
                    kind, label = f.get("warc-type"), f.get("warc-payload-digest")
                    if kind == "response":
                        digests[f.get("warc-record-id")] = label
                    elif kind == "revisit":
                        revisits.append((f.get("warc-refers-to"), label))
                    rows.append((f.get("warc-record-id"), f.get("warc-target-uri"), kind, f.get("warc-refers-to"), label and label.partition(":")[2], r["payload_bytes"], r["payload"] if payloads else None))
                    size += len(rows[-1][-1] or b"") + 200
                    if size > ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                for of, label in revisits:
                    if label and digests.get(of, label) != label:
                        raise ValueError(f"a revisit of {of} has another digest")
                if rows:
                    yield batch_of(rows)

    return archives.select("content").mapInArrow(read, "record_id string, target_uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def _page(column: str) -> F.Column:
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archives(write_archives(planned(table(spark, sf_dir, "pages"))), payloads=False)
    return read.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))


#: DuckDB has no base-32 function: the digest's 40 hex digits go through 5-bit groups.
SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS k FROM p GROUP BY h),
bits AS (SELECT h, string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (position(substr(h, i::INT, 1) IN '0123456789abcdef') - 1) + 1, 4), '' ORDER BY i) AS s FROM g, range(1, 41) AS x(i) GROUP BY h),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(s, 5 * i::INT + 1, 1)::INT + 8 * substr(s, 5 * i::INT + 2, 1)::INT + 4 * substr(s, 5 * i::INT + 3, 1)::INT + 2 * substr(s, 5 * i::INT + 4, 1)::INT + substr(s, 5 * i::INT + 5, 1)::INT, 1), '' ORDER BY i) AS digest FROM bits, range(0, 32) AS x(i) GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> k THEN k END AS refers_to
FROM p JOIN g USING (h) JOIN d USING (h)
"""
