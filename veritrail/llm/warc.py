"""WARC archives: records written through Spark's text writer, and a reader that salvages damaged files.

A compressed archive has a gzip member for each record, so that damage costs the records it hits.
Spark has no writer of binary files, but its text writer writes bytes as they are and ends each
row with a separator. The last byte of a member is the highest of the record's length, 0 for
records below 16 MB, so a zero byte as separator completes each member, and the files hold
nothing but members.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, table

LOG = logging.getLogger(__name__)

#: Payloads from this size may be replaced by a revisit record.
REVISIT_BYTES = 100
#: Records of one archive file at most, so that a file stays small in a reader's memory.
FILE_RECORDS = 2000
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
_TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}
_ID, _NAME = re.compile(r"<[^<>\s]+>"), re.compile(r"[a-z0-9-]+")
_CHUNK = 1 << 20


# --- writing -----------------------------------------------------------------------------


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, digest, size, first_id`` of every page.

    ``first_id`` is the smallest page_id among pages with an equal payload of at least
    ``REVISIT_BYTES`` bytes, or null if there is one page only. Winners come from an aggregate
    with map-side combining; the join that carries the payloads is one that Spark splits where
    a digest is frequent. Small payloads get a key of their own each and meet nowhere.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    html = F.coalesce(F.col(html_col), F.lit(""))
    full = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    groups = (
        full.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(F.col("digest").alias("key"), "first_id")
    )
    keyed = full.withColumn("key", F.when(F.col("size") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    return keyed.join(groups, "key", "left").drop("key")


def _is_revisit() -> Column:
    return F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))


def record_text(rows: DataFrame) -> DataFrame:
    """One column ``value``: the text of each row's record without the blank lines that end it."""
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(_END))
    block = F.when(_is_revisit(), http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.when(_is_revisit(), "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(_is_revisit(), f"WARC-Profile: {_PROFILE}"),
        F.when(_is_revisit(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block).alias("value"))


def member(record: bytes) -> bytes:
    """The record as a gzip member that ends in a zero byte; an empty member follows a record whose own doesn't."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    return out if out[-1] == 0 else out + member(b"")


def _members_but_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            records = batch.column(0).slice(at, 64)
            yield pa.RecordBatch.from_arrays([pa.array([member(r.as_buffer().to_pybytes() + _END.encode())[:-1] for r in records], pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes a record per page under ``path``: WARC/1.1, as gzip members or, with ``none``, as they are.

    A null html is an empty payload, a null url leaves the target out, a null page_id has an
    empty name; payloads may be of any length below 2 GB. Rows that repeat a page are records of
    their own. An empty table writes no record; columns but page_id, url and html are not read.
    In plain files the line separator of the text writer is the pair of blank lines that ends a
    record. Records are streamed and never gathered.
    """
    records = record_text(revisits(pages))
    separator = _END
    if compression == "gzip":
        packed = records.select(F.col("value").cast("binary")).mapInArrow(_members_but_ends, "value binary")
        records, separator = packed.select(F.col("value").cast("string")), "\0"
    elif compression != "none":
        raise ValueError(f"compression must be gzip or none, not {compression}")
    records.write.option("lineSep", separator).option("maxRecordsPerFile", FILE_RECORDS).text(path)


# --- reading -----------------------------------------------------------------------------


@dataclass
class Record:
    offset: int
    type: str
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP headers, or the block if it isn't HTTP."""
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def stated_bytes(self) -> int:
        """Content-Length of the HTTP headers."""
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else len(self.payload)


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def _stated(digest: str) -> tuple[str, bytes] | None:
    """Name and bytes of a digest header, in hex or base 32; null if it is of no known kind."""
    name, colon, value = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size, value = hashlib.new(name).digest_size, value.strip()
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return name, b""


def _check_digests(record: Record) -> None:
    """ValueError if a digest of the record's own bytes is wrong.

    A block digest speaks for the whole block. A payload digest counts where there is no block
    digest; that of a revisit is another record's, that of a cut off payload may be of the whole.
    """
    block = _stated(record.headers.get("warc-block-digest", ""))
    if block:
        if hashlib.new(block[0], record.block).digest() != block[1]:
            raise ValueError("the block has another digest")
        return
    payload = _stated(record.headers.get("warc-payload-digest", ""))
    if not payload or record.type == "revisit" or "warc-truncated" in record.headers:
        return
    if hashlib.new(payload[0], record.payload).digest() != payload[1]:
        raise ValueError("the payload has another digest")


def _read_record(data: bytes, at: int, doubtful: bool = False) -> tuple[Record, int]:
    """The record at ``at`` and where it ends; ValueError names the check that failed.

    In ``doubtful`` bytes a record needs sound headers besides, for which no digest speaks.
    """
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise ValueError("headers without an end")
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not (headers.get("warc-type") and headers.get("warc-record-id")):
        raise ValueError("no type or record id")
    if not re.fullmatch(r"\d+", headers.get("content-length", "")):
        raise ValueError("no content length")
    start, end = head + 4, head + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block does not end in blank lines")
    record = Record(at, headers.get("warc-type", ""), headers, data[start:end])
    sound = record.type in _TYPES and _ID.fullmatch(headers.get("warc-record-id", "")) and all(map(_NAME.fullmatch, headers))
    _check_digests(record)
    if doubtful and not sound:
        raise ValueError("odd headers in a damaged member")
    return record, end + 4


def salvage_records(data: bytes, base: int = 0, doubtful: bool = False) -> Salvage:
    """All records of plain WARC bytes that pass their checks.

    After a failed check the next version line is tried; the bytes between are a gap. ``base`` is added to all offsets.
    """
    out, at = Salvage(), 0
    while at < len(data):
        try:
            record, end = _read_record(data, at, doubtful)
            record.offset += base
            out.records.append(record)
            at = end
        except ValueError as why:
            start = at
            found = _VERSION.search(data, at + 1)
            at = found.start() if found else len(data)
            if out.gaps and out.gaps[-1].end == base + start:
                out.gaps[-1].end = base + at
            else:
                out.gaps.append(Gap(base + start, base + at, str(why)))
    return out


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Bytes of the gzip member at ``at``, where it ends or fails, and what is wrong with it.

    zlib drops what a failing call has inflated, so the call is made again from a copy in
    smaller steps, down to single bytes, of which all output before the failure is taken.
    """
    inflate, parts, place, size, wrong = zlib.decompressobj(31), [], at, _CHUNK, ""
    while not inflate.eof and place < len(data):
        before = inflate.copy()
        try:
            parts.append(inflate.decompress(data[place : place + size]))
            place = min(place + size, len(data))
        except zlib.error as why:
            inflate, wrong = before, str(why)
            if size == 1:
                parts += _last_bytes(inflate, data[place : place + 1])
                break
            size = max(1, size // 32)
    if wrong:
        return b"".join(parts), place, wrong
    if not inflate.eof:
        return b"".join(parts), place, "the member is cut off"
    return b"".join(parts), place - len(inflate.unused_data), ""


def _last_bytes(inflate, byte: bytes) -> Iterator[bytes]:
    """What one byte, in which the inflation fails, gives before it does."""
    try:
        while out := inflate.decompress(byte, 1):
            yield out
            byte = inflate.unconsumed_tail
    except zlib.error:
        return


def salvage(data: bytes) -> Salvage:
    """Records and gaps of a file, plain or of gzip members (one a record, or one for many).

    Offsets in a member count from the member's start for gaps inside it; a damaged member is
    read as far as it inflates, and the search goes on at the next place where a member with a
    version line begins. The gap of a damaged member is from where it fails to that place.
    """
    if data[:2] != b"\x1f\x8b":
        plain = salvage_records(data)
        if plain.records or b"\x1f\x8b\x08" not in data:
            return plain
    out, at = Salvage(), 0
    while at < len(data):
        body, end, wrong = _member(data, at) if data[at : at + 3] == b"\x1f\x8b\x08" else (b"", at, "no gzip member")
        inside = salvage_records(body, at, bool(wrong))
        out.records += inside.records
        out.gaps += inside.gaps
        if not wrong:
            at = end
            continue
        start, at = at, at + 1
        while at < len(data):
            at = data.find(b"\x1f\x8b\x08", at)
            if at < 0:
                at = len(data)
            elif _starts_record(data, at):
                break
            else:
                at += 1
        out.gaps.append(Gap(max(start, min(end, at)), at, wrong))
    return out


def _starts_record(data: bytes, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 16).startswith(b"WARC/")
    except zlib.error:
        return False


_ROWS = "file string, offset long, reason string, gap_end long, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string"


def _row(name: str, x: Record | Gap) -> tuple:
    if isinstance(x, Gap):
        return (name, x.start, x.reason, x.end, *[None] * 7)
    revisit = x.type == "revisit"
    body = b"" if revisit else x.payload
    digest = x.headers.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
    return (name, x.offset, None, None, x.type, x.headers.get("warc-record-id"), x.headers.get("warc-target-uri"), digest, x.stated_bytes if revisit else len(body), x.headers.get("warc-refers-to"), body)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record and per quarantined gap (``reason`` not null) of all files under ``path``.

    ``payload_digest`` and ``payload_bytes`` of a revisit are those that it states of the full
    payload. With ``payloads`` a binary column ``payload`` follows. Gaps are logged as well.
    Works through Spark's reader, so on any file system; a file, which Spark gives as one value
    and so below 2 GB, is held in memory with what it inflates to by the task that reads it. A
    folder without records gives no rows.
    """
    schema = _ROWS + (", payload binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, content = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                found = salvage(content)
                for g in found.gaps:
                    LOG.warning("%s: bytes %d to %d quarantined: %s", name, g.start, g.end, g.reason)
                items = [*found.records, *found.gaps]
                for i in range(0, len(items), 500):
                    columns = list(zip(*(_row(name, x) for x in items[i : i + 500])))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
                    names = [f.split()[0] for f in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[: len(names)], kinds)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def _page(col: str) -> Column:
    return F.regexp_extract(F.col(col), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive_round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes all pages under ``path``, reads them back and returns a row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A page whose page_id is
    null comes back with null. Rows that repeat the smallest page_id are responses, all of them.
    See :func:`write_warc` for null, empty and long payloads, an empty table and other columns.
    A gap in what is read back ends the job with its file, place and reason.
    """
    write_warc(pages, path)
    back = read_warc(pages.sparkSession, path)
    what = F.concat_ws(" ", F.lit("damaged archive:"), "file", F.col("offset").cast("string"), "reason")
    whole = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(what).cast("boolean"))
    revisited = F.when(F.col("record_type") == "revisit", _page("refers_to")).alias("refers_to")
    return back.where(whole).select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", revisited)


def op9_warc(spark, sf_dir):
    """Archives of all ``pages``, written and read back by :func:`archive_round_trip`."""
    return archive_round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
             CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM q
"""
