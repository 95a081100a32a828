"""WARC archives: a writer that replaces repeated payloads by revisits, and a reader that salvages damaged files."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm.common import bound_batches, new_path

#: Payloads below this many bytes are never replaced by a revisit.
REVISIT_FROM = 1000
#: Bytes from which on an archive file is complete.
FILE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UUID = "00000000-0000-4000-"
_NAMELESS = "00000000-0000-8000-"


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to of every page.

    Of pages with equal payloads of at least REVISIT_FROM bytes the one with the
    largest page_id is the response, and refers_to names it in the others.  Only
    digests that occur twice or more are joined back, one row each, so a payload
    that very many pages share splits like any skewed join.

    Null html is an empty payload, a null url an empty target.  Repeated rows of
    the largest page_id are responses each.  A null page_id is none of the
    largest, so that such a page is a revisit where one with an id has its
    payload, else a response.  Other columns are not read.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    shared = p.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").drop("n")
    joined = p.join(shared, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when((F.col("payload_bytes") >= REVISIT_FROM) & ~F.col("page_id").eqNullSafe(F.col("target")), F.col("target"))).drop("target")


def _record_id(page: Column) -> Column:
    """A name of its own for each page; pages without id are named by their payload."""
    h = F.coalesce(F.lower(F.lpad(F.hex(page), 16, "0")), F.substring("payload_digest", 1, 16))
    kind = F.when(page.isNull(), _NAMELESS).otherwise(_UUID)
    return F.concat(F.lit("<urn:uuid:"), kind, F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12), F.lit(">"))


def record_of(date: str) -> Column:
    """The text of a page's record."""
    end = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("payload_bytes"), F.lit(end + end))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{end}WARC-Date: {date}{end}WARC-Target-URI: "), uri,
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{end}WARC-Block-Digest: sha1:"), F.sha1(block),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: {PROFILE}{end}WARC-Refers-To: "), _record_id(F.col("refers_to")))).otherwise(""),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "), F.octet_length(block),
        F.lit(end + end), block, F.lit(end + end),
    )


#: A member without content, whose last byte is that of its length.
_NOTHING = gzip.compress(b"", mtime=0)


def _member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte: the highest of its content's length, or that of an empty member behind it."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + _NOTHING


def write_archives(pages: DataFrame, path: str, *, date: str = "2024-02-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """One record and one gzip member a page, in files of about ``file_bytes`` bytes, by Spark's own writer.

    A task's members are joined to archives, each a row, and each row is a file.
    Spark's text writer ends a row by a separator; here that is the zero byte in
    which every member ends, so that a file holds whole members and nothing else.
    The writer commits a task's files when the task has ended, so a lost
    executor leaves no half archive, and any file system that Spark writes to
    will do.  Rows that repeat a page are records each; ``with_roles`` says what
    null fields become.
    """
    spark = pages.sparkSession
    bound_batches(spark)

    def archives(batches):
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                held.append(_member(record.as_py()))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    records = with_roles(pages).select(F.encode(record_of(date), "utf-8").alias("record")).mapInArrow(archives, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    at: int = 0
    end: int = 0


@dataclass
class Gap:
    """Bytes [start, end) of a file that gave no record, or, of a gzip member, not all that were in it."""

    start: int
    end: int
    why: str


@dataclass
class Salvage:
    """Reads the records of an archive of plain text or gzip members, whatever befell it.

    A record counts if its version line, headers, length, closing line ends and
    block digest are right.  After one that fails, the reader looks for the next
    version line behind it; after a gzip member that fails, for the next member
    that inflates.  What lies between is logged as a gap.
    """

    gaps: list[Gap] = field(default_factory=list)

    def read(self, data: bytes) -> Iterator[Record]:
        at = 0
        while at < len(data):
            if data.startswith(b"\x1f\x8b\x08", at):
                used, content, why = _inflate(data, at)
                end = used or self._next(data, at + 1)
                faults: list[Gap] = []
                for record in self._records(content, 0, faults):
                    record.at, record.end = at, end
                    yield record
                if why or faults:
                    self.gaps.append(Gap(at, end, why or faults[0].why))
                at = end
            elif data.startswith(b"WARC/1.", at):
                member = data.find(b"\r\n\r\n\x1f\x8b\x08", at)
                stop = member + 4 if member >= 0 else len(data)
                yield from self._records(data[at:stop], at, self.gaps)
                at = stop
            else:
                end = self._next(data, at + 1)
                self.gaps.append(Gap(at, end, "neither a member nor a version line"))
                at = end

    @staticmethod
    def _next(data: bytes, at: int) -> int:
        """The next member that begins a record, or version line; the end if there is none."""
        while at < len(data):
            found = [x for x in (data.find(b"\x1f\x8b\x08", at), data.find(b"WARC/1.", at)) if x >= 0]
            if not found:
                break
            at = min(found)
            if data[at] == 0x57 or _starts(data, at):
                return at
            at += 1
        return len(data)

    @staticmethod
    def _records(data: bytes, base: int, gaps: list[Gap]) -> Iterator[Record]:
        at, bad, why = 0, None, ""
        while at < len(data):
            record, end, fault = _parse(data, at)
            if record is None:
                if bad is None:
                    bad, why = at, fault
                at = data.find(b"WARC/1.", at + 1)
                if at < 0:
                    break
                continue
            if bad is not None:
                gaps.append(Gap(base + bad, base + at, why))
                bad = None
            record.at, record.end = base + at, base + end
            yield record
            at = end
        if bad is not None:
            gaps.append(Gap(base + bad, base + len(data), why))


def _starts(data: bytes, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _inflate(data: bytes, at: int) -> tuple[int, bytes, str]:
    """(end of the member, its content, fault); after a fault what was inflated before it, and where to look on."""
    z, out, view, step = zlib.decompressobj(31), [], memoryview(data), 1 << 16
    pos = at
    while pos < len(data):
        part = view[pos : pos + step]
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            return 0, b"".join(out), f"gzip: {str(e).rpartition(':')[2].strip()}"
        pos += len(part)
        if z.eof:
            return pos - len(z.unused_data), b"".join(out), ""
    return 0, b"".join(out), "gzip: the member is cut off"


_LENGTH = re.compile(rb"\d{1,15}")


def _parse(data: bytes, at: int) -> tuple[Record | None, int, str]:
    if not re.compile(rb"WARC/1\.\d\r\n").match(data, at):
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None, at, "headers without end"
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "a header without colon"
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not _LENGTH.fullmatch(headers.get("content-length", "").encode()):
        return None, at, "no length"
    start, end = head + 4, head + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no closing line ends where the length says"
    block, digest = data[start:end], headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:].lower() != hashlib.sha1(block).hexdigest():
        return None, at, "the block digest differs"
    return Record(headers, block), end + 4, ""


def _page(uuid: str) -> int | None:
    found = re.fullmatch(rf"<urn:uuid:{_UUID}([0-9a-f]{{4}})-([0-9a-f]{{12}})>", uuid)
    if not found:
        return None
    n = int(found[1] + found[2], 16)
    return n - (1 << 64) if n >> 63 else n


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, gap_start long, gap_end long, gap_why string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, and a row of type ``gap`` for each run of bytes that gave none.

    payload_bytes and payload_digest are those of the full payload; for a
    response they are computed from what was read, for a revisit they are what
    its headers say of the payload it stands for.  A payload that differs from
    its record's digest makes the record a gap.  No file gives no rows.
    """
    bound_batches(spark)

    def rows(name: str, data: bytes):
        salvage = Salvage()
        for r in salvage.read(data):
            http, _, payload = r.block.partition(b"\r\n\r\n")
            kind, digest = r.headers.get("warc-type", ""), r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
            target = _page(r.headers.get("warc-refers-to", ""))
            if kind == "revisit":
                size, payload = int(length[1]) if length else None, None
            else:
                size, own = len(payload), hashlib.sha1(payload).hexdigest()
                if digest and digest != own:
                    salvage.gaps.append(Gap(r.at, r.end, "the payload digest differs"))
                    continue
                digest = own
            yield _page(r.headers.get("warc-record-id", "")), r.headers.get("warc-target-uri", ""), kind, target, size, digest, payload, name, None, None, None
        for g in salvage.gaps:
            yield None, None, "gap", None, None, None, None, name, g.start, g.end, g.why

    schema = pa.schema([pa.field(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in RECORDS.split(", ")])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                part, held = [], 0
                for row in rows(name.as_py(), data.as_py()):
                    part.append(row)
                    held += len(row[6] or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as target from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {REVISIT_FROM} and page_id is distinct from target and target is not null then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {REVISIT_FROM} and page_id is distinct from target then target end as refers_to
from m
"""
