"""WARC archives as a chunked record table.

A record is rows (record, chunk number) of at most ``CHUNK`` payload bytes.  Writers and readers pass
over these rows in order and hold one chunk at a time, so no task ever allocates a whole record: the
table of pages is cut into chunks, each task appends the chunks it reads to archives of its own
(gzip, one member per record), and reading an archive gives the chunk table back.  Every chunk row that
is read carries the digest and the byte count of the payload so far, so the last chunk of a record has
the digest of the whole, compared with the one in its header, and no rows have to be gathered.

Records with equal payloads are written once: the payload of the largest id is a ``response``, the
others are ``revisit`` records that name it.  Archives have unique names and count once the manifest
lists them; what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidex.session import cut_lineage, scratch_path

CHUNK = 256 << 10  # payload bytes of a row
ARCHIVE = 1 << 30  # compressed bytes after which a task opens its next archive
LEAST = 1000  # bytes from which equal payloads are written once
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CHUNK_FIELDS = (
    "archive string, record_no long, record_id string, target_uri string, record_type string, refers_to string, "
    "stated_bytes long, stated_digest string, chunk_no long, n_bytes long, bytes_so_far long, digest_so_far string, "
    "last boolean, data binary"
)


def filesystem(path: str):
    """(file system, path on it) of a folder that all executors share: local, hdfs, s3 or gs."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^file:/+", "/", path)))


# --- from pages to chunk rows


def record_rows(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest (SHA-1, hex), n_bytes, refers_to (of a revisit, else null).

    Payloads are equal if SHA-256 and length are.  Those of a group with the largest page_id are
    responses (all rows of that id, should it be repeated); rows without an id are revisits if an
    id holds the same payload, else responses.  Payloads under ``least`` bytes are never revisits."""
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"], pages["url"], payload.alias("payload")).withColumn("n_bytes", F.length("payload").cast("long"))
    large = F.col("n_bytes") >= least
    key = F.concat_ws(":", F.sha2("payload", 256), F.col("n_bytes"))
    repeats = (
        rows.where(large).groupBy(key.alias("key"))
        .agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 and first is not null").select("key", "first")
    )
    # Stored first: Spark then knows its size, and moves the pages only if it is not small.
    repeats = cut_lineage(repeats, "repeated-payloads")
    # Small payloads meet nothing; their keys are spread.
    own = F.when(large, key).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id", "url")))
    typed = rows.withColumn("key", own).join(repeats, "key", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return typed.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "n_bytes", refers.alias("refers_to"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """record_id, target_uri, refers_to, digest, n_bytes, chunk_no, data: chunks of a record follow
    each other.  A revisit has one chunk without bytes."""
    last = F.greatest(F.ceil(F.col("n_bytes") / chunk).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("payload"), i * chunk + 1, F.lit(chunk)))
    parts = F.when(F.col("refers_to").isNull(), cut).otherwise(F.array(F.lit(b"")))

    def name(column):
        return F.concat(F.lit("urn:page:"), F.col(column).cast("string"))

    return records.select(
        F.coalesce(name("page_id"), F.lit("urn:page:")).alias("record_id"), F.col("url").alias("target_uri"),
        name("refers_to").alias("refers_to"), "digest", "n_bytes", F.posexplode(parts).alias("chunk_no", "data"),
    )


# --- writing


def clean_uri(uri: str) -> str:
    """Control characters and spaces, which would end a header, percent-encoded."""
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def http_header(n_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes


def record_header(row: dict, date: str) -> bytes:
    """Header of the record and of its HTTP message; the payload follows."""
    http = http_header(row["n_bytes"])
    revisit = row["refers_to"] is not None
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date),
        ("WARC-Target-URI", None if row["target_uri"] is None else clean_uri(row["target_uri"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", f"<{row['refers_to']}>" if revisit else None),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else row["n_bytes"]))),
    ]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http


class Archive:
    """One file being written: records one after the other, each a gzip member of its own."""

    def __init__(self, folder: str, date: str):
        self.path, self.date = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", date
        fs, place = filesystem(self.path)
        self.out, self.records, self.size = fs.open_output_stream(place, compression=None), 0, 0
        self.member = None

    def add(self, row: dict) -> None:
        if row["chunk_no"] == 0:
            self.end_record()
            self.member, self.records = zlib.compressobj(6, zlib.DEFLATED, 31), self.records + 1
            self.put(self.member.compress(record_header(row, self.date)))
        self.put(self.member.compress(row["data"]))

    def put(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def end_record(self) -> None:
        if self.member:
            self.put(self.member.compress(b"\r\n\r\n"))
            self.put(self.member.flush())
            self.member = None

    def close(self) -> tuple[str, int, int]:
        self.end_record()
        self.out.close()
        return self.path, self.records, self.size


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """Write chunk rows to archives below ``folder`` and return the manifest: archive, records, bytes.

    Each task writes what it reads, in order; an archive ends with the record that takes it over
    ``archive_bytes``.  An empty table writes nothing."""
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def run(batches):
        held = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                if held and row["chunk_no"] == 0 and held.size >= archive_bytes:
                    yield entry(held)
                    held = None
                held = held or Archive(folder, date)
                held.add(row)
        if held:
            yield entry(held)

    def entry(held):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in held.close()], ["archive", "records", "bytes"])

    return cut_lineage(chunks.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


# --- reading


class Reader:
    """Records of one archive, a chunk at a time."""

    def __init__(self, path: str, chunk: int):
        fs, place = filesystem(path)
        raw = io.BufferedReader(fs.open_input_stream(place, compression=None), 1 << 18)
        self.path, self.chunk = path, chunk
        self.file = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        self.number = -1

    def fail(self, why: str):
        raise ValueError(f"{self.path}: record {self.number}: {why}")

    def lines(self, first: bytes | None = None) -> tuple[list[bytes], int]:
        """Lines up to an empty one, and the bytes they take."""
        found, size = [], 0
        while True:
            line = self.file.readline(1 << 20) if first is None else first
            first, size = None, size + len(line)
            if not line.endswith(b"\n"):
                self.fail("the header has no end")
            line = line.rstrip(b"\r\n")
            if not line:
                return found, size
            found.append(line)

    @staticmethod
    def fields(lines: list[bytes]) -> dict[str, str]:
        pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    def rows(self):
        """Chunk rows of the response and revisit records; other records are passed over."""
        while True:
            first = self.file.readline(1 << 20)
            while first in (b"\r\n", b"\n"):
                first = self.file.readline(1 << 20)
            if not first:
                return
            self.number += 1
            head, _ = self.lines(first)
            if not head or not head[0].startswith(b"WARC/"):
                self.fail("it does not begin with a version")
            fields = self.fields(head[1:])
            if not fields.get("content-length", "").isdigit():
                self.fail("it states no length")
            left = int(fields["content-length"])
            kind = fields.get("warc-type")
            if kind not in ("response", "revisit"):
                self.skip(left)
                continue
            http, size = self.lines()
            left -= size
            if left < 0:
                self.fail("its HTTP header is longer than its block")
            yield from self.payload(kind, fields, self.fields(http[1:]), left)

    def skip(self, left: int) -> None:
        while left:
            got = self.file.read(min(left, self.chunk))
            if not got:
                self.fail("it is cut off")
            left -= len(got)

    def payload(self, kind: str, fields: dict, http: dict, left: int):
        label, _, stated = fields.get("warc-payload-digest", "").partition(":")
        stated = base64.b32decode(stated).hex() if label.lower() == "sha1" and stated else None
        common = {
            "archive": self.path, "record_no": self.number, "record_id": fields.get("warc-record-id", "").strip("<>"),
            "target_uri": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "stated_bytes": int(http["content-length"]) if http.get("content-length", "").isdigit() else None,
            "stated_digest": stated,
        }
        digest, number, done = hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            data = b""
            while left and len(data) < self.chunk:  # a stream may give less than is asked for
                got = self.file.read(min(left, self.chunk - len(data)))
                if not got:
                    self.fail("it is cut off")
                data, left = data + got, left - len(got)
            digest.update(data)
            done += len(data)
            if not left and kind == "response" and stated not in (None, digest.hexdigest()):
                self.fail("its payload has another digest than its header")
            yield common | {
                "chunk_no": number, "n_bytes": len(data), "bytes_so_far": done, "digest_so_far": digest.copy().hexdigest(),
                "last": not left, "data": data,
            }
            if not left:
                return
            number += 1


def read_archives(archives: DataFrame, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives named in column ``archive`` (.warc or .warc.gz), one task per
    archive; without ``data`` the bytes are read and digested but not returned.  A record that is cut
    off or whose payload has another digest than its header states is an error that names it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(CHUNK_FIELDS)
    if not data:
        schema = StructType(schema.fields[:-1])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in Reader(path, chunk).rows():
                    held.append([row[name] for name in arrow.names])
                    size += row["n_bytes"] if data else 0
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    files = max(1, archives.count())
    return archives.select("archive").repartition(files).mapInArrow(run, schema)


def archive_list(spark: SparkSession, folder: str) -> DataFrame:
    """archive: the WARC files below a folder, listed by Spark without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc*").load(folder)
    return found.select(F.col("path").alias("archive"))


def record_summary(chunks: DataFrame) -> DataFrame:
    """record_id, target_uri, record_type, refers_to, payload_bytes, payload_digest of every record,
    from its last chunk; a revisit states those of the payload it refers to."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        "record_id", "target_uri", "record_type", "refers_to",
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
    )


def round_trip(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` to archives and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, one row per row of ``pages``.

    Null html is an empty payload, a null url has no header, a null page_id comes back as null;
    an empty table gives no rows.  Only page_id, url and html of ``pages`` are read."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(chunk_rows(record_rows(pages), chunk), folder, archive_bytes)
    read = record_summary(read_archives(manifest, data=False, chunk=chunk))

    def number(column):
        found = F.substring_index(F.col(column), ":", -1)
        return F.when(found != "", found.cast("long"))

    return read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


ORACLE = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest, coalesce(html, '') as html from pages),
firsts as (
  select *, max(page_id) over (partition by html) as first from payloads)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when n >= 1000 and page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id is distinct from first then first end as refers_to
from firsts
"""
