"""WARC records as tables of chunks, so that no task holds a whole oversized payload.

``chunk_table`` streams payloads into rows of a record identifier, a chunk number and at most ``CHUNK_BYTES`` bytes. Every
row carries the digest of its record's payload up to and with this chunk, so the last row has the payload's digest, and a
damaged chunk is found at its own row. ``write_archives`` settles from the last rows, without their bytes, which record of
equal payloads is the response and which ones revisit it, and streams chunks behind their record's header into archives:
the bytes of an archive's rows, by offset, are a WARC/1.1 file. An archive is a Parquet table of such rows, as Spark
writes no raw binaries; offset and length of every record stand beside it as an index. ``read_archives`` parses the
records again, chunk by chunk, and checks lengths and digests.

Payloads are moved once, as chunks, to stand behind their headers; on reading, only records of several chunks are. Records
of one payload that a third of all pages share are rows of an id and a digest when they meet.

Defined results: a null payload is empty, and an empty payload is a record like any other; of records with equal payloads
of at least ``min_bytes`` bytes the one with the largest page id is the response (null ids are smallest; of rows that repeat
a page id one is the response, and the others revisit it), all others are revisits; a null page id or address is left out
of the record; control characters and spaces of an address are percent-encoded; an empty table gives an empty archive;
columns other than the id, the address and the payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

#: Bytes of a chunk, of the pieces that a payload is cut into before chunks, and of an archive.
CHUNK_BYTES, PIECE_BYTES, ARCHIVE_BYTES = 32 << 10, 4 << 20, 1 << 30
#: Bytes of a row group of the tables of chunks.
ROW_GROUP = 8 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION, PROFILE, END = b"WARC/1.1\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n\r\n"
CONTENT_TYPE = "application/http;msgtype=response"

CHUNKS = "rid long, page_id long, url string, size long, chunk_no int, chunks int, data binary, sha1 binary, crc32 long"
RECORDS = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string"


def chunk_table(pages: DataFrame, payload: str = "html", *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``CHUNKS`` of every row of (page_id, url, payload), stored; ``sha1`` and ``crc32`` are of the payload up to this chunk."""
    piece_bytes = max(1, PIECE_BYTES // chunk_bytes) * chunk_bytes
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    size = F.octet_length("raw").cast("long")
    records = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("raw")).withColumn("size", size)
    steps = lambda n, step: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(n / step) - 1).cast("long")))
    part = lambda c, i, step: F.substring(c, (i * step + 1).cast("int"), F.lit(step))
    # In two steps, as cutting one chunk out of a payload may copy all of what it is cut from.
    pieces = records.withColumn("piece", steps(F.col("size"), piece_bytes)).select("rid", "page_id", "url", "size", "piece", part("raw", F.col("piece"), piece_bytes).alias("raw"))
    cut_up = pieces.withColumn("at", steps(F.octet_length("raw"), chunk_bytes))
    number = (F.col("piece") * (piece_bytes // chunk_bytes) + F.col("at")).cast("int")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes)).cast("int")
    rows = cut_up.select("rid", "page_id", "url", "size", number.alias("chunk_no"), chunks.alias("chunks"), part("raw", F.col("at"), chunk_bytes).alias("data"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of a record come one after the other, as they are cut."""
        sha1, crc32 = hashlib.sha1(), 0
        for batch in batches:
            sums, checks = [], []
            for number, data in zip(batch.column("chunk_no").to_pylist(), batch.column("data"), strict=True):
                if number == 0:
                    sha1, crc32 = hashlib.sha1(), 0
                view = data.as_buffer()
                sha1.update(view)
                crc32 = zlib.crc32(view, crc32)
                sums.append(sha1.digest())
                checks.append(crc32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.binary()), pa.array(checks, pa.int64())], [*batch.schema.names, "sha1", "crc32"])

    path = scratch_path(pages.sparkSession, "chunk-table")
    _stored(rows.mapInArrow(digested, CHUNKS), path)
    return pages.sparkSession.read.schema(CHUNKS).parquet(path)


def _stored(rows: DataFrame, path: str) -> None:
    """Write rows of chunks: small row groups, and no dictionary of the bytes, as a writer holds both in memory."""
    rows.write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.enable.dictionary#data": "false"}).parquet(path)


def record_types(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(rid, page_id, url, size, sha1, target, target_page) of every record; those of revisits name the response, others none."""
    ends = chunks.where("chunk_no = chunks - 1").select("rid", "page_id", "url", "size", "sha1", "crc32")
    # The second sum keeps payloads apart that were made to share a SHA-1.
    same = ["sha1", "crc32", "size"]
    kept = ends.where(F.col("size") >= min_bytes).groupBy(*same).agg(F.max(F.struct("page_id", "rid")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisit = F.col("kept").isNotNull() & (F.col("kept.rid") != F.col("rid"))
    return ends.join(kept, same, "left").select("rid", "page_id", "url", "size", "sha1", F.when(revisit, F.col("kept.rid")).alias("target"), F.when(revisit, F.col("kept.page_id")).alias("target_page"))


def record_id(rid: int, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{rid}')}>"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def heading(record: dict, date: str = DATE) -> bytes:
    """Header of a record and of the HTTP response in it, down to where the payload begins."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % record["size"]
    revisit = record["target"] is not None
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(record["rid"], record["page_id"]), "WARC-Date": date}
    if record["url"] is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", record["url"])
    fields |= {"WARC-Payload-Digest": f"sha1:{base32(record['sha1'])}", "Content-Type": CONTENT_TYPE, "Content-Length": len(http) + (0 if revisit else record["size"])}
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(record["target"], record["target_page"])}
        if record["target_page"] is not None:
            fields["Refers-To-Page-Id"] = record["target_page"]
    if record["page_id"] is not None:
        fields["Page-Id"] = record["page_id"]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + http


ARCHIVE = "archive long, offset long, record_id string, record_bytes long, chunk_no int, chunks int, sha1 binary, data binary"


def write_archives(chunks: DataFrame, path: str, *, min_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of a chunk table to ``path`` as rows of ``ARCHIVE``; a revisit's payload is left out.

    ``record_bytes`` is the record's length and stands in its first row; ``chunks`` are the rows of the record."""
    known = record_types(chunks, min_bytes).select("rid", F.lit(-1).alias("chunk_no"), "page_id", "url", "size", "sha1", "target", "target_page", F.lit(None).cast("int").alias("chunks"), F.lit(None).cast("binary").alias("data"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    moved = chunks.select("rid", "chunk_no", none("long", "page_id"), none("string", "url"), none("long", "size"), "sha1", none("long", "target"), none("long", "target_page"), "chunks", "data")
    # A record's type comes first, then its chunks; a partition is one or more archives.
    rows = known.unionByName(moved).repartition("rid").sortWithinPartitions("rid", "chunk_no")
    out = pa.schema([("archive", pa.int64()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_bytes", pa.int64()), ("chunk_no", pa.int32()), ("chunks", pa.int32()), ("sha1", pa.binary()), ("data", pa.binary())])

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, offset = TaskContext.get().partitionId() << 32, 0
        record, name, revisit = {}, "", False
        for batch in batches:
            made = []
            plain = [batch.column(c).to_pylist() for c in ("rid", "chunk_no", "page_id", "url", "size", "sha1", "target", "target_page", "chunks")]
            for (rid, number, page_id, url, size, sha1, target, target_page, n), data in zip(zip(*plain, strict=True), batch.column("data"), strict=True):
                if number == -1:
                    record = {"rid": rid, "page_id": page_id, "url": url, "size": size, "sha1": sha1, "target": target, "target_page": target_page}
                    name, revisit = record_id(rid, page_id), target is not None
                    continue
                if revisit and number:
                    continue
                body, whole = b"" if revisit else data.as_buffer().to_pybytes(), None
                if number == 0:
                    if offset >= archive_bytes:
                        archive, offset = archive + 1, 0
                    head = heading(record, date)
                    whole = len(head) + (0 if revisit else record["size"]) + len(END)
                    body = head + body
                if revisit or number == n - 1:
                    body += END
                made.append((archive, offset, name, whole, number, 1 if revisit else n, record["sha1"] if revisit else sha1, body))
                offset += len(body)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    _stored(rows.mapInArrow(archived, ARCHIVE), path)


def archive_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).parquet(path)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, archive, offset, record_bytes) of every record; its bytes are not read."""
    return archive_rows(spark, path).where("chunk_no = 0").select("record_id", "archive", "offset", "record_bytes")


class DamagedRecord(ValueError):
    """A record whose bytes are not what its header or its digests say."""


class RecordReader:
    """One record, fed with its rows in order; only its header and running digest are kept."""

    def __init__(self, first: bytes):
        head, _, rest = first.partition(END)
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION.decode().strip():
            raise DamagedRecord(f"no record begins with {lines[0]!r}")
        self.fields = dict(line.split(": ", 1) for line in lines[1:])
        http, _, self.first = rest.partition(END)
        length = re.search(rb"\r\nContent-Length: (\d+)$", http)
        if not length:
            raise DamagedRecord(f"{self.fields.get('WARC-Record-ID')}: no length of the payload")
        self.size, self.held, self.sha1 = int(length[1]), 0, hashlib.sha1()
        self.revisit = self.fields["WARC-Type"] == "revisit"
        if int(self.fields["Content-Length"]) != len(http) + len(END) + (0 if self.revisit else self.size):
            raise DamagedRecord(f"{self.name}: its length is not that of its block")

    @property
    def name(self) -> str:
        return self.fields["WARC-Record-ID"]

    def feed(self, data: bytes, number: int, last: bool, digest: bytes) -> bytes:
        """Payload bytes of a row, checked against the digest that the row carries."""
        body = self.first if number == 0 else data
        if last:
            if not body.endswith(END):
                raise DamagedRecord(f"{self.name}: it does not end")
            body = body[: -len(END)]
        self.sha1.update(body)
        self.held += len(body)
        if not self.revisit and self.sha1.digest() != digest:
            raise DamagedRecord(f"{self.name}: chunk {number} is not what was written")
        if last:
            said = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if said != base32(digest) or self.held != (0 if self.revisit else self.size):
                raise DamagedRecord(f"{self.name}: its payload is not what its header says")
        return body

    def row(self) -> tuple:
        f = self.fields
        number = lambda key: int(f[key]) if key in f else None
        return f["WARC-Record-ID"], f["WARC-Type"], number("Page-Id"), f.get("WARC-Target-URI"), self.size, f["WARC-Payload-Digest"].removeprefix("sha1:"), number("Refers-To-Page-Id"), f.get("WARC-Refers-To")


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the archives, those of a record one after the other. Records of one row stay where they are."""
    rows = archive_rows(spark, path).select("record_id", "chunk_no", "chunks", "sha1", "data")
    return rows.where("chunks = 1").unionByName(rows.where("chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no"))


def _parsed(batch: pa.RecordBatch, reader: RecordReader | None) -> Iterator[tuple[RecordReader, int, bool, bytes]]:
    """(reader, chunk number, whether it is the last, payload bytes) of each row; the reader goes on from batch to batch."""
    plain = [batch.column(c).to_pylist() for c in ("chunk_no", "chunks", "sha1")]
    for (number, n, sha1), data in zip(zip(*plain, strict=True), batch.column("data"), strict=True):
        raw = data.as_buffer().to_pybytes()
        if number == 0:
            reader = RecordReader(raw)
        yield reader, number, number == n - 1, reader.feed(raw, number, number == n - 1, sha1)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``RECORDS`` of every record, parsed from its bytes; a damaged record is an error."""
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    out = pa.schema([(c.split()[0], t) for c, t in zip(RECORDS.split(", "), types, strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            made = []
            for reader, _, last, _ in _parsed(batch, reader):  # noqa: B020  it goes on
                if last:
                    made.append(reader.row())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return _in_order(spark, path).mapInArrow(read, RECORDS)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, chunk_no, data): payloads of responses as chunks again."""
    columns = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            made = []
            for reader, number, _, body in _parsed(batch, reader):  # noqa: B020
                if not reader.revisit:
                    made.append((reader.name, reader.row()[2], number, body))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), columns, strict=True)], schema=columns)

    return _in_order(spark, path).mapInArrow(read, "record_id string, page_id long, chunk_no int, data binary")


def op12_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(chunk_table(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 takes five hexadecimal digits as four characters.
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {5 * g + 1}, 5))::int >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
SQL = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN kept END AS refers_to FROM payloads
"""
