"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary the records were
compressed with, either plain or itself a Zstandard frame; every record then is a frame of its own, so
any record can be read by its offset. Writer tasks stream their rows into archives of their own, with
names no other attempt uses, and return a manifest; only archives in the committed manifest are read,
so a lost executor leaves at most unlisted files. Readers take one archive at a time and hold one record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, staged

# Fixed values of the format.
DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"

#: Payloads below this size are never written as revisits.
MIN_REVISIT_BYTES = 100
#: A dictionary is trained on the first rows of each archive, as far as these bounds go.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 256, 1_000_000, 16_384
#: Archives are closed beyond this many compressed bytes.
ARCHIVE_BYTES = 256_000_000
CHUNK = 65_536

MANIFEST = "path string, records bigint, bytes bigint"
RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, payload binary, archive string, error string"
)


class BadRecord(ValueError):
    """A record whose headers, lengths or digest don't hold."""


def with_references(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Columns id, url-less: digest, payload and refers_to (the smallest id of an equal, large enough payload).

    Small payloads never meet: their join keys are spread by id. Groups are counted before they are
    joined, and the join splits a hot digest (skew join), so a payload that a third of all pages share is fine.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= MIN_REVISIT_BYTES
    rows = rows.withColumn("digest_key", F.when(large, F.col("digest")).otherwise(F.concat_ws(":", F.lit("small"), F.col(id_col), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))))
    groups = (
        rows.where(large)
        .groupBy(F.col("digest").alias("digest_key"))
        .agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest_key", "first_id")
    )
    same = F.col(id_col) == F.col("first_id")
    return rows.join(groups, "digest_key", "left").withColumn("refers_to", F.when(~same, F.col("first_id"))).drop("digest_key", "first_id")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that keeps only the HTTP header."""
    head = HTTP_HEAD % len(payload)
    block = head + payload if refers_to is None else head
    uri = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{uuid.uuid4()}>" if page_id is None else f"<urn:x-page:{page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        *([("WARC-Target-URI", uri)] if uri is not None else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; BadRecord if the version, a header, a length or the digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadRecord("no WARC version line")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or not k.strip():
            raise BadRecord(f"malformed header line {line[:60]!r}")
        fields[k.strip().lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise BadRecord(f"no {k}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        raise BadRecord("the block's length is not Content-Length")
    if not rest.endswith(b"\r\n\r\n"):
        raise BadRecord("the record does not end in two line ends")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or not http.startswith(b"HTTP/") or len(sizes) != 1 or not sizes[0].isdigit():
        raise BadRecord("no HTTP header with one length")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        if len(payload) != int(sizes[0]):
            raise BadRecord("the payload's length is not the HTTP length")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise BadRecord("the payload's digest differs")
    elif kind != "revisit" or "warc-refers-to" not in fields or len(digest) != 64:
        raise BadRecord(f"unknown or incomplete record of type {kind}")
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(sizes[0]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("warc-refers-to", "")),
        "payload": payload if kind == "response" else None,
    }


def number(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


class Archive:
    """Writes one archive; close() returns its manifest row."""

    def __init__(self, folder: str, sample: list[bytes]):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.records = f"{folder}/{name}", 0
        self.out = fs.open_output_stream(f"{base}/{name}", compression=None)
        trained = None
        try:
            part = [x[:CHUNK] for x in sample]
            size = min(DICT_BYTES, sum(map(len, part)) // 16)
            trained = zstd.train_dictionary(size, part) if len(part) >= 8 and size >= 1024 else None
        except zstd.ZstdError:  # too little or too uniform a sample: records go without a dictionary
            trained = None
        if trained is not None:
            packed = zstd.ZstdCompressor(level=3).compress(trained.as_bytes())
            self.out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        self.packer = zstd.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)

    def add(self, record: bytes) -> None:
        self.out.write(self.packer.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        size = self.out.tell()
        self.out.close()
        return self.path, self.records, size


def write_archives(rows: DataFrame, folder: str, id_col: str, url_col: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of with_references() below `folder`; returns the committed manifest, one row an archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held, held_bytes, done = None, [], 0, []

        def records():
            for batch in batches:
                for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield record_bytes(page_id, url, payload, digest, refers)

        for record in records():
            if archive is None:
                held.append(record)
                held_bytes += len(record)
                if len(held) < SAMPLE_ROWS and held_bytes < SAMPLE_BYTES:
                    continue
                archive = Archive(folder, held)
                for x in held:
                    archive.add(x)
                held, held_bytes = [], 0
                continue
            archive.add(record)
            if archive.out.tell() >= archive_bytes:
                done.append(archive.close())
                archive = None
        if held:
            archive = Archive(folder, held)
            for x in held:
                archive.add(x)
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pydict({k: [x[i] for x in done] for i, k in enumerate(("path", "records", "bytes"))}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    out = rows.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), "payload", "digest", F.col("refers_to").cast("bigint"))
    return staged(out.mapInArrow(write, MANIFEST), "warc-manifest")


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one decoded frame each; the leading skippable frame gives the dictionary."""
    held, first, unpacker = b"", True, zstd.ZstdDecompressor()

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            chunk = stream.read(max(CHUNK, n - len(held)))
            if not chunk:
                return False
            held += chunk
        return True

    while more(1):
        if not more(8):
            raise BadRecord("the archive ends inside a frame's header")
        magic, size = struct.unpack("<II", held[:8])
        if magic in SKIPPABLE:
            if not more(8 + size):
                raise BadRecord("the archive ends inside a skippable frame")
            body, held = held[8 : 8 + size], held[8 + size :]
            if first and magic == DICT_MAGIC:
                plain = zstd.ZstdDecompressor().decompress(body) if body[:4] == FRAME_MAGIC else body
                unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(plain))
            first = False
            continue
        first, parts, one = False, [], unpacker.decompressobj()
        while not one.eof:
            if not held and not more(1):
                raise BadRecord("the archive ends inside a record")
            parts.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
        yield b"".join(parts)


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of the manifest's archives, with validated headers, lengths and digests.

    A record that doesn't hold ends the job if `strict`, else gives a row with only `archive` and `error`; so does an
    archive that has not as many records as the manifest says, such as one that was cut after a whole frame.
    Archives are dealt out one by one; the number of tasks is the number of archives.
    """
    schema = pa.schema([(n, t) for n, t in zip(RECORD.replace(",", "").split()[::2], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                rows, size, seen = [], 0, 0
                fs, base = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(base, compression=None) as stream:
                    for raw in frames(stream):
                        try:
                            row = parse_record(raw) | {"archive": path, "error": None}
                        except BadRecord as e:
                            if strict:
                                raise
                            row = dict.fromkeys(schema.names) | {"archive": path, "error": str(e)}
                        seen += 1
                        rows.append(row if with_payload else row | {"payload": None})
                        size += len(raw)
                        if len(rows) >= 1000 or with_payload and size >= 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if seen != expected:
                    wrong = f"{seen} records, where the manifest has {expected}"
                    if strict:
                        raise BadRecord(wrong)
                    rows.append(dict.fromkeys(schema.names) | {"archive": path, "error": wrong})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, manifest.count())
    return manifest.select("path", "records").repartition(n).mapInArrow(read, RECORD)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row of `pages`, reads all archives back and returns the records' facts.

    Null payloads count as empty; rows that share the smallest id of a group of copies are all responses,
    and so is a group without any id. A null id gets a random record id and reads back as null. An empty
    table gives no archive and no rows. Other columns of `pages`, whatever their names, take no part.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = with_references(narrow, "page_id", "html")
    manifest = write_archives(rows, new_dir(spark, "warc"), "page_id", "url")
    return read_archives(spark, manifest, with_payload=False).drop("payload", "error")
