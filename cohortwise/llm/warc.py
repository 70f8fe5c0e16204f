"""Operator 6: WARC archives compressed with Zstandard, one frame for each record, with a dictionary.

An archive begins with a skippable frame that holds the dictionary (as it is,
or compressed itself); every later frame is one WARC record. The reader
streams an archive frame by frame, so its memory holds one record, and checks
each record's version line, mandatory headers, Content-Length, trailing empty
lines and payload digest. Other skippable frames are passed over.

Archives are written by the tasks straight into a folder that all executors
share, each under a name of its own; the manifest lists those of the tasks
that succeeded, so a task that is run again leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm.common import shared_folder, shuffle_width, table, written

# ---- fixed values of the formats ----
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
# ----

#: Bytes of records that the dictionary of an archive is trained on, and the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 18, 1 << 13
#: Uncompressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def warc_record(kind: str, key: str, uri: str | None, date: str, digest: str, block: bytes, refers_to: str | None = None) -> bytes:
    """One record. ``key`` becomes the record id; characters that a header cannot hold are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{quote(key, safe='')}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: quote(m[0]), uri) if uri else 'urn:unknown'}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:record:{quote(refers_to, safe='')}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RecordError(ValueError):
    """A frame that is no valid record."""


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one record; RecordError if anything about it is not valid."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        raise RecordError("no end of the headers")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise RecordError(f"version line {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise RecordError(f"header line {line[:40]!r}")
        headers.setdefault(name.strip(), value.strip())
    if missing := [h for h in MANDATORY if h not in headers]:
        raise RecordError(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isascii() or not headers["Content-Length"].isdigit():
        raise RecordError(f"Content-Length {headers['Content-Length'][:40]!r}")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise RecordError(f"Content-Length {n}, but {len(rest) - 4} bytes to the end of the frame")
    return headers, rest[:n]


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The payload (of a revisit: none); RecordError if its digest or HTTP length differs."""
    if headers["WARC-Type"] == "revisit":
        return None
    payload = block
    if headers.get("Content-Type", "").startswith("application/http"):
        head, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise RecordError("no end of the HTTP headers")
        if (m := re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)) and int(m[1]) != len(payload):
            raise RecordError("HTTP Content-Length differs from the payload's length")
    said = headers.get("WARC-Payload-Digest", "")
    if said.startswith("sha1:") and said[5:] != sha1_base32(payload):
        raise RecordError("payload digest differs")
    return payload


def frames(stream) -> Iterator[tuple[int, int, bytes | RecordError]]:
    """(offset, compressed length, record) of every frame of an open archive, the dictionary loaded on the way.

    A frame that cannot be decoded gives a RecordError and ends the archive,
    as the next frame's place is not known then.
    """
    held, at, dictionary, first = b"", 0, None, True
    unpack = zstandard.ZstdDecompressor()

    def more(n: int) -> bool:
        nonlocal held
        parts = [held]
        size = len(held)
        while size < n:
            part = stream.read(max(CHUNK, n - size))
            if not part:
                break
            parts.append(part)
            size += len(part)
        held = b"".join(parts)
        return len(held) >= n

    while more(4):
        (magic,) = struct.unpack_from("<I", held)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if not more(8) or not more(8 + (size := struct.unpack_from("<I", held, 4)[0])):
                yield at, len(held), RecordError("the file ends inside a skippable frame")
                return
            body = held[8:8 + size]
            if first and magic == DICTIONARY_FRAME:
                if body[:4] == struct.pack("<I", ZSTD_FRAME):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                dictionary = zstandard.ZstdCompressionDict(body)
                unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
            held, at, first = held[8 + size:], at + 8 + size, False
            continue
        first = False
        if magic != ZSTD_FRAME:
            yield at, len(held), RecordError(f"no Zstandard frame: magic number {magic:08x}")
            return
        one, out, read = unpack.decompressobj(), [], 0
        try:
            while not one.eof:
                if not held and not more(1):
                    yield at, read, RecordError("the file ends inside a frame")
                    return
                out.append(one.decompress(held))
                read += len(held)
                held = b""
        except zstandard.ZstdError as error:
            yield at, read, RecordError(f"frame: {error}")
            return
        held = one.unused_data
        read -= len(held)
        yield at, read, b"".join(out)
        at += read
    if held:
        yield at, len(held), RecordError("the file ends inside a magic number")


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


class _ArchiveWriter:
    """One archive: gathers a sample, trains the dictionary, writes a frame for each record."""

    def __init__(self, uri: str):
        self.uri, self.records, self.bytes, self.sample, self.sampled = uri, 0, 0, [], 0
        self.out = self.pack = None

    def _begin(self) -> None:
        where, path = _open(self.uri)
        self.out = where.open_output_stream(path, compression=None)
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:4096] for x in self.sample if x], k=256, d=8)
            body = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        except zstandard.ZstdError:  # too little to train on: an archive without a dictionary
            dictionary = None
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for record in self.sample:
            self.out.write(self.pack.compress(record))
        self.sample = []

    def add(self, record: bytes) -> None:
        self.records += 1
        self.bytes += len(record)
        if self.out is None:
            self.sample.append(record)
            self.sampled += len(record)
            if self.sampled >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.pack.compress(record))

    def close(self) -> None:
        if self.out is None:
            self._begin()
        self.out.close()


def write_archives(captures: DataFrame, folder: str, key_col: str, uri_col: str, payload_col: str, date_col: str | None = None, least_revisit: int = 0) -> DataFrame:
    """Write one record for each row into archives in ``folder``; returns the manifest (archive, records).

    The payload is the column's UTF-8 bytes (null: empty). Of the rows with
    equal payloads of at least ``least_revisit`` bytes those with the largest
    key are responses and the others revisits that refer to it; a null key is
    smaller than any other, and where all keys of a payload are null, all rows
    are responses. Rows with the same key and payload are all written. A null
    URI is written as urn:unknown. An empty table gives an empty manifest.
    """
    spark = captures.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = captures.select(F.col(key_col).alias("key"), F.col(uri_col).cast("string").alias("uri"),
                           (F.col(date_col).cast("timestamp") if date_col else F.lit(None).cast("timestamp")).alias("date"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = (captures.select(F.col(key_col).alias("key"), payload.alias("payload"))
             .filter(F.octet_length("payload") >= least_revisit)
             .groupBy(F.sha1("payload").alias("digest")).agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    rows = rows.join(first, "digest", "left").select(
        F.col("key").cast("string").alias("key"), "uri", F.date_format(F.coalesce("date", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.when(F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("first"))), F.col("first").cast("string")).alias("refers"), "digest",
        F.col("payload"))
    rows = rows.withColumn("payload", F.when(F.col("refers").isNull(), F.col("payload")))
    where, path = _open(folder)
    where.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            keys, uris, dates, refers, digests, payloads = batch.columns
            for i in range(batch.num_rows):
                body, refer = payloads[i].as_py(), refers[i].as_py()
                digest = base64.b32encode(bytes.fromhex(digests[i].as_py())).decode()
                key = keys[i].as_py()
                if archive is None:
                    archive = _ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                archive.add(warc_record("response" if refer is None else "revisit", key if key is not None else "", uris[i].as_py(), dates[i].as_py(), digest,
                                        http_block(body) if refer is None else b"HTTP/1.1 200 OK\r\n\r\n", refer))
                if archive.bytes >= ARCHIVE_BYTES:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array([x.uri for x in done], pa.string()), pa.array([x.records for x in done], pa.int64())], names=["archive", "records"])

    return written(rows.mapInArrow(write, "archive string, records bigint"), "archives")


RECORDS = "archive string, offset bigint, length bigint, record_type string, record_key string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes bigint, payload binary, error string"


def read_archives(manifest: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """Every record of the archives named by ``manifest.archive``, validated.

    A revisit has no payload and no payload_bytes; ``resolve`` adds them. A
    record that is not valid stops the job if ``strict``, else gives a row with
    ``error`` and nulls. A null archive name gives no rows.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for uri in batch.column(0).drop_null().to_pylist():
                where, path = _open(uri)
                with where.open_input_stream(path, compression=None) as stream:
                    for offset, length, raw in frames(stream):
                        try:
                            if isinstance(raw, RecordError):
                                raise raw
                            headers, block = parse_record(raw)
                            payload = payload_of(headers, block)
                            key, refers = (re.fullmatch(r"<urn:record:(.*)>", headers.get(h, "")) for h in ("WARC-Record-ID", "WARC-Refers-To"))
                            row = (uri, offset, length, headers["WARC-Type"], unquote(key[1]) if key else headers["WARC-Record-ID"], unquote(refers[1]) if refers else headers.get("WARC-Refers-To"),
                                   headers.get("WARC-Target-URI"), headers["WARC-Date"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                                   None if payload is None else len(payload), payload if with_payload else None, None)
                        except RecordError as error:
                            if strict:
                                raise RecordError(f"{uri} at byte {offset}: {error}") from None
                            row = (uri, offset, length, *[None] * 8, str(error))
                        rows.append(row)
                        held += len(raw) if with_payload and isinstance(raw, bytes) else 200
                        if held > 4 * CHUNK:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    tasks = min(manifest.count(), 2 * shuffle_width(manifest.sparkSession))
    names = manifest.select("archive").repartition(max(tasks, 1), "archive")
    return names.mapInArrow(read, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with the payload_bytes of revisits, taken from the responses with the same digest."""
    known = records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    revisits = records.filter("record_type = 'revisit'").join(known, "payload_digest", "left")
    revisits = revisits.withColumn("payload_bytes", F.col("__bytes")).select(records.columns)
    return records.filter("record_type is null or record_type <> 'revisit'").unionByName(revisits)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back."""
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(pages, shared_folder(spark, "warc"), "page_id", "url", "html")
    records = written(read_archives(manifest, with_payload=False).drop("payload"), "records")
    return resolve(records).select(
        F.col("record_key").try_cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("bigint").alias("refers_to"))


QUERIES = {"op6_warc": (op6_warc, None)}
