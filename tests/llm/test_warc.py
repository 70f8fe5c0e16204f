"""Operator 6: round trips, and archives that are not valid."""

import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from cohortwise.llm.warc import (DICTIONARY_FRAME, RecordError, frames, http_block, parse_record, payload_of, read_archives, resolve, sha1_base32, warc_record,
                                 write_archives)

SF = "/root/testdata/sf0.001"


class Trickle:
    """A stream that gives a few bytes at a time."""

    def __init__(self, data, step):
        self.data, self.step = data, step

    def read(self, n):
        part, self.data = self.data[:min(n, self.step)], self.data[min(n, self.step):]
        return part


def records(n=40):
    return [warc_record("response", str(i), f"http://example.org/{i}", "2024-01-01T00:00:00Z", sha1_base32(b"page %d" % i * 50), http_block(b"page %d" % i * 50)) for i in range(n)]


@pytest.mark.parametrize("compressed", [False, True, None])
@pytest.mark.parametrize("step", [1 << 20, 7])
def test_frames(compressed, step):
    plain = records()
    if compressed is None:
        dictionary, data = None, b""
    else:
        dictionary = zstandard.train_dictionary(1024, plain, k=64, d=8)
        body = dictionary.as_bytes()
        if compressed:
            body = zstandard.ZstdCompressor().compress(body)
        data = struct.pack("<II", DICTIONARY_FRAME, len(body)) + body
    pack = zstandard.ZstdCompressor(dict_data=dictionary)
    data += b"".join(pack.compress(r) for r in plain[:20])
    data += struct.pack("<II", 0x184D2A50, 5) + b"other"  # a skippable frame among the records
    data += b"".join(pack.compress(r) for r in plain[20:])
    got = list(frames(Trickle(data, step)))
    assert [raw for _, _, raw in got] == plain
    assert all(pack.compress(raw) == data[at:at + n] for at, n, raw in got)


@pytest.mark.parametrize("spoil", [lambda d: d[:-3], lambda d: d + b"junk!", lambda d: d + b"\x28", lambda d: d[:30] + bytes([d[30] ^ 255]) + d[31:]])
def test_broken_archives(spoil):
    pack = zstandard.ZstdCompressor(write_checksum=True)
    data = spoil(b"".join(pack.compress(r) for r in records(3)))
    assert isinstance(list(frames(Trickle(data, 1 << 20)))[-1][2], RecordError)


GOOD = warc_record("response", "k", "http://a/", "2024-01-01T00:00:00Z", sha1_base32(b"body"), http_block(b"body"))


@pytest.mark.parametrize("raw", [
    GOOD[:-1], GOOD + b"x", GOOD.replace(b"WARC/1.1", b"WARC/9.9"), GOOD.replace(b"WARC-Date", b"WARC-Dat"), GOOD.replace(b"WARC-Type: response", b"no colon here"),
    GOOD.replace(b"Content-Length: 4\r\n", b"Content-Length: 5\r\n"), GOOD.replace(b"body", b"bodY"), b"", b"WARC/1.1\r\n\r\n"])
def test_invalid_records(raw):
    with pytest.raises(RecordError):
        payload_of(*parse_record(raw))


def test_pages_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = pages.collect()
    extra = [(None, None, None), (None, "http://x/", rows[0].html), (900_001, "http://bad url/\r\nX: y", rows[0].html), (900_002, "http://e/", ""), (900_002, "http://e/", ""), (900_003, "http://n/", None),
             (900_004, "http://l/", "long " * 400_000)]
    df = pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumn("record_type", F.lit("x"))
    manifest = write_archives(df, f"file://{tmp_path}/a", "page_id", "url", "html")
    back = resolve(read_archives(manifest)).collect()
    everything = [(r.page_id, r.html or "") for r in df.collect()]
    assert len(back) == len(everything) == sum(r.records for r in manifest.collect())
    largest = {}
    for k, html in everything:
        if k is not None:
            largest[html] = max(largest.get(html, k), k)
    want = sorted((str(k if k is not None else ""), len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(),
                   *(("response", "") if largest.get(h) == k else ("revisit", str(largest[h])))) for k, h in everything)
    assert sorted((r.record_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in back) == want
    whole = {r.record_key: r.payload for r in back if r.record_type == "response"}
    assert all(bytes(whole[str(k)]).decode() == h for k, h in everything if str(k) in whole)
    assert all(r.error is None for r in back)


def test_least_revisit_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "k bigint, u string, p string")
    kinds = {r.record_key: r.record_type for r in read_archives(write_archives(df, f"file://{tmp_path}/b", "k", "u", "p", least_revisit=3)).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit", "4": "response"}
    assert read_archives(write_archives(df.limit(0), f"file://{tmp_path}/c", "k", "u", "p")).count() == 0


def test_errors_as_rows(spark, tmp_path):
    path = tmp_path / "broken.warc.zst"
    path.write_bytes(zstandard.ZstdCompressor().compress(GOOD) + zstandard.ZstdCompressor().compress(GOOD.replace(b"body", b"bodY")) + b"\0\0\0\0")
    manifest = spark.createDataFrame([(f"file://{path}",), (None,)], "archive string")
    rows = read_archives(manifest, strict=False).orderBy("offset").collect()
    assert [r.error is None for r in rows] == [True, False, False]
    with pytest.raises(Exception, match="digest differs"):
        read_archives(manifest).collect()
