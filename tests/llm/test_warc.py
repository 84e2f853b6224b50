import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from kerbline.llm import warc
from kerbline.llm.common import scratch

BIG = "<p>é</p>" * 40
ROWS = [(1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "n", BIG), (1, "http://a/", BIG), (7, "r", "\r\n\r\nWARC/1.0\r\n" * 30), (8, "h", "x" * 3_000_000), (None, "m", "only null " * 30), (None, "m", "only null " * 30)]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1))
    manifest = warc.write_archives(pages, scratch(spark, "t"))
    rows = warc.read_archives(manifest).collect()
    assert sum(r.records for r in manifest.collect()) == len(rows) == len(ROWS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(k, len((t or "").encode()), sha(t or ""), "revisit" if t == BIG and k != 1 else "response", 1 if t == BIG and k != 1 else None) for k, _, t in ROWS]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)
    assert {r.page_id: bytes(r.payload).decode() for r in rows if r.payload is not None and r.page_id in (7, 8)} == {7: ROWS[8][2], 8: ROWS[9][2]}
    assert next(r.url for r in rows if r.page_id == 2) == "http://b/%0D%0AX:%20y"


def test_empty_table(spark):
    assert warc.archive_round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_reader_finds_damage():
    whole = warc.record(1, b"u", b"payload", None, hashlib.sha256(b"payload").hexdigest())
    assert [warc.parse(m)["payload"] for m in warc.members(io.BytesIO(whole * 3), size=7)] == [b"payload"] * 3
    with pytest.raises(warc.Damaged):
        list(warc.members(io.BytesIO(whole[:-9])))
    text = gzip.decompress(whole)
    for old, new in ((b"payload\r\n", b"payloaD\r\n"), (b"\r\n\r\npayload", b"\r\n\r\npayloadd"), (b"WARC/", b"WURC/")):
        with pytest.raises(warc.Damaged):
            warc.parse(text.replace(old, new))
