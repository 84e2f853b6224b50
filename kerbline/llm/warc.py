"""WARC archives: one gzip member per record, read back sequentially.

The writer decides, per payload of at least min_revisit bytes, which record carries it (the smallest page id) and makes
the others revisits. The reader inflates one member at a time from a stream, frames the block by Content-Length, and
verifies block and payload digests, so a task holds one record and one read buffer.

Defined cases: a null html is an empty payload; a null url writes no target; line breaks and other control characters
in a url are percent-encoded; a page with a null id never carries a payload for others, and where a payload occurs on
null ids only, each is a response; rows repeating the smallest id of a payload are all responses; an empty table writes
no archive and reads back as an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, file_system, in_pieces, put_file, scratch, shared_root, written  # noqa: F401

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def _uri(text: bytes) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], text)


def record(page_id: int | None, url: bytes | None, payload: bytes, refers_to: int | None, digest: str, level: int = 6) -> bytes:
    """One compressed record: a response with its payload, or a revisit of refers_to with the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines = [x.encode() for x in head] + ([b"WARC-Target-URI: " + _uri(url)] if url is not None else [])
    whole = b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block]) + b"\r\n\r\n"
    deflate = zlib.compressobj(level, wbits=31)
    return deflate.compress(whole) + deflate.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """Writes the archives below folder, one for each task, and returns (path, records, bytes) of each."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    prints = rows.where(F.octet_length("html") >= min_revisit).select("id", "digest")
    first = prints.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = prints.join(first, "digest").where("not (id <=> first)").select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "first").distinct()
    again = written(again, scratch(pages.sparkSession, "warc-revisits"))
    decided = rows.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, count = f"{folder}/{part:05d}.warc.gz", 0

        def records() -> Iterator[bytes]:
            nonlocal count
            for batch in in_pieces(batches):
                for k, url, payload, digest, refers in zip(batch.column(0).to_pylist(), binaries(batch, 1), binaries(batch, 2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    count += 1
                    yield record(k, url, payload, refers, digest)

        todo = records()
        one = next(todo, None)
        if one is not None:
            size = put_file(path, (x for part in ([one], todo) for x in part))
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

    return written(decided.select("id", "url", "html", "digest", "first").mapInArrow(run, "path string, records long, bytes long"), f"{folder}-manifest")


class Damaged(ValueError):
    """An archive that isn't a sequence of whole records with right digests."""


def members(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The inflated members of a gzip stream, one after another."""
    inflate, out, data = zlib.decompressobj(wbits=31), [], b""
    begun = False
    while True:
        data = data or stream.read(size)
        if not data:
            if begun:
                raise Damaged("the last member is cut off")
            return
        begun = True
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out, begun = zlib.decompressobj(wbits=31), [], False


def parse(whole: bytes) -> dict:
    """The record in one member: its fields, HTTP head and payload, checked against its lengths and digests."""
    head, gap, rest = whole.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise Damaged("no record head")
    fields = {k.strip().lower().decode(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or len(block) != n:
        raise Damaged("the block's length is not Content-Length")
    if fields["warc-block-digest"] != b"sha256:" + hashlib.sha256(block).hexdigest().encode():
        raise Damaged("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    kind, digest = fields["warc-type"].decode(), fields["warc-payload-digest"].decode().removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise Damaged("wrong payload length or digest")
    return {"fields": fields, "type": kind, "payload": payload, "payload_bytes": length, "payload_digest": digest}


def _number(x: bytes | None) -> int | None:
    return int(n) if (n := (x or b"").decode().strip("<>").removeprefix(_ID)) else None


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of the archives in column path: READ, and with payload also its bytes (null for a revisit)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = file_system(path)
                with files.open_input_stream(at, compression=None) as stream:
                    for x in map(parse, members(stream)):
                        f = x["fields"]
                        row = {"page_id": _number(f["warc-record-id"]), "url": f["warc-target-uri"].decode() if "warc-target-uri" in f else None, "refers_to": _number(f.get("warc-refers-to")), "record_type": x["type"], **{k: x[k] for k in ("payload_bytes", "payload_digest")}}
                        held.append(row | ({"payload": x["payload"] if x["type"] == "response" else None} if payload else {}))
                        size += 200 + payload * len(x["payload"])
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, READ + (", payload binary" if payload else ""))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads every record back, verified."""
    return read_archives(write_archives(pages, scratch(spark, "warc")), payload=False)
