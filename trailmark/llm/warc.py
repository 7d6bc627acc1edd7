"""WARC archives compressed with Zstandard: one frame per record behind a dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of all its
frames; each record is one frame of its own. The reader loads the dictionary (which may itself be
compressed), decodes frame by frame, and checks version line, mandatory headers, Content-Length,
and the SHA-1 of block and payload.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the largest id
is a response; the others are revisit records that name it and hold no payload. Payloads are
compared by SHA-1 and length in one aggregation with map-side combination.

Defined results: a null payload is empty; a null url is written as about:blank, and white space or
control characters in a url are percent-encoded. Rows that repeat the largest id are all
responses. A row without id is refused, since records are named by it. A page is one record, whatever
its length; it must fit in memory. An empty table gives no archives and no rows. Other columns of pages are not read, so their
names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import shared_dir, stored
from trailmark.llm.files import WholeFile, as_uri, made, read_files

SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
BYTES_PER_FILE, DICT_BYTES, SAMPLE_BYTES, PIECE = 24 << 20, 32 << 10, 1 << 20, 16 << 10
#: Heads of records, and the dictionary's size, where a file's own records do not suffice to train one.
HEADS, HEAD_DICT_BYTES = 64, 4 << 10
#: Parts in which records of one payload meet the one that they refer to.
SALTS = 16
VERSION, MANDATORY = "WARC/1.1", ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Records carry this date unless the table has one: the archive is a copy of a table, not a crawl.
DATE = "1970-01-01T00:00:00Z"
URN, PROFILE = "urn:page:", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "about:blank"),
        ("WARC-Payload-Digest", _base32(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[4:4] = [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Checks one record; raises ValueError on any fault."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {version[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {line[:40]!r}")
        fields[name.lower()] = value.strip()
    for name in MANDATORY:
        if name.lower() not in fields:
            raise ValueError(f"missing {name}")
    length = int(fields["content-length"])
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    block, kind = rest[:length], fields["warc-type"]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _base32(hashlib.sha1(block).digest()):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(v) for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if n.lower() == b"content-length"]
    digest = fields.get("warc-payload-digest", "")
    if kind == "response" and (sizes != [len(payload)] or digest != _base32(hashlib.sha1(payload).digest())):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or len(sizes) != 1):
        raise ValueError("malformed revisit")
    number = lambda name: int(fields[name].strip("<>").removeprefix(URN)) if name in fields else None
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": sizes[0] if sizes else length, "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(), "record_type": kind, "refers_to": number("warc-refers-to")}


def dictionary(samples: list[bytes]):
    """A dictionary trained on a file's first records. Where these are too few or too alike to train on, heads of records
    are added, which any record begins with, so that every archive has one."""
    import zstandard

    heads = [record(i, f"https://page.example/{i}", b"", None) for i in range(HEADS)]
    for some, size in ((samples, DICT_BYTES), (samples + heads, HEAD_DICT_BYTES), (heads, HEAD_DICT_BYTES)):
        try:
            return zstandard.train_dictionary(size, some, k=256, d=8)
        except (zstandard.ZstdError, ValueError):
            continue
    raise RuntimeError("no dictionary could be trained")


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The parts of one archive file. The dictionary only affects its size, never its content."""
    import zstandard

    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            break
    trained = dictionary(first)
    yield struct.pack("<II", SKIPPABLE, len(trained.as_bytes())) + trained.as_bytes()
    c = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in first:
        yield c.compress(r)
    for r in records:
        yield c.compress(r)


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of an archive file: dictionary first, then a frame for each."""
    import zstandard

    view, at, known = memoryview(content), 0, None
    while at + 8 <= len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 != 0x184D2A50:
            break
        if at + 8 + size > len(view):
            raise ValueError("the dictionary is cut short")
        if at == 0 and magic == SKIPPABLE:
            body = bytes(view[8 : 8 + size])
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == FRAME else body)
        at += 8 + size
    d = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(view):
        one, raw = d.decompressobj(), []
        while not one.eof and at < len(view):
            part = view[at : at + PIECE]
            raw.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        if not one.eof:
            raise ValueError("a frame is cut short")
        yield parse_record(b"".join(raw))


def revisits(pages: DataFrame, *, min_revisit: int = 1000, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """(page, refers_to): records whose payload another record of larger id holds."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    d = pages.select(F.col(page_id).alias("page"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= min_revisit)
    last = d.groupBy("digest", "size").agg(F.max("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # a payload may fill a third of all rows: they meet the last one in parts
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).join(last, ["digest", "size", "salt"]).where("page < refers_to").select("page", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, *, min_revisit: int = 1000, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the archives in id order; returns (file, records) per file, already written."""
    folder = made(folder)
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    total, lost = pages.agg(F.sum(F.octet_length(body)), F.count_if(F.col(page_id).isNull())).first()
    if lost:
        raise ValueError("records are named by their id, which may not be null")
    d = pages.select(F.col(page_id).cast("long").alias("page"), F.lit(1).alias("kind"), F.xxhash64(body, F.col(url)).alias("tie"), F.col(url).alias("url"), body.alias("payload"), F.lit(None).cast("long").alias("refers_to"))
    # a revisit's target travels as a row in front of its page, so the payloads are dealt out once
    marks = revisits(pages, min_revisit=min_revisit, page_id=page_id, payload=payload)
    d = d.unionByName(marks.select(F.col("page").cast("long").alias("page"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), F.col("refers_to").cast("long").alias("refers_to")), allowMissingColumns=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = TaskContext.get().partitionId(), 0

        def records() -> Iterator[bytes]:
            nonlocal n
            marked, target = None, None
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                    page, kind, url, payload, refers_to = (x.as_py() for x in row)
                    if kind == 0:
                        marked, target = page, refers_to
                        continue
                    n += 1
                    yield record(page, url, payload, target if page == marked else None)

        with WholeFile(folder, f"part-{number:06d}.warc.zst") as out:
            for part in frames(records()):
                out.write(part)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([n], pa.int64())], ["file", "records"])

    n = max(1, -(-(total or 0) // BYTES_PER_FILE))
    ordered = d.repartitionByRange(n, "page").sortWithinPartitions("page", "kind", "tie")
    return stored(ordered.select("page", "kind", "url", "payload", "refers_to").mapInArrow(work, "file int, records long"), "archives")


def read_archives(spark, folder: str, *, payload: bool = True) -> DataFrame:
    """All records of a folder: page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload]."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"url": pa.string(), "payload": pa.binary()} if payload else {})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_archive(content.as_buffer().to_pybytes()):
                    rows.append({k: r[k] for k in kinds})
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds.items()))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds.items()))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payload
    return read_files(spark, folder, ".warc.zst").select("content").mapInArrow(work, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = as_uri(shared_dir(spark, "warc"))
    write_archives(pages, folder)
    return read_archives(spark, folder, payload=False)
