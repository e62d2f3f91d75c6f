"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import commit, place_of, saved
from sitequarry.session import fresh_dir

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, html: bytes, size: int, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record; a revisit has no payload but tells its length and digest.

    The block of a response is the page alone, without the HTTP headers that were never kept; Content-Type says so.
    """
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        *([] if url is None else [f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}"]),
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(html)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + html + b"\r\n\r\n"


def _sha1(told: str) -> str:
    """A digest as bare hex; the standard lets it be written in base 32 too."""
    value = told.partition(":")[2] or told
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def parse(raw: bytes) -> dict:
    """The fields of a record; raises ValueError where headers, lengths or the digest don't fit.

    Records of other archives may have a block with HTTP headers, which are cut off, and may leave out the payload's digest and length,
    which are then taken from the payload of a response and are null for a revisit. Record types beside response and revisit come back
    with their block as payload.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        # the only header that may repeat
        if not colon or (name in fields and name != "warc-concurrent-to"):
            raise ValueError(f"bad or repeated header {line[:80]!r}")
        fields[name] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"headers missing: {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    own = re.compile(r"<urn:page:(-?\d+)>")
    number = lambda x: int(m[1]) if x and (m := own.fullmatch(x)) else None
    kind, payload = fields["warc-type"], rest[:n]
    if fields.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    digest, size = fields.get("warc-payload-digest"), fields.get("x-payload-length")
    digest = _sha1(digest) if digest else None
    if kind == "response":
        if digest not in (None, hashlib.sha1(payload).hexdigest()) or size not in (None, str(len(payload))):
            raise ValueError("payload and digest differ")
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    if kind == "revisit" and "warc-refers-to" not in fields:
        raise ValueError("a revisit that refers to nothing")
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": None if size is None else int(size),
        "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload": None if kind == "revisit" else payload,
    }


def dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes | None:
    """A trained dictionary, or none where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def write_archive(stream, records: Iterator[bytes], sample_bytes: int = 2 << 20) -> int:
    """Writes records, each a frame of its own, behind a dictionary trained on the first `sample_bytes` of them."""
    held, size, n = [], 0, 0
    for raw in records:
        held.append(raw)
        size += len(raw)
        if size >= sample_bytes:
            break
    learnt = dictionary(held, min(64 << 10, max(1 << 10, size // 20)))
    if learnt:
        packed = zstandard.ZstdCompressor(level=3).compress(learnt)
        stream.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(learnt) if learnt else None)
    for some in (held, records):
        for raw in some:
            stream.write(pack.compress(raw))
            n += 1
    return n


def read_archive(source, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, decoded frame by frame."""
    unpack, data = zstandard.ZstdDecompressor(), source.read(step)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        length = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + length:
            more = source.read(step)
            if not more:
                raise ValueError("the archive ends in its dictionary")
            data += more
        inner, data = data[8 : 8 + length], data[8 + length :]
        if struct.unpack_from("<I", inner)[0] == FRAME:
            inner = zstandard.ZstdDecompressor().decompress(inner)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(inner))
    data = data or source.read(step)
    while data:
        frame, out = unpack.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                break
            data = source.read(step)
            if not data:
                raise ValueError("the archive ends in a record")
        data = frame.unused_data or source.read(step)
        yield b"".join(out)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html (bytes; null for revisits), payload_bytes, payload_digest, refers_to.

    Of equal payloads of `least` bytes or more that with the largest page_id is kept. Payloads that occur once, found by counts
    combined in the map tasks, meet no other row; the written list of repeated ones is joined by digest, a join
    of two shuffled sides whose hot digests Spark splits.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    repeated = own.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = saved(repeated.where("n > 1").select(F.col("payload_digest").alias("of"), "first"), "payloads")
    joined = own.join(repeated, F.col("payload_digest") == F.col("of"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to")
    )


def write_warc(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Writes an archive from each partition; part, file and n_records of each.

    A null html is an empty payload, a null url leaves its header out. Rows that repeat a page_id are records of their own; if
    theirs is the largest page_id of equal payloads, all of them are responses. WARC-Date is the time of the call.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0

        def rows() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, html, size, digest, refers_to = (batch.column(k)[i].as_py() for k in range(6))
                    yield record(page_id, url, html or b"", size, digest, refers_to, date)

        def fill(stream) -> None:
            nonlocal n
            n = write_archive(stream, rows())

        file = commit(folder, f"part-{part:06d}.warc.zst", fill)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([file]), pa.array([n])], names=["part", "file", "n_records"])

    return saved(with_revisits(pages, least).mapInArrow(write, "part long, file string, n_records long"), "archives")


def read_warc(files: DataFrame) -> DataFrame:
    """A row per response or revisit in the archives listed in column file, checked; payload is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                store, name = place_of(uri)
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for raw in read_archive(source):
                        fields = parse(raw)
                        if fields["record_type"] not in ("response", "revisit"):
                            continue
                        held.append(fields)
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, kinds)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(read, FIELDS)


def archived(pages: DataFrame, least: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes archives of `pages` and reads them back: a row per page. No rows in, no rows out."""
    return read_warc(write_warc(pages, folder or fresh_dir(pages.sparkSession, "warc"), least))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
d AS (SELECT *, sha1(html) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
FROM m
"""
