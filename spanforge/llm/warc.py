"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Every archive holds some 16 MB of payloads. Its dictionary is trained on records spread evenly over it (some
``SAMPLE_BYTES`` of them and of none more than its first ``RECORD_BYTES``, bounds on the training alone: every record is
written whole), and stands, itself compressed, in a
skippable frame (magic 0x184D2A5D) at the archive's head, so that a file can be read without any other. Each record is
a frame of its own.

Equal payloads of 1000 bytes or more become one response, that with the largest page id, and revisit records that refer
to it and carry headers alone. Which one stays is found by a partial aggregation of digests. The digests that more than one
page has are a written table, so their size is known: as long as they are few they are broadcast and payloads are not
shuffled; else the join is a plain equi-join with one row a digest on the other side.

Archives are files in the shared folder that the cluster names, written under a name of their own by each attempt of a
task and renamed when complete. Only files that the checkpointed manifest lists are read, so lost executors and repeated
attempts do no harm. A record is named by its page's id and its payload's digest, an archive's first record by a UUID.

Edge cases: a null payload is empty, a null url leaves its header out, a null id is written as such; rows with one id
and one payload are all responses; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder, written

MAGIC = 0x184D2A5D
ARCHIVE_BYTES, SAMPLE_BYTES, RECORD_BYTES, DICTIONARY_BYTES, LEVEL = 16 << 20, 1 << 20, 64 << 10, 64 << 10, 3
REVISIT_BYTES = 1000
MANIFEST_SCHEMA = "path string, n_records long, n_bytes long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # the tables hold no time; a fixed one keeps archives reproducible


def _uri(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def _page_id(uri: str | None) -> int | None:
    name = "null" if uri is None else uri.split(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given (then without the payload)."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id, digest)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to, digest)}", f"WARC-Profile: {_PROFILE}", "WARC-Truncated: length"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> zstd.ZstdCompressionDict:
    """Trained on records spread evenly; from few or tiny records their plain bytes."""
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    samples = [r[:RECORD_BYTES] for r in records[::step]]
    try:
        return zstd.train_dictionary(size, samples, k=512, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[:size].ljust(8, b" "), dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    info = f"software: spanforge\r\nformat: WARC File Format 1.1\r\nrecords: {len(records)}\r\n".encode()
    first = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode() + b">\r\nWARC-Date: " + _DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: " + str(len(info)).encode() + b"\r\n\r\n" + info + b"\r\n\r\n"
    own = dictionary(records)
    packed = zstd.ZstdCompressor(level=19, write_checksum=True).compress(own.as_bytes())
    compress = zstd.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True).compress
    return struct.pack("<II", MAGIC, len(packed)) + packed + b"".join(map(compress, [first, *records]))


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; fails if there are not as many as its first record tells."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    own = data[8 : 8 + size]
    if own[:4] == b"\x28\xb5\x2f\xfd":
        own = zstd.ZstdDecompressor().decompress(own)
    stream = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(own)).stream_reader(memoryview(data)[8 + size :], read_across_frames=True)
    rest, told, seen = b"", None, -1
    while True:
        while (end := rest.find(b"\r\n\r\n")) < 0:
            more = stream.read(1 << 18)
            if not more:
                if rest.strip() or told != seen:
                    raise ValueError(f"the archive ends after {seen} of {told} records")
                return
            rest += more
        version, *lines = rest[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        headers = dict(line.split(": ", 1) for line in lines)
        need = end + 4 + int(headers["Content-Length"]) + 4
        while len(rest) < need:
            more = stream.read(max(1 << 18, need - len(rest)))
            if not more:
                raise ValueError("the archive ends within a record")
            rest += more
        block, rest, seen = rest[end + 4 : need - 4], rest[need:], seen + 1
        if headers["WARC-Type"] == "warcinfo":
            told = int(block.rpartition(b"records: ")[2])
        yield headers, block


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``*.warc.zst`` files below ``folder`` (any place that pyarrow's file systems reach) and returns the manifest."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(written(shared), ["digest", "size"], "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        own, made, held, room = uuid.uuid4().hex, 0, [], 0

        def put() -> pa.RecordBatch:
            nonlocal made, held, room
            data = archive(held)
            path = f"{top}/{own}-{made:05d}.warc.zst"
            with store.open_output_stream(path + ".part", compression=None) as out:
                out.write(data)
            store.move(path + ".part", path)
            done = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)]), pa.array([len(data)])], ["path", "n_records", "n_bytes"])
            made, held, room = made + 1, [], 0
            return done

        for batch in batches:
            for k in range(batch.num_rows):
                ident, where, body, size, digest, refers_to = (batch.column(c)[k].as_py() for c in range(6))
                held.append(record(ident, where, body or b"", size, digest, refers_to))
                room += len(held[-1])
                if room >= archive_bytes:
                    yield put()
        if held:
            yield put()

    return checkpointed(rows.mapInArrow(write, MANIFEST_SCHEMA))


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all listed archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    data = source.read()
                rows = []
                for headers, block in records_of(data):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    whole = headers["WARC-Type"] == "response"
                    if whole and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} differs from its digest")
                    rows.append((_page_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], _page_id(headers.get("WARC-Refers-To")), size, digest, body if whole and with_payload else None))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                for at in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2000]), types)], RECORD_NAMES)

    return manifest.select("path").mapInArrow(read, RECORD_SCHEMA)


RECORD_NAMES = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


def archived(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back, without payloads."""
    from pyarrow import fs

    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    records = read_archives(write_archives(pages, folder), folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN k.keep <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keep <> p.page_id THEN k.keep END AS refers_to
FROM p LEFT JOIN k USING (payload_digest, payload_bytes)
"""
