"""WARC archives whose records are compressed one by one with a Zstandard dictionary that the archive itself carries.

An archive begins with a skippable frame that holds the dictionary, built from records of that archive; every record after
it is a frame of its own, so that one can be read without the others. Records with equal payloads are written once, as a
response; the others revisit it by record id and carry no payload. Tasks write archives of bounded size side by side, each
under a name that its partition gives, through a temporary name and in a fixed order: a task that is run again, or twice at a
time, replaces its files by the same ones.

Reading takes whole archives as Spark's binary files, finds each frame's end while it decompresses it, checks every digest
and gives the records with their places; revisits are joined with what they refer to.

Defined results: a null body counts as empty; of equal payloads of ``min_bytes`` or more the row with the greatest id is the
response, smaller payloads are always responses; rows that repeat an id and its payload are all what one of them is; null
ids revisit where the payload has an id at all, and are responses elsewhere; an empty table gives no archive and an empty
table; other columns are ignored, whatever their names; control characters of addresses are percent-encoded.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm import common
from loomsieve.llm.common import Scratch, documents, materialise, shared_dir, worker_serves

#: Bytes of an archive's records before compression; of a dictionary, and of the records that it is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 10, 4 << 20
LEVEL = 3
#: The skippable frame that holds a dictionary, as the format says.
DICTIONARY_MAGIC = 0x184D2A5D
#: Names record ids; the date of records whose pages have none.
_NAMESPACE, DATE = uuid.UUID("6f0a2f0e-54f4-4c0f-8d2f-3c7f6a1e9b10"), "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f<>]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for rows of one id and payload, and for no others."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def _header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def response_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A record before compression. With ``refers_to`` (a record id) it is a revisit, and its payload stays out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if refers_to:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", refers_to)]
    return _header(fields, http if refers_to else http + payload)


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary; records too few or too small to train one are the dictionary themselves."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: DICTIONARY_BYTES * 2])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(size // 8, 1024)), sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


# --- files in the shared folder --------------------------------------------------------------------------------


def _filesystem(path: str):
    """Arrow's view of a shared folder, and the path in it; plain paths and file: addresses are local to the folder's mount."""
    from pyarrow import fs

    parts = urlparse(path)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _put(folder: str, name: str, data: list[bytes]) -> None:
    """A whole file or none: written beside its place and then renamed. Another attempt at a task has written the same bytes."""
    files, at = _filesystem(folder)
    files.create_dir(at, recursive=True)
    beside = f"{at}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as out:
        for part in data:
            out.write(part)
    try:
        files.move(beside, f"{at}/{name}")
    except OSError:  # where a rename doesn't replace a file
        files.delete_file(f"{at}/{name}")
        files.move(beside, f"{at}/{name}")


class _Archive:
    """Records waiting for their archive."""

    def __init__(self) -> None:
        self.records: list[bytes] = []
        self.names: list[tuple[int | None, str]] = []
        self.size = 0

    def write(self, folder: str, name: str) -> pa.RecordBatch:
        dictionary = dictionary_of(self.records)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True).compress
        frames = [compress(r) for r in self.records]
        lead = dictionary_frame(dictionary)
        _put(folder, name, [lead, *frames])
        offsets, at = [], len(lead)
        for f in frames:
            offsets.append(at)
            at += len(f)
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(frames), pa.string()), pa.array(offsets, pa.int64()), pa.array([len(f) for f in frames], pa.int64()), pa.array([p for p, _ in self.names], pa.int64()), pa.array([r for _, r in self.names], pa.string())],
            ["archive", "at", "length", "page_id", "record_id"],
        )


def _write(folder: str, prefix: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_serves("warc")
        partition, k, archive = TaskContext.get().partitionId(), 0, _Archive()
        for batch in batches:
            for page, url, body, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "first_id")), strict=True):
                payload = (body or "").encode("utf-8", "surrogatepass")
                digest = digest_of(payload)
                record = response_bytes(page, url, payload, digest, record_id(first, digest) if first is not None else None, date)
                if archive.size and archive.size + len(record) > archive_bytes:
                    yield archive.write(folder, f"{prefix}-{partition:06d}-{k:04d}.warc.zst")
                    k, archive = k + 1, _Archive()
                archive.records.append(record)
                archive.names.append((page, record_id(page, digest)))
                archive.size += len(record)
        if archive.records:
            yield archive.write(folder, f"{prefix}-{partition:06d}-{k:04d}.warc.zst")

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", prefix: str = "pages", date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row; gives where each is: archive, at, length (of its frame), page_id, record_id."""
    scratch = Scratch()
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(body_col).alias("body"), F.unhex(F.sha2(body, 256)).alias("payload"), F.octet_length(body).alias("size"))
    # The greatest id of each payload; ids and hashes alone are shuffled for it. It is written, so that the join below reads
    # two exchanges, which adaptive execution can split where a payload is in a third of the rows.
    firsts = scratch(rows.filter(F.col("size") >= min_bytes).groupBy("payload").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select("payload", "last"))
    volume = rows.agg(F.coalesce(F.sum(F.col("size") + 512), F.lit(0))).first()[0]
    revisits = (F.col("size") >= min_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    named = rows.join(firsts, "payload", "left").select("page_id", "url", F.col("body"), F.when(revisits, F.col("last")).alias("first_id"))
    # Sorted, so that every attempt at a task writes the same bytes and names the same places.
    dealt = named.repartition(max(1, -(-volume // archive_bytes)), F.xxhash64("page_id", "url")).sortWithinPartitions("page_id", "url", F.xxhash64("body"))
    written = materialise(dealt.mapInArrow(_write(folder, prefix, date, archive_bytes), "archive string, at long, length long, page_id long, record_id string"))
    scratch.drop()
    return written


# --- reading ---------------------------------------------------------------------------------------------------


def dictionary_in(archive: memoryview) -> tuple[bytes | None, int]:
    """The dictionary of an archive, if it begins with one, and where its records begin."""
    if len(archive) >= 8:
        magic, size = struct.unpack_from("<II", archive)
        if magic == DICTIONARY_MAGIC:
            found = bytes(archive[8 : 8 + size])
            if found[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):  # the dictionary may be compressed itself
                found = zstandard.ZstdDecompressor().decompressobj().decompress(found)
            return found, 8 + size
    return None, 0


def frames_of(archive: bytes, step: int = 1 << 13) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every record frame."""
    view = memoryview(archive)
    dictionary, at = dictionary_in(view)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary is not None else zstandard.ZstdDecompressor()
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        frame, end, out = decompressor.decompressobj(), at, io.BytesIO()
        while not frame.eof:
            if end >= len(view):
                raise ValueError(f"the frame at {at} is cut short")
            out.write(frame.decompress(view[end : end + step]))
            end = min(end + step, len(view))
        end -= len(frame.unused_data)
        yield at, end - at, out.getvalue()
        at = end


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields, names in lower case, and its payload (what follows the HTTP header)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


_RECORD = "archive string, at long, length long, record_type string, record_id string, url string, date string, page_id long, payload_digest string, refers_to_record string, payload_bytes long, payload string"


def _read(with_payload: bool):
    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_serves("warc")
        for batch in batches:
            for k in range(batch.num_rows):
                name = os.path.basename(batch.column("path")[k].as_py())
                rows, size = [], 0
                for at, length, record in frames_of(batch.column("content")[k].as_py()):
                    fields, payload = parsed(record)
                    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    whole = kind == "response"
                    if whole and digest != digest_of(payload):
                        raise ValueError(f"{name}: the payload at {at} doesn't have the digest that its record names")
                    page = fields.get("page-id")
                    text = payload.decode("utf-8", "surrogatepass") if whole and with_payload else None
                    rows.append((name, at, length, kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-date"), int(page) if page else None, digest or None, fields.get("warc-refers-to"), len(payload) if whole else None, text))
                    size += len(record)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the folder's archives, dictionary or not. Digests of payloads are checked."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return found.select("path", "content").mapInArrow(_read(with_payload), _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits with payload_bytes, and refers_to, the page_id of what a revisit refers to."""
    slim = records.filter(F.col("record_type").isin("response", "revisit")).select("record_type", "record_id", "page_id", "payload_digest", "refers_to_record", "payload_bytes")
    slim = materialise(slim)
    named = slim.filter("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("whole"))
    joined = slim.join(materialise(named).withColumnRenamed("record_id", "refers_to_record"), "refers_to_record", "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "whole").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/loomsieve-{uuid.uuid4().hex}"
    atexit.register(common._remove, spark, folder)
    where = write_archives(documents(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    if where.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return resolved(read_archives(spark, folder, with_payload=False))


_BITS = "array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '')"
_CHARACTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{1 << (4 - j)} * CAST(substr(bits, 5 * i + {j + 1}, 1) AS BIGINT)" for j in range(5)) + ", 1)"
_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
  b AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY h) AS top, {_BITS} AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {_CHARACTER}), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM b
"""

QUERIES = {"op12_warc": op12_warc}
ORACLE = {"op12_warc": _SQL}
