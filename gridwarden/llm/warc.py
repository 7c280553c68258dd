"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Layout of an archive: the skippable frame (magic 0x184D2A5D, 32-bit length) holds the dictionary, as it is
or itself compressed; every record is a frame of its own, so a reader can start at any record. Writing
never replaces a file: each archive has a fresh name, and only archives named in the manifest that the
finished tasks wrote are read, so tasks that ran twice leave no doubled records.

Equal payloads are stored once: the record with the largest page_id is a response, the others are revisits
that refer to it.

Defined results: null html is an empty payload; a null url leaves out its header; a null page_id is never
the largest of a group with other ids, and rows that repeat the largest page_id of a group are all responses;
an empty table gives no archive and no rows. Damage (lengths, terminators, versions, digests) raises
``WarcError``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import schema_of
from gridwarden.session import cut_lineage, shared_dir

SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
_READ = 65_536
_END = b"\r\n\r\n"


class WarcError(ValueError):
    """An archive or record that does not hold what its headers say."""


def digest_text(sha1: bytes) -> str:
    """A SHA-1 as bare upper-case base32 (20 bytes need no padding)."""
    return base64.b32encode(sha1).decode()


# --- records ---------------------------------------------------------------------------------------


def _header_value(text: str) -> str:
    return quote(text, safe=":/?#[]@!$&'()*+,;=%~-._")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(value: str) -> int | None:
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise WarcError(f"no page in record id {value!r}")
    number = value[10:-1]
    return int(number) if number else None


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit holds the HTTP head of its payload (with its length), but not the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest_text(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: sha1:{digest_text(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record, checked: version, mandatory headers, lengths, terminator, digests."""
    end = record.find(_END)
    if end < 0:
        raise WarcError("record without end of headers")
    first, *lines = record[:end].decode("utf-8").split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC version: {first[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"malformed header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]
    if missing:
        raise WarcError(f"mandatory headers missing: {missing}")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit():
        raise WarcError(f"bad content length: {length!r}")
    block, after = record[end + 4 : end + 4 + int(length)], record[end + 4 + int(length) :]
    if len(block) != int(length) or after != _END:
        raise WarcError("content length does not fit the record")
    if (told := headers.get("warc-block-digest")) and told != f"sha1:{digest_text(hashlib.sha1(block).digest())}":
        raise WarcError("block digest differs")
    out = {"headers": headers, "record_type": headers["warc-type"], "payload": None, "payload_bytes": None, "payload_digest": None}
    if out["record_type"] not in ("response", "revisit"):
        return out
    http_end = block.find(_END)
    if not block.startswith(b"HTTP/") or http_end < 0:
        raise WarcError("block without HTTP head")
    sizes = [x.partition(b":")[2].strip() for x in block[:http_end].split(b"\r\n") if x.lower().startswith(b"content-length:")]
    payload, told = block[http_end + 4 :], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] == "response":
        if sizes and int(sizes[0]) != len(payload):
            raise WarcError("HTTP content length differs from the payload")
        found = digest_text(hashlib.sha1(payload).digest())
        if told and told != found:
            raise WarcError("payload digest differs")
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
    if not told or "warc-refers-to" not in headers or not sizes:
        raise WarcError("revisit without digest, length or record referred to")
    return out | {"payload_bytes": int(sizes[0]), "payload_digest": told}


# --- archives --------------------------------------------------------------------------------------


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample records; with too few of them, their own last bytes serve as one."""
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame with the dictionary, itself compressed."""
    content = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content


def read_records(stream: BinaryIO) -> Iterator[bytes]:
    """Records of an open archive, one frame at a time; memory follows the largest record."""
    start = stream.read(8)
    dictionary, pending = None, start
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == SKIPPABLE_MAGIC:
        length = struct.unpack("<I", start[4:])[0]
        data = stream.read(length)
        if len(data) != length:
            raise WarcError("dictionary frame cut short")
        if data[:4] == FRAME_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 27)
        dictionary, pending = _as_dictionary(data) if data else None, b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        pending = pending or stream.read(_READ)
        if not pending:
            return
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(pending))
            except zstandard.ZstdError as error:
                raise WarcError(f"not a frame of this archive: {error}") from error
            pending = frame.unused_data
            if frame.eof:
                break
            pending = stream.read(_READ)
            if not pending:
                raise WarcError("frame cut short")
        yield b"".join(parts)


_MANIFEST = schema_of("path string, records long, bytes long")
_READ_BACK = schema_of("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Which pages refer to another page's payload. Only digests that occur more than once meet the pages again."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html")
    ).withColumn("_sha1", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    counted = rows.filter(F.octet_length("html") >= least_bytes).groupBy("_sha1").agg(F.max("page_id").alias("_largest"), F.count("*").alias("_n"))
    shared = cut_lineage(counted.filter("_n > 1 and _largest is not null").select("_sha1", "_largest"), "warc-shared")
    revisit = F.col("_largest").isNotNull() & ~F.col("_largest").eqNullSafe(F.col("page_id"))
    joined = rows.join(shared, "_sha1", "left")
    return joined.select("page_id", "url", "html", revisit.alias("_revisit"), F.when(revisit, F.col("_largest")).alias("_refers_to"))


def write_archives(plan: DataFrame, folder: str, archive_bytes: int = 64_000_000, dictionary_bytes: int = 32_768, sample_records: int = 128, level: int = 3) -> DataFrame:
    """Write marked pages as archives under ``folder`` (any URI pyarrow opens); returns the stored manifest.

    Each archive's dictionary is trained on its first ``sample_records`` records (a bounded sample; it
    affects the size only).
    """
    schema = to_arrow_schema(_MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        rows = (tuple(x.values()) for batch in batches for x in _slices(batch))
        held: list[bytes] = []
        done, out, waiting = [], None, 0

        def start(samples):
            dictionary = train_dictionary(samples, dictionary_bytes)
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            stream = where.open_output_stream(path, compression=None)
            stream.write(dictionary_frame(dictionary))
            return [path, stream, zstandard.ZstdCompressor(level=level, dict_data=_as_dictionary(dictionary), write_content_size=True), 0]

        def put(archive, records):
            for record in records:
                archive[1].write(archive[2].compress(record))
                archive[3] += 1

        def close(archive):
            size = archive[1].tell()
            archive[1].close()
            done.append({"path": archive[0], "records": archive[3], "bytes": size})

        where.create_dir(base, recursive=True)
        for page, url, html, revisit, refers in rows:
            record = build_record(page, url, html.encode("utf-8"), refers, revisit)
            if out is None:
                held.append(record)
                waiting += len(record)
                if len(held) < sample_records and waiting < 4_000_000:
                    continue
                out = start(held)
                put(out, held)
                held, waiting = [], 0
            else:
                put(out, [record])
                if out[1].tell() >= archive_bytes:
                    close(out)
                    out = None
        if held:
            out = start(held)
            put(out, held)
        if out:
            close(out)
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return cut_lineage(plan.mapInArrow(run, _MANIFEST), "warc-manifest")


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[dict]:
    for at in range(0, batch.num_rows, rows):
        yield from batch.slice(at, rows).to_pylist()


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives in a manifest, one archive per task at a time, checked as they are read."""
    schema = to_arrow_schema(_READ_BACK)
    tasks = max(1, min(manifest.count(), 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, read = [], 0, 0
                with where.open_input_stream(path, compression=None) as stream:
                    for record in read_records(stream):
                        found, read = parse_record(record), read + 1
                        headers, url = found["headers"], found["headers"].get("warc-target-uri")
                        refers = headers.get("warc-refers-to")
                        rows.append(
                            {
                                "page_id": _page_of(headers["warc-record-id"]), "url": None if url is None else unquote(url), "payload_bytes": found["payload_bytes"], "payload_digest": found["payload_digest"],
                                "record_type": found["record_type"], "refers_to": None if refers is None else _page_of(refers), "payload": found["payload"] if with_payload else None,
                            }
                        )
                        size += len(record) if with_payload else 200
                        if size >= 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if read != told:
                    raise WarcError(f"{path}: {read} records, {told} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("path", "records").repartition(tasks).mapInArrow(run, _READ_BACK)


def warc_round_trip(pages: DataFrame, with_payload: bool = False, **options) -> DataFrame:
    """Write pages as archives in the session's shared folder and read the records back."""
    folder = shared_dir(pages.sparkSession, "warc")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    manifest = write_archives(mark_revisits(pages), uri, **options)
    return read_archives(manifest, uri, with_payload)
