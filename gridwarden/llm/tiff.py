"""TIFF: write samples as pages, walk image directories, decode strips and tiles, one row per page.

Reads both byte orders, strips and tiles, no compression (1), LZW (5), deflate (8, 32946) and PackBits
(32773), horizontal differencing (predictor 2), 8- and 16-bit samples. Writes 8-bit pages of strips with any
of the four. A directory chain that loops, or offsets outside the file, raise ``TiffError``.

Defined results: a null file has no pages; an empty or damaged file gives one row with ``error`` set and
no page; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridwarden.llm.common import per_row, schema_of

#: Compression tags of the format (fixed values).
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of a field type (fixed values of the format).
_TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_INT_CODES = {1: "B", 3: "H", 4: "I"}


class TiffError(ValueError):
    """A file that is no readable TIFF."""


class Page(NamedTuple):
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: np.ndarray  # height x width x samples


# --- codecs ----------------------------------------------------------------------------------------


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, the rest as literals of at most 128 bytes."""
    out, values = bytearray(), np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.array([0])
    literal = 0

    def put_literal(end):
        for at in range(literal, end, 128):
            part = data[at : min(at + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= 3:
            put_literal(a)
            for at in range(a, b, 128):
                out.append((257 - min(128, b - at)) & 255 if min(128, b - at) > 1 else 0)
                out.append(data[a])
            literal = b
    put_literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first; the code width grows one code early, as the format has it."""
    clear, end = 256, 257
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, out, before = list(first), 9, 0, 0, [], None
    for byte in data:
        held, bits = ((held << 8) | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = (held >> bits) & ((1 << width) - 1)
        if code == end:
            break
        if code == clear:
            table, width, before = list(first), 9, None
            continue
        if before is None:
            entry = table[code] if code < 256 else None
        elif code < len(table):
            entry = table[code]
            table.append(before + entry[:1])
        elif code == len(table):
            entry = before + before[:1]
            table.append(entry)
        else:
            entry = None
        if not entry:
            raise TiffError("LZW code outside the table")
        out.append(entry)
        before = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code):
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    put(256)
    table, word = {bytes([i]): i for i in range(256)}, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        if len(table) + 2 >= 4094:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        elif len(table) + 2 >= 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _decode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as error:
            raise TiffError(f"deflate: {error}") from error
    if compression == LZW:
        return lzw_decode(data)
    if compression == PACKBITS:
        return packbits_decode(data)
    raise TiffError(f"compression {compression} is not supported")


def _encode(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 1), LZW: lzw_encode, PACKBITS: packbits_encode}[compression](data)


# --- files -----------------------------------------------------------------------------------------


def write_tiff(samples: bytes, width: int, page_rows: int, strip_rows: int = 64, compression: int = DEFLATE, predictor: int = 2) -> bytes:
    """8-bit grey pages of ``page_rows`` rows (the last may have fewer), each in strips, each with its directory."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(rows), page_rows):
        page, offsets, counts = rows[top : top + page_rows], [], []
        for at in range(0, len(page), strip_rows):
            strip = page[at : at + strip_rows]
            if predictor == 2:
                strip = np.diff(strip, axis=1, prepend=np.uint8(0)).astype(np.uint8)
            data = _encode(strip.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        fields = [(256, 4, [width]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (273, 4, offsets), (277, 3, [1]), (278, 4, [strip_rows]), (279, 4, counts), (317, 3, [predictor])]
        arrays = {}
        for tag, _, values in fields:
            if len(values) > 1:
                arrays[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, kind, values in fields:
            value = struct.pack("<I", arrays[tag]) if tag in arrays else struct.pack("<" + _INT_CODES[kind], values[0]).ljust(4, b"\0")
            out += struct.pack("<HHI", tag, kind, len(values)) + value
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in _INT_CODES:
                continue
            where = at + 10 + 12 * i
            if _TYPE_BYTES[kind] * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + _TYPE_BYTES[kind] * count > len(data):
                raise TiffError("values outside the file")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{_INT_CODES[kind]}", data, where))
        return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as error:
        raise TiffError(f"directory outside the file: {error}") from error


def read_tiff(data: bytes) -> Iterator[Page]:
    """Pages in file order; one is decoded at a time."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        tags, following = _directory(data, at, order)
        yield _page(data, tags, len(seen) - 1, order)
        at = following
    if not seen:
        raise TiffError("no directory")


def _page(data: bytes, tags: dict[int, list[int]], number: int, order: str) -> Page:
    one = lambda tag, default=None: (tags.get(tag) or [default])[0]
    width, height, compression, samples, predictor = one(256), one(257), one(259, 1), one(277, 1), one(317, 1)
    if not width or not height:
        raise TiffError("page without size")
    bits = set(tags.get(258) or [1])
    if bits not in ({8}, {16}) or predictor not in (1, 2) or not samples:
        raise TiffError(f"bits {sorted(bits)}, predictor {predictor} are not supported")
    dtype = np.dtype(np.uint8) if bits == {8} else np.dtype(order + "u2")
    planes = samples if one(284, 1) == 2 and samples > 1 else 1
    deep = samples // planes
    tiled = 322 in tags
    block_w, block_h = (one(322), one(323)) if tiled else (width, min(one(278, height) or height, height))
    offsets, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    across, down = -(-width // (block_w or 1)), -(-height // (block_h or 1))
    if not block_w or not block_h or not offsets or not counts or len(offsets) != len(counts) or len(offsets) != across * down * planes:
        raise TiffError("strips or tiles do not cover the page")
    pixels = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for i, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        if at + n > len(data):
            raise TiffError("strip or tile outside the file")
        plane, place = divmod(i, across * down)
        top, left = place // across * block_h, place % across * block_w
        rows = block_h if tiled else min(block_h, height - top)
        raw = _decode(data[at : at + n], compression)
        if len(raw) < rows * block_w * deep * dtype.itemsize:
            raise TiffError("strip or tile holds too few samples")
        block = np.frombuffer(raw, dtype, rows * block_w * deep).reshape(rows, block_w, deep).astype(pixels.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=pixels.dtype)
        kept = block[: height - top, : width - left]
        pixels[top : top + kept.shape[0], left : left + kept.shape[1], plane * deep : (plane + 1) * deep] = kept
    return Page(number, width, height, samples, 8 * dtype.itemsize, compression, pixels)


# --- on tables -------------------------------------------------------------------------------------

_PAGES = schema_of("page int, width int, height int, samples int, bits int, compression int, pixels binary, error string")


def tiff_pages(df: DataFrame, content: str = "content", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per page of each file: size, format and pixels (rows first, samples last, native byte order)."""
    passed = [c for c in keep if c not in _PAGES.names]
    schema = T.StructType([df.schema[c] for c in passed] + list(_PAGES.fields))
    arrow = to_arrow_schema(schema)

    def pages(data):
        if data is None:
            return
        try:
            for p in read_tiff(data):
                yield p.number, p.width, p.height, p.samples, p.bits, p.compression, p.pixels.tobytes(), None
        except TiffError as error:
            yield None, None, None, None, None, None, None, str(error)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                known = {c: row.column(i)[0].as_py() for i, c in enumerate(passed)}
                for made in pages(row.column(len(passed))[0].as_py()):
                    yield pa.RecordBatch.from_pylist([known | dict(zip(_PAGES.names, made, strict=True))], schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{content}`").alias("_content")).mapInArrow(run, schema)


#: Payloads are padded to a multiple of this, which is also the width of a page.
WIDTH = 576
PAGE_ROWS = 2048


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text with bytes 255 up to a positive multiple of the width; the length before."""
    data = (text or "").encode("utf-8")
    return data + b"\xff" * ((-len(data)) % WIDTH if data else WIDTH), len(data)


def feature_of(pages: Iterator[Page]) -> tuple[bytes, str]:
    """Payload of all pages in order, and pages, rows, mean and shares of 16 brightness bands in parts per million."""
    parts, n, rows, bins = [], 0, 0, np.zeros(256, np.int64)
    for p in pages:
        parts.append(p.pixels.tobytes())
        bins += np.bincount(p.pixels.ravel(), minlength=256)
        n, rows = n + 1, rows + p.height
    total = int(bins.sum())
    mean = int((bins * np.arange(256)).sum()) * 1000 // total
    shares = ",".join(str(int(x) * 1_000_000 // total) for x in bins.reshape(16, 16).sum(axis=1))
    return b"".join(parts), f"pages={n};rows={rows};mean_milli={mean};bands={shares}"


def tiff_store(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), compression: int = DEFLATE) -> DataFrame:
    """Texts as stored files: ``keep`` columns, n_bytes (before padding), content binary."""

    def setup():
        def one(value):
            payload, n = padded(value)
            return n, write_tiff(payload, WIDTH, PAGE_ROWS, compression=compression)

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[], []]

    return per_row(df, setup, "n_bytes long, content binary", [text], keep)


def tiff_features(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), compression: int = DEFLATE) -> DataFrame:
    """Store each text as a file, read the stored bytes back page by page, and describe what was read.

    ``keep`` columns, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    The file lives only inside the task: nothing is shuffled.
    """

    def setup():
        def one(value):
            payload, n = padded(value)
            media = write_tiff(payload, WIDTH, PAGE_ROWS, compression=compression)
            back, feature = feature_of(read_tiff(media))
            return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[]] * 7

    return per_row(df, setup, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", [text], keep)
