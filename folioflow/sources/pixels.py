"""Pixels of PNG and TIFF files, band by band.

A band is some rows of a picture, 8 bits a channel, red, green and blue. PNG lines are inflated and freed of their filters one
after the other, TIFF strips one by one, so that a picture is never held as more than its stored bytes and one band; an
interlaced PNG, whose passes cover the whole page, is the exception. The bands are pieces of rasters as ``operators.tiles``
takes them.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.sources.pdf_objects import undone

#: The passes of an interlaced PNG (first column, first row, column step, row step), and channels by colour type.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
BANDS = "path string, height int, width int, y int, x int, h int, w int, samples binary, error string"


def samples(lines: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    """(rows, width, channels) numbers of packed lines; of 16 bits the upper 8 stay."""
    if bits == 16:
        return lines.reshape(len(lines), -1)[:, 0 : width * channels * 2 : 2].reshape(len(lines), width, channels)
    if bits == 8:
        return lines[:, : width * channels].reshape(len(lines), width, channels)
    apart = np.unpackbits(lines, axis=1)[:, : width * channels * bits].reshape(len(lines), width, channels, bits)
    return (apart * (1 << np.arange(bits - 1, -1, -1))).sum(axis=-1).astype(np.uint8)


def coloured(found: np.ndarray, bits: int, palette: np.ndarray | None, inverted: bool = False) -> np.ndarray:
    """(rows, width, 3) colours of grey levels, palette places or colours; what is more than these is left out."""
    if palette is not None:
        return palette[np.minimum(found[..., 0], len(palette) - 1)]
    if bits < 8:
        found = (found.astype(np.int32) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if inverted:
        found = 255 - found
    return np.repeat(found[..., :1], 3, axis=2) if found.shape[2] < 3 else found[..., :3]


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        yield kind, raw[at + 8 : at + 8 + size]
        at += 12 + size


def png_bands(raw: bytes, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    head, palette, stored = None, None, zlib.decompressobj()
    waiting = bytearray()
    parts: Iterator[bytes] = (data for kind, data in found if kind == b"IDAT") if (found := list(chunks(raw))) else iter(())
    for kind, data in found:
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
    if head is None or head[3] not in CHANNELS or head[2] not in (1, 2, 4, 8, 16) or not head[0] or not head[1]:
        raise ValueError("no picture head")
    width, height, bits, colour, _, _, interlaced = head
    if colour == 3 and palette is None:
        raise ValueError("no palette")
    channels = CHANNELS[colour]
    palette, pixel = palette if colour == 3 else None, max(1, channels * bits // 8)

    def line(n: int) -> bytes:
        while len(waiting) < n:
            part = next(parts, None)
            if part is None:
                raise ValueError("picture ends early")
            waiting.extend(stored.decompress(part))
        out = bytes(waiting[:n])
        del waiting[:n]
        return out

    def lines(w: int, h: int) -> Iterator[np.ndarray]:
        size = -(-w * channels * bits // 8)
        above = bytearray(size)
        for _ in range(h):
            one = line(1 + size)
            if one[0] > 4:
                raise ValueError("unknown filter")
            above = undone(one[0], np.frombuffer(one, np.uint8)[1:], above, pixel)
            yield np.frombuffer(bytes(above), np.uint8)

    if not interlaced:
        every = lines(width, height)
        for y in range(0, height, rows):
            band = np.stack([next(every) for _ in range(min(rows, height - y))])
            yield y, coloured(samples(band, width, channels, bits), bits, palette)
        return
    whole = np.zeros((height, width, 3), dtype=np.uint8)
    for x0, y0, dx, dy in PASSES:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w > 0 and h > 0:
            whole[y0::dy, x0::dx] = coloured(samples(np.stack(list(lines(w, h))), w, channels, bits), bits, palette)
    for y in range(0, height, rows):
        yield y, whole[y : y + rows]


def unpacked_bits(data: bytes) -> bytes:
    """Runs and copies of bytes, told by a count before each."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_codes(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, widened one code early; 256 clears and 257 ends."""
    out, table, size, before = bytearray(), [], 9, b""
    number, have = 0, 0
    for byte in data:
        number, have = (number << 8 | byte) & 0xFFFFFF, have + 8
        if have < size:
            continue
        have -= size
        code = number >> have & (1 << size) - 1
        if code == 257:
            break
        if code == 256:
            table, size, before = [], 9, b""
            continue
        if code > 258 + len(table):
            raise ValueError("code out of turn")
        entry = bytes([code]) if code < 256 else table[code - 258] if code - 258 < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
        out += entry
        before = entry
        size = min(12, max(9, (259 + len(table)).bit_length()))
    return bytes(out)


def tiff_bands(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    order = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        if kind not in (1, 3, 4):
            continue
        letter = {1: "B", 3: "H", 4: "I"}[kind]
        place = at + 10 + 12 * k
        if struct.calcsize(order + letter * n) > 4:
            place = struct.unpack_from(order + "I", raw, place)[0]
        tags[tag] = struct.unpack_from(order + letter * n, raw, place)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bits, channels, packing, shown = one(256, 0), one(257, 0), one(258, 1), one(277, 1), one(259, 1), one(262, 1)
    unpack = {1: bytes, 5: unpacked_codes, 32773: unpacked_bits, 8: zlib.decompress, 32946: zlib.decompress}.get(packing)
    if unpack is None or bits not in (1, 2, 4, 8, 16) or not width or not height or one(284, 1) != 1 or 273 not in tags or one(317, 1) not in (1, 2) or (one(317, 1) == 2 and bits != 8):
        raise ValueError("a TIFF of another kind")
    palette = None
    if shown == 3:
        palette = (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8)
    per, size = min(one(278, height), height), -(-width * channels * bits // 8)
    for k, (start, length) in enumerate(zip(tags[273], tags[279])):
        n = min(per, height - k * per)
        if n <= 0:
            break
        data = unpack(raw[start : start + length])[: n * size]
        if len(data) < n * size:
            raise ValueError("picture ends early")
        lines = np.frombuffer(data, np.uint8).reshape(n, size)
        if bits == 16 and order == "<":
            lines = lines.reshape(n, -1, 2)[..., ::-1].reshape(n, size)
        found = samples(lines, width, channels, bits)
        if one(317, 1) == 2:
            found = np.cumsum(found, axis=1, dtype=np.uint8)
        yield k * per, coloured(found, bits, palette, inverted=shown == 0)


def bands_of(raw: bytes, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and pixels of a picture's bands; none for other formats."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        yield from png_bands(raw, rows)
    elif raw[:4] in (b"II*\0", b"MM\0*"):
        yield from tiff_bands(raw)


def size_of(raw: bytes) -> tuple[int, int]:
    """Height and width, from the head alone."""
    if raw[:1] == b"\x89":
        return struct.unpack(">II", raw[16:24])[::-1]
    order = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", raw, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind = struct.unpack_from(order + "HH", raw, at + 2 + 12 * k)
        found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), raw, at + 10 + 12 * k)[0]
    return found[257], found[256]


FAULTS = (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError, OverflowError)


def said(fault: Exception) -> str:
    return re.sub(r"\s+", " ", str(fault)) or type(fault).__name__


def read_bands(raw: bytes, rows: int = 64) -> tuple[list[tuple[int, np.ndarray]], str | None]:
    """All bands of a picture, or none and what is wrong with it."""
    try:
        return list(bands_of(raw, rows)), None
    except FAULTS as fault:
        return [], said(fault)


def image_bands(files: DataFrame, rows: int = 64) -> DataFrame:
    """The pieces of the pictures in PNG and TIFF files (path, content): path, height, width, y, x, h, w, samples and error.

    PNG of 1 to 16 bits with or without palette, transparency (left out) and interlacing; TIFF in strips, not packed or by runs,
    codes or deflation. A file that cannot be read, or only in part, has one row more that says why; files of other formats have
    none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py() or b""
                row = lambda *values: pa.RecordBatch.from_arrays([pa.array([path], pa.string()), *(pa.array([v], pa.int32()) for v in values[:6]), pa.array([values[6]], pa.binary()), pa.array([values[7]], pa.string())], names=["path", "height", "width", "y", "x", "h", "w", "samples", "error"])  # noqa: B023,E731
                try:
                    size = None
                    for y, band in bands_of(raw, rows):
                        size = size or size_of(raw)
                        yield row(*size, y, 0, band.shape[0], band.shape[1], np.ascontiguousarray(band).tobytes(), None)
                except FAULTS as fault:
                    yield row(*(None,) * 7, said(fault))

    return files.select("path", "content").mapInArrow(read, BANDS)
