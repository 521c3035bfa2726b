"""GIF media columns: lossless 8-bit samples in, timed frames and colour histograms out.

``encode_gif`` stores bytes as the palette indices of a grey-scale GIF, 192 pixels a row, LZW-compressed, in as many frames
as a frame's greatest height asks for. ``decode_gif`` reads any GIF 87a or 89a: LZW streams of any code size and table
growth, global and local palettes, interlacing, transparency, frame delays, and the disposal rules, and composes every
frame's picture on the canvas. Media are stored as a table in the shared folder; features are read from it: frames with their
times, places and the colour histograms of their composed pictures, and digests of the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import pieces, scratch_path

ROW = 192
TALLEST = 65535
PLACE = ("start", "delay", "left", "top", "width", "height")
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


@dataclass
class Frame:
    """One image of a file: start and delay in hundredths of a second, place, palette indices and composed RGBA picture."""

    start: int
    left: int
    top: int
    delay: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    picture: np.ndarray


def code_widths(count: int, minimum: int) -> np.ndarray:
    """Bits of the first ``count`` codes after a clear code: one more each time the table outgrows them, up to 12."""
    number = np.arange(1, count + 1) + (1 << minimum)
    return np.clip(np.floor(np.log2(number)).astype(np.int64) + 1, minimum + 1, 12)


def compress_lzw(samples: bytes, minimum: int = 8) -> bytes:
    """An LZW stream of samples; the table is cleared when it is full.

    Codes are kept shifted left by 8 bits here, so that a code and its next sample make a key by one operation.
    """
    clear, most = 1 << minimum, 4096 << 8
    runs: list[list[int]] = [[]]
    table: dict[int, int] = {}
    emit, find, free = runs[0].append, table.get, clear + 2 << 8
    rest = iter(samples)
    now = next(rest) << 8
    for s in rest:
        code = find(now | s)
        if code is not None:
            now = code
            continue
        emit(now)
        if free < most:
            table[now | s] = free
            free += 256
        else:
            emit(clear << 8)
            table.clear()
            runs.append([])
            emit, free = runs[-1].append, clear + 2 << 8
        now = s << 8
    emit(now)
    emit(clear + 1 << 8)
    # A clear code comes first; then each run ends with its own clear or end code.
    codes = np.concatenate([[clear << 8], *runs]).astype(np.int64) >> 8
    widths = np.concatenate([[minimum + 1], *(code_widths(len(r), minimum) for r in runs)])
    bits = ((codes[:, None] >> np.arange(12)) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def sub_blocks(data: bytes) -> bytes:
    """Data in counted blocks of at most 255 bytes, ended by an empty one."""
    whole = len(data) // 255
    blocks = np.empty((whole, 256), dtype=np.uint8)
    blocks[:, 0] = 255
    blocks[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return blocks.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(payload: bytes, delay: int = 10) -> bytes:
    """Payload bytes, a positive multiple of 192, as a grey-scale GIF89a; every frame starts on a cleared canvas."""
    height = len(payload) // ROW
    if not height or height * ROW != len(payload):
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    tallest = min(height, TALLEST)
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, tallest, 0xF7, 0, 0), GREY]
    for top in range(0, height, TALLEST):
        rows = min(TALLEST, height - top)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, ROW, rows, 0) + b"\x08")
        out.append(sub_blocks(compress_lzw(payload[top * ROW : (top + rows) * ROW])))
    return b"".join([*out, b"\x3b"])


def decode_lzw(data: bytes, minimum: int, pixels: int) -> np.ndarray:
    """The samples of any GIF LZW stream; a damaged or short stream leaves zeros at the end.

    Up to the next clear code, widths follow from the number of codes alone, so codes are unpacked a width at a time.
    """
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    clear, end = 1 << minimum, (1 << minimum) + 1
    base = [bytes([i]) for i in range(min(clear, 256))] + [b""] * (end + 1 - min(clear, 256))
    table, last, width, parts, filled, at = base.copy(), b"", minimum + 1, [], 0, 0
    while filled < pixels:
        # Codes of this width: until the table has an entry for its greatest value, without bound at 12 bits.
        count = min((1 << width) - len(table) + (not last) if width < 12 else 4096, (len(bits) - at) // width)
        if count <= 0:
            break
        codes = bits[at : at + count * width].reshape(count, width) @ (1 << np.arange(width))
        stop = np.flatnonzero((codes == clear) | (codes == end))[:1]
        run = codes[: stop[0] if len(stop) else count].tolist()
        fresh = len(parts)
        if not last and run:
            last = table[run[0]] if run[0] < clear else b""
            if not last:
                break
            parts.append(last)
            del run[0]
        put, add, size, whole = parts.append, table.append, len(table), True
        growing, full = run[: 4096 - size], run[4096 - size :]
        for code in growing:
            if code < size:
                text = table[code]
            elif code == size:
                text = last + last[:1]
            else:
                whole = False
                break
            add(last + text[:1])
            size += 1
            put(text)
            last = text
        if whole and full:  # no more entries
            parts += [table[code] for code in full]
            last = parts[-1]
        filled += sum(map(len, parts[fresh:]))
        if not whole:
            break
        if not len(stop):
            at += count * width
            width = min(width + 1, 12)
            continue
        at += (int(stop[0]) + 1) * width
        if codes[stop[0]] == end:
            break
        table, last, width = base.copy(), b"", minimum + 1
    return np.frombuffer(b"".join(parts)[:pixels].ljust(pixels, b"\0"), np.uint8)


def decode_gif(data: bytes) -> Iterator[Frame]:
    """All frames of a file in order; a frame's picture is the canvas itself and good until the next frame is asked for."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        palette, at = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size
    canvas = np.zeros((high, wide, 4), dtype=np.uint8)
    start, delay, disposal, clear = 0, 0, 0, None

    def block_data(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = block_data(at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block at byte {at}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if packed & 0x80:
            size = 3 << (packed & 7) + 1
            colours, at = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size
        minimum = data[at]
        stream, at = block_data(at + 1)
        indices = decode_lzw(stream, minimum, w * h).reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        shown = indices[: region.shape[0], : region.shape[1]]
        table = np.zeros((256, 4), dtype=np.uint8)
        if colours is not None:
            table[: len(colours), :3], table[: len(colours), 3] = colours, 255
        if clear is None:
            region[:] = table[shown]
        else:
            opaque = shown != clear
            region[opaque] = table[shown[opaque]]
        yield Frame(start, left, top, delay, disposal, clear, indices, canvas)
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = before
        start += delay
        delay, disposal, clear = 0, 0, None


def colour_histogram(picture: np.ndarray, band: int = 1 << 18) -> np.ndarray:
    """Opaque pixels in 16 equal ranges of red, of green and of blue, one after another; worked out in bands of pixels."""
    pixels, out = picture.reshape(-1, 4), np.zeros(48, dtype=np.int64)
    for lo in range(0, len(pixels), band):
        part = pixels[lo : lo + band]
        part = part if (part[:, 3] == 255).all() else part[part[:, 3] > 0]
        for c in range(3):
            out[16 * c : 16 * c + 16] += np.bincount(part[:, c], minlength=256).reshape(16, 16).sum(axis=1)
    return out


def padded_payload(text: str | None) -> bytes:
    """UTF-8 and spaces up to a positive multiple of 192 bytes."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delay: int = 10) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a GIF. A null text counts as empty; other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            media = [encode_gif(padded_payload(t), delay) for t in texts]
            sizes = [len((t or "").encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    return docs.select(*columns).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame, **options) -> DataFrame:
    """``text_media`` written to a table in the shared folder and read back from there."""
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    text_media(docs, **options).write.option("compression", "zstd").parquet(path)
    return spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """Decode the stored files of ``text_media``: sizes, digests of the samples and of the file, and frame features.

    frames holds every frame's start and delay in hundredths of a second, place, size, and the colour histogram of its composed
    picture; feature is the number of frames and those histograms over all frames as text. A file without frames has an
    empty payload. Rows that share an id are read each; an empty table gives no rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(lo, 256), []
                for data in batch.column(2):
                    data, samples, shown, total = data.as_py(), [], [], np.zeros(48, np.int64)
                    for f in decode_gif(data):
                        counts = colour_histogram(f.picture)
                        h, w = f.indices.shape
                        samples.append(f.indices.tobytes())
                        shown.append({"start": f.start, "delay": f.delay, "left": f.left, "top": f.top, "width": w, "height": h, "histogram": counts.tolist()})
                        total += counts
                    payload = b"".join(samples)
                    feature = f"{len(shown)}:" + ",".join(map(str, total.tolist()))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, shown))
                if rows:
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([(x, pa.int32()) for x in PLACE] + [("histogram", pa.list_(pa.int64()))])))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"])

    kinds = ",".join(f"{x}:int" for x in PLACE)
    return media.mapInArrow(decode, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<{kinds},histogram:array<long>>>")
