"""PNG and TIFF pixels by bands, against generated files; bad files; from files through tiles."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from folioflow.operators import tiles
from folioflow.sources import files, pixels

PASSES = [(y, x, dy, dx) for x, y, dx, dy in pixels.PASSES]


def packed_lines(a, bits):
    """Lines of (h, w, n) numbers at so many bits."""
    h, w, n = a.shape
    if bits == 16:
        return a.astype(">u2").reshape(h, -1).view(np.uint8)
    if bits == 8:
        return a.astype(np.uint8).reshape(h, w * n)
    apart = (a.reshape(h, w * n, 1) >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(apart.reshape(h, -1).astype(np.uint8), axis=1)


def filtered(lines, pixel, first):
    out, above = b"", np.zeros(lines.shape[1], int)
    for i, line in enumerate(lines.astype(int)):
        left = np.concatenate([np.zeros(min(pixel, len(line)), int), line[:-pixel]])[: len(line)]
        corner = np.concatenate([np.zeros(min(pixel, len(line)), int), above[:-pixel]])[: len(line)]
        far = np.stack([abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)])
        near = np.choose(far.argmin(axis=0), [left, above, corner])
        kind = (first + i) % 5
        out += bytes([kind]) + ((line - [0 * line, left, above, (left + above) // 2, near][kind]) & 255).astype(np.uint8).tobytes()
        above = line
    return out


def png(a, bits, colour, palette=None, interlaced=False):
    h, w, n = a.shape
    pixel = max(1, n * bits // 8)
    parts = [a[y::dy, x::dx] for y, x, dy, dx in PASSES] if interlaced else [a]
    body = b"".join(filtered(packed_lines(p, bits), pixel, k) for k, p in enumerate(parts) if p.size)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = zlib.compress(body)
    cut = len(data) // 2
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, int(interlaced)))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b"") + chunk(b"IDAT", data[:cut]) + chunk(b"IDAT", data[cut:]) + chunk(b"IEND", b"")


def shown(a, bits, palette=None, inverted=False):
    if palette is not None:
        return palette[a[..., 0]]
    a = a >> 8 if bits == 16 else a * 255 // ((1 << bits) - 1)
    a = 255 - a if inverted else a
    return np.repeat(a[..., :1], 3, axis=2) if a.shape[2] < 3 else a[..., :3]


def put_together(bands):
    return np.concatenate([b for _, b in bands]).astype(int)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("bits, colour, n", [(1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3), (1, 3, 1), (2, 3, 1), (4, 3, 1), (8, 3, 1), (8, 4, 2), (16, 4, 2), (8, 6, 4), (16, 6, 4)])
def test_png_of_every_kind(bits, colour, n, interlaced):
    rng = np.random.default_rng(bits + colour)
    for h, w in ((1, 1), (3, 5), (21, 17)):
        a = rng.integers(0, 1 << bits, (h, w, n))
        palette = rng.integers(0, 256, (1 << bits, 3)) if colour == 3 else None
        bands, error = pixels.read_bands(png(a, bits, colour, palette, interlaced), rows=4)
        assert error is None and (put_together(bands) == shown(a, bits, palette)).all() and [y for y, _ in bands] == list(range(0, h, 4))


def runs(data):
    out = b""
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out + b"\x80"


def codes(data):
    """Codes as a TIFF stores them: widths grow one code early, cleared when the table is full."""
    bits, table, size, word = "", {}, 9, b""
    put = lambda code: format(code, f"0{size}b")
    bits += put(256)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        bits += put(table[word] if len(word) > 1 else word[0])
        table[longer] = 258 + len(table)
        size = max(9, (258 + len(table)).bit_length()) if 258 + len(table) < 4094 else size
        if 258 + len(table) >= 4094:
            bits += put(256)
            table, size = {}, 9
        word = data[k : k + 1]
    if word:
        bits += put(table[word] if len(word) > 1 else word[0])
        table[word + b"?"] = 0
        size = min(12, max(9, (258 + len(table)).bit_length()))
    bits += put(257)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def tiff(a, bits, shown_as, packing, per, order="<", predictor=1, palette=None):
    h, w, n = a.shape
    strips = []
    for y in range(0, h, per):
        part = a[y : y + per]
        if predictor == 2:
            part = np.concatenate([part[:, :1], (part[:, 1:] - part[:, :-1]) & 255], axis=1)
        lines = packed_lines(part, bits)
        if bits == 16 and order == "<":
            lines = lines.reshape(len(lines), -1, 2)[..., ::-1].reshape(len(lines), -1)
        data = np.ascontiguousarray(lines).tobytes()
        strips.append({1: bytes, 32773: runs, 5: codes, 8: zlib.compress}[packing](data))
    out, starts = (b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0", []
    for s in strips:
        starts.append(len(out))
        out += s + b"\0" * (len(s) % 2)
    tags = {256: (3, [w]), 257: (4, [h]), 258: (3, [bits] * n), 259: (3, [packing]), 262: (3, [shown_as]), 273: (4, starts), 277: (3, [n]), 278: (4, [per]), 279: (4, [len(s) for s in strips]), 317: (3, [predictor])}
    if palette is not None:
        tags[320] = (3, (palette.T * 257).ravel().tolist())
    entries = b""
    for tag, (kind, values) in sorted(tags.items()):
        data = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(data) > 4:
            at = len(out)
            out += data + b"\0" * (len(data) % 2)
            data = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    at = len(out)
    return out[:4] + struct.pack(order + "I", at) + out[8:] + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"


@pytest.mark.parametrize("packing", [1, 32773, 5, 8])
@pytest.mark.parametrize("bits, n, order, predictor", [(1, 1, "<", 1), (4, 1, ">", 1), (8, 1, "<", 2), (8, 3, ">", 2), (8, 3, "<", 1), (16, 1, "<", 1), (16, 3, ">", 1)])
def test_tiff_of_every_kind(packing, bits, n, order, predictor):
    rng = np.random.default_rng(packing + bits)
    for h, w, per in ((1, 1, 1), (9, 13, 4), (70, 90, 32)):
        a = rng.integers(0, 1 << bits, (h, w, n))
        a[: h // 2] = a[0, 0]
        for shown_as in ((0, 1) if n == 1 else (2,)):
            bands, error = pixels.read_bands(tiff(a, bits, shown_as, packing, per, order, predictor))
            assert error is None and (put_together(bands) == shown(a, bits, inverted=shown_as == 0)).all()
    palette = rng.integers(0, 256, (1 << min(bits, 8), 3))
    if n == 1 and bits < 16 and predictor == 1:
        a = rng.integers(0, 1 << bits, (9, 13, 1))
        assert (put_together(pixels.read_bands(tiff(a, bits, 3, packing, 4, order, 1, palette))[0]) == palette[a[..., 0]]).all()


def test_bad_files_say_why(spark):
    a = np.random.default_rng(1).integers(0, 256, (20, 10, 3))
    good, strips = png(a, 8, 2), tiff(a, 8, 2, 5, 8)
    bad = {"cut": good[:-60], "no head": good[:8], "head": good[:20], "colour": good[:25] + b"\x07" + good[26:], "tiff": strips[:50], "kind": tiff(a, 8, 2, 1, 8).replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0)), "no palette": png(a[..., :1], 8, 3)}
    rows = [(k, bytearray(v)) for k, v in bad.items()] + [("good", bytearray(good)), ("other", bytearray(b"GIF89a")), ("none", None), ("strips", bytearray(strips))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r for r in files.image_pixels(df).collect()}
    assert {k for k, r in got.items() if r["error"]} == set(bad) and all(got[k]["r"] is None for k in bad) and got["other"]["error"] is None and got["other"]["r"] is None
    assert [got["good"][c] for c in "rgb"] == [got["strips"][c] for c in "rgb"] == [a[..., k].ravel().tolist() for k in range(3)]
    bands = pixels.image_bands(df, 8).collect()
    assert {r["path"] for r in bands if r["error"]} == set(bad) and sorted(r["y"] for r in bands if r["path"] == "good") == [0, 8, 16]


def test_from_files_through_tiles(spark):
    """Pictures become pieces, pieces a binarized page, tile by tile."""
    a = np.repeat(np.repeat(np.random.default_rng(2).integers(0, 256, (30, 25, 3)), 5, 0), 5, 1)
    df = spark.createDataFrame([("a.png", bytearray(png(a, 8, 2, interlaced=True))), ("b.tif", bytearray(tiff(a, 8, 2, 32773, 11)))], "path string, content binary")
    steps = [tiles.grey(), *tiles.binarizing(100)]
    got = tiles.tiled(pixels.image_bands(df, 16), "path", steps, tile=40, bands=3).collect()
    want = tiles.whole(steps, a.astype(np.uint8))
    for path in ("a.png", "b.tif"):
        page = np.zeros(want.shape, np.uint8)
        for r in got:
            if r["path"] == path:
                page[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["samples"], np.uint8).reshape(r["h"], r["w"])
        assert (page == want).all()
