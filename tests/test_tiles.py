"""Tiled rasters against the whole page, against plain loops, and with awkward pieces."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from folioflow.operators import raster, tiles
from folioflow.sources import views

CHAINS = {"binarize": tiles.binarizing(40), "no shrinking": tiles.binarizing(1000), "supersample": tiles.binarizing(50, 55, 2), "smooth": tiles.smoothing(30), "smooth, width kept": tiles.smoothing(0)}


def pages(n, seed=0):
    rng = np.random.default_rng(seed)
    for k in range(n):
        h, w = (int(x) for x in rng.integers(1, 90, 2))
        a = rng.integers(0, 256, (h, w)).astype(np.uint8)
        yield a if k % 2 else np.repeat(np.repeat(a[: h // 6 + 1, : w // 6 + 1], 6, 0), 6, 1)[:h, :w]


def by_tiles(steps, a, tile):
    made = tiles.sizes(steps, a.shape[:2])[-1]
    out = np.zeros(made, dtype=np.uint8)
    rows, columns = tiles.grid(steps, a.shape[:2], tile)
    for (y, from_y) in rows:
        for (x, from_x) in columns:
            out[slice(*y), slice(*x)] = tiles.forwards(steps, a[slice(*from_y), slice(*from_x)], (y, x), a.shape[:2])
    return out


@pytest.mark.parametrize("name", CHAINS)
def test_tiles_equal_the_whole_page(name):
    for a in pages(12):
        want = tiles.whole(CHAINS[name], a)
        for tile in (5, 16):
            assert (by_tiles(CHAINS[name], a, tile) == want).all()


def test_fine_structure_equals_the_untiled_kernel():
    for a in pages(8, 1):
        rgb = np.stack([a, np.roll(a, 3, 1), a[::-1]], axis=-1)
        gray, chroma = rgb.astype(int) @ np.array([299, 587, 114]) // 1000, rgb.max(-1).astype(int) - rgb.min(-1)
        want = raster.fine_structure(gray[None], chroma[None])[0]
        assert (tiles.whole(tiles.fine_structure(), rgb) == want).all() and (by_tiles(tiles.fine_structure(), rgb, 11) == want).all()


@pytest.mark.parametrize("kind, radius, diamond", [("erode", 2, True), ("dilate", 2, True), ("erode", 6, False), ("dilate", 6, False), ("erode", 0, True)])
def test_shapes_by_every_offset(kind, radius, diamond):
    for a in pages(6, 2):
        want = (raster.erode if kind == "erode" else raster.dilate)(a[None].astype(int), radius, diamond)[0]
        assert (tiles.whole([tiles.Shape(kind, radius, diamond)], a) == want).all()


@pytest.mark.parametrize("size, made", [((7, 9), (3, 4)), ((5, 5), (5, 2)), ((4, 3), (16, 12)), ((1, 6), (4, 9)), ((6, 2), (1, 1))])
def test_resizing_by_fractions(size, made):
    a = np.random.default_rng(3).integers(0, 256, size).astype(np.uint8)

    def weight(n, m, o, i):
        if m <= n:
            return max(Fraction(0), min(Fraction((o + 1) * n, m), Fraction(i + 1)) - max(Fraction(o * n, m), Fraction(i))) * m / n
        at = min(max(Fraction(2 * o + 1, 2) * n / m - Fraction(1, 2), Fraction(0)), Fraction(n - 1))
        return max(Fraction(0), 1 - abs(at - i))

    got = tiles.whole([tiles.Resize(lambda s: made)], a)
    for y in range(made[0]):
        for x in range(made[1]):
            exact = sum(weight(size[0], made[0], y, i) * weight(size[1], made[1], x, j) * int(a[i, j]) for i in range(size[0]) for j in range(size[1]))
            assert got[y, x] == int(exact + Fraction(1, 2))


def test_sharpening_by_plain_loops():
    a = np.random.default_rng(4).integers(0, 256, (9, 7)).astype(np.uint8)
    weight, got = tiles.gaussian(), tiles.whole([tiles.Unsharp()], a)
    assert sum(weight) == 1 << 16 and weight == weight[::-1]
    for y in range(9):
        for x in range(7):
            mean = Fraction(sum(weight[i + 4] * weight[j + 4] * int(a[min(max(y + i, 0), 8), min(max(x + j, 0), 6)]) for i in range(-4, 5) for j in range(-4, 5)), 1 << 32)
            g = int(a[y, x])
            sharp = g + Fraction(12, 10) * (g - mean) + Fraction(1, 2)
            assert got[y, x] == (min(255, max(0, sharp.numerator // sharp.denominator)) if abs(g - mean) > Fraction(255, 100) else g)


def pieces_of(page, a, cuts):
    """Rows for pieces of a page cut at rows and columns."""
    h, w = a.shape[:2]
    ys, xs = ([0, *(c for c in cuts if c < n), n] for n in (h, w))
    return [(page, h, w, y, x, y2 - y, x2 - x, bytearray(np.ascontiguousarray(a[y:y2, x:x2]).tobytes()), "extra") for y, y2 in zip(ys, ys[1:]) for x, x2 in zip(xs, xs[1:])]


SCHEMA = "book string, height int, width int, y int, x int, h int, w int, samples binary, ty string"


def put_together(rows):
    out = {}
    for r in rows:
        page = out.setdefault(r["book"], np.full((r["height"], r["width"]), 7, dtype=np.uint8))
        page[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["samples"], np.uint8).reshape(r["h"], r["w"])
    return out


def test_tiled_on_tables(spark):
    """Pages of several sizes, in pieces cut anywhere, among rows that are no pieces."""
    made = {f"b{i}": a for i, a in enumerate(pages(5, 5))}
    rows = [r for i, (name, a) in enumerate(made.items()) for r in pieces_of(name, a, [3 + i, 20, 41])]
    rows += [rows[0], (None, *rows[0][1:]), ("bad", 5, 5, 0, 0, 2, 2, bytearray(b"abc"), ""), ("none", 5, 5, 0, 0, 2, 2, None, ""), ("empty", 0, 0, 0, 0, 0, 0, bytearray(b""), "")]
    for steps in (CHAINS["binarize"], CHAINS["smooth"]):
        got = put_together(tiles.tiled(spark.createDataFrame(rows, SCHEMA), "book", steps, tile=16).collect())
        assert got.keys() == made.keys() and all((got[k] == tiles.whole(steps, a)).all() for k, a in made.items())
    assert tiles.tiled(spark.createDataFrame([], SCHEMA), "book", CHAINS["smooth"]).count() == 0


def test_what_no_piece_covers_is_white(spark):
    rows = [("b", 40, 40, 10, 10, 1, 2, bytearray(b"\0\0"), "")]
    page = put_together(tiles.tiled(spark.createDataFrame(rows, SCHEMA), "book", [tiles.cut_at(50)], tile=16).collect())["b"]
    assert page.sum() == 255 * (1600 - 2) and page[10, 10] == page[10, 11] == 0


def test_a_page_of_scan_size(spark):
    """1000 x 1400 in strips: every step does something, and the tiles equal the page."""
    rng = np.random.default_rng(6)
    a = np.repeat(np.repeat(rng.integers(0, 256, (200, 143)), 7, 0), 7, 1)[:1400, :1000].astype(np.uint8)
    rows = spark.createDataFrame(pieces_of("b", a, range(100, 1400, 100)), SCHEMA)
    got = put_together(tiles.tiled(rows, "b" if "b" in rows.columns else "book", tiles.binarizing(800)).collect())["b"]
    want = tiles.whole(tiles.binarizing(800), a)
    assert got.shape == (1120, 800) and (got == want).all() and (got[:11] == 255).all() and (got[:, :12] == 255).all() and 0.2 < (got == 0).mean() < 0.8
    sums = {r["y"]: (r["total"], r["moment"]) for r in tiles.row_sums(tiles.tiled(rows, "book", tiles.binarizing(800)), "book").collect()}
    assert sums == {y: (int(row.sum()), int(row.astype(int) @ np.arange(1, 801))) for y, row in enumerate(want)}


def coloured_page(h, w, seed):
    """Coloured and black strokes, a large coloured area, and noise."""
    rng = np.random.default_rng(seed)
    a = np.full((h, w, 3), 240, dtype=np.uint8)
    for k in range(12):
        y, x = int(rng.integers(0, h - 12)), int(rng.integers(0, w - 12))
        a[y : y + int(rng.integers(1, 4)), x : x + 12] = [(200, 20, 20), (20, 20, 200), (10, 10, 10)][k % 3]
    a[h // 2 : h // 2 + 30, 5:40] = (20, 180, 20)
    return np.clip(a.astype(int) + rng.integers(-8, 9, a.shape), 0, 255).astype(np.uint8)


def test_masks_and_background_equal_the_untiled_kernels():
    for seed in range(3):
        rgb = coloured_page(90, 70, seed)
        fine = tiles.whole(tiles.fine_structure(), rgb).astype(int)
        strokes = tiles.whole([tiles.Ink(black=False)], rgb).astype(int)
        black = tiles.whole([tiles.Ink()], rgb)
        assert not ((strokes > 0) & (black > 0)).any() and (black > 0).any() and (strokes > 0).any()
        bins = tiles.hue_bins(rgb)
        clusters = [[35, 0, 1, 2], [22, 23, 24, 25], []]
        want = raster.cluster_masks(fine, strokes, bins, clusters)
        for i, mine in enumerate(clusters):
            for tile in (1000, 13):
                assert (by_tiles([tiles.SlotMask(mine)], rgb, tile) == want[i]).all()
        assert (want[0] == 0).any() and (want[1] == 0).any() and (want[2] == 255).all()
        paper = raster.paper(rgb, (255 - black)[None].astype(int), 50)
        steps = tiles.background(50)
        made = tiles.sizes(steps, rgb.shape[:2])[-1]
        out = np.zeros((*made, 3), dtype=np.uint8)
        rows, columns = tiles.grid(steps, rgb.shape[:2], 17)
        for y, from_y in rows:
            for x, from_x in columns:
                out[slice(*y), slice(*x)] = tiles.forwards(steps, rgb[slice(*from_y), slice(*from_x)], (y, x), rgb.shape[:2])
        assert (out == tiles.whole(steps, rgb)).all() and np.abs(out.astype(int) - paper).max() <= 4  # the older kernel averages in fractions


def test_hue_bins_of_colours():
    import colorsys

    rgb = np.random.default_rng(7).integers(0, 256, (40, 25, 3)).astype(np.uint8)
    rgb[0] = rgb[0][:, :1]
    want = [[-1 if max(p) == min(p) else int(colorsys.rgb_to_hls(*(c / 255 for c in p))[0] * 36) % 36 for p in row] for row in rgb.tolist()]
    assert tiles.hue_bins(rgb).tolist() == want


def test_slot_masks_of_pages(spark):
    made = {f"p{k}": coloured_page(80, 60, 10 + k) for k in range(3)}
    rows = [r for name, a in made.items() for r in pieces_of(name, a, [17, 50])]
    clusters = spark.createDataFrame([("p0", 0, [35, 0, 1]), ("p0", 1, [22, 23, 24, 25]), ("p1", 0, [22, 23, 24, 25]), ("absent", 0, [1])], "book string, slot int, bins array<int>")
    got = tiles.slot_masks(spark.createDataFrame(rows, SCHEMA), "book", clusters, tile=32).collect()
    want = {("p0", 0): [35, 0, 1], ("p0", 1): [22, 23, 24, 25], ("p1", 0): [22, 23, 24, 25]}
    assert {(r["book"], r["slot"]) for r in got} == {(b, s) for b in made for s in range(3)}
    for (book, slot) in {(r["book"], r["slot"]) for r in got}:
        page = put_together([r for r in got if (r["book"], r["slot"]) == (book, slot)])[book]
        assert (page == tiles.whole([tiles.SlotMask(want.get((book, slot), []))], made[book])).all()


@pytest.mark.parametrize("name", ["smoothing", "binarizing", "background", "fine"])
def test_a_tile_asks_for_its_own_spans_alone(name, monkeypatch):
    """What a tile or a piece costs does not follow the height of its page."""
    chain = {"smoothing": tiles.smoothing(100), "binarizing": tiles.binarizing(100), "background": tiles.background(100), "fine": [tiles.by_factor(2), *tiles.fine_structure()]}[name]
    size = (40_000, 128)
    whole = tiles.grid(chain, size, 64)[0]
    asked, own = [], tiles.source_region
    monkeypatch.setattr(tiles, "source_region", lambda *a: asked.append(1) or own(*a))
    for lo, hi in ((0, 1), (20_011, 20_012), (31_000, 31_064), (39_999, 40_000)):
        met = tiles.Axis(chain, size, 0, 64).meeting(lo, hi)
        assert list(met) == [t for t, (_, (top, bottom)) in enumerate(whole) if top < hi and bottom > lo]
    assert len(asked) < 60
    axis = tiles.Axis(chain, size, 0, 64)
    assert [list(axis.meeting(*p)) for p in ((-9, 0), (40_000, 40_009))] == [[], []]


def test_a_sheets_levels_are_worked_out_once_a_row(spark, sf_dir):
    """Also where a filter on the samples is moved down to the table."""
    sheet = views.vector_sheet(spark, sf_dir, 3).where("length(samples) = h * w * 3").select("height", "width").distinct()
    plan = sheet._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("0.6") for line in plan.splitlines()) == 1
