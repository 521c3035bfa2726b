"""Rasters of any size as tables of pieces, worked on tile by tile.

A raster is a set of rows (page, height, width, y, x, h, w, samples): rectangles that cover it, 8 bits a sample, row by row.
``tiled`` runs a chain of steps over it. For every tile of the result the region is found that the chain needs of its
source, step by step backwards: sharpening and shapes widen it by their radius, resizing maps it. Every piece sends each tile
only what lies in its region, in one shuffle for the whole chain, and a tile is then computed forwards on exactly these
regions. At the page's edges every step sees what it would see on the whole page, so the tiles together equal the page
worked on as a whole, while no task holds more than one tile with its halo. All arithmetic is in whole numbers: no sum
depends on how a page is cut.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import raster

Size = tuple[int, int]
Span = tuple[int, int]
Region = tuple[Span, Span]
PIECE = "height int, width int, y int, x int, h int, w int, samples binary"


class Step:
    """A step of a chain; this one changes nothing."""

    def size(self, size: Size) -> Size:
        return size

    def needs(self, axis: int, span: Span, size: Size) -> Span:
        """What a span of the result needs along an axis of the source, whose size is given."""
        return span

    def run(self, a: np.ndarray, have: Region, want: Region, size: Size) -> np.ndarray:
        """The wanted region of the result from a region of the source."""
        return a


@dataclass
class Point(Step):
    """A function of every sample; colours are in the last axis."""

    f: Callable[[np.ndarray], np.ndarray]

    def run(self, a, have, want, size):
        return self.f(a)


def widened(span: Span, radius: int, n: int) -> Span:
    return max(0, span[0] - radius), min(n, span[1] + radius)


def padded(a: np.ndarray, have: Region, want: Region, radius: int, fill: int | None) -> np.ndarray:
    """The source around a wanted region, what lies outside the page filled, or repeated from its edge."""
    sides = [(have[k][0] - (want[k][0] - radius), want[k][1] + radius - have[k][1]) for k in (0, 1)]
    return np.pad(a, sides, mode="edge") if fill is None else np.pad(a, sides, constant_values=fill)


def running(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours along the last axis, by windows that double."""
    n, have = a.shape[-1] - width + 1, 1
    while have * 2 <= width:
        a, have = best(a[..., :-have], a[..., have:]), have * 2
    return best(a[..., :n], a[..., width - have : width - have + n])


@dataclass
class Shape(Step):
    """The least (erode) or greatest (dilate) sample under a diamond or a disk; beyond the page nothing counts."""

    kind: str
    radius: int
    diamond: bool = True

    def needs(self, axis, span, size):
        return widened(span, self.radius, size[axis])

    def run(self, a, have, want, size):
        r, best = self.radius, np.minimum if self.kind == "erode" else np.maximum
        a = padded(a, have, want, r, 255 if self.kind == "erode" else 0)
        h, w = want[0][1] - want[0][0], want[1][1] - want[1][0]
        out = None
        for y in range(-r, r + 1):
            reach = r - abs(y) if self.diamond else int((r * r - y * y) ** 0.5)
            row = running(a[r + y : r + y + h, r - reach : r + w + reach], 2 * reach + 1, best)
            out = row if out is None else best(out, row)
        return out


#: The sharpening of the enhancement steps (sigma, amount and limit).
SIGMA, AMOUNT, LIMIT = 1.2, (12, 10), (1, 100)


def gaussian(sigma: float = SIGMA, radius: int = 4, whole: int = 1 << 16) -> list[int]:
    """Whole weights of a Gaussian that add up to ``whole``; what rounding leaves is the middle's."""
    shape = [float(np.exp(-(k * k) / (2 * sigma * sigma))) for k in range(-radius, radius + 1)]
    made = [round(s / sum(shape) * whole) for s in shape]
    made[radius] += whole - sum(made)
    return made


@dataclass
class Unsharp(Step):
    """Sharpened against a Gaussian mean, edges repeated; differences up to the limit stay."""

    radius: int = 4

    def needs(self, axis, span, size):
        return widened(span, self.radius, size[axis])

    def run(self, a, have, want, size):
        weight, r = gaussian(radius=self.radius), self.radius
        core = tuple(slice(want[k][0] - have[k][0], want[k][1] - have[k][0]) for k in (0, 1))
        b = padded(a.astype(np.int64), have, want, r, None)
        h, w = want[0][1] - want[0][0], want[1][1] - want[1][0]
        b = sum(weight[k] * b[k : k + h] for k in range(2 * r + 1))
        b = sum(weight[k] * b[:, k : k + w] for k in range(2 * r + 1))
        gray, unit = a[core].astype(np.int64), 1 << 32
        differ = gray * unit - b
        sharp = (2 * (AMOUNT[1] * gray * unit + AMOUNT[0] * differ) + AMOUNT[1] * unit) // (2 * AMOUNT[1] * unit)
        return np.where(np.abs(differ) * LIMIT[1] > 255 * LIMIT[0] * unit, np.clip(sharp, 0, 255), gray).astype(np.uint8)


def taps(size: int, made: int, span: Span) -> tuple[np.ndarray, np.ndarray, int]:
    """For every place of a span of ``made``: its first source place, its whole weights, and what the weights add up to.

    Shares of covered cells where the axis shrinks; linear between centres where it grows.
    """
    at = np.arange(*span, dtype=np.int64)
    if made <= size:
        first, last = at * size // made, -(-(at + 1) * size // made)
        cell = first[:, None] + np.arange(int((last - first).max(initial=1)))
        cover = np.minimum((at[:, None] + 1) * size, (cell + 1) * made) - np.maximum(at[:, None] * size, cell * made)
        return first, np.maximum(cover, 0), size
    place = np.clip((2 * at + 1) * size - made, 0, 2 * made * (size - 1))
    first, right = np.divmod(place, 2 * made)
    return first, np.stack([2 * made - right, right], axis=1), 2 * made


@dataclass
class Resize(Step):
    """Another size: ``to`` gives it from the page's."""

    to: Callable[[Size], Size]

    def size(self, size):
        return self.to(size)

    def needs(self, axis, span, size):
        first, weight, _ = taps(size[axis], self.to(size)[axis], span)
        return int(first[0]), min(size[axis], int(first[-1]) + weight.shape[1])

    def run(self, a, have, want, size):
        out, whole = a.astype(np.int64), 1
        for axis, n in enumerate(self.to(size)):
            first, weight, unit = taps(size[axis], n, want[axis])
            shape = [1] * a.ndim
            shape[axis] = -1
            # Places past the page have weight 0; any sample does for them.
            place = lambda k: np.minimum(first - have[axis][0] + k, out.shape[axis] - 1)  # noqa: B023,E731
            out = sum(np.take(out, place(k), axis=axis) * weight[:, k].reshape(shape) for k in range(weight.shape[1]))
            whole *= unit
        return ((2 * out + whole) // (2 * whole)).astype(np.uint8)


def by_width(width: int) -> Resize:
    """Down to a width, the height in proportion, halves to even; narrower pages, and width 0, stay."""
    return Resize(lambda s: (max(1, round(s[0] * width / s[1])), width) if 0 < width < s[1] else s)


def by_factor(factor: int) -> Resize:
    return Resize(lambda s: (s[0] * factor, s[1] * factor))


@dataclass
class Margins(Step):
    """White margins of 15 thousandths of the width and 10 of the height."""

    def run(self, a, have, want, size):
        edge = (size[0] * 10 // 1000, size[1] * 15 // 1000)
        inside = [(np.arange(*want[k]) >= edge[k]) & (np.arange(*want[k]) < size[k] - edge[k]) for k in (0, 1)]
        return np.where(inside[0][:, None] & inside[1][None, :], a, np.uint8(255))


@dataclass
class Without(Step):
    """The source less what a chain makes of it, not below 0."""

    steps: list[Step]

    def needs(self, axis, span, size):
        for step in reversed(self.steps):
            span = step.needs(axis, span, size)
        return span

    def run(self, a, have, want, size):
        core = tuple(slice(want[k][0] - have[k][0], want[k][1] - have[k][0]) for k in (0, 1))
        made = forwards(self.steps, a, want, size)
        return np.where(a[core] > made, a[core] - made, 0).astype(np.uint8)


def sizes(steps: list[Step], size: Size) -> list[Size]:
    """The page's size before each step and after the last."""
    out = [size]
    for step in steps:
        out.append(step.size(out[-1]))
    return out


def source_region(steps: list[Step], want: Region, size: Size) -> list[Region]:
    """The regions before each step that a wanted region of the result needs, and the region itself."""
    out = [want]
    for step, before in zip(reversed(steps), sizes(steps, size)[-2::-1]):
        out.append(tuple(step.needs(k, out[-1][k], before) for k in (0, 1)))
    return out[::-1]


def forwards(steps: list[Step], a: np.ndarray, want: Region, size: Size) -> np.ndarray:
    """The wanted region of a chain's result from the region of the source that it needs."""
    for step, before, have, then in zip(steps, sizes(steps, size), (regions := source_region(steps, want, size)), regions[1:]):
        a = step.run(a, have, then, before)
    return a


def whole(steps: list[Step], a: np.ndarray) -> np.ndarray:
    """A chain over one page as a single region."""
    made = sizes(steps, a.shape[:2])[-1]
    return forwards(steps, a, ((0, made[0]), (0, made[1])), a.shape[:2])


class Axis:
    """An axis of a grid of tiles: their spans in the result and in the source, each worked out when it is asked for.

    What a task pays follows the tiles that it meets, not those of the page.
    """

    def __init__(self, steps: list[Step], size: Size, axis: int, tile: int):
        self.steps, self.size, self.axis, self.tile = steps, size, axis, tile
        self.made = sizes(steps, size)[-1][axis]
        self.n = -(-self.made // tile)
        self.known: dict[int, tuple[Span, Span]] = {}

    def spans(self, t: int) -> tuple[Span, Span]:
        """A tile's span in the result and in the source."""
        if t not in self.known:
            to = (t * self.tile, min((t + 1) * self.tile, self.made))
            self.known[t] = to, source_region(self.steps, (to, (0, 1)) if self.axis == 0 else ((0, 1), to), self.size)[0][self.axis]
        return self.known[t]

    def meeting(self, lo: int, hi: int) -> range:
        """The tiles whose spans in the source meet one; these follow each other along the axis."""
        first = max(0, min(self.n - 1, lo * self.made // self.size[self.axis] // self.tile))
        while first > 0 and self.spans(first - 1)[1][1] > lo:
            first -= 1
        while first < self.n and self.spans(first)[1][1] <= lo:
            first += 1
        end = first
        while end < self.n and self.spans(end)[1][0] < hi:
            end += 1
        return range(first, end)


def grid(steps: list[Step], size: Size, tile: int) -> list[list[tuple[Span, Span]]]:
    """For rows and for columns of tiles: their span in the result and in the source."""
    return [[axis.spans(t) for t in range(axis.n)] for axis in (Axis(steps, size, k, tile) for k in (0, 1))]


def tiled(pieces: DataFrame, page: str, steps: list[Step] | Callable[[object], list[Step]], tile: int = 512, bands: int = 1) -> DataFrame:
    """The pieces of a chain's result, a tile each: (page, height, width, y, x, h, w, samples).

    ``steps`` may be a function of the page, of chains that differ in what they do to samples but not in sizes and reach.
    Pages may differ in size; pieces of one page that give it different sizes are pieces of different pages. What no piece
    covers is white, also where a tile meets none; where pieces overlap the one that comes last in order of place and samples
    counts. Pieces without page, samples or a size are ignored; a page without pixels gives none.
    """
    kind, steps_of = pieces.schema[page].dataType.simpleString(), steps if callable(steps) else lambda _: steps
    columns = ("height", "width", "y", "x", "h", "w")
    named = pieces.select(F.col(f"`{page}`").alias("page"), *columns, "samples").where(f"page is not null and samples is not null and height > 0 and width > 0 and length(samples) = h * w * {bands}")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[Size, tuple[Axis, Axis]] = {}
        names = ("page", "height", "width", "ty", "tx", "y", "x", "h", "w", "samples")

        def sent_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, *[pa.int32()] * 8, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.stack([batch.column(c).to_numpy() for c in columns], axis=1).astype(np.int64)
            keys, rows, size = batch.column("page").to_pylist(), [], 0
            for i, (height, width, y, x, h, w) in enumerate(numbers.tolist()):
                if (height, width) not in grids:
                    grids[height, width] = tuple(Axis(steps_of(keys[i]), (height, width), axis, tile) for axis in (0, 1))
                down, across = grids[height, width]
                a = np.frombuffer(batch.column("samples")[i].as_buffer(), np.uint8).reshape(h, w, bands)
                for ty in down.meeting(y, y + h):
                    top, bottom = down.spans(ty)[1]
                    for tx in across.meeting(x, x + w):
                        left, right = across.spans(tx)[1]
                        y0, y1, x0, x1 = max(y, top), min(y + h, bottom), max(x, left), min(x + w, right)
                        rows.append((keys[i], height, width, ty, tx, y0, x0, y1 - y0, x1 - x0, a[y0 - y : y1 - y, x0 - x : x1 - x].tobytes()))
                        size += len(rows[-1][-1]) + 64
                        if size > 1 << 22:
                            yield sent_rows(rows, batch.column("page").type)
                            rows, size = [], 0
            if rows:
                yield sent_rows(rows, batch.column("page").type)

    def every_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, size in enumerate(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist())):
                n_y, n_x = (Axis(steps_of(batch.column("page")[i].as_py()), size, axis, tile).n for axis in (0, 1))
                n = n_y * n_x
                fixed = {"page": pa.array([batch.column("page")[i].as_py()] * n, batch.column("page").type), "height": pa.array([size[0]] * n, pa.int32()), "width": pa.array([size[1]] * n, pa.int32())}
                at = {"ty": pa.array(np.repeat(np.arange(n_y, dtype=np.int32), n_x)), "tx": pa.array(np.tile(np.arange(n_x, dtype=np.int32), n_y))}
                yield pa.RecordBatch.from_pydict(fixed | at | {k: pa.array(np.zeros(n, dtype=np.int32)) for k in ("y", "x", "h", "w")} | {"samples": pa.array([b""] * n, pa.binary())})

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        page_key, height, width, ty, tx = key
        size, chain = (int(height), int(width)), steps_of(page_key)
        made = sizes(chain, size)[-1]
        (rows_to, rows_from), (columns_to, columns_from) = (Axis(chain, size, axis, tile).spans(int(t)) for axis, t in enumerate((ty, tx)))
        a = np.full((rows_from[1] - rows_from[0], columns_from[1] - columns_from[0], bands), 255, dtype=np.uint8)
        for y, x, h, w, samples in sorted(rows.loc[rows["h"] > 0, ["y", "x", "h", "w", "samples"]].itertuples(index=False, name=None)):
            a[y - rows_from[0] : y - rows_from[0] + h, x - columns_from[0] : x - columns_from[0] + w] = np.frombuffer(samples, np.uint8).reshape(h, w, bands)
        out = forwards(chain, a if bands > 1 else a[..., 0], (rows_to, columns_to), size)
        return pd.DataFrame([(page_key, *made, rows_to[0], columns_to[0], *out.shape[:2], out.tobytes())], columns=["page", *columns, "samples"])

    sent = f"page {kind}, height int, width int, ty int, tx int, y int, x int, h int, w int, samples binary"
    dealt = named.mapInArrow(scatter, sent).unionByName(named.select("page", "height", "width").distinct().mapInArrow(every_tile, sent))
    return dealt.groupBy("page", "height", "width", "ty", "tx").applyInPandas(gather, f"page {kind}, {PIECE}").withColumnRenamed("page", page)


def level_tenths(g: np.ndarray) -> np.ndarray:
    """Levels stretched so that 15 % become 0 and 88 % become 255, halves up."""
    return np.clip((2 * (100 * g.astype(np.int64) - 15 * 255) + 73) // 146, 0, 255).astype(np.uint8)


def cut_at(percent: int) -> Point:
    """255 above a share of 255, else 0."""
    return Point(lambda g: np.where(g.astype(np.int64) * 100 > percent * 255, 255, 0).astype(np.uint8))


def posterized(levels: int) -> Point:
    """The nearest of evenly spaced levels, halves up, as whole numbers."""
    n = levels - 1

    def f(g: np.ndarray) -> np.ndarray:
        nearest = (2 * g.astype(np.int64) * n + 255) // 510
        return ((2 * nearest * 255 + n) // (2 * n)).astype(np.uint8)

    return Point(f)


def coloured_ink(gate: int = 15, dark: int = 72) -> Point:
    """255 where a colour's chroma is above a share of 255 and its grey level not above another, in percent."""

    def f(rgb: np.ndarray) -> np.ndarray:
        rgb = rgb.astype(np.int64)
        gray, chroma = rgb @ np.array([299, 587, 114]) // 1000, rgb.max(axis=-1) - rgb.min(axis=-1)
        return np.where((chroma * 100 > gate * 255) & (gray * 100 <= dark * 255), 255, 0).astype(np.uint8)

    return Point(f)


#: The enhancement steps, in their order.
ENHANCE = [Point(level_tenths), Unsharp()]


def binarizing(width: int, percent: int = 55, supersample: int = 1) -> list[Step]:
    """A scan to black and white: shrink, enhance, enlarge by ``supersample``, threshold, whiten the margins."""
    return [by_width(width), *ENHANCE, *([by_factor(supersample)] if supersample > 1 else []), cut_at(percent), Margins()]


def smoothing(width: int, percent: int = 55, levels: int = 3, zoom: int = 4) -> list[Step]:
    """Black and white with soft edges: enhance, enlarge, threshold, smooth the outlines, go down to a width, posterize."""
    shapes = [Shape(kind, 2) for kind in ("erode", "dilate", "dilate", "erode")]

    def down(s: Size) -> Size:
        h, w = s[0] // zoom, s[1] // zoom
        target = width if 0 < width < w else w
        return max(1, round(h * target / w)), target

    return [*ENHANCE, by_factor(zoom), cut_at(percent), *shapes, Resize(down), posterized(levels), Margins()]


def fine_structure(large: int = 6) -> list[Step]:
    """Coloured ink that is no large area: less its opening by a disk, opened once more by a diamond."""
    opening = [Shape("erode", large, False), Shape("dilate", large, False)]
    return [coloured_ink(), Without(opening), Shape("erode", 1), Shape("dilate", 1)]


def row_sums(tiles: DataFrame, page: str, bands: int = 1) -> DataFrame:
    """Per row of a raster the sum of its samples and the sum of its samples times their places, counted from 1."""
    kind = tiles.schema[page].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y, x, h, w = (batch.column(c)[i].as_py() for c in ("y", "x", "h", "w"))
                a = np.frombuffer(batch.column("samples")[i].as_buffer(), np.uint8).reshape(h, w * bands).astype(np.int64)
                key = pa.array([batch.column("page")[i].as_py()] * h, batch.column("page").type)
                yield pa.RecordBatch.from_arrays([key, pa.array(np.arange(y, y + h)), pa.array(a.sum(axis=1)), pa.array(a @ np.arange(x * bands + 1, (x + w) * bands + 1))], names=["page", "y", "total", "moment"])

    made = tiles.select(F.col(page).alias("page"), "y", "x", "h", "w", "samples").mapInArrow(sums, f"page {kind}, y long, total long, moment long")
    return made.groupBy("page", "y").agg(F.sum("total").alias("total"), F.sum("moment").alias("moment")).withColumnRenamed("page", page)


def grey() -> Point:
    """Grey levels of colours by whole-number weights, halves down."""
    return Point(lambda rgb: (rgb.astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8))


def chroma(rgb: np.ndarray) -> np.ndarray:
    return rgb.max(axis=-1).astype(np.int64) - rgb.min(axis=-1)


def hue_bins(rgb: np.ndarray, bins: int = 36) -> np.ndarray:
    """The hue bin of every colour, -1 for greys; operations in the order of ``functions.geometry``."""
    r, g, b = (rgb[..., k] / 255.0 for k in range(3))
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = np.where(high == low, 1.0, high - low)
    rc, gc, bc = (high - r) / span, (high - g) / span, (high - b) / span
    turn = np.where(r == high, bc - gc, np.where(g == high, 2.0 + rc - bc, 4.0 + gc - rc)) / 6.0
    return np.where(high == low, -1, np.floor((turn - np.floor(turn)) * bins).astype(np.int64) % bins)


def around(want: Region, radius: int, size: Size) -> Region:
    return tuple(widened(want[k], radius, size[k]) for k in (0, 1))


def cropped(a: np.ndarray, have: Region, want: Region) -> np.ndarray:
    return a[tuple(slice(want[k][0] - have[k][0], want[k][1] - have[k][0]) for k in (0, 1))]


@dataclass
class Ink(Step):
    """255 where levelled and sharpened grey is dark and chroma is on one side of the gate: black ink, or coloured."""

    dark: int = 50
    gate: int = 35
    black: bool = True
    reach = 4

    def needs(self, axis, span, size):
        return widened(span, self.reach, size[axis])

    def run(self, a, have, want, size):
        chain = [grey(), *ENHANCE]
        sharp = forwards(chain, cropped(a, have, source_region(chain, want, size)[0]), want, size).astype(np.int64)
        over = chroma(cropped(a, have, want)) * 100 > self.gate * 255
        return np.where((sharp * 100 <= self.dark * 255) & (over != self.black), 255, 0).astype(np.uint8)


@dataclass
class SlotMask(Step):
    """A colour slot's mask, 0 where it draws: coloured ink near fine structure of the slot's hue bins, small gaps closed.

    Fine structure finds where the colour is text; the strokes are taken from the ink itself. No bins: all white.
    """

    bins: list[int]
    widen: int = 4
    large: int = 6
    gate: int = 35
    dark: int = 50

    def needs(self, axis, span, size):
        return widened(span, 2 + self.widen + 2 * self.large + 2, size[axis])

    def run(self, a, have, want, size):
        if not self.bins:
            return np.full((want[0][1] - want[0][0], want[1][1] - want[1][0]), 255, dtype=np.uint8)
        drawn_at = around(want, 2, size)
        near_at = around(drawn_at, self.widen, size)
        fine, ink = fine_structure(self.large), Ink(self.dark, self.gate, False)
        band = forwards(fine, cropped(a, have, source_region(fine, near_at, size)[0]), near_at, size)
        band = np.where(np.isin(hue_bins(cropped(a, have, near_at)), self.bins), band, 0).astype(np.uint8)
        near = forwards([Shape("dilate", self.widen, False)], band, drawn_at, size)
        strokes = forwards([ink], cropped(a, have, around(drawn_at, ink.reach, size)), drawn_at, size)
        drawn = np.where((near > 0) & (strokes > 0), 255, 0).astype(np.uint8)
        return 255 - forwards([Shape("dilate", 1, False), Shape("erode", 1, False)], drawn, want, size)


@dataclass
class WithoutInk(Step):
    """Colours with black ink made white, as it stands and no wider."""

    ink: Ink

    def needs(self, axis, span, size):
        return self.ink.needs(axis, span, size)

    def run(self, a, have, want, size):
        return np.where(self.ink.run(a, have, want, size)[..., None] > 0, np.uint8(255), cropped(a, have, want))


def toned() -> Point:
    """The tone of paper: levels, contrast along a sigmoid, lightness and saturation."""

    def f(rgb: np.ndarray) -> np.ndarray:
        return raster.modulated(raster.contrasted(raster.stretched(rgb, *raster.PAPER_LEVELS), *raster.PAPER_CONTRAST), *raster.PAPER_SATURATION).astype(np.uint8)

    return Point(f)


def background(width: int, ink: Ink | None = None) -> list[Step]:
    """Colours without black ink at a width, toned: ink is taken out before anything is averaged."""
    return [WithoutInk(ink or Ink()), by_width(width), toned()]


def slot_masks(pieces: DataFrame, page: str, clusters: DataFrame, slots: int = 3, tile: int = 512, **options: int) -> DataFrame:
    """The masks of every page's colour slots as pieces: (page, slot, height, width, y, x, h, w, samples).

    ``clusters`` has the slots' hue bins (page, slot, bins); slots that a page lacks are white, so that every page has as many
    layers. A page is sent once for each slot.
    """
    keyed = pieces.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    bins = clusters.select(page, F.col("slot").cast("int").alias("slot"), F.concat_ws(" ", F.transform("bins", lambda b: b.cast("string"))).alias("hues"))
    named = keyed.join(bins, [page, "slot"], "left").withColumn("key", F.to_json(F.struct(F.col(page).alias("page"), "slot", F.coalesce("hues", F.lit("")).alias("hues"))))
    steps = lambda key: [SlotMask([int(b) for b in json.loads(key)["hues"].split()], **options)]
    kind = f"page {pieces.schema[page].dataType.simpleString()}, slot int"
    made = tiled(named, "key", steps, tile, bands=3).withColumn("of", F.from_json("key", kind))
    return made.select(F.col("of.page").alias(page), "of.slot", "height", "width", "y", "x", "h", "w", "samples")
