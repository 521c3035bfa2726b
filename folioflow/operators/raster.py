"""Raster kernels: pointwise and block operations on arrays, morphology in batches of numpy."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold(gray: Column, level: float) -> Column:
    """255 where a level is above the share of 255, else 0."""
    return F.transform(gray, lambda g: F.when(g > F.lit(level * 255.0), 255).otherwise(0))


def level(gray: Column, black: float, white: float) -> Column:
    """Levels stretched so that the black share becomes 0 and the white share 255."""
    span = F.lit((white - black) * 255.0)
    return F.transform(gray, lambda g: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((g - F.lit(black * 255.0)) * F.lit(255.0) / span + 0.5))).cast("int"))


def negate(gray: Column) -> Column:
    return F.transform(gray, lambda g: F.lit(255) - g)


def white_border(gray: Column, width: int, height: int, x: int, y: int) -> Column:
    """White on the outermost x columns and y rows."""

    def edge(g: Column, i: Column) -> Column:
        col, row = i % width, F.floor(i / width)
        return F.when((col < x) | (col >= width - x) | (row < y) | (row >= height - y), 255).otherwise(g)

    return F.transform(gray, edge)


def lighten(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def darken(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.floor((x * y + 127) / 255).cast("int"))


def minus(destination: Column, source: Column) -> Column:
    """Destination minus source, not below 0."""
    return F.zip_with(destination, source, lambda x, y: F.greatest(x - y, F.lit(0)))


def posterize(gray: Column, levels: int) -> Column:
    """The nearest of evenly spaced levels, halves up."""
    step = F.lit(255.0 / (levels - 1))
    return F.transform(gray, lambda g: F.floor(F.floor(g / step + 0.5) * step + 0.5).cast("int"))


def box_half(gray: Column, width: int, height: int) -> Column:
    """Half the size by whole means of 2 x 2 boxes, halves down."""
    places = F.sequence(F.lit(0), F.lit(width // 2 * (height // 2) - 1))

    def mean(i: Column) -> Column:
        at = (F.floor(i / (width // 2)) * 2 * width + i % (width // 2) * 2).cast("int")
        return F.floor((F.get(gray, at) + F.get(gray, at + 1) + F.get(gray, at + width) + F.get(gray, at + width + 1)) / 4).cast("int")

    return F.transform(places, mean)


def mask_digest(gray: Column, level_: int = 128) -> Column:
    """A digest that is equal for rasters of equal pixels after thresholding."""
    return F.md5(F.concat_ws("", F.transform(gray, lambda g: F.when(g > level_, "1").otherwise("0"))))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Gray levels of three channels by whole-number weights, halves down."""
    both = F.zip_with(r, g, lambda x, y: x * 299 + y * 587)
    return F.zip_with(both, b, lambda x, y: F.floor((x + y * 114) / 1000).cast("int"))


def chroma(r: Column, g: Column, b: Column) -> Column:
    """The C channel of hue, chroma and luma: greatest minus least."""
    high = F.zip_with(F.zip_with(r, g, lambda x, y: F.greatest(x, y)), b, lambda x, y: F.greatest(x, y))
    low = F.zip_with(F.zip_with(r, g, lambda x, y: F.least(x, y)), b, lambda x, y: F.least(x, y))
    return F.zip_with(high, low, lambda x, y: x - y)


def ink_masks(gray: Column, colourfulness: Column, dark: float, gate: float) -> tuple[Column, Column]:
    """Black and coloured ink: dark pixels on either side of one and the same chroma gate, 255 where there is ink."""
    dark_ = lambda g: g < F.lit(dark * 255.0)
    pick = lambda keep: F.zip_with(gray, colourfulness, lambda g, c: F.when(dark_(g) & keep(c), 255).otherwise(0))
    return pick(lambda c: c <= F.lit(gate * 255.0)), pick(lambda c: c > F.lit(gate * 255.0))


def background_half(gray: Column, ink: Column, width: int, height: int) -> Column:
    """Half the size by means of the pixels without ink; boxes that are all ink become white."""
    places = F.sequence(F.lit(0), F.lit(width // 2 * (height // 2) - 1))

    def mean(i: Column) -> Column:
        at = (F.floor(i / (width // 2)) * 2 * width + i % (width // 2) * 2).cast("int")
        box = F.filter(F.array(*(F.when(F.get(ink, at + d) == 0, F.get(gray, at + d)) for d in (0, 1, width, width + 1))), lambda g: g.isNotNull())
        total = F.aggregate(box, F.lit(0), lambda s, g: s + g)
        return F.when(F.size(box) == 0, 255).otherwise(F.floor(total / F.size(box)).cast("int"))

    return F.transform(places, mean)


def sigmoidal(gray: Column, contrast: float, middle: float) -> Column:
    """Contrast along a sigmoid around the middle share, ends kept in place."""
    curve = lambda x: 1.0 / (1.0 + F.exp(F.lit(contrast) * (F.lit(middle) - x)))
    low, high = curve(F.lit(0.0)), curve(F.lit(1.0))
    return F.transform(gray, lambda g: F.floor((curve(g / F.lit(255.0)) - low) / (high - low) * 255.0 + 0.5).cast("int"))


def shifted(a: np.ndarray, radius: int, diamond: bool, fill: int) -> list[np.ndarray]:
    """Copies of (n, h, w) rasters moved by every offset of a structuring element."""
    _, h, w = a.shape
    padded = np.pad(a, ((0, 0), (radius, radius), (radius, radius)), constant_values=fill)
    size = range(-radius, radius + 1)
    inside = [(y, x) for y in size for x in size if (abs(y) + abs(x) <= radius if diamond else y * y + x * x <= radius * radius)]
    return [padded[:, radius + y : radius + y + h, radius + x : radius + x + w] for y, x in inside]


def erode(a: np.ndarray, radius: int = 1, diamond: bool = True) -> np.ndarray:
    return functools.reduce(np.minimum, shifted(a, radius, diamond, 255))


def dilate(a: np.ndarray, radius: int = 1, diamond: bool = True) -> np.ndarray:
    return functools.reduce(np.maximum, shifted(a, radius, diamond, 0))


def unsharp(gray: np.ndarray, amount: float, limit: float) -> np.ndarray:
    """(n, h, w) rasters sharpened against their 3 x 3 mean, edges repeated; differences up to the limit stay."""
    _, h, w = gray.shape
    padded = np.pad(gray.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    mean = sum(padded[:, y : y + h, x : x + w] for y in range(3) for x in range(3)) / 9
    differ = gray - mean
    sharp = np.where(np.abs(differ) > limit * 255, gray + amount * differ, gray)
    return np.clip(np.floor(sharp + 0.5), 0, 255).astype(np.int32)


#: The levels, sharpening and sigmoid of the enhancement steps, and the tone of backgrounds.
LEVELS, SHARPEN, CONTRAST, PAPER_LEVELS, PAPER_CONTRAST, PAPER_SATURATION = (0.15, 0.88), (1.2, 0.01), (3.0, 0.5), (0.06, 0.94), (3.5, 0.5), (1.02, 1.07)


def rounded(a: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(a + 0.5), 0, 255).astype(np.int32)


def stretched(gray: np.ndarray, black: float, white: float) -> np.ndarray:
    """Levels stretched so that the black share becomes 0 and the white share 255."""
    return rounded((gray - black * 255.0) * 255.0 / ((white - black) * 255.0))


def contrasted(gray: np.ndarray, contrast: float, middle: float) -> np.ndarray:
    """Contrast along a sigmoid around the middle share, ends kept in place."""
    curve = lambda x: 1.0 / (1.0 + np.exp(contrast * (middle - x)))
    return rounded((curve(gray / 255.0) - curve(0.0)) / (curve(1.0) - curve(0.0)) * 255.0)


def modulated(rgb: np.ndarray, brightness: float, saturation: float) -> np.ndarray:
    """(..., 3) colours with their lightness and their distance from their grey scaled."""
    high, low = rgb.max(axis=-1, keepdims=True), rgb.min(axis=-1, keepdims=True)
    light = (high + low) / 2.0
    return rounded((light + (rgb - light) * saturation) * brightness)


def weights(size: int, made: int) -> np.ndarray:
    """(made, size) weights of one axis: shares of covered cells when it shrinks, linear between centres when it grows."""
    ends = np.arange(made + 1) * size / made
    if made <= size:
        cells = np.arange(size)
        cover = np.minimum(ends[1:, None], cells + 1) - np.maximum(ends[:-1, None], cells)
        return np.maximum(cover, 0) * made / size
    at = np.clip((np.arange(made) + 0.5) * size / made - 0.5, 0, size - 1)
    left = np.minimum(at.astype(int), size - 1)
    right = np.minimum(left + 1, size - 1)
    out = np.zeros((made, size))
    np.add.at(out, (np.arange(made), left), 1 - (at - left))
    np.add.at(out, (np.arange(made), right), at - left)
    return out


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """(n, h, w) rasters at another size."""
    return rounded(weights(a.shape[1], height) @ a @ weights(a.shape[2], width).T)


def shrunk(a: np.ndarray, width: int) -> np.ndarray:
    """Rasters brought down to a width, heights in proportion, halves to even; narrower ones, and width 0, stay."""
    _, h, w = a.shape
    return resized(a, max(1, round(h * width / w)), width) if 0 < width < w else a


def whitened(a: np.ndarray) -> np.ndarray:
    """White margins of 15 thousandths of the width and 10 of the height."""
    _, h, w = a.shape
    x, y = w * 15 // 1000, h * 10 // 1000
    out = np.full_like(a, 255)
    out[:, y : h - y, x : w - x] = a[:, y : h - y, x : w - x]
    return out


def enhanced(gray: np.ndarray, steps: tuple[str, ...]) -> np.ndarray:
    """The enhancement steps of a mode, in their order; modulate is for colours and leaves grey as it is."""
    for step in steps:
        if step == "level":
            gray = stretched(gray, *LEVELS)
        elif step == "sigmoidal":
            gray = contrasted(gray, *CONTRAST)
        elif step == "unsharp":
            gray = unsharp(gray, *SHARPEN)
    return gray


def binarized(gray: np.ndarray, width: int, share: float, steps: tuple[str, ...] = (), supersample: int = 1) -> np.ndarray:
    """A scan as black and white: shrink, enhance, enlarge by ``supersample``, threshold, whiten the margins."""
    a = enhanced(shrunk(gray, width), steps)
    if supersample > 1:
        a = resized(a, a.shape[1] * supersample, a.shape[2] * supersample)
    return whitened(np.where(a > share * 255.0, 255, 0).astype(np.int32))


def smoothed(gray: np.ndarray, width: int, share: float, steps: tuple[str, ...] = (), levels: int = 3) -> np.ndarray:
    """Black and white with soft edges: enhance, enlarge four times, threshold, smooth the outlines, go down, posterize."""
    _, h, w = gray.shape
    target = width if 0 < width < w else w
    a = resized(enhanced(gray, steps), 4 * h, 4 * w)
    a = np.where(a > share * 255.0, 255, 0)
    for step in (erode, dilate, dilate, erode):
        a = step(a, 2, True)
    a = resized(a, max(1, round(h * target / w)), target)
    nearest = 255.0 / (levels - 1)
    return whitened(rounded(np.floor(a / nearest + 0.5) * nearest))


def fine_structure(gray: np.ndarray, colourfulness: np.ndarray, gate: float = 0.15, dark: float = 0.72, large: int = 6) -> np.ndarray:
    """Coloured ink that is no large area: chroma over the gate and dark enough, less its opening by a disk, opened once more."""
    ink = np.where((colourfulness > gate * 255.0) & (gray <= dark * 255.0), 255, 0)
    areas = dilate(erode(ink, large, False), large, False)
    return dilate(erode(np.maximum(ink - areas, 0), 1, True), 1, True)


def cluster_masks(ink: np.ndarray, detail: np.ndarray, hue_bins: np.ndarray, clusters: list[list[int]], slots: int = 3, widen: int = 4) -> np.ndarray:
    """(slots, h, w) masks of one page, 0 where a slot's colour draws: detail inside a widened gate of its ink and hues.

    ink and hue_bins (-1: grey) may be smaller than detail; the gate is brought to its size. A slot without a cluster is white.
    """
    h, w = detail.shape
    out = np.full((slots, h, w), 255, dtype=np.int32)
    for i, bins in enumerate(clusters[:slots]):
        band = np.where(np.isin(hue_bins, bins), ink, 0)[None]
        gate = np.where(resized(band, h, w) > 0.3 * 255.0, 255, 0)
        drawn = np.where((dilate(gate, widen, False)[0] > 0) & (detail > 0), 255, 0)[None]
        out[i] = 255 - erode(dilate(drawn, 1, False), 1, False)[0]
    return out


def paper(rgb: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """(h, w, 3) background without any ink: pixels that no mask draws on, averaged to a width and toned; all-ink cells are white."""
    open_ = (masks.min(axis=0) > 127).astype(np.float64)
    h, w = open_.shape
    made = (max(1, round(h * width / w)), width) if 0 < width < w else (h, w)
    down, across = weights(h, made[0]), weights(w, made[1]).T
    share = down @ open_ @ across
    colours = np.stack([down @ (rgb[..., c] * open_) @ across for c in range(3)], axis=-1)
    # Where some of a cell is ink, what is left shows through to white in proportion.
    mixed = rounded(colours + 255.0 * (1 - share[..., None]))
    return modulated(contrasted(stretched(mixed, *PAPER_LEVELS), *PAPER_CONTRAST), *PAPER_SATURATION)


#: Rasters that a kernel works on at once, so that its memory does not follow the batch.
AT_ONCE = 256


def in_parts(f: Callable[..., np.ndarray], *columns: pd.Series) -> pd.Series:
    """What ``f`` makes of arrays of samples, (n, samples) each, some rasters at a time."""
    made: list[np.ndarray] = []
    for lo in range(0, len(columns[0]), AT_ONCE):
        out = f(*(np.stack(c.iloc[lo : lo + AT_ONCE].to_list()) for c in columns))
        made.extend(out.reshape(len(out), -1).astype(np.int32))
    return pd.Series(made, dtype=object)


def kernel(f, width: int, height: int):
    """A column function of gray arrays of one size that runs a kernel on (n, h, w) rasters."""

    @F.pandas_udf("array<int>")
    def run(gray: pd.Series) -> pd.Series:
        return in_parts(lambda a: f(a.astype(np.int32).reshape(-1, height, width)), gray)

    return run


def colour_kernel(f, width: int, height: int):
    """The same for kernels of gray levels and chroma, made of three channel arrays."""

    def of_channels(*channels: np.ndarray) -> np.ndarray:
        rgb = np.stack(channels, axis=-1).astype(np.int64).reshape(-1, height, width, 3)
        return f((rgb @ np.array([299, 587, 114])) // 1000, rgb.max(axis=-1) - rgb.min(axis=-1))

    @F.pandas_udf("array<int>")
    def run(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        return in_parts(of_channels, r, g, b)

    return run


def morphology(kind: str, width: int, height: int, radius: int = 1, diamond: bool = True):
    """A column function of gray arrays: erode, dilate, open, close or smooth (open then close)."""
    steps = {"erode": (erode,), "dilate": (dilate,), "open": (erode, dilate), "close": (dilate, erode), "smooth": (erode, dilate, dilate, erode)}[kind]
    return kernel(lambda a: functools.reduce(lambda made, step: step(made, radius, diamond), steps, a), width, height)
