"""Page geometry, affine matrices and hue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A4 in points, and its width in inches as used for resolutions.
A4_WIDTH, A4_HEIGHT, A4_INCHES = 595.28, 841.89, 8.27


def dpi_on_a4(width: Column) -> Column:
    return width / F.lit(A4_INCHES)


def is_a4(w: Column, h: Column, tolerance: float = 1.5) -> Column:
    return (F.abs(w - A4_WIDTH) < tolerance) & (F.abs(h - A4_HEIGHT) < tolerance)


def a4_fit(w: Column, h: Column) -> Column:
    """The centred rectangle x0, y0, x1, y1 of a page scaled into A4."""
    scale = F.least(F.lit(A4_WIDTH) / w, F.lit(A4_HEIGHT) / h)
    x0, y0 = (F.lit(A4_WIDTH) - w * scale) / 2, (F.lit(A4_HEIGHT) - h * scale) / 2
    return F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + w * scale).alias("x1"), (y0 + h * scale).alias("y1"))


def scaled_height(w: Column, h: Column, target: Column) -> Column:
    """The height that goes with a target width, halves to even."""
    return F.rint(h * target / w).cast("bigint")


def raster_size(page_w: Column, page_h: Column, width: Column) -> Column:
    """Whole width and height, 1 at least, of a page drawn ``width`` wide; halves to even."""
    return F.struct(width.cast("int").alias("w"), F.greatest(F.lit(1), F.rint(width * page_h / page_w).cast("int")).alias("h"))


def border(w: Column, h: Column, supersample: int = 1) -> Column:
    """Margins to whiten: 15 thousandths of the width and 10 of the height, of the supersampled size."""
    return F.struct(F.expr("0").alias("zero"), F.floor(w * supersample * 15 / 1000).cast("int").alias("x"), F.floor(h * supersample * 10 / 1000).cast("int").alias("y")).dropFields("zero")


def zoom_back(w: Column, target: Column) -> Column:
    """Percent that bring a page enlarged four times to its target width, which never exceeds its own."""
    return F.when((target > 0) & (target < w), target).otherwise(w) / w * 25.0


def text_box(chars: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Font size and horizontal scaling (1 to 1000 %) that stretch a line over its box."""
    size = F.greatest(F.lit(1.0), h * page_h)
    stretch = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.lit(100.0) * w * page_w / (chars * size)))
    return F.struct(size.alias("size"), stretch.alias("stretch"))


def multiply(a: Column, b: Column) -> Column:
    """The affine matrix a times b; both are arrays of six, the left operand applies first."""
    x, y = (lambda i: a[i]), (lambda i: b[i])
    return F.array(
        x(0) * y(0) + x(1) * y(2),
        x(0) * y(1) + x(1) * y(3),
        x(2) * y(0) + x(3) * y(2),
        x(2) * y(1) + x(3) * y(3),
        x(4) * y(0) + x(5) * y(2) + y(4),
        x(4) * y(1) + x(5) * y(3) + y(5),
    )


def hue_lightness_saturation(r: Column, g: Column, b: Column) -> Column:
    """Hue, lightness and saturation of channels in 0 to 1, with the operation order of the colorsys module."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    total, span = high + low, high - low
    light = total / 2.0
    saturation = F.when(light <= 0.5, span / total).otherwise(span / (2.0 - high - low))
    rc, gc, bc = (high - r) / span, (high - g) / span, (high - b) / span
    turn = F.when(r == high, bc - gc).when(g == high, 2.0 + rc - bc).otherwise(4.0 + gc - rc) / 6.0
    grey = high == low
    hue = turn - F.floor(turn)
    return F.struct(F.when(grey, 0.0).otherwise(hue).alias("hue"), light.alias("lightness"), F.when(grey, 0.0).otherwise(saturation).alias("saturation"))


def hue_bin(hue: Column, bins: int = 36) -> Column:
    return F.floor(hue * bins).cast("int") % bins
