"""Glyphs of black and white pages, and one dictionary of equal glyphs for every chunk of pages.

A glyph is a component of black pixels that touch at a side or a corner. Tiles are labelled by themselves, over runs of
pixels; only pixels at the sides of tiles meet across tiles, and the pieces they link are joined into glyphs by rounds over
these links alone. What is known of a glyph (box, size, shape) is added up from its pieces, so that no page, and no glyph
however large, is ever one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.closure import components

BOX = ("top", "left", "bottom", "right")


def run_lengths(black: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true in every row, in order: their row, start and end."""
    edge = np.diff(np.pad(black, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (y, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return y, start, end


def joined_runs(y: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """For every run the first run of its component."""
    wide = width + 2
    low = np.searchsorted(y * wide + end, (y + 1) * wide + start)
    high = np.searchsorted(y * wide + start, (y + 1) * wide + end, side="right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(y))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return root


def glyph_pieces(tiles: DataFrame, page: str) -> DataFrame:
    """A row per component of every tile: page, piece, width, box, n_pixels, runs and border.

    ``tiles`` are pieces as ``tiles.tiled`` gives them, black where a sample is 0. A piece's number is its first pixel's, row by
    row over the page; boxes include their last row and column; runs are (row, column, length) one after the other; border has
    the numbers of pixels with a neighbour in another tile. A tile without black gives no row.
    """
    kind = tiles.schema[page].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (height, width, y0, x0, h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width", "y", "x", "h", "w")))):
                black = np.frombuffer(batch.column("samples")[i].as_buffer(), np.uint8).reshape(h, w) == 0
                y, start, end = run_lengths(black)
                if not len(y):
                    continue
                root = joined_runs(y, start, end, w)
                order = np.argsort(root, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(root[order]) > 0]))
                first, cuts = order[heads], np.append(heads, len(order))
                sides = np.zeros((h, w), dtype=bool)
                # A tile may be one row or column alone, with neighbours on both sides.
                sides[0] |= y0 > 0
                sides[-1] |= y0 + h < height
                sides[:, 0] |= x0 > 0
                sides[:, -1] |= x0 + w < width
                of = np.empty((h, w), dtype=np.int32)
                of[black] = np.repeat(np.searchsorted(first, root), end - start)
                by, bx = np.nonzero(sides & black)
                turn = np.argsort(of[by, bx], kind="stable")
                border_cuts = np.searchsorted(of[by, bx][turn], np.arange(len(first) + 1))
                y, start, end = y[order] + y0, start[order] + x0, end[order] + x0
                lists = lambda at, values, t: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, t))
                best = {"top": np.minimum.reduceat(y, heads), "left": np.minimum.reduceat(start, heads), "bottom": np.maximum.reduceat(y, heads), "right": np.maximum.reduceat(end, heads) - 1}
                yield pa.RecordBatch.from_pydict({
                    "page": pa.array([batch.column("page")[i].as_py()] * len(first), batch.column("page").type),
                    "piece": pa.array(y[heads].astype(np.int64) * width + start[heads]),
                    "width": pa.array([width] * len(first), pa.int32()),
                    **{name: pa.array(v, pa.int32()) for name, v in best.items()},
                    "n_pixels": pa.array(np.add.reduceat(end - start, heads), pa.int64()),
                    "runs": lists(cuts * 3, np.stack([y, start, end - start], axis=1).ravel(), pa.int32()),
                    "border": lists(border_cuts, ((by + y0).astype(np.int64) * width + bx + x0)[turn], pa.int64()),
                })

    schema = f"page {kind}, piece long, width int, top int, left int, bottom int, right int, n_pixels long, runs array<int>, border array<long>"
    named = tiles.select(F.col(page).alias("page"), "height", "width", "y", "x", "h", "w", "samples")
    return named.mapInArrow(label, schema).withColumnRenamed("page", page)


def piece_links(pieces: DataFrame, page: str) -> DataFrame:
    """Pairs of pieces (a, b) of a page with pixels that touch across tiles: every border pixel meets those after it."""
    border = pieces.select(page, "width", F.col("piece").alias("a"), F.explode("border").alias("at"))
    x, wide = F.col("at") % F.col("width"), F.col("width")
    after = F.array(*(F.when((x + dx >= 0) & (x + dx < wide), F.col("at") + dy * wide + dx) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))
    met = border.select(page, "a", F.explode(after).alias("at")).where("at is not null")
    return met.join(border.select(page, "at", F.col("a").alias("b")), [page, "at"]).where("a <> b").select(page, "a", "b").distinct()


def shape_codes(pieces: DataFrame, page: str, per_slice: int = 1 << 20) -> DataFrame:
    """page, glyph and two 64-bit codes of every piece's pixels relative to its glyph's box (columns top and left).

    A code is the exclusive or of its pixels' hashes, so a glyph's is that of its pieces' however tiles cut it.
    """
    kind = pieces.schema[page].dataType.simpleString()

    def mixed(v: np.ndarray, seed: int) -> np.ndarray:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v + np.uint64(seed)) ^ ((v + np.uint64(seed)) >> np.uint64(shift))
            v = v * np.uint64(factor)
        return v ^ (v >> np.uint64(31))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reached = np.cumsum(batch.column("n_pixels").to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(reached // per_slice)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                runs = part.column("runs").flatten().to_numpy().reshape(-1, 3).astype(np.int64)
                n_runs = part.column("runs").value_lengths().to_numpy() // 3
                at, n = np.repeat(np.arange(len(part)), n_runs), runs[:, 2]
                dy, dx = runs[:, 0] - part.column("top").to_numpy()[at], runs[:, 1] - part.column("left").to_numpy()[at]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pixel = (np.repeat(dy, n) << 32 | (np.repeat(dx, n) + step)).astype(np.uint64)
                heads = np.concatenate([[0], np.cumsum(n)])[np.cumsum(n_runs) - n_runs]
                found = [np.bitwise_xor.reduceat(mixed(pixel, seed), heads).view(np.int64) for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
                yield pa.RecordBatch.from_arrays([part.column("page"), part.column("glyph"), *map(pa.array, found)], names=["page", "glyph", "code1", "code2"])

    asked = pieces.select(F.col(page).alias("page"), "glyph", "top", "left", "n_pixels", "runs")
    return asked.mapInArrow(codes, f"page {kind}, glyph long, code1 long, code2 long").withColumnRenamed("page", page)


def with_glyphs(pieces: DataFrame, page: str) -> DataFrame:
    """Adds glyph, the first pixel's number of the whole glyph that a piece belongs to."""
    roots = components(piece_links(pieces, page), [page], "a", "b").select(page, F.col("node").alias("piece"), "root")
    return pieces.join(roots, [page, "piece"], "left").withColumn("glyph", F.coalesce("root", "piece")).drop("root")


def glyph_table(pieces: DataFrame, page: str) -> DataFrame:
    """A row per glyph: page, glyph, top, left, height, width, n_pixels, code1 and code2; ``pieces`` have their glyph.

    Glyphs of equal height, width, n_pixels and codes are equal but for a chance of about 2 to the power of -128 a pair.
    """
    boxes = pieces.groupBy(page, "glyph").agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"), F.sum("n_pixels").alias("n"))
    told = pieces.select(page, "glyph", "n_pixels", "runs").join(boxes.select(page, "glyph", "top", "left"), [page, "glyph"])
    codes = shape_codes(told, page).groupBy(page, "glyph").agg(F.bit_xor("code1").alias("code1"), F.bit_xor("code2").alias("code2"))
    return boxes.join(codes, [page, "glyph"]).select(page, "glyph", "top", "left", F.expr("bottom - top + 1").alias("height"), F.expr("right - left + 1").alias("width"), F.col("n").alias("n_pixels"), "code1", "code2")


def dictionary(glyphs: DataFrame, page: str, chunk: str) -> DataFrame:
    """A row per different glyph of a chunk: its size, n_pixels, codes, occurrences, and page and number of the first one.

    ``glyphs`` have their chunk; pages are ordered by their value.
    """
    first = F.min(F.struct(F.col(page).alias("page"), "glyph")).alias("first")
    found = glyphs.groupBy(chunk, "height", "width", "n_pixels", "code1", "code2").agg(F.count("*").alias("occurrences"), first)
    return found.select(chunk, "height", "width", "n_pixels", "code1", "code2", "occurrences", F.col("first.page").alias("first_page"), F.col("first.glyph").alias("first_glyph"))


def symbols(entries: DataFrame, pieces: DataFrame, page: str, chunk: str) -> DataFrame:
    """The strokes of a dictionary's symbols: (chunk, first_page, first_glyph, runs), a row per piece of the first glyph."""
    drawn = pieces.select(F.col(page).alias("first_page"), F.col("glyph").alias("first_glyph"), "runs")
    return entries.select(chunk, "first_page", "first_glyph").join(drawn, ["first_page", "first_glyph"]).select(chunk, "first_page", "first_glyph", "runs")
