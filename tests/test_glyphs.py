"""Glyphs and components against plain search."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.catalog import QUERIES
from folioflow.catalog_sql import ORACLES
from folioflow.operators import glyphs, tiles
from folioflow.plans.closure import components

PIECE = f"page string, {tiles.PIECE}"


def flooded(black):
    """(first pixel, set of pixels) of every component, by flooding."""
    h, w = black.shape
    seen, out = set(), []
    for start in zip(*map(lambda a: a.tolist(), np.nonzero(black))):
        if start in seen:
            continue
        seen.add(start)
        todo, found = [start], []
        while todo:
            y, x = todo.pop()
            found.append((y, x))
            for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if 0 <= p[0] < h and 0 <= p[1] < w and black[p] and p not in seen:
                    seen.add(p)
                    todo.append(p)
        out.append((start[0] * w + start[1], frozenset(found)))
    return out


def found_in(spark, pages, tile):
    rows = [(name, *a.shape, 0, 0, *a.shape, np.where(a, 0, 255).astype(np.uint8).tobytes()) for name, a in pages.items()]
    cut = tiles.tiled(spark.createDataFrame(rows, PIECE), "page", [], tile=tile)
    return glyphs.with_glyphs(glyphs.glyph_pieces(cut, "page"), "page")


def spiral(n):
    """One glyph that winds through every tile."""
    a, y, x, dy, dx = np.zeros((n, n), dtype=bool), 0, 0, 0, 1
    a[0, 0] = True
    for _ in range(n * n):
        for _ in range(2):
            far = (y + 2 * dy, x + 2 * dx)
            if 0 <= y + dy < n and 0 <= x + dx < n and not (0 <= far[0] < n and 0 <= far[1] < n and a[far]) and not a[y + dy, x + dx]:
                break
            dy, dx = dx, -dy
        else:
            break
        y, x = y + dy, x + dx
        a[y, x] = True
    return a


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_glyphs_by_flooding(spark, tile):
    rng = np.random.default_rng(tile)
    pages = {"thin": rng.random((23, 31)) < 0.2, "thick": rng.random((20, 26)) < 0.5, "full": np.ones((9, 8), dtype=bool), "empty": np.zeros((5, 5), dtype=bool), "spiral": spiral(24), "row": rng.random((1, 40)) < 0.5}
    pieces = found_in(spark, pages, tile)
    table = glyphs.glyph_table(pieces, "page").toPandas()
    shapes = {}
    for name, a in pages.items():
        want = flooded(a)
        of = table[table["page"] == name].set_index("glyph")
        assert sorted(of.index) == sorted(g for g, _ in want), name
        for g, found in want:
            top, left = min(y for y, _ in found), min(x for _, x in found)
            row = of.loc[g]
            assert (row["top"], row["left"], row["height"], row["width"], row["n_pixels"]) == (top, left, max(y for y, _ in found) - top + 1, max(x for _, x in found) - left + 1, len(found))
            shapes.setdefault(frozenset((y - top, x - left) for y, x in found), []).append((name, g, row["code1"], row["code2"]))
    # Codes are equal exactly where shapes are, and a dictionary counts them and draws the first.
    assert all(len({r[2:] for r in rows}) == 1 for rows in shapes.values())
    assert len({rows[0][2:] for rows in shapes.values()}) == len(shapes) > 20
    entries = glyphs.dictionary(glyphs.glyph_table(pieces, "page").withColumn("chunk", F.lit(1)), "page", "chunk")
    assert sorted((r["first_page"], r["first_glyph"], r["occurrences"]) for r in entries.collect()) == sorted((*min(r[:2] for r in rows), len(rows)) for rows in shapes.values())
    drawn = {}
    for r in glyphs.symbols(entries, pieces, "page", "chunk").collect():
        for y, x, n in np.array(r["runs"]).reshape(-1, 3).tolist():
            drawn.setdefault((r["first_page"], r["first_glyph"]), []).extend((y, x + k) for k in range(n))
    assert {k: (len(v), frozenset(v)) for k, v in drawn.items()} == {(n, g): (len(f), f) for n, a in pages.items() for g, f in flooded(a) if (n, g) in drawn} and len(drawn) == len(shapes)


def test_tiles_of_one_row_or_column(spark):
    """The last tiles of these pages are one row high or one column wide, and glyphs go on into them."""
    rng = np.random.default_rng(4)
    pages = {"row": rng.random((9, 12)) < 0.3, "column": rng.random((12, 9)) < 0.3, "both": rng.random((13, 13)) < 0.3, "full": np.ones((5, 5), dtype=bool)}
    got = glyphs.glyph_table(found_in(spark, pages, 4), "page").select("page", "glyph", "n_pixels").collect()
    assert sorted(map(tuple, got)) == sorted((name, g, len(found)) for name, a in pages.items() for g, found in flooded(a))


def test_a_sheet_with_one_row_after_its_last_whole_tile_equals_sql(spark, tmp_path):
    """130 vectors of a label are 65 rows, of which one is in the second tile; glyphs go on into it."""
    rows = [(i, [float(e) for e in v], 0) for i, v in enumerate(np.random.default_rng(4).normal(0, 0.125, (130, 64)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(ORACLES["glyph_dictionary"])
    got = QUERIES["glyph_dictionary"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_codes_do_not_depend_on_tiles_or_slices(spark):
    pages = {"p": np.random.default_rng(1).random((30, 30)) < 0.4}
    made = []
    for tile, per_slice in ((5, 1), (30, 1 << 20)):
        pieces = found_in(spark, pages, tile).withColumn("top", F.lit(0)).withColumn("left", F.lit(0))
        codes = glyphs.shape_codes(pieces, "page", per_slice).groupBy("glyph").agg(F.bit_xor("code1"), F.bit_xor("code2"))
        made.append(sorted(map(tuple, codes.collect())))
    assert made[0] == made[1] and made[0]


def test_no_tiles(spark):
    none = spark.createDataFrame([], PIECE)
    assert glyphs.glyph_table(glyphs.with_glyphs(glyphs.glyph_pieces(none, "page"), "page"), "page").count() == 0


def test_components_by_search(spark):
    rng = np.random.default_rng(3)
    links = [("chain", k, k + 1) for k in range(0, 90)] + [("hub", 0, k) for k in range(1, 300)] + [("loose", int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [("self", 4, 4)]
    want = {}
    for g, a, b in links:
        for n in (a, b):
            want.setdefault((g, n), n)
    while True:
        before = dict(want)
        for g, a, b in links:
            want[g, a] = want[g, b] = min(want[g, a], want[g, b])
        if want == before:
            break
    df = spark.createDataFrame(links + links[:20], "g string, a long, b long")
    got = {(r["g"], r["node"]): r["root"] for r in components(df, ["g"], "a", "b").collect()}
    assert got == {k: v for k, v in want.items() if k[1] != v}
