from __future__ import annotations

import colorsys
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import text as T
from folioflow.operators import raster, selection
from folioflow.plans import assembly


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("spec, want", [("3,7,10-12", [3, 7, 10, 11, 12]), ("", []), (" 3 , ,4", [3, 4]), ("10-5", []), ("-3", [-3]), ("2,1-3,2", [1, 2, 3])])
def test_parse_ranges(spark, spec, want):
    assert one(spark, T.parse_ranges(F.lit(spec))) == want


def test_parse_ranges_property(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=4), min_size=20, max_size=20))
    def holds(cases):
        specs = [",".join(f"{a}-{b}" for a, b in case) for case in cases]
        rows = spark.createDataFrame(list(enumerate(specs)), "i int, spec string").select("i", T.parse_ranges(F.col("spec")).alias("x")).collect()
        for r in rows:
            assert r["x"] == sorted({n for a, b in cases[r["i"]] for n in range(a, b + 1)})

    holds()


@pytest.mark.parametrize("n, k, per", [(0, 1, 0), (1, 1, 1), (15, 1, 15), (16, 1, 16), (31, 1, 31), (32, 2, 16), (100, 6, 17), (127, 7, 19), (128, 8, 16), (848, 8, 106)])
def test_chunk_shape(spark, n, k, per):
    got = spark.range(1).select(*(c.alias(x) for c, x in zip(assembly.chunk_shape(F.lit(n)), "kp"))).first()
    assert (got["k"], got["p"]) == (k, per)


def test_numbering(spark):
    names = ["image00060.jpg", "a12_b.png", "noNumber.tif", "1" * 20 + ".jpg", "v2.0.jpg"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", T.last_number(T.stem(F.col("name"))).alias("n"), T.trailing_number(T.stem(F.col("name"))).alias("t")).collect()
    assert {r["name"]: (r["n"], r["t"]) for r in rows} == {"image00060.jpg": (60, 60), "a12_b.png": (12, None), "noNumber.tif": (None, None), "1" * 20 + ".jpg": (None, None), "v2.0.jpg": (0, 0)}


def test_page_images(spark):
    names = ["a.jpg", "X.JPG", ".hidden.jpg", "b.tiff", "c.pdf", "jpg", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string").where(T.is_page_image(F.col("name"))).collect()
    assert {r["name"] for r in rows} == {"a.jpg", "X.JPG", "b.tiff"}


def test_number_pages_falls_back_per_book(spark):
    rows = [("a", "p2.jpg"), ("a", "p10.jpg"), ("b", "x1.jpg"), ("b", "y1.jpg"), ("c", "q.jpg"), ("c", "r3.jpg")]
    got = selection.number_pages(spark.createDataFrame(rows, "book string, name string"), "book", "name").collect()
    assert {(r["name"]): (r["numbered"], r["page_no"]) for r in got} == {"p2.jpg": (True, 2), "p10.jpg": (True, 10), "x1.jpg": (False, 1), "y1.jpg": (False, 2), "q.jpg": (False, 1), "r3.jpg": (False, 2)}


@pytest.mark.parametrize("seconds, want", [(0, "0s"), (59, "59s"), (60, "1m"), (61, "1m 1s"), (3600, "1h 0m"), (3725, "1h 2m")])
def test_duration(spark, seconds, want):
    assert one(spark, T.duration(F.lit(seconds))) == want


def test_sizes_names_and_formats(spark):
    assert one(spark, T.human_size(F.lit(1048576))) == "1.0 MB"
    assert one(spark, T.human_size(F.lit(1048575))) == "1024 KB"
    assert one(spark, T.safe_name(F.lit(" a/b:c\\d\te "))) == "abcde"
    assert one(spark, T.with_suffix(F.lit("x.y.pdf"), "_ocr")) == "x.y_ocr.pdf"
    assert one(spark, T.padded("p", F.lit(123456), ".png")) == "p123456.png"
    assert one(spark, T.sniff_format(F.lit(bytearray(b"\xff\xd8\xff\xe0")))) == "jpeg"
    assert one(spark, T.sniff_format(F.lit(bytearray(b"<htm")))) == "3c68746d"


def test_hue_follows_colorsys(spark):
    colours = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    hls = G.hue_lightness_saturation(*(F.col(c) / F.lit(255.0) for c in "rgb"))
    for row in spark.createDataFrame(colours, "r int, g int, b int").select("r", "g", "b", hls.alias("x")).collect():
        want = colorsys.rgb_to_hls(row["r"] / 255, row["g"] / 255, row["b"] / 255)
        assert (row["x"]["hue"], row["x"]["lightness"], row["x"]["saturation"]) == want


def test_heights_round_half_to_even(spark):
    assert [one(spark, G.scaled_height(F.lit(2), F.lit(h), F.lit(1))) for h in (5, 7)] == [2, 4]


def test_matrix_product(spark):
    a, b = ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0, 0.0, 0.0, 2.0, 1.0, -1.0])
    assert one(spark, G.multiply(*(F.array(*map(F.lit, m)) for m in (a, b)))) == [2.0, 4.0, 6.0, 8.0, 11.0, 11.0]


def test_sizes_halfway_go_to_even(spark):
    """Sizes exactly between two tenths of a MB, or two KB, at which printf and Java's format differ."""
    want = {1310720: "1.2 MB", 1835008: "1.8 MB", 2359296: "2.2 MB", 1046749000: "998.3 MB", 2 * 1048576 - 1: "2.0 MB", 512: "0 KB", 1536: "2 KB", 2560: "2 KB", 0: "0 KB"}
    got = spark.createDataFrame([(k,) for k in want], "n long").select("n", T.human_size(F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in got} == want


def test_a_range_spec_is_cut_once_a_row(spark):
    """What a spec's pieces cost must not be paid again for every time they are named."""
    specs = spark.createDataFrame([("3,7,10-12",)], "spec string")
    for made, most in ((T.parse_ranges(F.col("spec")), 1), (T.ranges_error(F.col("spec")), 1), (T.parse_page_spec(F.col("spec")), 2)):
        plan = specs.select(made.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("split(spec") <= most


def test_kernels_work_on_some_rasters_at_a_time():
    rows, seen = pd.Series([np.arange(6) + k for k in range(1000)]), []

    def f(a, b):
        seen.append(len(a))
        return (a + b).reshape(-1, 2, 3)

    got = raster.in_parts(f, rows, rows)
    assert max(seen) <= raster.AT_ONCE and sum(seen) == 1000
    assert all((g == 2 * r).all() for g, r in zip(got, rows)) and len(raster.in_parts(f, rows[:0], rows[:0])) == 0


def test_a_shape_holds_no_copy_for_every_offset():
    a = np.random.default_rng(1).integers(0, 256, (50, 32, 32)).astype(np.int32)
    tracemalloc.start()
    raster.erode(a, 6, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * a.nbytes
