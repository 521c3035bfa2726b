"""Page kernels, content streams, stage tables and queues against plain loops."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions.options import Options, migrated

from folioflow.functions import geometry as G
from folioflow.functions import text as T
from folioflow.operators import colour, content, jobs, raster, selection
from folioflow.operators.scans import ordinals
from folioflow.plans import assembly, stages
from folioflow.sources import files, pdf, streams
from folioflow.streaming import progress


def brute_resize(a, height, width):
    h, w = a.shape
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            total = area = 0.0
            for i in range(h):
                for j in range(w):
                    dy = min((y + 1) * h / height, i + 1) - max(y * h / height, i)
                    dx = min((x + 1) * w / width, j + 1) - max(x * w / width, j)
                    if dy > 0 and dx > 0:
                        total, area = total + a[i, j] * dy * dx, area + dy * dx
            out[y, x] = total / area
    return out


def test_resizing():
    a = np.random.default_rng(0).integers(0, 256, (1, 9, 7))
    assert np.abs(raster.resized(a, 4, 3)[0] - brute_resize(a[0], 4, 3)).max() <= 0.5 + 1e-9
    assert (raster.resized(a, 9, 7) == a).all() and raster.shrunk(a, 100) is a and raster.shrunk(a, 0) is a
    assert raster.shrunk(a, 3).shape == (1, 4, 3)
    flat = np.full((1, 5, 5), 77)
    assert (raster.resized(flat, 20, 20) == 77).all() and (raster.resized(flat, 3, 2) == 77).all()
    step = np.array([[[0, 200]]])
    assert raster.resized(step, 1, 4).ravel().tolist() == [0, 50, 150, 200]


def test_binarized_pages():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (2, 300, 200))
    made = raster.binarized(a, 0, 0.55)
    assert (made[:, 3:297, 3:197] == np.where(a > 140.25, 255, 0)[:, 3:297, 3:197]).all()
    assert (made[:, :3] == 255).all() and (made[:, :, 197:] == 255).all() and set(np.unique(made)) == {0, 255}
    assert raster.binarized(a, 100, 0.55, ("level", "unsharp"), 2).shape == (2, 300, 200)
    soft = raster.smoothed(a[:1], 100, 0.5)
    assert soft.shape == (1, 150, 100) and set(np.unique(soft)) <= {0, 128, 255}
    line = np.full((1, 40, 40), 255)
    line[:, 10:30, 15:25] = 0
    assert (raster.smoothed(line, 40, 0.5) == line).mean() > 0.97  # straight strokes stay, but for their corners


def test_steps_by_mode():
    a = np.random.default_rng(2).integers(0, 256, (1, 6, 6))
    by_hand = raster.unsharp(raster.contrasted(raster.stretched(a, 0.15, 0.88), 3.0, 0.5), 1.2, 0.01)
    assert (raster.enhanced(a, ("level", "sigmoidal", "unsharp")) == by_hand).all() and (raster.enhanced(a, ("modulate",)) == a).all()
    grey = np.full((2, 2, 3), 100)
    assert (raster.modulated(grey, 1.0, 1.5) == 100).all() and (raster.modulated(grey, 1.02, 1.07) == 102).all()
    assert raster.modulated(np.array([[[200, 100, 100]]]), 1.0, 1.5).ravel().tolist() == [225, 75, 75]


def test_fine_structure_drops_areas_and_specks():
    gray, colourfulness = np.full((1, 40, 40), 255), np.zeros((1, 40, 40), int)
    gray[:, 2:22, 2:22] = 100  # an area
    gray[:, 30:34, 5:35] = 100  # a stroke
    gray[0, 25, 35] = 100  # a speck
    colourfulness[gray == 100] = 120
    found = raster.fine_structure(gray, colourfulness)[0]
    assert found[31, 20] == 255 and found[12, 12] == 0 and found[25, 35] == 0 and not raster.fine_structure(gray, colourfulness * 0).any()


def test_masks_of_clusters_and_paper_without_ink():
    ink, hue, detail = np.zeros((20, 20), int), np.full((20, 20), -1), np.zeros((40, 40), int)
    ink[2:6, 2:18], hue[2:6, 2:18], detail[4:12, 4:36] = 255, 3, 255
    ink[14:18, 2:18], hue[14:18, 2:18], detail[28:36, 4:36] = 255, 20, 255
    masks = raster.cluster_masks(ink, detail, hue, [[2, 3, 4], [20]])
    assert (masks[2] == 255).all() and ((masks[0] == 0) == (detail[:] > 0) & (np.arange(40)[:, None] < 20)).all() and ((masks[1] == 0).sum() == 8 * 32)
    rgb = np.full((40, 40, 3), 230)
    rgb[detail > 0] = (200, 20, 20)
    clean = raster.paper(rgb, masks, 20)
    assert clean.shape == (20, 20, 3) and (clean[0, 0] == clean[10, 10]).all()
    assert (clean[4, 10] == 255).all()  # all ink: white
    assert (raster.paper(rgb, np.full((1, 40, 40), 255), 20)[4, 10] != 255).any()


def test_streams_become_operators(spark):
    text = "q 1 0 0 1 5 -7.5 cm % (not\n/F1 12 Tf (a\\)b(c(d)) e) Tj [(x) -3 <00 41>] TJ << /A 1 >> /P BDC BI /W 2 ID \x00(\xff EI true 3 gs T* (" + "long " * 20000 + ") '"
    df = spark.createDataFrame([(1, text), (2, "(open q"), (3, None), (4, ""), (5, "q Q")], "page int, stream string")
    rows = streams.stream_operators(df, "page", "stream").orderBy("page", "pos").collect()
    one = [(r["op"], r["args"]) for r in rows if r["page"] == 1]
    assert [op for op, _ in one] == ["q", "cm", "Tf", "Tj", "TJ", "BDC", "BI", "gs", "T*", "'"]
    assert one[1][1] == ["1", "0", "0", "1", "5", "-7.5"] and one[3][1] == ["(a\\)b(c(d)) e)"] and one[4][1] == ["[(x) -3 <00 41>]"] and one[7][1] == ["true", "3"]
    assert {r["page"] for r in rows} == {1, 5} and [r["pos"] for r in rows if r["page"] == 1] == list(range(10))
    good = {r["page"]: r["g"] for r in df.select("page", streams.well_formed(F.col("stream")).alias("g")).collect()}
    assert good == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_text_is_carried_and_matrices_are_found(spark):
    """A landscape picture on a portrait page keeps its own matrix, and its text layer stays."""
    df = spark.createDataFrame([(1, "q 0 -594 420 0 0 594 cm /Im0 Do Q q BT 3 Tr (hidden) Tj ET Q"), (2, "q 1 0 0 bad 2 3 cm /Im0 Do Q")], "page int, stream string")
    ops = streams.stream_operators(df, "page", "stream")
    text = content.carried_text(ops, "page", "pos", "op", streams.written(F.col("op"), F.col("args"))).collect()
    assert [(r["page"], r["text"]) for r in text] == [(1, "BT\n3 Tr\n(hidden) Tj\nET")]
    again = streams.stream_operators(spark.createDataFrame(text), "page", "text").orderBy("pos").collect()
    assert [r["op"] for r in again] == ["BT", "Tr", "Tj", "ET"]
    found = {r["page"]: r["ctm"] for r in content.placement(streams.matrices(ops), "page", "pos", "op", "m").collect()}
    assert found == {1: [0.0, -594.0, 420.0, 0.0, 0.0, 594.0], 2: [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]}
    # Six operands of which one is no number: no matrix for that page, unless its image comes first.
    odd = spark.createDataFrame([(3, "q 1 0 0 /bad 2 3 cm /Im0 Do Q"), (4, "2 0 0 2 0 0 cm /Im0 Do 1 0 0 /bad 2 3 cm")], "page int, stream string")
    found = content.placement(streams.matrices(streams.stream_operators(odd, "page", "stream")), "page", "pos", "op", "m").collect()
    assert [(r["page"], r["ctm"]) for r in found] == [(4, [2.0, 0.0, 0.0, 2.0, 0.0, 0.0])]


def test_gaps_end_a_job_with_their_number_and_first(spark):
    want, have = spark.createDataFrame([("a", i) for i in range(9)], "book string, page int"), spark.createDataFrame([("a", i) for i in range(9) if i not in (4, 7)], "book string, page int")
    assert tuple(stages.missing_report(want, have, "book", "page").first()) == ("a", 9, 2, 4)
    assert stages.require_complete(want, want, "book", "page").count() == 1
    with pytest.raises(Exception, match="a: 2 of 9 without a result, first 4"):
        stages.require_complete(want, have, "book", "page").collect()
    assert stages.require_rows(want, "pages").count() == 9
    with pytest.raises(Exception, match="no pages left"):
        stages.require_rows(selection.select_pages(want, "page", span=(100, None)), "pages").collect()


def test_stage_tables_are_not_overwritten_by_accident(spark, tmp_path):
    rows, place = spark.range(5), str(tmp_path / "stage")
    assert stages.write_stage(rows, place, "one").count() == 5
    with pytest.raises(Exception, match="(?i)already exists"):
        stages.write_stage(rows, place, "one")
    assert stages.write_stage(spark.range(3), place, "one", force=True).count() == 3
    with pytest.raises(ValueError):
        stages.write_stage(rows, place, "one", inputs=(f"{place}/tag=one",), force=True)
    stages.write_stage(rows, place, "two")
    assert stages.drop_stages(spark, place, "one", committed=rows.limit(0)) == [] and os.path.isdir(f"{place}/tag=one")
    assert len(stages.drop_stages(spark, place, "one", "absent", committed=rows)) == 1
    assert not os.path.exists(f"{place}/tag=one") and os.path.isdir(f"{place}/tag=two")


def test_equal_numbers_are_ordered_by_name(spark):
    rows = [("k", 1, n) for n in "bca"] + [("k", 0, "z"), ("k", 90000, "a"), ("k", 90000, "B")]
    for parts in (1, 3, 6):
        got = ordinals(spark.createDataFrame(rows, "book string, n int, name string").repartition(parts), ["book"], "n", ties=("name",)).orderBy("ord").collect()
        assert [(r["n"], r["name"]) for r in got] == [(0, "z"), (1, "a"), (1, "b"), (1, "c"), (90000, "B"), (90000, "a")]


def test_positions_of_a_large_book(spark):
    """Pages without numbers are numbered by name over many ranges."""
    names = [("x", f"p{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}.png") for i in range(3000)] + [("y", "a1.png"), ("y", "a2.png")]
    got = selection.number_pages(spark.createDataFrame(names, "book string, name string").repartition(7), "book", "name").collect()
    assert {r["name"]: r["page_no"] for r in got if r["book"] == "x"} == {n: i for i, n in enumerate(sorted(n for b, n in names if b == "x"), 1)}
    assert {r["name"]: r["page_no"] for r in got if r["book"] == "y"} == {"a1.png": 1, "a2.png": 2}


def test_lines_of_broken_chunks(spark):
    text = "first line\n\nthird\nlast without end"
    for size in (1, 3, 7, 100):
        chunks = [(1, i, text[i : i + size]) for i in range(0, len(text), size)] + [(2, 0, None), (3, 0, "whole\n")]
        got = jobs.framed_lines(spark.createDataFrame(chunks, "job int, seq int, text string"), "job", "seq", "text").orderBy("job", "line_no").collect()
        assert [(r["job"], r["line"], r["whole"]) for r in got] == [(1, "first line", True), (1, "", True), (1, "third", True), (1, "last without end", False), (3, "whole", True)]


@pytest.mark.parametrize("limit, keep", [(400, 300), (50, 1), (100, 100), (30, 29)])
def test_logs_line_by_line(spark, limit, keep):
    rng = np.random.default_rng(limit)
    lines = {job: ["l" * int(n) + str(i) for i, n in enumerate(rng.integers(0, 90, 120))] for job in (1, 2)}
    want = {}
    for job, mine in lines.items():
        log = ""
        for line in mine:
            log += line + "\n"
            log = log[-keep:] if len(log) > limit else log
        want[job] = log
    df = spark.createDataFrame([(j, i, x) for j, mine in lines.items() for i, x in enumerate(mine)], "job int, seq int, line string")
    assert {r["job"]: r["log"] for r in jobs.log_tail(df, limit, keep).collect()} == want


def test_admission_leaves_room_for_running_jobs(spark):
    rows = [(i, 100 - i, "running" if i < 3 else "waiting") for i in range(10)]
    df = spark.createDataFrame(rows, "job int, asked int, state string")
    assert sorted(r["job"] for r in jobs.admit(df, "asked", 5).collect()) == [8, 9]
    assert jobs.admit(df, "asked", 3).count() == 0 and jobs.admit(df.where("state = 'waiting'"), "asked", 4).count() == 4


def test_range_specs_that_are_refused(spark):
    specs = ["3,7,10-12", "x", "3,abc", "1-9999999999", " 3 , ,4", "10-5", "-3", "99999999999999999999", "", None, "1,,2", "4 - 6"]
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    got = {r["s"]: (r["n"], r["e"], r["p"]) for r in df.select("s", T.parse_ranges(F.col("s")).alias("n"), T.ranges_error(F.col("s")).alias("e"), T.parse_page_spec(F.col("s")).alias("p")).collect()}
    assert got["3,7,10-12"] == ([3, 7, 10, 11, 12], None, [3, 7, 10, 11, 12]) and got["4 - 6"][0] == [4, 5, 6]
    assert got["x"][:2] == (None, "no range: x") and got["3,abc"][1] == "no range: abc" and got["1-9999999999"][:2] == (None, "too many numbers")
    assert got["99999999999999999999"][0] is None and got[" 3 , ,4"] == ([3, 4], None, None) and got["10-5"][0] == [] and got["-3"] == ([-3], None, None)
    assert got[""][0] == [] and got["1,,2"] == ([1, 2], None, None)


def test_text_layer_pieces(spark):
    lines = T.unicode_map().split("\n")
    ranges = [x for x in lines if x.count("<") == 3]
    assert len(ranges) == 256 and ranges[0] == "<0000> <00FF> <0000>" and ranges[-1] == "<FF00> <FFFF> <FF00>"
    assert [x for x in lines if x.endswith("beginbfrange")] == ["100 beginbfrange", "100 beginbfrange", "56 beginbfrange"] and lines[-2:] == ["end", ""]
    row = spark.createDataFrame([("é\U0001f600", 12.3456, 99.95, 10.0, 7.125, b"\xffbad ")], "t string, s double, z double, x double, y double, raw binary")
    got = row.select(T.text_line(F.col("t"), F.col("s"), F.col("z"), F.col("x"), F.col("y")).alias("l"), T.failure_text(F.col("raw"), 3).alias("f"), G.raster_size(F.lit(100.0), F.lit(0.1), F.lit(200)).alias("r")).first()
    assert got["l"].startswith("/Recognised 12.35 Tf ") and got["l"].endswith(" 1 0 0 1 10.00 7.13 Tm <00E9D83DDE00> Tj") and got["f"] == "�ba" and tuple(got["r"]) == (200, 1)


def test_results_replace_streams_and_pages(spark):
    images = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, None)], "obj int, raw int")
    made = spark.createDataFrame([(1, 60), (2, 100), (9, 1)], "obj int, made int")
    got = {r["obj"]: (r["kept"], r["is_new"]) for r in assembly.replaced(images, made, ["obj"], "raw", "made").collect()}
    assert got == {1: (60, True), 2: (100, False), 3: (100, False), 4: (None, False)}
    assert sorted((r["obj"], r["raw"]) for r in assembly.remade(images, made.withColumnRenamed("made", "raw"), "obj", "raw").collect())[:3] == [(1, 60), (2, 100), (3, 100)]


def png(pixels, kinds, colour=2, palette=None):
    """A PNG whose lines are filtered by the given kinds."""
    h, w, n = pixels.shape
    flat, out = np.zeros((h + 1, w + 1, n), int), b""
    flat[1:, 1:] = pixels
    for y in range(h):
        a, b, c = flat[y + 1, :-1], flat[y, 1:], flat[y, :-1]
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = [0, a, b, (a + b) // 2, near][kinds[y]]
        out += bytes([kinds[y]]) + ((pixels[y] - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_pixels_of_png_files(spark):
    rng = np.random.default_rng(4)
    rgb, grey, indices = rng.integers(0, 256, (7, 5, 3)), rng.integers(0, 256, (5, 6, 1)), rng.integers(0, 2, (2, 3, 1))
    rows = [("a", bytearray(png(rgb, [0, 1, 2, 3, 4, 4, 3]))), ("b", bytearray(png(grey, [4, 3, 2, 1, 0], 0))), ("c", bytearray(png(indices, [0, 1], 3, bytes([9, 8, 7, 1, 2, 3])))), ("d", bytearray(b"GIF89a")), ("e", None)]
    got = {r["path"]: r for r in files.image_pixels(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert [got["a"][c] for c in "rgb"] == [rgb[..., k].ravel().tolist() for k in range(3)] and (got["a"]["width"], got["a"]["height"]) == (5, 7)
    assert got["b"]["r"] == got["b"]["b"] == grey.ravel().tolist() and got["c"]["g"] == [(8, 2)[i] for i in indices.ravel()]
    assert got["d"]["r"] is None and got["e"]["width"] is None


def test_tiff_heads():
    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        entry = lambda tag, kind, value: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        raw = mark + struct.pack(order + "I", 8) + struct.pack(order + "H", 3) + entry(254, 4, 0) + entry(256, 3, 1000) + entry(257, 4, 70000)
        assert files.size_in_head(raw) == (1000, 70000) and files.size_in_head(raw[:20]) == (None, None) and files.size_in_head(mark) == (None, None)


def test_pdf_pages_in_document_order(spark):
    body = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type/Pages /Kids [9 0 R 3 0 R 5 0 R] /Count 4>> endobj\n"
    body += b"3 0 obj <</Type /Pages /Parent 2 0 R /Kids [8 0 R 7 0 R]>> endobj 5 0 obj <</Type /Page /Parent 2 0 R>> endobj 7 0 obj <</Type /Page /Parent 3 0 R /MediaBox [0 0 10 20]>> endobj 8 0 obj <</Type /Page /Parent 3 0 R>> endobj 9 0 obj <</Type /Page /Parent 2 0 R>> endobj"
    df = spark.createDataFrame([("a", bytearray(body)), ("b", bytearray(b"no"))], "path string, content binary")
    got = [(r["path"], r["page_no"], r["num"], r["box"]) for r in pdf.page_rows(df).orderBy("page_no").collect()]
    assert got == [("a", 1, 9, None), ("a", 2, 8, None), ("a", 3, 7, "0 0 10 20"), ("a", 4, 5, None)]


def test_inputs_that_are_refused_and_picked(spark, tmp_path):
    for name in ("b.pdf", "x.txt", "img007.png"):
        (tmp_path / name).write_bytes(b"%PDF")
    for wrong in (f"{tmp_path}/x.txt", f"{tmp_path}/img007.PNG"):
        with pytest.raises(ValueError, match="not a PDF"):
            files.list_documents(spark, [f"{tmp_path}/b.pdf", wrong])
    with pytest.raises(Exception, match="(?i)not.*exist"):
        files.list_documents(spark, [f"{tmp_path}/absent"]).collect()
    folder, names = files.adopt(spark, [f"{tmp_path}/img007.png", f"{tmp_path}/x.txt"])
    assert folder == str(tmp_path) and [tuple(r) for r in names.collect()] == [("img007.png", 7)]
    assert files.adopt(spark, [f"{tmp_path}/"])[0] == str(tmp_path) and files.adopt(spark, [str(tmp_path)])[1].count() == 0


def test_saved_settings():
    got = Options.saved({"mode": "gray", "quality": 60, "enhance": "yes", "gone": 1, "width": None, "supersample": 2})
    assert (got.mode, got.quality, got.enhance, got.width, got.supersample) == ("gray", 60, False, None, 2)
    assert migrated("en", ("en", "en,de"), "en,de,ko") == "en,de,ko" and migrated("fr", ("en",), "en,ko") == "fr" and migrated(None, (), "x") == "x"


def test_colour_state_is_read_back(spark):
    found = spark.createDataFrame([(3, 1, 4.5, 5.0, 6.0), (3, 0, 1.0, 2.0, 3.0), (9, 0, 0.0, 0.0, 0.0)], "page bigint, slot int, r double, g double, b double")
    lines = colour.colours_as_json(found, "page").unionByName(spark.createDataFrame([("{bad",), ('{"x": [[1, 2, 3]]}',)], "value string"))
    assert sorted(map(tuple, colour.colours_from_json(lines, "page").collect())) == sorted(map(tuple, found.collect()))


def test_probe_rows_are_appended(spark, tmp_path):
    rows = [(1, i, f'@@J{{"path": "/a b/{i}.pdf", "size": {i}, "ratio": 0.5}}') for i in range(6)] + [(1, 90, "@@P x 1 2"), (1, 91, "@@J{bad")]
    spark.createDataFrame(rows, "job long, seq long, line string").repartition(4).write.json(str(tmp_path / "lines"))
    got = progress.follow_probes(progress.read_lines(spark, str(tmp_path / "lines"), 1), str(tmp_path / "out"), str(tmp_path / "log"))
    assert sorted((r["seq"], r["path"], r["size"]) for r in got.collect()) == [(i, f"/a b/{i}.pdf", i) for i in range(6)]


def test_text_layers_are_not_drawn(spark):
    df = spark.createDataFrame([(1, ["(one) Tj", None, "(two) Tj"]), (2, []), (3, None)], "page int, lines array<string>")
    got = {r["page"]: r["t"] for r in df.select("page", T.text_layer(F.col("lines")).alias("t")).collect()}
    assert got == {1: "q\nBT\n3 Tr\n(one) Tj\n(two) Tj\nET\nQ", 2: "q\nBT\n3 Tr\nET\nQ", 3: "q\nBT\n3 Tr\nET\nQ"}
    ops = streams.stream_operators(df.select("page", T.text_layer(F.col("lines")).alias("t")).where("page = 1"), "page", "t").orderBy("pos").collect()
    assert [r["op"] for r in ops] == ["q", "BT", "Tr", "Tj", "Tj", "ET", "Q"]
