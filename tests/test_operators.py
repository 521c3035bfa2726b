from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions.options import Options, check_paths, job_threads, usable_languages
from folioflow.operators import colour, content, jobs, raster
from folioflow.operators.scans import ordinals, running
from folioflow.plans import assembly
from folioflow.plans.closure import closure
from folioflow.sources import files, pdf, views
from folioflow.streaming import progress


def test_running_over_slices(spark):
    rows = [(g, i * 7 % 1000, i) for g in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = running(df, ["g"], "o", 50, s=("sum", F.col("v")), m=("max", F.col("v")), p=("max_before", F.col("v")), q=("sum_before", F.col("v"))).collect()
    for g in "ab":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])
        total, most = 0, None
        for r in mine:
            assert (r["q"], r["p"]) == (total, most)
            total, most = total + r["v"], r["v"] if most is None else max(most, r["v"])
            assert (r["s"], r["m"]) == (total, most)
    assert sorted(r["ord"] for r in ordinals(df.where("g = 'a'"), ["g"], "o", width=10).collect()) == list(range(1, 301))


def brute_ink(hist):
    left, total, out = dict(enumerate(hist)), sum(hist), []
    while total and len(out) < 3 and left and max(left.values()) > 0:
        n, peak = max((n, i) for i, n in left.items())
        bins = [b % 36 for b in range(peak - 4, peak + 5) if b % 36 in left]
        mass = sum(left.pop(b) for b in bins)
        if mass >= total * 0.08:
            out.append((peak, mass))
    return out


def test_ink_colours(spark):
    rng = np.random.default_rng(3)
    cases = [rng.integers(0, 40, 36) * (rng.random(36) < 0.3) for _ in range(40)] + [np.eye(36, dtype=int)[0] * 5 + np.eye(36, dtype=int)[35] * 5, np.full(36, 1), np.array([100] + [0] * 9 + [3] + [0] * 9 + [40] + [0] * 15)]
    rows = [(p, i, int(n), int(n), int(n) * i, int(n), 0) for p, h in enumerate(cases) for i, n in enumerate(h) if n]
    df = spark.createDataFrame(rows, "page int, bin int, n bigint, core_n bigint, sum_r bigint, sum_g bigint, sum_b bigint")
    got = {}
    for r in colour.ink_colours(df, "page").orderBy("page", "slot").collect():
        got.setdefault(r["page"], []).append((r["peak"], r["n"]))
    assert got == {p: [(k, int(n)) for k, n in want] for p, h in enumerate(cases) if (want := brute_ink(h.tolist()))}


def test_text_islands(spark):
    ops = ["Tj", "BT", "Tj", "BT", "ET", "Tj", "ET", "BT", "q"]
    df = spark.createDataFrame([(1, i, op) for i, op in enumerate(ops)], "page int, pos int, op string")
    got = [r["inside"] for r in content.text_islands(df, "page", "pos", "op").orderBy("pos").collect()]
    assert got == [False, True, True, True, True, False, False, True, True]


def test_placement_stack(spark):
    unit, move, grow = [1.0, 0, 0, 1, 0, 0], [1.0, 0, 0, 1, 5, 7], [2.0, 0, 0, 2, 0, 0]
    ops = [("Q", None), ("q", None), ("cm", move), ("Q", None), ("cm", grow), ("cm", move), ("Do", None), ("cm", grow), ("Do", None)]
    rows = [(1, i, op, [float(x) for x in m] if m else None) for i, (op, m) in enumerate(ops)] + [(2, 0, "cm", [float(x) for x in unit])]
    got = content.placement(spark.createDataFrame(rows, "page int, pos int, op string, m array<double>"), "page", "pos", "op", "m").collect()
    assert [(r["page"], r["ctm"]) for r in got] == [(1, [2.0, 0, 0, 2, 10, 14])]


def test_sidecar_tells_nothing_from_empty(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, None)], "doc int, page int, text string")
    assert content.sidecar(df, "doc", "page", "text").first()["sidecar"] == "a\f\n\f\nc\n"


def test_morphology_invariants():
    a = np.random.default_rng(1).integers(0, 256, (20, 8, 8))
    opened, closed = raster.dilate(raster.erode(a)), raster.erode(raster.dilate(a))
    assert (opened <= a).all() and (closed >= a).all()
    assert (raster.dilate(raster.erode(opened)) == opened).all()
    assert (raster.erode(a, 2, False) <= raster.erode(a, 1)).all()


def test_pointwise_kernels(spark):
    g = F.array(*(F.lit(x) for x in (0, 100, 255, 30)))
    row = spark.range(1).select(raster.negate(raster.negate(g)).alias("n"), raster.threshold(g, 0.3).alias("t"), raster.posterize(g, 2).alias("p"), raster.minus(g, g).alias("m"), raster.level(g, 0.0, 1.0).alias("l"), g.alias("g")).first()
    assert row["n"] == row["g"] == row["l"]
    assert row["t"] == [0, 255, 255, 0] and row["p"] == [0, 0, 255, 0] and row["m"] == [0] * 4


def test_interleave_covers_every_page_once(spark, sf_dir):
    rows = assembly.interleave(views.document_pages(spark, sf_dir), "book", "page_no").collect()
    for book in {r["book"] for r in rows}:
        mine = sorted((r for r in rows if r["book"] == book), key=lambda r: r["ord"])
        assert [r["ord"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["idx"] for r in mine if r["doc"] == "content"] == list(range(len(mine) - 2))
        assert [r["doc"] for r in mine].count("cover") == 2


def test_stage_key_sees_every_parameter(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), (None, "a")], "x string, y string")
    keys = {r["k"] for r in rows.select(assembly.stage_key(F.col("x"), F.col("y")).alias("k")).collect()}
    assert len(keys) == 4


def test_to_do_resumes_absent_and_empty_results(spark):
    expected = spark.createDataFrame([(i,) for i in range(5)], "key int")
    stage = spark.createDataFrame([(0, 10), (1, 0), (3, 5)], "key int, length int")
    assert sorted(r["key"] for r in assembly.to_do(expected, stage, "key").collect()) == [1, 2, 4]


def test_log_tail(spark):
    lines = [f"line {i} " + "x" * (i % 30) for i in range(200)]
    log = ""
    for line in lines:
        log += line + "\n"
        if len(log) > 400:
            log = log[-300:]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "job int, seq int, line string")
    assert jobs.log_tail(df, 400, 300).first()["log"] == log


def test_decode_keeps_spaces_in_paths(spark):
    df = spark.createDataFrame([(1, 1, "@@DONE 10 2 /a b  c.pdf"), (1, 2, "@@P x 1"), (1, 3, "@@Q")], "job int, seq int, line string")
    rows = {r["seq"]: r for r in jobs.decode(df).collect()}
    assert rows[1]["path"] == "/a b  c.pdf" and rows[1]["progress"] == 1.0
    assert rows[2]["kind"] == "P" and rows[2]["progress"] is None and rows[3]["kind"] == "LOG"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    lines = views.progress_lines(spark, sf_dir)
    lines.repartition(5).write.json(str(tmp_path / "lines"))
    (tmp_path / "lines" / "broken.json").write_text('{"job": 1, "seq": 5\n')
    got = progress.run_latest(progress.read_lines(spark, str(tmp_path / "lines"), 2), str(tmp_path / "states"), str(tmp_path / "log"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.latest(jobs.decode(lines)).collect()))


def test_listing_and_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 30, 40) + b"\x08\x00\x00\x00\x00"
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 20, 10) + b"\x01"
    for name, raw in (("p2.png", png), ("p1.jpg", jpg), (".p3.png", png), ("note.txt", b"x")):
        (tmp_path / name).write_bytes(raw)
    listed = files.list_images(spark, str(tmp_path)).collect()
    assert {r["name"]: (r["numbered"], r["page_no"]) for r in listed} == {"p2.png": (True, 2), "p1.jpg": (True, 1)}
    sizes = files.image_sizes(spark.read.format("binaryFile").load(f"{tmp_path}/p*")).collect()
    assert {r["path"][-6:]: (r["width"], r["height"]) for r in sizes} == {"p2.png": (30, 40), "p1.jpg": (10, 20)}


def test_list_documents_takes_each_path_once(spark, tmp_path):
    for name in ("b.pdf", "a.PDF", ".c.pdf", "d.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    got = files.list_documents(spark, [str(tmp_path / "b.pdf"), str(tmp_path)]).collect()
    assert [(r["arg"], r["name"]) for r in got] == [(0, "b.pdf"), (1, "a.PDF")]


def test_json_lines_round_trip(spark):
    rows = spark.createDataFrame([('{"k": 1}',), ("{bad",), ('{"k": "x"}',)], "line string").select(F.from_json("line", "k long").alias("p")).where("p.k is not null").select(F.to_json("p").alias("x")).collect()
    assert [json.loads(r["x"]) for r in rows] == [{"k": 1}]


def test_pdf_objects(spark, tmp_path):
    body = b"%PDF-1.4\n1 0 obj << /Type /Pages /Count 2 >> endobj\n2 0 obj << /Type /Page /Resources << /Font << >> >> >> endobj\n3 0 obj << /Type /Page >> endobj\n"
    body += b"4 0 obj << /Subtype /Image /Width 30 /Height 40 /BitsPerComponent 1 /Filter /CCITTFaxDecode /Length 5 >> stream\nabcde\nendstream endobj\n"
    body += b"5 1 obj << /Type /XObject /Subtype /Image /Width 3 /Height 4 /ImageMask true /BitsPerComponent 1 /Filter [/FlateDecode] /Length 9 0 R >> stream\nx\nendstream endobj\n6 0 obj << /Subtype /Image /Width 7 /Height 8 >> endobj"
    (tmp_path / "a.pdf").write_bytes(body)
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    found = spark.read.format("binaryFile").load(str(tmp_path))
    got = sorted(tuple(r)[1:] for r in pdf.image_objects(found).collect())
    assert got == [(4, 0, 30, 40, 1, False, "CCITTFaxDecode", 5, True), (5, 1, 3, 4, 1, True, "FlateDecode", 0, False), (6, 0, 7, 8, 8, False, "", 0, False)]
    assert {r["path"][-5:]: tuple(r)[1:] for r in pdf.page_counts(found).collect()} == {"a.pdf": (2, True, None), "b.pdf": (None, None, "not a PDF")}


def test_unsharp_keeps_flat_pages():
    flat = np.full((1, 6, 6), 77)
    assert (raster.unsharp(flat, 1.2, 0.01) == 77).all()
    edge = np.where(np.arange(6) < 3, 50, 200)[None, None, :].repeat(6, axis=1)
    sharp = raster.unsharp(edge, 1.0, 0.01)
    assert sharp[0, 2, 2] < 50 and sharp[0, 2, 3] > 200 and sharp[0, 2, 0] == 50


def test_options():
    assert Options().settled().width == 1800 and Options(mode="smooth").settled().width == 1400
    assert Options(enhance=True).settled().threshold == "58%" and Options(threshold="60").settled().threshold == "60%"
    assert Options(mode="gray", enhance=True, quality=60).arguments() == ["--mode", "gray", "--quality", "60", "--enhance"]
    for wrong in (Options(mode="x"), Options(width=100)):
        with pytest.raises(ValueError):
            wrong.settled()
    with pytest.raises(ValueError):
        check_paths(["a", "b"], "a")
    assert job_threads(10, 4) == 2 and usable_languages(["xx", "ko"], ["ko", "en"], "en") == ["ko"] and usable_languages(["xx"], ["ko"], "en") == ["en"]


def test_closure_of_all_parts(spark, sf_dir):
    parts = views.read(spark, sf_dir, "part")
    steps = parts.select(F.col("p_partkey").alias("part"), F.expr("p_partkey div 2").alias("needs")).where("needs > 0")
    want = {(r["p_partkey"], r["p_partkey"] >> k) for r in parts.collect() for k in range(1, 64) if r["p_partkey"] >> k}
    got = [tuple(r) for r in closure(steps, "part", "needs").collect()]
    assert len(got) == len(want) and set(got) == want


def test_closure_of_long_chains_and_cycles(spark):
    chain = [(k, k - 1) for k in range(1, 71)] + [(100, 101), (101, 102), (102, 100), (70, None), (70, 69)]
    got = [tuple(r) for r in closure(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()]
    want = {(i, j) for i in range(1, 71) for j in range(i)} | {(i, j) for i in (100, 101, 102) for j in (100, 101, 102)}
    assert len(got) == len(want) and set(got) == want
    assert closure(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
