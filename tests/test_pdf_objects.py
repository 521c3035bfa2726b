"""PDF files of several makes, generated here, read as rows of objects, pages, images and content."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from folioflow.sources import pdf, pdf_objects, streams

SCHEMA = "path string, content binary"
BODY = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 3 /MediaBox [0 0 595 842] /Resources << /XObject << /Im0 9 0 R >> >> >>",
    3: b"<< /Type /Pages /Parent 2 0 R /Kids [4 0 R 5 0 R] /Count 2 /Rotate 90 >>",
    4: b"<< /Type /Page /Parent 3 0 R /Contents 7 0 R >>",
    5: b"<< /Type /Page /Parent 3 0 R /MediaBox [0 0 10 20] /Contents [7 0 R 8 0 R] /Resources 11 0 R >>",
    6: b"<< /Type /Page /Parent 2 0 R /Note (endobj \\) stream (x)) /Contents 13 0 R >>",
    10: b"1234",
    11: b"<< /XObject 12 0 R /Font << /F1 99 0 R >> >>",
    12: b"<< /Im1 9 0 R /Im2 14 0 R /Form 15 0 R >>",
    13: b"[8 0 R 7 0 R]",
}
STREAMS = {
    7: (b"/Filter /FlateDecode", b"q 1 0 0 1 5 5 cm /Im0 Do Q"),
    8: (b"", b"BT (endstream?) Tj ET"),
    9: (b"/Subtype /Image /Width 10 0 R /Height 20 /BitsPerComponent 1 /Filter [/CCITTFaxDecode]", b"\x00\x01endobj 77 0 obj\xff"),
    14: (b"/Subtype /Image /Width 5 /Height 6 /ImageMask true /BitsPerComponent 1", b"\x00" * 6),
    15: (b"/Subtype /Form", b"q Q"),
}


def written(num, body, extra=b""):
    return b"%d 0 obj\n%s%s\nendobj\n" % (num, body, extra)


def stream(num, keys, data):
    data = zlib.compress(data) if b"FlateDecode" in keys and b"DecodeParms" not in keys else data
    return written(num, b"<< %s /Length %d >>" % (keys, len(data)), b"\nstream\r\n" + data + b"\nendstream")


def plain(broken=False):
    """A cross-reference table and a trailer; broken: it leads nowhere."""
    out, places = b"%PDF-1.4\n%\xff\xff\n", {}
    for num in sorted(BODY | STREAMS):
        places[num] = len(out)
        out += written(num, BODY[num]) if num in BODY else stream(num, *STREAMS[num])
    table = b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in places.items())
    return out + table + b"trailer\n<< /Size 16 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (7 if broken else len(out))


def predicted(rows, kind, width):
    """Rows of bytes stored by PNG predictors: their kind before each."""
    out, above = b"", bytes(width)
    for i, row in enumerate(rows):
        k = kind if kind < 5 else i % 5
        line = bytearray()
        for j, b in enumerate(row):
            a, u, c = (row[j - 1], above[j], above[j - 1]) if j else (0, above[0], 0)
            far = (abs(u - c), abs(a - c), abs(a + u - 2 * c))
            line.append((b - (0, a, u, (a + u) // 2, (a, u, c)[far.index(min(far))])[k]) & 255)
        out, above = out + bytes([k]) + bytes(line), row
    return out


def packed(kind=2, more=b""):
    """Dictionaries in an object stream, references in a stream with predictors."""
    out, rows = b"%PDF-1.5\n", {}
    for num in sorted(STREAMS):
        rows[num] = (1, len(out), 0)
        out += stream(num, *STREAMS[num])
    heads, bodies = b"", b""
    for k, num in enumerate(sorted(BODY)):
        heads += b"%d %d " % (num, len(bodies))
        bodies += BODY[num] + b" "
        rows[num] = (2, 20, k)
    rows[20] = (1, len(out), 0)
    out += stream(20, b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(BODY), len(heads)), heads + bodies)
    rows[21], rows[0] = (1, len(out), 0), (0, 0, 255)
    lines = [bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in (rows.get(n, (0, 0, 0)) for n in range(22))]
    keys = b"/Type /XRef /Size 22 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor %d /Columns 5 >>" % (10 + kind)
    at = len(out)
    return out + stream(21, keys, zlib.compress(predicted(lines, kind, 5))) + b"startxref\n%d\n%%%%EOF\n" % at


def updated(base):
    """An increment that turns page 4, frees nothing and names the older references as its predecessor."""
    before = int(re.findall(rb"startxref\s+(\d+)", base)[-1])
    out = base
    at = len(out)
    out += written(4, BODY[4].replace(b"/Parent", b"/Rotate 180 /Parent"))
    table = len(out)
    return out + b"xref\n4 1\n%010d 00000 n \ntrailer\n<< /Size 22 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, before, table)


PAGES = [(1, 4, "0 0 595 842", 90), (2, 5, "0 0 10 20", 90), (3, 6, "0 0 595 842", 0)]


@pytest.mark.parametrize("make", ["plain", "broken", "packed", "packed, mixed predictors", "updated", "packed and updated"])
def test_pages_images_and_content(spark, make):
    raw = {"plain": plain(), "broken": plain(True), "packed": packed(), "packed, mixed predictors": packed(5), "updated": updated(plain()), "packed and updated": updated(packed(4))}[make]
    df = spark.createDataFrame([("a", bytearray(raw)), ("no", bytearray(b"GIF89a")), ("none", None), ("bare", bytearray(b"%PDF-1.4\n"))], SCHEMA)
    pages = [(r["page_no"], r["num"], r["box"], r["turn"]) for r in pdf.page_rows(df).orderBy("page_no").collect()]
    assert pages == [(n, num, box, 180 if num == 4 and "updated" in make else turn) for n, num, box, turn in PAGES]
    images = sorted((r["page_no"], r["name"], r["num"]) for r in pdf.page_images(df).collect())
    assert images == [(1, "Im0", 9), (2, "Im1", 9), (2, "Im2", 14), (3, "Im0", 9)]
    found = {r["num"]: (r["width"], r["height"], r["bpc"], r["is_mask"], r["filter"], r["length"], r["bilevel"]) for r in pdf.image_objects(df).collect()}
    assert found == {9: (1234, 20, 1, False, "CCITTFaxDecode", len(STREAMS[9][1]), True), 14: (5, 6, 1, True, "", 6, False)}
    content = {r["page_no"]: r["content"] for r in pdf.page_contents(df).collect()}
    one, two = (STREAMS[k][1].decode() for k in (7, 8))
    assert content == {1: one, 2: f"{one}\n{two}", 3: f"{two}\n{one}"}
    ops = streams.stream_operators(pdf.page_contents(df).where("page_no = 2"), "page_no", "content").orderBy("pos").collect()
    assert [r["op"] for r in ops] == ["q", "cm", "Do", "Q", "BT", "Tj", "ET"]
    counts = {r["path"]: (r["pages"], r["has_font"], r["error"]) for r in pdf.page_counts(df).collect()}
    assert counts == {"a": (3, True, None), "no": (None, None, "not a PDF"), "none": (None, None, "not a PDF"), "bare": (0, False, None)}


def test_trees_of_any_depth_and_circles(spark):
    """300 levels need 9 rounds; a circle, a node out of reach and a page listed twice."""
    body = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 900: b"<< /Type /Page >>", 901: b"<< /Type /Pages /Parent 902 0 R /Kids [902 0 R 900 0 R] >>", 902: b"<< /Type /Pages /Parent 901 0 R /Kids [901 0 R] >>"}
    for n in range(2, 302):
        up = b"/Parent %d 0 R" % (n - 1) if n > 2 else b"/MediaBox [0 0 7 7]"
        body[n] = b"<< /Type /Pages %s /Kids [%d 0 R %d 0 R] >>" % (up, n + 1, n + 400)
        body[n + 400] = b"<< /Type /Page /Parent %d 0 R >>" % n
    body[302] = b"<< /Type /Page /Parent 301 0 R >>"
    body[2] = body[2].replace(b"[3 0 R", b"[402 0 R 3 0 R")
    raw = b"%PDF-1.4\n" + b"".join(written(n, b) for n, b in body.items()) + b"trailer << /Root 1 0 R >>"
    rows = pdf.page_rows(spark.createDataFrame([("a", bytearray(raw))], SCHEMA)).orderBy("page_no").collect()
    assert [r["num"] for r in rows] == [402, 302, *range(701, 401, -1)] and {r["box"] for r in rows} == {"0 0 7 7"}


def test_objects_as_they_are(spark):
    raw = packed().replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R")
    got = pdf_objects.pdf_objects(spark.createDataFrame([("locked", bytearray(raw)), ("a", bytearray(plain()))], SCHEMA)).collect()
    assert [r["error"] for r in got if r["path"] == "locked"] == ["encrypted"]
    one = {r["num"]: r for r in got if r["path"] == "a"}
    assert one[0]["entries"]["Root"] == "1 0 R" and one[10]["value"] == "1234" and one[9]["stream"] is None and bytes(one[8]["stream"]) == STREAMS[8][1]
    assert one[6]["entries"]["Note"] == "(endobj \\) stream (x))" and one[2]["entries"]["Resources/XObject/Im0"] == "9 0 R"


def test_predictors_of_samples():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (6, 12), dtype=np.uint8)
    entries = {"Filter": "/FlateDecode", "DecodeParms/Predictor": "2", "DecodeParms/Columns": "4", "DecodeParms/Colors": "3"}
    apart = rows.reshape(6, 4, 3).astype(int)
    apart[:, 1:] -= rows.reshape(6, 4, 3)[:, :-1]
    assert pdf_objects.unfiltered(zlib.compress((apart & 255).astype(np.uint8).tobytes()), entries) == rows.tobytes()
    assert pdf_objects.unfiltered(b"no zlib", entries) is None and pdf_objects.unfiltered(b"x", {"Filter": "/DCTDecode"}) is None and pdf_objects.unfiltered(b"x", {}) == b"x"


@pytest.mark.parametrize("cut", [40, 200, 400, -60, -20, -5])
def test_files_cut_short_give_what_is_left(spark, cut):
    for raw in (plain()[:cut], packed()[:cut]):
        assert pdf_objects.pdf_objects(spark.createDataFrame([("a", bytearray(raw))], SCHEMA)).count() >= 1


def test_folders_are_asked_of_the_file_system(spark, tmp_path):
    """A folder whose name looks like a file of another kind is a folder; a folder named as a PDF too."""
    from folioflow.sources import files

    for name in ("scan.2024", "notes.txt", "box.pdf"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "real.txt").write_bytes(b"x")
    got = files.list_documents(spark, [f"{tmp_path}/{n}" for n in ("notes.txt", "scan.2024", "box.pdf")]).collect()
    assert [(r["arg"], r["name"], r["path"].split("/")[-2]) for r in got] == [(0, "a.pdf", "notes.txt"), (1, "a.pdf", "scan.2024"), (2, "a.pdf", "box.pdf")]
    with pytest.raises(ValueError, match="not a PDF"):
        files.list_documents(spark, [f"{tmp_path}/real.txt"])
