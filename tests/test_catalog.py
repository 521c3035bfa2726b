"""Every query against its SQL in another engine, and the contract's three functions."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.catalog import QUERIES
from folioflow.catalog_sql import ORACLES
from folioflow.functions.text import sniff_format
from folioflow.operators import raster
from folioflow.sources import views

ROOT = Path(__file__).resolve().parent.parent
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is None, str(x)) for x in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, tables, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = tables.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types)}
    places = [want.columns.index(c) for c in columns]
    got = ordered([tuple(normal(r[c]) for c in columns) for r in df.collect()])
    assert got and got == ordered([tuple(normal(r[i]) for i in places) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_folder_size_is_what_the_folder_holds(spark, sf_dir):
    found = [p.stat().st_size for p in Path(sf_dir).rglob("*") if p.is_file()]
    row = QUERIES["dir_size"](spark, sf_dir).first()
    assert (row["files"], row["bytes"]) == (len(found), sum(found))


def test_every_known_format_is_sniffed(spark):
    """First bytes of the formats, and of one that is none."""
    heads = {"jpeg": b"\xff\xd8\xff\xe0", "png": b"\x89PNG\r\n", "tiff": b"II*\x00", "pdf": b"%PDF-1.7", "3c68746d": b"<html>"}
    rows = [(k, bytearray(v)) for k, v in heads.items()] + [("tiff", bytearray(b"MM\x00*"))]
    got = spark.createDataFrame(rows, "want string, content binary").select("want", sniff_format(F.col("content")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got) and len(got) == 6


def test_smooth_pages_equal_the_kernel(spark, sf_dir):
    """The query's rows against the steps one after another, written out for single pixels where they are plain."""
    rows = {r["vec_id"]: np.array(r["gray"]).reshape(1, 8, 8) for r in views.vector_rasters(spark, sf_dir).limit(40).collect()}
    got = {r["vec_id"]: r["mask"] for r in QUERIES["smooth_page"](spark, sf_dir).where(F.col("vec_id").isin(list(rows))).collect()}
    for i, a in rows.items():
        big = raster.resized(raster.unsharp(raster.stretched(a, 0.15, 0.88), 1.2, 0.01), 32, 32)
        mask = np.where(big > 0.55 * 255, 255, 0)
        for kind in (np.min, np.max, np.max, np.min):
            fill = 255 if kind is np.min else 0
            padded = np.pad(mask[0], 2, constant_values=fill)
            mask = np.array([[kind([padded[2 + y + dy, 2 + x + dx] for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) <= 2]) for x in range(32)] for y in range(32)])[None]
        small = np.floor(mask.reshape(8, 4, 8, 4).mean(axis=(1, 3)) + 0.5)
        want = np.floor(np.floor(small / 127.5 + 0.5) * 127.5 + 0.5).astype(int)
        assert got[i] == ",".join(map(str, want.ravel()))


def test_harness_catches_a_wrong_query(tables):
    assert tables.sql(ORACLES["missing_pages"]).fetchall() != tables.sql("SELECT doc_id, source FROM documents").fetchall()


def test_entry_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for path in (ROOT / "folioflow").rglob("*.py"):
        to = tmp_path / path.relative_to(ROOT)
        if "llm" not in to.parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op1_') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), "True", "False"], out.stderr
