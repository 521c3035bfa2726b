"""Folders of page images and PDF lists, and image headers."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import IMAGE_EXTENSIONS, base_name, is_page_image, sniff_format, stem, trailing_number
from folioflow.operators.selection import number_pages
from folioflow.sources.pixels import read_bands


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Page images directly in a folder: book, path, name, length, numbered, page_no. Contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{folder}/*")
    named = files.select("path", "length", base_name(F.col("path")).alias("name")).where(is_page_image(F.col("name")))
    return number_pages(named.withColumn("book", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "book", "name")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(place) and system.getFileStatus(place).isDirectory())


def list_documents(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """PDFs of the inputs in order, folders one level deep by name, each path once: arg, path, name, length.

    All inputs are one read. The file system is asked what is a folder, whatever its name; another input that is not named as
    a PDF is refused, as is one that is not there.
    """
    named = {one: one.lower().endswith(".pdf") and not is_folder(spark, one) for one in inputs}
    for one, is_pdf in named.items():
        if not is_pdf and re.search(r"\.[a-z0-9]{1,5}$", one, re.I) and not is_folder(spark, one):
            raise ValueError(f"not a PDF: {one}")
    files = spark.read.format("binaryFile").load([x if is_pdf else f"{x.rstrip('/')}/*" for x, is_pdf in named.items()]).select("path", "length")
    plain = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", "")
    folder = F.regexp_replace(plain, r"/[^/]*$", "")
    turns = [F.when((plain == bare) | (folder == bare), i) for i, x in enumerate(inputs) if (bare := re.sub(r"^[a-z]+:(//[^/]*)?(?=/)", "", x.rstrip("/"))) is not None]
    pdfs = files.withColumn("name", base_name(F.col("path"))).where(F.lower("name").endswith(".pdf") & ~F.col("name").startswith("."))
    return pdfs.withColumn("arg", F.coalesce(*turns)).groupBy("path", "name", "length").agg(F.min("arg").alias("arg")).orderBy("arg", "name")


def adopt(spark: SparkSession, picks: list[str]) -> tuple[str, DataFrame]:
    """The folder of a folder or of some picked images, and the picked images' names and numbers (none: the whole folder)."""
    images = [x for x in picks if re.search(rf"\.({'|'.join(IMAGE_EXTENSIONS)})$", x, re.I)]
    folder = picks[0].rstrip("/") if not images else images[0].rsplit("/", 1)[0]
    names = spark.createDataFrame([(x.rsplit("/", 1)[1],) for x in images], "name string")
    return folder, names.withColumn("number", trailing_number(stem(F.col("name"))))


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def formats(files: DataFrame) -> DataFrame:
    """True formats of files with path and content, from their first bytes."""
    return files.select("path", sniff_format(F.col("content")).alias("format"))


def size_in_head(raw: bytes) -> tuple[int | None, int | None]:
    """Width and height that the first bytes of a PNG, JPEG or TIFF give, else nulls."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:4] in (b"II*\0", b"MM\0*") and len(raw) >= 8:
        order = "<" if raw[:2] == b"II" else ">"
        at, found = struct.unpack_from(order + "I", raw, 4)[0], {}
        for k in range(struct.unpack_from(order + "H", raw, at)[0] if at + 2 <= len(raw) else 0):
            if at + 14 + 12 * k > len(raw):
                break
            tag, kind, _ = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), raw, at + 10 + 12 * k)[0]
        return found.get(256), found.get(257)
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 <= len(raw) and raw[at] == 0xFF:
        marker, length = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return struct.unpack(">HH", raw[at + 5 : at + 9])[::-1]
        at += 2 + length
    return None, None


def image_pixels(files: DataFrame) -> DataFrame:
    """path, width, height, the channels r, g, b row by row, and error, of PNG and TIFF files (path, content); a file is a row.

    Files of other formats have nulls, and so have files that cannot be read, with the reason in error.
    """

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, raw in zip(part["path"], part["content"]):
                bands, error = read_bands(bytes(raw or b""))
                row = {"path": path, "width": None, "height": None, "r": None, "g": None, "b": None, "error": error}
                if bands:
                    found = np.concatenate([b for _, b in bands]).astype(np.int32)
                    row |= {"height": found.shape[0], "width": found.shape[1]} | {c: found[..., k].ravel() for k, c in enumerate("rgb")}
                yield pd.DataFrame([row])

    return files.select("path", "content").mapInPandas(decode, "path string, width int, height int, r array<int>, g array<int>, b array<int>, error string")


def image_sizes(files: DataFrame, head_bytes: int = 65536) -> DataFrame:
    """path, width and height from the head of each file's content."""

    @F.pandas_udf("width int, height int")
    def header_size(head: pd.Series) -> pd.DataFrame:
        sizes = [size_in_head(bytes(raw or b"")) for raw in head]
        return pd.DataFrame({"width": pd.array([s[0] for s in sizes], dtype="Int32"), "height": pd.array([s[1] for s in sizes], dtype="Int32")})

    return files.select("path", header_size(F.substring("content", 1, head_bytes)).alias("size")).select("path", "size.width", "size.height")
