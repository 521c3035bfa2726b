"""Page-shaped views of relational tables, for queries over data that holds no scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import last_number, once, padded, stem
from folioflow.operators.scans import ordinals, running


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small file, on which much is worked out, dealt to all cores: a reader's splits follow bytes, not work."""
    return rows.repartition(max(1, spark.sparkContext.defaultParallelism), key)


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, fname, page_no, bytes: documents as pages of their sources."""
    docs = read(spark, sf_dir, "documents")
    named = docs.select(F.col("source").alias("book"), padded("image", F.col("doc_id"), ".jpg").alias("fname"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    return named.withColumn("page_no", last_number(stem(F.col("fname"))))


def line_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, obj, bilevel, decoded, raw, made: order lines as images of documents, sizes in whole bytes."""
    lines = read(spark, sf_dir, "lineitem")
    raw = F.col("l_quantity").cast("bigint") * 1000
    made = F.expr("bigint(l_quantity) * 1000 * (100 - bigint(round(l_discount * 100))) div 100")
    return lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("bigint").alias("page"), F.col("l_partkey").alias("obj"), (F.col("l_linestatus") == "F").alias("bilevel"), (F.col("l_returnflag") != "R").alias("decoded"), raw.alias("raw"), made.alias("made"))


def vector_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, gray: embeddings as 8 x 8 rasters of levels 0 to 255, row by row."""
    level = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + F.lit(0.6)) * F.lit(200.0)))).cast("int")
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", level).alias("gray"))


def vector_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, i, r, g, b: consecutive triples of the levels as 22 pixels, the last one going on at the first levels."""
    at = F.explode(F.sequence(F.lit(0), F.lit(21)))
    return vector_rasters(spark, sf_dir).select("vec_id", at.alias("i"), "gray").select("vec_id", "i", *(F.col("gray")[(F.col("i") * 3 + k) % 64].alias(c) for k, c in enumerate("rgb")))


def content_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pos, op, value: users' events as content streams; signup opens text, error ends it, click and view show it."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "BT").when(kind == "error", "ET").when(kind.isin("click", "view"), "Tj").otherwise("re")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), op.alias("op"), F.col("value"))


def page_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, stream: conversation turns as content streams; three of four pages hold text, in two islands."""
    turn = F.col("turn")
    text = F.format_string("q %d 0 0 %d 5 -7 cm\n%% BT no text (\nBT\n/F%d 12 Tf\n(a\\(b (%s) c) Tj ET /Im%d Do Q\nBT [<00%02X> -12 (x)] TJ\nET", turn + 1, turn + 2, turn % 3, F.col("role"), turn, turn % 256)
    stream = F.when(turn % 4 == 3, F.lit("q /Im1 Do Q")).otherwise(text)
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + turn).alias("page"), "conv_id", "turn", "role", stream.alias("stream"))


def as_progress_lines(events: DataFrame) -> DataFrame:
    """job, seq, line: events, streamed or not, as a job's progress protocol."""
    kind, seq = F.col("event_type"), F.col("event_id")
    line = (
        F.when(kind == "view", F.format_string("@@P binarize %d 20", seq % 20 + 1))
        .when(kind == "click", F.format_string("@@P jbig2 %d 8", seq % 8 + 1))
        .when(kind == "signup", F.lit("@@S jbig2"))
        .when(kind == "purchase", F.format_string("@@DONE %d %d /out/book %d.pdf", seq * 100, seq % 9 + 1, seq))
        .otherwise(F.format_string("note %d", seq))
    )
    return events.select(F.col("user_id").alias("job"), seq.alias("seq"), line.alias("line"))


def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_progress_lines(read(spark, sf_dir, "events"))


def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, text: conversation turns as pages of recognised text."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "role", "text")


def text_scans(spark: SparkSession, sf_dir: str, width: int = 500, strip: int = 64) -> DataFrame:
    """book and pieces of a raster: the characters of a source's documents as levels, each document from a new row on.

    A character's level is its code point times 7, modulo 256; the rest of a document's last row is white.
    """
    docs = read(spark, sf_dir, "documents").where("length(text) > 0")
    rows = docs.select(F.col("source").alias("book"), "doc_id", F.ceil(F.length("text") / width).cast("bigint").alias("rows"))
    heights = rows.groupBy("book").agg(F.sum("rows").cast("int").alias("height"))
    placed = running(rows, ["book"], "doc_id", y=("sum_before", F.col("rows"))).join(heights, "book")
    texts = placed.join(docs.select("doc_id", "text"), "doc_id").select("book", "height", F.lit(width).alias("width"), F.col("y").cast("int"), "text")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, height, y, text in zip(*(batch.column(c).to_pylist() for c in ("book", "height", "y", "text"))):
                levels = np.frombuffer(text.encode("utf-32-le"), np.uint32) * 7 % 256
                a = np.full(-(-len(levels) // width) * width, 255, dtype=np.uint8)
                a[: len(levels)] = levels
                cuts = list(range(0, len(a) // width, strip))
                parts = [a[k * width : (k + strip) * width].tobytes() for k in cuts]
                n = len(cuts)
                columns = [pa.array([book] * n, pa.string()), *(pa.array(v, pa.int32()) for v in ([height] * n, [width] * n, [y + k for k in cuts], [0] * n, [len(part) // width for part in parts], [width] * n)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["book", "height", "width", "y", "x", "h", "w", "samples"])

    return texts.mapInArrow(draw, "book string, height int, width int, y int, x int, h int, w int, samples binary")


def label_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label and pieces of one raster a label: its vectors in order of their ids, two a row."""
    vectors = ordinals(vector_rasters(spark, sf_dir), ["label"], "vec_id", total="n")
    place, hexed = F.col("ord") - 1, F.concat_ws("", F.transform("gray", lambda g: F.lpad(F.hex(g), 2, "0")))
    return vectors.select("label", F.ceil(F.col("n") / 2).cast("int").alias("height"), F.lit(128).alias("width"), F.floor(place / 2).cast("int").alias("y"), (place % 2 * 64).cast("int").alias("x"), F.lit(1).alias("h"), F.lit(64).alias("w"), F.unhex(hexed).alias("samples"))


def vector_sheet(spark: SparkSession, sf_dir: str, bands: int = 1) -> DataFrame:
    """sheet (0) and pieces of one raster of all vectors in order of their ids, two a row; band k begins at level k."""
    vectors = ordinals(vector_rasters(spark, sf_dir).withColumn("sheet", F.lit(0)), ["sheet"], "vec_id")
    height = -(-read(spark, sf_dir, "embeddings").count() // 2)
    at = F.sequence(F.lit(0), F.lit(63))
    # The levels are worked out once a row: a filter on samples is moved below everything that would else hold them.
    levels = F.transform("gray", lambda g: F.lpad(F.hex(g), 2, "0"))
    hexed = once(levels, lambda a: F.concat_ws("", F.flatten(F.transform(at, lambda i: F.array(*(F.get(a, (i + k) % 64) for k in range(bands)))))))
    place = F.col("ord") - 1
    return vectors.select("sheet", F.lit(height).alias("height"), F.lit(128).alias("width"), F.floor(place / 2).cast("int").alias("y"), (place % 2 * 64).cast("int").alias("x"), F.lit(1).alias("h"), F.lit(64).alias("w"), F.unhex(hexed).alias("samples"))
