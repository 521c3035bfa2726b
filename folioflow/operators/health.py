"""What documents hold, and what recompressing them would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import human_size

#: The kinds of documents by what images they hold.
BILEVEL, COLOUR, MIXED, NONE = "黑白", "彩色/灰度", "混合", "无图像"


def unique_images(images: DataFrame, document: str, image: str, order: list[str]) -> DataFrame:
    """Each image of a document once, where it comes first; the first in ``order`` over all other columns."""
    rest = [c for c in images.columns if c not in (document, image)]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("first")
    return images.groupBy(document, image).agg(first).select(document, image, *(F.col(f"first.{c}") for c in rest))


def sole_images(images: DataFrame, page: list[str]) -> DataFrame:
    """Images of pages that hold exactly one."""
    counts = images.groupBy(*page).agg(F.count("*").alias("__n")).where("__n = 1")
    return images.join(counts.drop("__n"), page, "left_semi")


def composition(images: DataFrame, document: str) -> DataFrame:
    """Per document counts and bytes of bilevel and other images, all bytes, bytes after replacement if smaller, and kind."""
    made = F.when(F.col("bilevel") & F.col("decoded") & (F.col("made") < F.col("raw")), F.col("made")).otherwise(F.col("raw"))
    bi = F.col("bilevel")
    rows = images.groupBy(document).agg(
        F.count_if(bi).alias("n_bilevel"),
        F.count_if(~bi).alias("n_colour"),
        F.sum(F.when(bi, F.col("raw")).otherwise(0)).alias("bilevel_bytes"),
        F.sum(F.when(bi, 0).otherwise(F.col("raw"))).alias("colour_bytes"),
        F.sum("raw").alias("size"),
        F.sum(made).alias("after"),
    )
    kind = F.when((F.col("n_bilevel") > 0) & (F.col("n_colour") == 0), BILEVEL).when((F.col("n_colour") > 0) & (F.col("n_bilevel") == 0), COLOUR).when(F.col("n_bilevel") > 0, MIXED).otherwise(NONE)
    return rows.withColumn("kind", kind)


def sampled_ratio(images: DataFrame, document: str, order: list[str], sample: int) -> DataFrame:
    """Per document the compression of its first ``sample`` bilevel images that decode: ratio, null where there is none."""
    good = images.where(F.col("bilevel") & F.col("decoded"))
    rank = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    first = good.withColumn("__rank", rank).where(F.col("__rank") <= sample)
    ratios = first.groupBy(document).agg(F.try_divide(F.sum("made"), F.sum("raw")).alias("ratio"), F.count("*").alias("sampled"))
    return images.select(document).distinct().join(ratios, document, "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))


def estimate(size: Column, bilevel_bytes: Column, ratio: Column) -> Column:
    """Size after recompression, the size itself where no ratio is known."""
    return F.when(ratio.isNotNull(), size - bilevel_bytes * (1 - ratio)).otherwise(size)


def saving(size: Column, estimated: Column, n_bilevel: Column) -> Column:
    """Share saved, null unless something bilevel gets smaller."""
    return F.when((n_bilevel > 0) & (size > 0) & (estimated < size), 1 - estimated / size)


def report(rows: DataFrame, document: str) -> DataFrame:
    """Rows of size and after per document and one total row (null document), with the share saved and sizes as text."""
    total = rows.rollup(document).agg(F.sum("size").alias("now"), F.sum("after").alias("after"))
    saved = F.when(F.col("now") > 0, F.round((1 - F.col("after") / F.col("now")) * 100, 4))
    return total.select(F.col(document), "now", "after", saved.alias("saved_pct"), human_size(F.col("now")).alias("now_text"), human_size(F.col("after")).alias("after_text"))
