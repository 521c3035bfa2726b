"""Manifests, chunking, ordered assembly and stage bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.scans import ordinals, running
from folioflow.operators.selection import mark_covers

#: At most so many chunks, and at least so many pages in each.
MOST_CHUNKS, LEAST_PAGES = 8, 16


def chunk_shape(n: Column) -> tuple[Column, Column]:
    """Number of chunks and pages per chunk for n pages."""
    k = F.greatest(F.lit(1), F.least(F.lit(MOST_CHUNKS), F.floor(n / LEAST_PAGES))).cast("bigint")
    return k, F.ceil(n / k).cast("bigint")


def chunked(pages: DataFrame, group: str, order: str, width: int | None = 65536) -> DataFrame:
    """Adds ord, n, k, per and chunk: equal runs of pages, the last one shorter; ``width`` as in ``scans.running``."""
    k, per = chunk_shape(F.col("n"))
    placed = ordinals(pages, [group], order, width=width, total="n")
    return placed.withColumn("k", k).withColumn("per", per).withColumn("chunk", F.floor((F.col("ord") - 1) / F.col("per")).cast("bigint"))


def manifest(pages: DataFrame, group: str, number: str, size: str) -> DataFrame:
    """Per book and chunk the pages, first and last number and bytes; covers, the first and last page, are chunk -1."""
    marked = mark_covers(pages, group, number)
    inner = (~F.col("is_cover")).cast("bigint")
    placed = running(marked, [group], number, __c=("sum", inner), __n=("sum_all", inner))
    _, per = chunk_shape(F.col("__n"))
    chunk = F.when(F.col("is_cover"), -1).otherwise(F.floor((F.col("__c") - 1) / per)).cast("bigint")
    return placed.withColumn("chunk", chunk).groupBy(group, "chunk").agg(F.count("*").alias("pages"), F.min(number).alias("first_page"), F.max(number).alias("last_page"), F.sum(size).cast("bigint").alias("bytes"))


def interleave(pages: DataFrame, group: str, number: str) -> DataFrame:
    """Adds ord, doc ('cover' or 'content') and idx: covers by their number, content pages by their running index from 0."""
    marked = mark_covers(pages, group, number)
    placed = running(marked, [group], number, ord=("sum", F.lit(1).cast("bigint")), content=("sum", (~F.col("is_cover")).cast("bigint")))
    doc = F.when(F.col("is_cover"), "cover").otherwise("content")
    return placed.withColumn("doc", doc).withColumn("idx", F.when(F.col("is_cover"), F.col(number)).otherwise(F.col("content") - 1)).drop("content", "is_cover")


def missing(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """Expected rows without a result."""
    return expected.join(produced.select(key).distinct(), key, "left_anti")


def merge_state(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Old values updated by new ones; a new value wins where both exist and it is not null."""
    a, b = old.select(key, F.col(value).alias("__old")), new.select(key, F.col(value).alias("__new"))
    return a.join(b, key, "full").select(key, F.coalesce("__new", "__old").alias(value))


def replace_if_smaller(size: Column, made: Column) -> Column:
    """The new size only where it exists and is strictly smaller."""
    return F.when(made < size, made).otherwise(size)


def replaced(images: DataFrame, made: DataFrame, keys: list[str], size: str, new_size: str) -> DataFrame:
    """All images with kept, the new size where a result exists and is strictly smaller, and is_new: a left join."""
    new = made.select(*keys, F.col(new_size).alias("__new"))
    joined = images.join(new, keys, "left")
    smaller = F.coalesce(F.col("__new") < F.col(size), F.lit(False))
    return joined.withColumn("kept", F.when(smaller, F.col("__new")).otherwise(F.col(size))).withColumn("is_new", smaller).drop("__new")


def remade(pages: DataFrame, made: DataFrame, key: str, value: str) -> DataFrame:
    """All pages with their remade value, the original one where there is none: a left join."""
    new = made.select(key, F.col(value).alias("__new"))
    return pages.join(new, key, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def draw_order(layers: DataFrame, page: str, name: str, background: str) -> DataFrame:
    """Adds ord: the background first, then by name; a page's layers are few."""
    turn = Window.partitionBy(page).orderBy((F.col(name) != background).cast("int"), name)
    return layers.withColumn("ord", F.row_number().over(turn).cast("bigint"))


def swapped(rows: DataFrame, group: str, order: str, at: Column) -> DataFrame:
    """The order after a user swaps the row at position ``at`` with the next one; a swap beyond the end changes nothing."""
    n = rows.groupBy(group).agg(F.max(order).alias("__n"))
    real = (at >= 1) & (at < F.col("__n"))
    new = F.when(real & (F.col(order) == at), F.col(order) + 1).when(real & (F.col(order) == at + 1), F.col(order) - 1).otherwise(F.col(order))
    return rows.join(n, group).withColumn(order, new).drop("__n")


def start_offsets(inputs: DataFrame, group: list[str], order: str, pages: str) -> DataFrame:
    """Adds start: the pages of all earlier inputs."""
    scanned = running(inputs, group, order, upto=("sum", F.col(pages).cast("bigint")))
    return scanned.withColumn("start", F.col("upto") - F.col(pages)).drop("upto")


def stage_key(*parameters: Column) -> Column:
    """One key for a stage's results from every parameter that changes them; nulls count."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parameters))), 256)


def to_do(expected: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """Expected rows whose result is absent or empty in the stage table (key, length), for resuming."""
    return missing(expected, stage.where("length > 0"), key)
