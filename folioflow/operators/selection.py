"""Numbering, filtering and sampling of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import last_number, stem
from folioflow.operators.scans import ordinals
from folioflow.plans.scratch import stored


def number_pages(names: DataFrame, group: str, name: str) -> DataFrame:
    """Adds numbered and page_no: the last digits of a stem, or positions by name where any is missing or repeated.

    Positions are only worked out for groups that need them, by ranges of names that follow the rows: every range counts
    its names, ranges' counts are added up, and no task ranks a whole group.
    """
    found = names.withColumn("__number", last_number(stem(F.col(name))))
    counts = found.groupBy(group, "__number").agg(F.count("*").alias("n"))
    kinds = counts.groupBy(group).agg((F.bool_and(F.col("__number").isNotNull()) & (F.max("n") == 1)).alias("numbered"))
    marked = found.join(kinds, group)
    good = marked.where("numbered").withColumn("page_no", F.col("__number"))
    ranged = marked.where("not numbered").repartitionByRange(group, name).withColumn("__range", F.spark_partition_id())
    within = Window.partitionBy(group, "__range").orderBy(name)
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # Ranges are cut by a sample, so they are stored before two branches read them.
    placed = stored(ranged, "ranges").withColumn("__within", F.row_number().over(within))
    bases = placed.groupBy(group, "__range").agg(F.max("__within").alias("__n")).select(group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rest = placed.join(bases, [group, "__range"]).withColumn("page_no", (F.col("__base") + F.col("__within")).cast("bigint"))
    return good.unionByName(rest.select(*good.columns)).drop("__number")


def select_pages(pages: DataFrame, number: str, include: DataFrame | None = None, exclude: DataFrame | None = None, span: tuple[int, int | None] | None = None) -> DataFrame:
    """Pages in the included set and the inclusive span (None: no end), but not in the excluded set.

    Sets have one number column each. ``plans.stages.require_rows`` makes an empty result an error.
    """
    kept = pages
    if span:
        kept = kept.where((F.col(number) >= span[0]) & (F.col(number) <= span[1] if span[1] is not None else F.lit(True)))
    if include is not None:
        kept = kept.join(include.select(F.col(include.columns[0]).alias(number)).distinct(), number, "left_semi")
    if exclude is not None:
        kept = kept.join(exclude.select(F.col(exclude.columns[0]).alias(number)).distinct(), number, "left_anti")
    return kept


def mark_covers(pages: DataFrame, group: str, number: str, first: bool = True, last: bool = True, chosen: Column | None = None) -> DataFrame:
    """Adds is_cover: the first or last page that is left in the group, or pages that a condition names."""
    ends = pages.groupBy(group).agg(F.min(number).alias("__first"), F.max(number).alias("__last"))
    cover = F.lit(False)
    if first:
        cover = cover | (F.col(number) == F.col("__first"))
    if last:
        cover = cover | (F.col(number) == F.col("__last"))
    if chosen is not None:
        cover = cover | chosen
    return pages.join(ends, group).withColumn("is_cover", cover).drop("__first", "__last")


def stride_sample(pages: DataFrame, group: str, order: str, size: int, capped: bool = True) -> DataFrame:
    """Every step-th page of a group, step = max(1, pages div size), at most size of them if capped; adds ord, n_pages and step."""
    step = F.greatest(F.lit(1), F.floor(F.col("n_pages") / size)).cast("bigint")
    placed = ordinals(pages, [group], order, total="n_pages").withColumn("step", step)
    taken = ((F.col("ord") - 1) % F.col("step") == 0) & (((F.col("ord") - 1) < F.col("step") * size) if capped else F.lit(True))
    return placed.where(taken)
