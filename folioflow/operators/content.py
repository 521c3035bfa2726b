"""Content streams and recognised text: islands, affine folds, reading order, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import multiply
from folioflow.operators.scans import running


def text_islands(operators: DataFrame, page: str, pos: str, op: str) -> DataFrame:
    """Adds inside: whether an operator is between BT and ET, both included. Islands do not nest: any ET closes."""
    opens, closes = (F.when(F.col(op) == kind, F.col(pos)) for kind in ("BT", "ET"))
    scanned = running(operators, [page], pos, opened=("max", opens), closed=("max_before", closes))
    inside = F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("opened") > F.col("closed")))
    return scanned.withColumn("inside", inside).drop("opened", "closed")


def placement(operators: DataFrame, page: str, pos: str, op: str, matrix: str, width: int = 4096) -> DataFrame:
    """The matrix at each page's first Do: cm multiplies onto the current one, q saves and Q restores it.

    A Q too many changes nothing; pages without Do give no row, nor do pages where a cm before it has no six numbers. No stack
    is folded: a cm counts at the Do exactly if no Q between them goes below its depth, and depths, which never fall under 0,
    are sums and minima of +1 and -1. Pages are cut into slices of ``width`` positions; a slice carries its sum and its
    minima from the left and, towards the Do, its least depth from the right. The matrices that count are multiplied slice by
    slice and then slice products in two more levels (products of fractions may differ in the last bits from a fold in
    order), so that no page is one row, nor one task.
    """
    six = F.col(matrix).cast("array<double>")
    ops = operators.where(F.col(op).isin("q", "Q", "cm", "Do")).select(F.col(page).alias("page"), F.col(pos).alias("pos"), F.col(op).alias("op"), F.when(F.col(op) == "cm", six).alias("m"))
    spoilt = (F.col("op") == "cm") & F.coalesce((F.size("m") != 6) | F.exists("m", lambda x: x.isNull()), F.lit(True))
    ends = ops.groupBy("page").agg(F.min(F.when(F.col("op") == "Do", F.col("pos"))).alias("stop"), F.min(F.when(spoilt, F.col("pos"))).alias("spoilt"))
    ends = ends.where("stop is not null and (spoilt is null or spoilt > stop)").select("page", "stop")
    step = F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0).cast("bigint")
    before_do = ops.join(ends, "page").where("pos <= stop").select("page", "pos", "op", "m", step.alias("step"), F.floor(F.col("pos") / width).alias("slice"))
    here = Window.partitionBy("page", "slice").orderBy("pos")
    past, ahead = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(1, Window.unboundedFollowing)
    earlier = Window.partitionBy("page").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("page").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    summed = before_do.withColumn("own", F.sum("step").over(past)).withColumn("least", F.min("own").over(past))
    slices = summed.groupBy("page", "slice").agg(F.sum("step").alias("own"), F.min("own").alias("least"))
    slices = slices.withColumn("base", F.coalesce(F.sum("own").over(earlier), F.lit(0))).withColumn("lowest", F.min(F.col("base") + F.col("least")).over(earlier)).select("page", "slice", "base", "lowest")
    # What a sum is under 0 at its lowest so far are Qs that had nothing to restore.
    under = F.least(F.lit(0), F.coalesce("lowest", F.lit(0)), F.col("base") + F.col("least"))
    deep = summed.join(slices, ["page", "slice"]).select("page", "slice", "pos", "op", "m", (F.col("base") + F.col("own") - under).alias("depth"))
    least_after = deep.groupBy("page", "slice").agg(F.min("depth").alias("depth")).select("page", "slice", F.min("depth").over(later).alias("after"))
    reached = deep.withColumn("next", F.min("depth").over(ahead)).join(least_after, ["page", "slice"])
    counts = (F.col("op") == "Do") | ((F.col("op") == "cm") & (F.col("depth") <= F.coalesce(F.least("next", "after"), F.col("depth"))))
    unit = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)))
    found = reached.where(counts).select("page", "slice", F.col("pos").alias("at"), F.coalesce("m", unit).alias("m"))
    for level in (F.col("slice"), F.floor(F.col("slice") / width), F.lit(0)):
        ordered = F.array_sort(F.collect_list(F.struct("at", "m")))
        grouped = found.groupBy("page", level.alias("slice")).agg(ordered.alias("ms"))
        found = grouped.select("page", "slice", F.col("slice").alias("at"), F.aggregate("ms", unit, lambda now, x: multiply(x["m"], now)).alias("m"))
    return found.select(F.col("page").alias(page), F.col("m").alias("ctm"))


def carried_text(operators: DataFrame, page: str, pos: str, op: str, line: Column) -> DataFrame:
    """Per page the operators from BT to ET, both included, as a stream of their own; pages without text give no row."""
    kept = text_islands(operators.withColumn("__line", line), page, pos, op).where("inside")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("__line").alias("t"))))
    return kept.groupBy(page).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))


def reading_order(boxes: DataFrame, page: str, x: str, y: str, tie: str, gap: float = 0.02) -> DataFrame:
    """Adds band and ord: top to bottom in bands that a vertical gap of more than ``gap`` separates, left to right inside."""
    down = Window.partitionBy(page).orderBy(F.desc(y), tie)
    new = F.coalesce((F.lag(y).over(down) - F.col(y) > gap).cast("bigint"), F.lit(0).cast("bigint"))
    banded = boxes.withColumn("__new", new).withColumn("band", F.sum("__new").over(down)).drop("__new")
    return banded.withColumn("ord", F.row_number().over(Window.partitionBy(page).orderBy("band", x, tie)).cast("bigint"))


def sidecar(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """One text per document: pages in order, a form feed and line feed between, a line feed at the end; null is empty."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    joined = pages.groupBy(document).agg(ordered.alias("pages"))
    return joined.select(document, F.size("pages").cast("bigint").alias("n_pages"), F.concat(F.array_join(F.transform("pages", lambda x: x["t"]), "\f\n"), F.lit("\n")).alias("sidecar"))
