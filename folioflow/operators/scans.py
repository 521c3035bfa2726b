"""Running values within groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_quantiles(df: DataFrame, order: str, slices: int | None = None) -> DataFrame:
    """Adds __slice: rows cut at quantiles of a numeric column, so that slices follow the rows and not the span of values.

    The quantiles come from mergeable summaries of the column, the only one read for them; their error is a tenth of a
    slice, so no slice has twice the mean unless rows of one value do. By default there are as many slices as shuffle
    partitions. A part of a slice that belongs to one group is no larger than the slice, however groups are distributed.
    Nulls are a slice of their own; an empty table is one slice.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = [k / n for k in range(1, n)]
    found = df.select(F.percentile_approx(F.col(order).cast("double"), marks, 10 * n).alias("cuts")).first()["cuts"] if marks else None
    cuts = sorted(set(found or []))
    if not cuts:
        return df.withColumn("__slice", F.lit(0).cast("double"))
    place = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__order", outputCol="__slice", handleInvalid="keep")
    return place.transform(df.withColumn("__order", F.col(order).cast("double"))).drop("__order")


def running(df: DataFrame, group: list[str], order: str, width: int | None = 65536, ties: tuple[str, ...] = (), **values: tuple[str, Column]) -> DataFrame:
    """Adds running sums or maxima within each group in the order of a numeric column.

    ``values`` maps a new column's name to ('sum', 'max', 'sum_before' or 'max_before', expression), of which the latter two
    leave out the row itself, or to ('sum_all', 'min_all' or 'max_all', expression), the whole group's. Groups are cut into
    slices of ``width`` order values, or at quantiles of the column where ``width`` is None (for hashes, times and other
    numbers whose span says nothing): rows are scanned slice by slice, slice totals are scanned per group, and both are
    combined, so that a group is never one task's work, however large; ``width`` should be some ten thousand rows' span of the
    column. Rows of equal ``order`` are scanned by the columns ``ties``, and in an arbitrary order where these are equal
    too. A sum before the first row is 0, a maximum null.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    kinds = {name: kind.split("_")[0] for name, (kind, _) in values.items()}
    whole = {name for name, (kind, _) in values.items() if kind.endswith("_all")}
    ends = {name: -1 if kind.endswith("_before") else 0 for name, (kind, _) in values.items()}
    sliced = by_quantiles(df, order) if width is None else df.withColumn("__slice", F.floor(F.col(order) / width))
    for name, (_, column) in values.items():
        sliced = sliced.withColumn(f"__{name}", column)
    every = Window.partitionBy(*group)
    before = every.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*group, "__slice").agg(*(fold[kind](f"__{name}").alias(f"__{name}") for name, kind in kinds.items()))
    carried = totals.select(*group, "__slice", *(fold[kind](f"__{name}").over(every if name in whole else before).alias(f"__before_{name}") for name, kind in kinds.items()))
    scanned = sliced
    for name in kinds.keys() - whole:
        inside = Window.partitionBy(*group, "__slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, ends[name])
        scanned = scanned.withColumn(f"__{name}", fold[kinds[name]](f"__{name}").over(inside))
    same = [scanned[c].eqNullSafe(carried[c]) for c in [*group, "__slice"]]
    joined = scanned.join(carried, same, "left")
    out = [scanned[c] for c in df.columns]
    for name, kind in kinds.items():
        own, past = scanned[f"__{name}"], carried[f"__before_{name}"]
        zero = F.lit(0)
        both = F.coalesce(own, zero) + F.coalesce(past, zero) if kind == "sum" else F.coalesce(F.greatest(own, past), own, past)
        out.append((past if name in whole else both).alias(name))
    return joined.select(*out)


def ordinals(df: DataFrame, group: list[str], order: str, name: str = "ord", width: int | None = 65536, ties: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """Adds the 1-based position of each row in its group, rows of equal order by ``ties``, and as ``total`` the group's rows."""
    one = F.lit(1).cast("bigint")
    return running(df, group, order, width, ties, **{name: ("sum", one)} | ({total: ("sum_all", one)} if total else {}))
