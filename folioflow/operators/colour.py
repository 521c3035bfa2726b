"""Hue histograms of pages and the ink colours in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import hue_bin, hue_lightness_saturation

#: Bins, the saturation that counts, the lightness of stroke cores, slots, neighbourhood, least share.
BINS, SATURATED, CORE, SLOTS, SPAN, SHARE = 36, 0.15, 0.55, 3, 4, 0.08


def hue_histogram(pixels: DataFrame, page: str, mask: str | None = None) -> DataFrame:
    """Per page and hue bin: pixels, stroke-core pixels, and the cores' channel sums; grey pixels are left out.

    With a mask column only its pixels over 128 count.
    """
    pixels = pixels if mask is None else pixels.where(F.col(mask) > 128)
    hls = hue_lightness_saturation(*(F.col(c) / F.lit(255.0) for c in "rgb"))
    seen = pixels.withColumn("hls", hls).where(F.col("hls.saturation") >= SATURATED)
    core = F.col("hls.lightness") < CORE
    sums = [F.sum(F.when(core, F.col(c)).otherwise(0)).cast("bigint").alias(f"sum_{c}") for c in "rgb"]
    return seen.groupBy(page, hue_bin(F.col("hls.hue"), BINS).alias("bin")).agg(F.count("*").alias("n"), F.count_if(core).alias("core_n"), *sums)


def dense(histogram: DataFrame, page: str) -> DataFrame:
    """One row per page with a 36-element array for each measure."""
    measures = ["n", "core_n", "sum_r", "sum_g", "sum_b"]
    rows = histogram.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct(*measures)))).alias("m"))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))

    def array_of(measure: str) -> Column:
        return F.transform(bins, lambda b: F.coalesce(F.try_element_at("m", b)[measure], F.lit(0).cast("bigint"))).alias(measure)

    return rows.select(page, *(array_of(m) for m in measures))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def ink_colours(histogram: DataFrame, page: str) -> DataFrame:
    """Up to three colours per page: slot, peak bin, pixels, and the cores' mean colour.

    Peaks are taken greedily, ties to the higher bin; each uses up its neighbourhood of unused bins around the circle,
    also when that holds too few pixels to count. Every step retires a bin, so 36 steps always do.
    """
    numbers = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    rows = dense(histogram, page).withColumn("total", numbers(F.col("n")))
    pick = "struct<peak:int,n:bigint,bins:array<int>>"
    start = F.struct(F.col("n").alias("left"), F.array().cast(f"array<{pick}>").alias("picks"))

    def step(state: Column, _: Column) -> Column:
        left, picks = state["left"], state["picks"]
        top = F.array_max(F.transform(left, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))

        def around(peak: Column) -> Column:
            near = F.transform(F.sequence(F.lit(-SPAN), F.lit(SPAN)), lambda d: F.pmod(peak["i"] + d, F.lit(BINS)))
            bins = F.array_sort(F.filter(near, lambda b: F.get(left, b) >= 0))
            return let(bins, lambda bins: let(numbers(F.transform(bins, lambda b: F.get(left, b))), lambda n: taken(peak, bins, n)))

        def taken(peak: Column, bins: Column, n: Column) -> Column:
            now = F.transform(left, lambda x, i: F.when(F.array_contains(bins, i), F.lit(-1).cast("bigint")).otherwise(x))
            one = F.array(F.struct(peak["i"].cast("int").alias("peak"), n.alias("n"), bins.alias("bins")).cast(pick))
            kept = F.when(n.cast("double") < F.col("total") * F.lit(SHARE), picks).otherwise(F.concat(picks, one))
            return F.struct(now.alias("left"), kept.alias("picks"))

        return F.when(F.size(picks) >= SLOTS, state).otherwise(let(top, lambda peak: F.when(peak["n"] <= 0, state).otherwise(around(peak))))

    folded = rows.withColumn("picks", F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), start, step, lambda s: s["picks"]))
    each = folded.select("*", F.posexplode("picks").alias("slot", "pick"))
    over = lambda c: numbers(F.transform("pick.bins", lambda b: F.get(F.col(c), b)))
    cores = F.greatest(over("core_n"), F.lit(1)).cast("double")
    return each.select(page, F.col("slot").cast("int").alias("slot"), F.col("pick.peak").alias("peak"), F.col("pick.n").alias("n"), *((over(f"sum_{c}") / cores).alias(c) for c in "rgb"))


def hue_runs(histogram: DataFrame, page: str) -> DataFrame:
    """Contiguous runs of filled bins per page, not joined around the circle, with their bounds in percent."""
    # A page has at most 36 bins, so its window is small whatever the corpus holds.
    island = F.col("bin") - F.row_number().over(Window.partitionBy(page).orderBy("bin"))
    runs = histogram.withColumn("island", island).groupBy(page, "island").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.sum("n").alias("n"))
    return runs.select(page, "first", "last", "n", (F.col("first") * 100 / F.lit(float(BINS))).alias("lo"), ((F.col("last") + 1) * 100 / F.lit(float(BINS))).alias("hi"))


def colours_as_json(colours: DataFrame, page: str) -> DataFrame:
    """One JSON object a page, from its number to its colours in the order of slots: a stage's state that a later run reads."""
    rgb = F.array_sort(F.collect_list(F.struct("slot", F.array("r", "g", "b").alias("rgb"))))
    return colours.groupBy(page).agg(F.transform(rgb, lambda x: x["rgb"]).alias("c")).select(F.to_json(F.create_map(F.col(page).cast("string"), F.col("c"))).alias("value"))


def colours_from_json(lines: DataFrame, page: str) -> DataFrame:
    """The state read back: page, slot, r, g, b; lines that are no such object are left out."""
    read = lines.select(F.from_json("value", "map<string,array<array<double>>>").alias("m")).where("m is not null")
    each = read.select(F.explode("m").alias("key", "c")).select(F.col("key").try_cast("bigint").alias(page), F.posexplode("c").alias("slot", "rgb"))
    return each.where(f"{page} is not null").select(page, "slot", *(F.get("rgb", F.lit(i)).alias(c) for i, c in enumerate("rgb")))
