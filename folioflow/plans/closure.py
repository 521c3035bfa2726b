"""Everything that is reached by steps, and the components of links, in rounds of joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.scratch import dropped, shared_folder


#: Pairs that one task makes distinct.
PAIRS_A_TASK = 1 << 19


def closure(steps: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct (start, end) pairs with a path of one or more steps; cycles reach themselves.

    Pairs have their least number of steps. A round joins those of exactly the reach so far with all that is known: every pair
    of up to twice the reach has a node at that place of a shortest path, so the reach doubles and a pair is met once for
    each such node, not for every way to cut its path. It goes on until a round finds nothing. A round writes its new pairs
    alone, below one folder of the shared place that holds the result in the end. A midpoint of many pairs is a large key of a
    plain join, which adaptive execution splits. How many pairs a join gives is counted first, from the pairs at every
    midpoint, and they are dealt before they are made distinct, so that a task's memory does not follow the size of the table.
    """
    spark = steps.sparkSession
    place = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"

    def stored(pairs: DataFrame, number: int) -> DataFrame:
        pairs.write.parquet(f"{place}/{number}")
        return spark.read.schema(pairs.schema).parquet(f"{place}/{number}")

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        met = a.alias("a").join(b.alias("b"), F.col(f"a.{end}") == F.col(f"b.{start}"))
        return met.select(F.col(f"a.{start}"), F.col(f"b.{end}"), (F.col("a.__steps") + F.col("b.__steps")).alias("__steps"))

    def meeting(a: DataFrame, b: DataFrame) -> int:
        """How many rows ``meet`` gives."""
        ends, starts = a.groupBy(F.col(end).alias("at")).agg(F.count("*").alias("n")), b.groupBy(F.col(start).alias("at")).agg(F.count("*").alias("m"))
        return ends.join(starts, "at").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0

    def different(pairs: DataFrame, rows: int) -> DataFrame:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PAIRS_A_TASK))
        return pairs.repartition(n, start, end).groupBy(start, end).agg(F.min("__steps").alias("__steps"))

    given = steps.select(start, end, F.lit(1).cast("bigint").alias("__steps")).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    found, number = stored(different(given, steps.count()), 0), 0
    known = found
    while not found.isEmpty():
        edge = known.where(F.col("__steps") == 1 << number)
        further = different(meet(edge, known), meeting(edge, known))
        number += 1
        found = stored(further.join(known, [start, end], "left_anti"), number)
        known = spark.read.schema(found.schema).parquet(*(f"{place}/{k}" for k in range(number + 1)))
    return known.select(start, end)


def components(links: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """group, node and root, the least node that is reached, of every linked node but the roots; links run both ways.

    Large and small stars take turns: every node's greater neighbours are linked to the least it sees, then its lesser ones.
    Nodes' neighbours are never gathered, only their least is, so a hub is a large key of a plain join, which adaptive
    execution splits. It goes on until a round changes no link; each round reads the last one's table, which is
    then deleted.
    """
    spark = links.sparkSession
    place = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def stored(stars: DataFrame, number: int) -> DataFrame:
        stars.where("node <> root").distinct().write.parquet(f"{place}/{number}")
        return spark.read.schema(stars.schema).parquet(f"{place}/{number}")

    def least(of: DataFrame) -> DataFrame:
        return of.groupBy(*group, "node").agg(F.min("root").alias("__least"))

    ends = [F.greatest(a, b).alias("node"), F.least(a, b).alias("root")]
    now, number = stored(links.select(*group, *ends), 0), 0
    while True:
        number += 1
        turned = now.select(*group, F.col("root").alias("node"), F.col("node").alias("root"))
        seen = least(now.unionByName(turned)).withColumn("__least", F.least("node", "__least"))
        large = stored(turned.join(seen, [*group, "node"]).select(*group, F.col("root").alias("node"), F.col("__least").alias("root")), 2 * number - 1)
        small = large.join(least(large), [*group, "node"])
        moved = small.select(*group, F.col("root").alias("node"), F.col("__least").alias("root"))
        then = stored(moved.unionByName(small.select(*group, "node", F.col("__least").alias("root"))), 2 * number)
        if then.count() == now.count() and then.join(now, [*group, "node", "root"], "left_anti").isEmpty():
            break
        for old in (2 * number - 2, 2 * number - 1):
            dropped(spark, f"{place}/{old}")
        now = then
    for old in (2 * number - 2, 2 * number - 1):
        dropped(spark, f"{place}/{old}")
    return then
