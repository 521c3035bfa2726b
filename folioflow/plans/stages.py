"""Stage tables: completeness, overwriting, and cleaning up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def missing_report(expected: DataFrame, produced: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: how many keys are expected, how many of them have no result, and the first such key."""
    have = produced.select(group, key).distinct().withColumn("__have", F.lit(True))
    gone = F.col("__have").isNull()
    return expected.join(have, [group, key], "left").groupBy(group).agg(F.count("*").alias("expected"), F.count_if(gone).alias("missing"), F.min(F.when(gone, F.col(key))).alias("first_missing"))


def require(rows: DataFrame, wrong: Column, message: Column) -> DataFrame:
    """The rows as they are; a row that is wrong ends the job with its message."""
    return rows.where(F.when(wrong, F.raise_error(message).isNull()).otherwise(True))


def require_complete(expected: DataFrame, produced: DataFrame, group: str, key: str) -> DataFrame:
    """``missing_report`` of complete groups; a group with gaps ends the job, naming their number and the first one."""
    message = F.format_string("%s: %d of %d without a result, first %s", F.col(group).cast("string"), F.col("missing"), F.col("expected"), F.col("first_missing").cast("string"))
    return require(missing_report(expected, produced, group, key), F.col("missing") > 0, message)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The rows as they are; no row at all ends the job. One row of a count is what is joined for that."""
    found = df.agg(F.count("*").alias("__n"))
    checked = require(found, F.col("__n") == 0, F.lit(f"no {what} left")).withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(checked.select("__one")), "__one", "left_semi").drop("__one")


def first_clashes(wanted: DataFrame, there: DataFrame, name: str, most: int = 5) -> DataFrame:
    """The first names, by name, that would be written over: an example for a question, not all of them."""
    return wanted.select(name).distinct().join(there.select(name).distinct(), name, "left_semi").orderBy(name).limit(most)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _snapshots(spark: SparkSession, where: str) -> list[tuple[int, str]]:
    """Number and data folder of every committed snapshot of a stage, in order."""
    place, files = _place(spark, f"{where}/_commits")
    if not files.exists(place):
        return []
    return sorted((int(name.split(".")[0]), name.split(".", 1)[1]) for name in (x.getPath().getName() for x in files.listStatus(place)))


def write_stage(df: DataFrame, path: str, tag: str, inputs: tuple[str, ...] = (), force: bool = False) -> DataFrame:
    """Write one stage's rows below ``path`` under its tag and read them back.

    Refuses to write over an input, and over an earlier result unless ``force`` says so. Rows go to a new folder; only when
    all are there an empty file of the next number names that folder, and from then on it is the result. So a writer that
    dies leaves the earlier result as it was, and of two writers of one number one is refused. ``drop_snapshots`` deletes
    earlier results and what dead writers left.
    """
    spark, where = df.sparkSession, f"{path.rstrip('/')}/tag={tag}"
    if any(where.rstrip("/") == x.rstrip("/") or x.startswith(f"{where}/") for x in inputs):
        raise ValueError(f"{where} holds an input")
    before = _snapshots(spark, where)
    if before and not force:
        raise FileExistsError(f"{where} already exists")
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{where}/{folder}")
    number = before[-1][0] + 1 if before else 1
    now = _snapshots(spark, where)
    if now and now[-1][0] >= number:
        raise FileExistsError(f"{where}: another writer committed {now[-1][0]}")
    place, files = _place(spark, f"{where}/_commits/{number:09d}.{folder}")
    files.create(place, False).close()
    return read_stage(spark, path, tag)


def read_stage(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A stage's rows as last committed."""
    where = f"{path.rstrip('/')}/tag={tag}"
    found = _snapshots(spark, where)
    if not found:
        raise FileNotFoundError(f"{where} has no result")
    return spark.read.parquet(f"{where}/{found[-1][1]}")


def drop_snapshots(spark: SparkSession, path: str, tag: str, keep: int = 1) -> int:
    """Delete all but the last ``keep`` results of a stage, and data that no commit names; how many folders went.

    Not while a writer is at work: its data has no commit yet.
    """
    where = f"{path.rstrip('/')}/tag={tag}"
    found = _snapshots(spark, where)
    stay = {folder for _, folder in found[-max(keep, 1) :]}
    for number, folder in found:
        if folder not in stay:
            place, files = _place(spark, f"{where}/_commits/{number:09d}.{folder}")
            files.delete(place, False)
    place, files = _place(spark, where)
    gone = [x.getPath() for x in (files.listStatus(place) if files.exists(place) else []) if x.getPath().getName().startswith("data-") and x.getPath().getName() not in stay]
    for one in gone:
        files.delete(one, True)
    return len(gone)


def drop_stages(spark: SparkSession, path: str, *tags: str, committed: DataFrame) -> list[str]:
    """Delete the intermediate stages, but only when the final result can be read and holds rows; gives the deleted paths."""
    if committed.limit(1).count() == 0:
        return []
    gone = []
    for tag in tags:
        place, files = _place(spark, f"{path.rstrip('/')}/tag={tag}")
        if files.delete(place, True):
            gone.append(place.toString())
    return gone
