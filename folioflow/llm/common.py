"""Helpers that several training-data operators share: shared scratch space, sizes, id columns, bounded pieces of batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), also set for checkpoint().

    Where the setting is absent a local session, whose driver and executors are one process, gets a temporary folder;
    on a cluster there is no folder that would do, so that is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How much scratch this driver has named so far, for ``drop_scratch``."""
    return len(_WRITTEN)


def drop_scratch(spark: SparkSession, since: int = 0, *needed: DataFrame) -> None:
    """Delete the scratch named since a mark, but for the tables that ``needed`` rows are read from."""
    files = [name for df in needed for name in df.inputFiles()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [p for p in _WRITTEN[since:] if not any(f"/{p.rsplit('/', 1)[1]}/" in name for name in files)]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _WRITTEN.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a string column over all rows."""
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{column}`"))).alias("n")).first()["n"] or 0)


def crc32_of_id(column: Column) -> Column:
    """Unsigned CRC-32 of an id written as decimal text; nulls stay null."""
    return F.crc32(column.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows whose strings in ``column`` have about ``size`` bytes; a longer row stands alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(lengths + 16), 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
