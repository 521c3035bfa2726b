"""Job progress as a stream of lines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.operators.jobs import decode, latest
from folioflow.sources import views
from folioflow.plans.scratch import shared_folder

LINES = "job long, seq long, line string"


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Progress lines from JSON files as they arrive; a line that is not whole is left out."""
    rows = spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(folder)
    return rows.where(F.col("line").isNotNull())


CHUNKS = "job long, seq long, text string"


def read_chunks(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Pieces of jobs' output from JSON files as they arrive, cut anywhere."""
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_per_trigger).json(folder).where("job is not null and seq is not null")


def frame_lines(chunks: DataFrame) -> DataFrame:
    """Whole lines of a stream of chunks (job, seq, text): job, line_no (from 0) and line, each as soon as it is ended.

    State per job is the line begun and not ended, the number of the next one and the seq of the last chunk. A trigger's
    chunks of a job are taken by seq; one whose seq is not past the last one's, such as a chunk that is delivered again, is
    left out. Null text is empty. State grows with the longest line alone.
    """

    def frame(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, number, last = state.get if state.exists else ("", 0, None)
        arrived = sorted((int(seq), text or "") for part in parts for seq, text in zip(part["seq"], part["text"]))
        out, pieces = [], [begun]
        for seq, text in arrived:
            if last is not None and seq <= last:
                continue
            last = seq
            first, *more = text.split("\n")
            pieces.append(first)
            for piece in more:
                out.append((key[0], number, "".join(pieces)))
                number, pieces = number + 1, [piece]
        state.update(("".join(pieces), number, last))
        yield pd.DataFrame(out, columns=["job", "line_no", "line"])

    job = chunks.schema["job"].dataType.simpleString()
    return chunks.groupBy("job").applyInPandasWithState(frame, f"job {job}, line_no long, line string", "begun string, number long, last long", "append", GroupStateTimeout.NoTimeout)


def follow_lines(chunks: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Frames all chunks that are there and appends the lines to a table; run again, it goes on where it stopped."""
    lines = frame_lines(chunks)
    lines.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return chunks.sparkSession.read.schema(lines.schema).parquet(table)


def run_latest(lines: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Follows a stream of lines over all that is there and returns every job's latest state.

    State is one row per job. Each trigger writes all states to a folder of its own below ``table``; the last is read, so
    a trigger that is run again after a failure does no harm.
    """
    spark, last = lines.sparkSession, []

    def keep(states: DataFrame, batch: int) -> None:
        states.write.mode("overwrite").parquet(f"{table}/{batch}")
        last[:] = [batch]

    states = latest(decode(lines))
    query = states.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(states.schema).parquet(f"{table}/{last[0]}") if last else spark.createDataFrame([], states.schema)


def follow_probes(lines: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Probe results as they come: rows of JSON lines tagged @@J are appended to a table that can be read meanwhile."""
    spark = lines.sparkSession
    probe = F.from_json(F.substring_index("line", "@@J", -1), "path string, size bigint, ratio double")
    rows = lines.where(F.col("line").startswith("@@J")).select("job", "seq", probe.alias("p")).where("p.path is not null").select("job", "seq", "p.path", "p.size", "p.ratio")
    query = rows.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(table)


def stream_framed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines, by a stream over the events table as chunks: every line's end comes with the start of the next one."""
    place = f"{shared_folder(spark)}/framing-{uuid.uuid4().hex}"
    events = spark.readStream.schema(views.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    line = F.concat("line", F.lit("\n"))
    cut = (F.length("line") / 2).cast("int")
    lines = views.as_progress_lines(events)
    halves = F.explode(F.array(F.struct((F.col("seq") * 2).alias("seq"), F.left(line, cut).alias("text")), F.struct((F.col("seq") * 2 + 1).alias("seq"), F.substr(line, cut + 1).alias("text"))))
    chunks = lines.select("job", halves.alias("half")).select("job", "half.seq", "half.text")
    return follow_lines(chunks, f"{place}/lines", f"{place}/log")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest states by a stream over the events table as a progress protocol."""
    place = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    schema = views.read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return run_latest(views.as_progress_lines(events), f"{place}/states", f"{place}/log")
