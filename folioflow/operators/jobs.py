"""Progress lines decoded, jobs' latest states, and queue decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.scans import running

#: How far a page stage, the encoding stage and the assembly bring a job.
BINARIZE, OTHER_PAGES, ENCODE_FROM, ENCODE, ASSEMBLE = 0.72, 0.85, 0.74, 0.19, 0.93


def decode(lines: DataFrame) -> DataFrame:
    """Adds kind (P, S, DONE or LOG), stage, done, total, bytes, pages, path and progress; lines keep their columns.

    A path keeps its spaces. Lines that are malformed for their kind have nulls.
    """
    line = F.col("line")
    kind = F.when(line.startswith("@@P "), "P").when(line.startswith("@@S "), "S").when(line.startswith("@@DONE "), "DONE").otherwise("LOG")
    part = lambda pattern, i: F.when(line.rlike(pattern), F.regexp_extract(line, pattern, i))
    page, stage, done = r"^@@P (\S+) (\d+) (\d+)$", r"^@@S (\S+)", r"^@@DONE (\d+) (\d+) (.*)$"
    out = lines.withColumn("kind", kind).withColumn("stage", F.coalesce(part(page, 1), part(stage, 1)))
    for name, pattern, i in (("done", page, 2), ("total", page, 3), ("bytes", done, 1), ("pages", done, 2)):
        out = out.withColumn(name, part(pattern, i).cast("bigint"))
    return out.withColumn("path", part(done, 3)).withColumn("progress", progress())


def progress() -> Column:
    share = F.col("done") / F.col("total")
    pages = F.when(F.col("stage") == "jbig2", ENCODE_FROM + ENCODE * share).when(F.col("stage") == "binarize", share * BINARIZE).otherwise(share * OTHER_PAGES)
    return F.when((F.col("kind") == "P") & (F.col("total") > 0), pages).when((F.col("kind") == "S") & (F.col("stage") == "jbig2"), ENCODE_FROM).when((F.col("kind") == "S") & (F.col("stage") == "assemble"), ASSEMBLE).when(F.col("bytes").isNotNull(), 1.0)


def latest(decoded: DataFrame) -> DataFrame:
    """Per job its last progress and how many lines there were; the greatest (seq, progress) wins."""
    moved = F.col("progress").isNotNull()
    top = F.max(F.when(moved, F.struct("seq", "progress", "stage", "kind")))
    rows = decoded.groupBy("job").agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "DONE").alias("finished"), top.alias("top"))
    return rows.select("job", "lines", "finished", F.col("top.seq").alias("seq"), F.col("top.progress").alias("progress"), F.col("top.kind").alias("kind"), F.coalesce("top.stage", F.lit("")).alias("stage"))


def queue_counts(jobs: DataFrame, group: str) -> DataFrame:
    """Per group how many jobs wait, run, and are active, that is either."""
    waiting, going = F.col("state") == "waiting", F.col("state") == "running"
    return jobs.groupBy(group).agg(F.count_if(waiting).alias("waiting"), F.count_if(going).alias("running"), F.count_if(waiting | going).alias("active"))


def admit(jobs: DataFrame, order: str, concurrency: int) -> DataFrame:
    """The waiting jobs that may start now: first come first served, as many as running ones leave of ``concurrency``."""
    going = jobs.where(F.col("state") == "running").agg(F.count("*").alias("__going"))
    first = jobs.where(F.col("state") == "waiting").orderBy(order).limit(concurrency)  # bounded by the setting
    placed = first.withColumn("__rank", F.row_number().over(Window.orderBy(order)))
    return placed.join(F.broadcast(going), placed["__rank"] <= concurrency - going["__going"]).select(*jobs.columns)


def new_jobs(requests: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Requests that equal no active job, each once."""
    return requests.join(active.select(key).distinct(), key, "left_anti").dropDuplicates([key])


LENGTHS = "total long, above array<long>, left array<long>"


def what_lines_do(sizes: np.ndarray, limit: int, keep: int) -> tuple[int, np.ndarray, np.ndarray]:
    """What lines do to a log's length, as (total, above, left).

    A length over ``above[k]``, for the first such k, becomes ``left[k]``; one over none grows by ``total``. The bounds fall:
    a longer log is cut at an earlier line, and what follows a cut does not depend on what was before it.
    """
    upto, n = np.cumsum(sizes), len(sizes)
    total = int(upto[-1]) if n else 0
    follows = np.searchsorted(upto, upto + limit - keep, side="right").tolist()
    after = [0] * n
    for k in range(n - 1, -1, -1):
        after[k] = after[follows[k]] if follows[k] < n else keep + total - int(upto[k])
    first = min(n, int(np.searchsorted(upto, limit, side="right")) + 1)  # an empty log is cut here at the latest
    return total, limit - upto[:first], np.array(after[:first], dtype=np.int64)


def applied(length: np.ndarray, total: int, above: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A log's lengths after what lines do."""
    k = np.searchsorted(-above, -length, side="right")
    return np.where(k < len(above), np.append(left, 0)[k], length + total)


def one_after_other(first: tuple, then: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """Two such functions as one."""
    total, above, left = first
    # Over the first function's least bound it has cut already, and its own values go through the second.
    more = then[1] - total
    reach = more < (above[-1] if len(above) else np.iinfo(np.int64).max)
    at, value = np.append(above, more[reach]), np.append(applied(left, *then), then[2][reach])
    asked = 1 + int(np.searchsorted(-at, 0, side="right"))  # no log is shorter than empty
    return total + then[0], at[:asked], value[:asked].astype(np.int64)


def by_slice(rows: DataFrame, order: str, made: Callable[[pa.RecordBatch], tuple]) -> DataFrame:
    """What ``made`` makes of every (job, slice), its rows in order, as rows of job, slice and LENGTHS.

    Slices follow each other in sorted batches, so one pass serves any number of them: jobs of a line or two cost a line or
    two. Only a slice that goes on in the next batch is held.
    """
    schema = f"job {rows.schema['job'].dataType.simpleString()}, slice long, {LENGTHS}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(batch: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
            found = [made(batch.slice(lo, hi - lo)) for lo, hi in zip(cuts, cuts[1:])]
            keys = [batch.column(c).take(pa.array(cuts[:-1], pa.int64())) for c in ("job", "slice")]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[k]) for f in found)]), pa.int32()), pa.array(np.concatenate([f[k] for f in found]), pa.int64())) for k in (1, 2)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([f[0] for f in found], pa.int64()), *lists], names=["job", "slice", "total", "above", "left"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = held[-1] if held else None
            goes_on = last is not None and all(last.column(c)[last.num_rows - 1] == batch.column(c)[0] for c in ("job", "slice"))
            if held and not goes_on:
                one = pa.concat_batches(held)
                yield whole(one, [0, one.num_rows])
                held = []
            job, slice_ = batch.column("job"), batch.column("slice")
            new = pc.or_(pc.not_equal(job[1:], job[:-1]), pc.not_equal(slice_[1:], slice_[:-1]))
            cuts = (np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist()
            if held and cuts:
                one = pa.concat_batches([*held, batch.slice(0, cuts[0])])
                yield whole(one, [0, one.num_rows])
                held = []
            elif cuts:
                cuts = [0, *cuts]
            if len(cuts) > 1:
                yield whole(batch, cuts)
            held.append(batch.slice(cuts[-1]) if cuts else batch)
        if held:
            one = pa.concat_batches(held)
            yield whole(one, [0, one.num_rows])

    return rows.repartition("job", "slice").sortWithinPartitions("job", "slice", order).mapInArrow(scan, schema)


def length_functions(placed: DataFrame, limit: int, keep: int, width: int, fan: int) -> Iterator[DataFrame]:
    """Per job and slice of ``width`` lines what they do to a log's length, then that of ``fan`` slices in a row, twice."""

    def of_lines(rows: pa.RecordBatch) -> tuple:
        return what_lines_do(rows.column("n").to_numpy(), limit, keep)

    def of_slices(rows: pa.RecordBatch) -> tuple:
        parts = [[rows.column(c)[i].values.to_numpy() for i in range(rows.num_rows)] for c in ("above", "left")]
        made = None
        for each in zip(rows.column("total").to_pylist(), *parts):
            made = each if made is None else one_after_other(made, each)
        return made

    sliced = F.floor((F.col("at") - 1) / width).alias("slice")
    slices = by_slice(placed.select("job", sliced, "upto", "n"), "upto", of_lines)
    yield slices
    for over in (F.floor(F.col("slice") / fan), F.floor(F.col("slice") / fan), F.lit(0).cast("long")):
        slices = by_slice(slices.select("job", over.alias("slice"), F.col("slice").alias("place"), "total", "above", "left"), "place", of_slices)
        yield slices


def log_tail(lines: DataFrame, limit: int = 40000, keep: int = 30000, width: int = 65536, fan: int = 256) -> DataFrame:
    """Per job its log, cut to the last ``keep`` characters whenever it outgrows ``limit``; lines in order of seq.

    What is left depends on line lengths alone. A slice of a job's lines (``width`` of them) is a function from the log's
    length before it to that after it; functions of ``fan`` slices in a row are composed into one, level by level, and the
    last one is asked for an empty log. Only the lines that reach into what is left, at most ``limit`` characters, are put
    together. Lines of equal seq are taken by their text; a null line is empty.
    """
    sized = lines.where("job is not null").select("job", "seq", F.coalesce("line", F.lit("")).alias("line")).withColumn("n", (F.length("line") + 1).cast("bigint"))
    placed = running(sized, ["job"], "seq", ties=("line",), upto=("sum", F.col("n")), at=("sum", F.lit(1).cast("bigint")))
    *_, last = length_functions(placed, limit, keep, width, fan)
    cut = F.filter(F.arrays_zip("above", "left"), lambda x: x["above"] < 0)
    totals = last.select("job", "total", F.coalesce(F.get(cut, F.lit(0))["left"], F.col("total")).alias("left"))
    near = placed.join(totals, "job").where(F.col("upto") > F.col("total") - F.col("left"))
    tail = near.groupBy("job", "left").agg(F.array_sort(F.collect_list(F.struct("upto", "line"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return tail.select("job", F.right(text, F.col("left").cast("int")).alias("log"))


def framed_lines(chunks: DataFrame, job: str, seq: str, text: str) -> DataFrame:
    """Lines of byte streams that arrive in chunks: job, line_no (from 0), line and whole (false for one not ended yet).

    A line may reach over any number of chunks; it is put together from its pieces alone, so no job's stream is one row.
    """
    cut = chunks.select(F.col(job).alias("job"), F.col(seq).alias("seq"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("parts"))
    placed = running(cut, ["job"], "seq", before=("sum_before", (F.size("parts") - 1).cast("bigint")))
    each = placed.select("job", "seq", "before", F.size("parts").alias("k"), F.posexplode("parts").alias("i", "part"))
    pieces = each.select("job", (F.col("before") + F.col("i")).alias("line_no"), "seq", "part", (F.col("i") < F.col("k") - 1).alias("ended"))
    whole = pieces.groupBy("job", "line_no").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("p"), F.bool_or("ended").alias("whole"))
    line = F.array_join(F.transform("p", lambda x: x["part"]), "")
    return whole.select("job", "line_no", line.alias("line"), "whole").where(F.col("whole") | (F.col("line") != ""))
