"""Graphics state and logs by slices, against folds in order."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import content, jobs
from folioflow.operators.scans import by_quantiles, ordinals, running
from folioflow.plans import stages
from folioflow.plans.closure import closure


def fold(ops):
    """The matrix at the first Do, with a stack."""
    now, saved = [1, 0, 0, 1, 0, 0], []
    for op, m in ops:
        if op == "q":
            saved.append(now)
        elif op == "Q" and saved:
            now = saved.pop()
        elif op == "cm":
            if m is None or len(m) != 6 or None in m:
                return None
            (a, b, c, d, e, f), (A, B, C, D, E, G) = m, now
            now = [a * A + b * C, a * B + b * D, c * A + d * C, c * B + d * D, e * A + f * C + E, e * B + f * D + G]
        elif op == "Do":
            return now
    return None


@pytest.mark.parametrize("width", [1, 3, 8, 4096])
def test_matrices_by_a_stack(spark, width):
    rng, rows, want = np.random.default_rng(width), [], {}
    for page in range(60):
        ops = []
        for _ in range(int(rng.integers(0, 70))):
            op = str(rng.choice(["q", "Q", "cm", "cm", "re", "Do"], p=[0.3, 0.3, 0.17, 0.1, 0.1, 0.03]))
            m = [float(x) for x in rng.integers(-2, 3, 6)] if op == "cm" and rng.random() < 0.99 else None
            ops.append((op, m))
        rows += [(page, 3 * i, op, m, "x") for i, (op, m) in enumerate(ops)]
        if (found := fold(ops)) is not None:
            want[page] = found
    df = spark.createDataFrame(rows, "page int, pos int, op string, m array<double>, slice string")
    got = {r["page"]: r["ctm"] for r in content.placement(df, "page", "pos", "op", "m", width).collect()}
    assert got == want and len(want) > 10
    assert content.placement(df.limit(0), "page", "pos", "op", "m").count() == 0


def test_a_page_of_many_operators_is_many_rows(spark):
    """200,000 operators of one page, nested and restored; slices of 512 positions."""
    n = 200_000
    i = F.col("id")
    op = F.when(i == n - 1, "Do").when(i % 4 == 0, "q").when(i % 4 == 2, "Q").otherwise("cm")
    m = F.array(*(x.cast("double") for x in (F.lit(1), F.lit(0), F.lit(0), F.lit(1), i % 4, F.when(i % 1000 == 3, 1).otherwise(0))))
    df = spark.range(n).select(F.lit("p").alias("page"), i.alias("pos"), op.alias("op"), m.alias("m"))
    got = content.placement(df, "page", "pos", "op", "m", 512).collect()
    # Those at 1 modulo 4 are undone by the Q after them; the last row is the Do.
    assert [r["ctm"] for r in got] == [[1.0, 0.0, 0.0, 1.0, 3.0 * (n // 4 - 1), float(n // 1000)]]


def log_of(lines, limit, keep):
    log = ""
    for line in lines:
        log += (line or "") + "\n"
        log = log[-keep:] if len(log) > limit else log
    return log


@pytest.mark.parametrize("limit, keep, width, fan", [(400, 300, 16, 2), (50, 1, 7, 3), (100, 100, 1, 2), (30, 29, 1000, 256), (40, 20, 5, 2)])
def test_logs_by_slices(spark, limit, keep, width, fan):
    rng = np.random.default_rng(limit + width)
    lines = {job: [None if rng.random() < 0.05 else "l" * int(n) + str(i) for i, n in enumerate(rng.integers(0, 60, int(rng.integers(1, 260))))] for job in range(12)}
    df = spark.createDataFrame([(j, i, x, "c") for j, mine in lines.items() for i, x in enumerate(mine)], "job int, seq int, line string, slice string")
    got = {r["job"]: r["log"] for r in jobs.log_tail(df, limit, keep, width, fan).collect()}
    assert got == {j: log_of(mine, limit, keep) for j, mine in lines.items()}
    assert jobs.log_tail(df.limit(0), limit, keep).count() == 0


def test_functions_of_lengths_compose():
    rng = np.random.default_rng(2)
    for _ in range(300):
        limit = int(rng.integers(1, 60))
        keep = int(rng.integers(1, limit + 1))
        parts = [rng.integers(1, 30, int(rng.integers(0, 12))) for _ in range(3)]
        made = [jobs.what_lines_do(p, limit, keep) for p in parts]
        both = jobs.one_after_other(jobs.one_after_other(made[0], made[1]), made[2])
        other = jobs.one_after_other(made[0], jobs.one_after_other(made[1], made[2]))
        for start in range(limit + 1):
            length = start
            for n in np.concatenate(parts).tolist():
                length = keep if length + n > limit else length + n
            assert jobs.applied(np.array([start]), *both)[0] == jobs.applied(np.array([start]), *other)[0] == length


def test_a_dead_writer_leaves_the_earlier_result(spark, tmp_path):
    place = str(tmp_path / "stages")
    with pytest.raises(FileNotFoundError):
        stages.read_stage(spark, place, "a")
    first = stages.write_stage(spark.range(5), place, "a")
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="dies"):
        stages.write_stage(broken, place, "a", force=True)
    assert stages.read_stage(spark, place, "a").count() == 5
    assert stages.write_stage(spark.range(3), place, "a", force=True).count() == 3 and first.count() == 5  # an open reader goes on
    assert stages.drop_snapshots(spark, place, "a", keep=2) == 1 and stages.drop_snapshots(spark, place, "a") == 1
    assert stages.read_stage(spark, place, "a").count() == 3 and stages.drop_snapshots(spark, place, "absent") == 0


def test_closure_through_one_midpoint(spark):
    """Many pairs through one node, circles, chains and repeated steps, against a search from every node."""
    rng = np.random.default_rng(9)
    steps = [(i, 500) for i in range(40)] + [(500, 600 + i) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))] + [(700 + i, 701 + i) for i in range(37)] + [(1, 500)] * 3
    want = set()
    for start in {a for a, _ in steps}:
        seen, waiting = set(), [start]
        while waiting:
            here = waiting.pop()
            for b in {b for a, b in steps if a == here} - seen:
                seen.add(b)
                waiting.append(b)
        want |= {(start, b) for b in seen}
    got = [tuple(r) for r in closure(spark.createDataFrame(steps, "a long, b long"), "a", "b").collect()]
    assert len(got) == len(want) and set(got) == want


def test_slices_follow_rows_of_any_order_column(spark):
    """Hashes, and times that crowd at one end; one group has a third of all rows and more."""
    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), F.xxhash64("id").alias("hash"), F.exp(F.rand(5) * 40).alias("late"), "id")
    for order in ("hash", "late"):
        sizes = [r["count"] for r in by_quantiles(df, order, 64).groupBy("__slice").count().collect()]
        assert len(sizes) == 64 and max(sizes) <= 2 * 100_000 / 64
    got = ordinals(df, ["g"], "hash", width=None, total="n").toPandas().sort_values(["g", "hash"])
    assert (got["ord"] == got.groupby("g").cumcount() + 1).all()
    assert (got["n"] == got.groupby("g")["id"].transform("size")).all()


def test_whole_group_values_and_edges_of_quantile_slices(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", None, 3), ("b", -7, None), (None, 1, 4)], "g string, k long, v long")
    out = running(df, ["g"], "k", None, ("v",), s=("sum", F.col("v")), t=("sum_all", F.col("v")), low=("min_all", F.col("k")), high=("max_all", F.col("k")))
    assert sorted(map(tuple, out.select("g", "v", "s", "t", "low", "high").collect()), key=str) == sorted([("a", 1, 4, 6, 5, 5), ("a", 2, 6, 6, 5, 5), ("a", 3, 3, 6, 5, 5), ("b", None, 0, None, -7, -7), (None, 4, 4, 4, 1, 1)], key=str)
    assert ordinals(df.limit(0), ["g"], "k", width=None).count() == 0
    assert {r["ord"] for r in ordinals(df.where("g = 'a' and k = 5"), ["g"], "k", width=None, ties=("v",)).collect()} == {1, 2}


def test_positions_and_totals_take_two_scans(spark, sf_dir):
    from folioflow.catalog import QUERIES

    for name in ("chunk_plan", "probe_grid", "progress_milestones"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2, name


def test_a_job_of_few_lines_is_one_slice_however_wide_its_numbers(spark):
    """A slice is a call in Python: lines far apart, as in an interleaved log of many jobs, must not cost one each."""
    lines = spark.range(3000).select((F.col("id") % 60).alias("job"), (F.col("id") * 100_003).alias("seq"), F.lit("x" * 30).alias("line"))
    sized = lines.withColumn("n", (F.length("line") + 1).cast("bigint"))
    placed = running(sized, ["job"], "seq", upto=("sum", F.col("n")), at=("sum", F.lit(1).cast("bigint")))
    made = [s.groupBy("job").count().select(F.count("*"), F.max("count")).first() for s in jobs.length_functions(placed, 400, 300, 2048, 2)]
    assert [tuple(m) for m in made] == [(60, 1)] * 4
    again = [s.count() for s in jobs.length_functions(placed, 400, 300, 7, 2)]
    assert again == [60 * 8, 60 * 4, 60 * 2, 60]
    want = log_of(["x" * 30] * 50, 400, 300)
    for width in (1, 7, 2048):
        got = jobs.log_tail(lines, 400, 300, width, 2).collect()
        assert len(got) == 60 and {r["log"] for r in got} == {want}


def test_a_task_of_a_closure_holds_few_pairs(spark, monkeypatch):
    """What a join fans out is dealt by its own size, not by that of its compressed input."""
    monkeypatch.setattr("folioflow.plans.closure.PAIRS_A_TASK", 100)
    steps = spark.range(1, 600).select(F.col("id").alias("a"), F.expr("id div 2").alias("b")).where("b > 0")
    found = closure(steps, "a", "b")
    want = {(k, k >> d) for k in range(1, 600) for d in range(1, 10) if k >> d}
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(want)
    assert found.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 400
