"""Lines of streams whose chunks are cut anywhere, over several triggers and restarts."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import jobs
from folioflow.streaming import progress


def test_lines_over_triggers_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = {job: "".join(f"@@P binarize {i + 1} 20\n" if rng.random() < 0.7 else "é long note " * int(rng.integers(0, 9)) + "\n" for i in range(20)) + "not ended" for job in (1, 2, 3)}
    chunks = []
    for job, text in texts.items():
        cuts = [0, *sorted(int(x) for x in rng.integers(0, len(text), 15)), len(text)]
        chunks += [(job, i, text[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    chunks.append((1, 50, None))
    folder, table, log = tmp_path / "in", str(tmp_path / "lines"), str(tmp_path / "log")
    folder.mkdir()
    every = spark.createDataFrame(chunks, "job long, seq long, text string")
    seen = []
    for k in range(4):  # each round is a run of its own; the first chunk of a round was delivered before
        here = [c for c in chunks if c[1] % 100 // 5 == k or (c[1] == 50 and k == 3)] + ([seen[-1]] if seen else [])
        seen += here
        for part in (0, 1):
            rows = sorted(here, key=lambda c: c[1])
            half = [c for c in rows if (c[1] % 5 < 3) == (part == 0)]
            (folder / f"{k}-{part}.json").write_text("".join(json.dumps(dict(zip(("job", "seq", "text"), c))) + "\n" for c in half) or "\n")
            got = progress.follow_lines(progress.read_chunks(spark, str(folder)), table, log)
    want = jobs.framed_lines(every, "job", "seq", "text").where("whole").select("job", "line_no", "line")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 60
    asked = lambda lines: sorted(map(tuple, jobs.latest(jobs.decode(lines.select("job", F.col("line_no").alias("seq"), "line"))).collect()))
    assert asked(got) == asked(want)
