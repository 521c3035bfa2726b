"""The pipeline stage by stage, each held against brute force on what the stage before kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import queries
from folioflow.llm.common import stored, table

from .test_operators import brute_components, brute_hits, brute_removed, check_packing, encoded


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, labels = docs.columns, {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    texts, stages = {r["doc_id"]: r["text"] for r in docs.collect()}, iter(corpus_pipeline.STAGES)

    def step():
        nonlocal docs
        name, stage = next(stages)
        docs = stored(stage(spark, docs, sf_dir), "test")
        return {r["doc_id"]: r for r in docs.collect()}

    scores = {r["doc_id"]: r["predicted"] for r in queries.op10_subword_quality(spark, sf_dir).collect()}
    kept = step()
    assert set(kept) == {i for i, p in scores.items() if p} and docs.columns == columns
    assert sum(i in kept for i, q in labels.items() if q) >= 0.95 * sum(labels.values())

    near = brute_components((i, texts[i]) for i in sorted(kept))
    kept = step()
    assert set(kept) == {i for i, (_, c) in near.items() if i == c} and all(kept[i]["text"] == texts[i] for i in kept)

    cut = brute_removed((i, texts[i]) for i in sorted(kept))
    kept = step()
    assert docs.columns == columns and set(kept) == set(cut)
    for i, r in kept.items():
        assert r["text"] == (cut[i][2] if cut[i][1] else texts[i]) and r["n_chars"] == len(r["text"])

    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    hits, now = brute_hits([(i, r["text"]) for i, r in kept.items()], items), kept
    kept = step()
    assert docs.columns == columns and set(kept) == {i for i, x in hits.items() if not x[-1]}
    assert 0 < len(kept) <= len(now)

    order = sorted(kept)
    step()
    check_packing(docs.collect(), dict(zip(order, encoded([kept[i]["text"] for i in order], 0))))


AWKWARD = [None, "", "  ", "word", "x" * 300_000, "many words " * 30_000, "a few words of one text", "a few words of one text"]


def awkward(spark, texts):
    """Rows with null and repeated ids, nulls in every column, and columns named as operators name theirs."""
    ids = [None if i % 5 == 4 else i % 6 for i in range(len(texts))]
    rows = [(i, t, None if k % 2 else "en", None, None if t is None else len(t), k, "mine", "mine", "mine") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, kept string, carried string, `end` string")


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, sf_dir, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = awkward(spark, AWKWARD)
    got = run(spark, docs, sf_dir)
    rows = got.collect()
    if stage < 4:
        assert got.columns == docs.columns and {r["part"] for r in rows} <= set(range(len(AWKWARD)))
        assert all(r["kept"] == r["carried"] == r["end"] == "mine" for r in rows)
    if name == "substring dedup":
        assert len(rows) == len(AWKWARD) and {r["part"]: r["text"] for r in rows}[0] is None
    if name == "minhash near-dedup":
        by_id = lambda part: (None if part % 5 == 4 else part % 6)
        assert {r["part"] for r in rows if r["doc_id"] is None} == {4}
        assert len({by_id(r["part"]) for r in rows}) >= 5
    if name == "benchmark decontamination":
        assert len(rows) == len(AWKWARD)
    if name == "best-fit packing":
        ids = encoded(AWKWARD, 0)
        assert sum(r["length"] for r in rows) == sum(map(len, ids)) and sum(r["piece"] == 0 for r in rows) == len(AWKWARD)
    empty = run(spark, docs.limit(0), sf_dir)
    assert empty.columns == got.columns and not empty.count()


def test_repeated_rows_go_through(spark, sf_dir):
    """Ten copies of a table's rows leave what one leaves, but for the number of copies of a kept id."""
    docs = table(spark, sf_dir, "documents").where("doc_id < 30")
    ten = docs.withColumn("copy", F.explode(F.array(*map(F.lit, range(10))))).drop("copy")
    once, often = ({r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, sf_dir).collect()} for d in (docs, ten))
    assert once == often
