"""The corpus pipeline: five training-data operators, each over all that the one before it kept.

Every stage takes any rows with the columns of documents, and more columns of any names: null and empty texts, null ids and
rows that share an id are rows like others, and an empty table gives an empty table. A null text scores as an empty one,
has no shingles, no windows and no hits, and is packed as its end id alone. Rows that share an id are linked as near-duplicates
and stay or go together; rows without an id stay. What each stage returns beyond this is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bbit_minhash import drop_near_duplicates
from folioflow.llm.common import drop_scratch, scratch_mark, stored, table
from folioflow.llm.decontam import drop_contaminated
from folioflow.llm.packing_lp import pack_documents
from folioflow.llm.queries import tokenizer_path
from folioflow.llm.subword_quality import keep_good_documents
from folioflow.llm.substring_dedup import drop_repeated_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from the labels of what is here, scores under 0.3."""
    return keep_good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of every group of near-duplicates."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words under repeated 20-word windows; a document that loses none stays as it is, one that loses all stays empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = drop_repeated_passages(docs, carry=(*others, "n_chars"), untouched_as_is=True, part_bytes=4 << 20)
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": chars} | {c: F.col(f"carried.`{c}`") for c in others}
    return cut.select(*(made[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids."""
    return pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Models, iteration and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each one's rows stored and read again by the next.

    What a stage wrote besides is deleted once its rows are stored.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = scratch_mark()
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop_scratch(spark, mark, docs)
    return docs
