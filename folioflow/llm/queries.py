"""The registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bbit_minhash import near_duplicates
from folioflow.llm.boosted_rules import judge_documents
from folioflow.llm.common import table
from folioflow.llm.decontam import contamination_digest, find_contamination
from folioflow.llm.divergence_audit import audit_sources
from folioflow.llm.elias_fano import token_shards
from folioflow.llm.gif_media import media_features, stored_media
from folioflow.llm.html_paths import extract_main_text
from folioflow.llm.oracles import ORACLES  # noqa: F401  the registered SQL
from folioflow.llm.packing_lp import pack_documents
from folioflow.llm.period_runs import find_periodic_runs, run_digest, with_repeated_tails
from folioflow.llm.ppm_langid import identify_languages
from folioflow.llm.substring_dedup import drop_repeated_passages
from folioflow.llm.subword_quality import score_quality
from folioflow.llm.warc_bundles import archive_pages

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op2_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_elias_fano_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op4_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(stored_media(table(spark, sf_dir, "documents")))


def op6_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), with_bits=False)


def op7_configuration_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op12_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(find_periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_seekable_warc": op1_seekable_warc,
    "op2_tag_path_text": op2_tag_path_text,
    "op3_elias_fano_shards": op3_elias_fano_shards,
    "op4_prefix_filter_decontamination": op4_prefix_filter_decontamination,
    "op5_gif_media": op5_gif_media,
    "op6_ppm_language_id": op6_ppm_language_id,
    "op7_configuration_lp_packing": op7_configuration_lp_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_bbit_minhash": op9_bbit_minhash,
    "op10_subword_quality": op10_subword_quality,
    "op11_source_divergence": op11_source_divergence,
    "op12_boosted_rules": op12_boosted_rules,
    "op13_periodic_runs": op13_periodic_runs,
}
