"""One thin query per corpus operator, over its whole table with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import (
    decontaminate,
    html_extract,
    language_id,
    lexical_search,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    spelling,
    substring_dedup,
    toxicity,
)
from packetloom.llm.support import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.learn(pages))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network that learned from labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets are at least 80 % similar."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic spans and the score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.tag(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).drop("spans")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    return pii.replace(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes among sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, base rules and the verdict of the host, per document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that a document is of good quality."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows, or of texts too short for one."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_texts=True)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, word for word or with other parameters."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every text without passages of 400 bytes that also start elsewhere."""
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual form and the root of every word."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_language_id,
        op3_minhash_near_dedup,
        op4_toxicity_crf,
        op5_pii_surrogates,
        op6_best_fit_packing,
        op7_quality_rules,
        op8_quality_classifier,
        op9_line_dedup,
        op10_benchmark_decontamination,
        op11_suffix_array_dedup,
        op12_spelling_variants,
        op13_lexical_search,
    )
}

ORACLE_SQL = {
    "op3_minhash_near_dedup": near_dedup.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_suffix_array_dedup": substring_dedup.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
