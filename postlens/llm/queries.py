"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlens.llm import (bpe, exact_dedup, html_template, langid, licenses, mixing, ngram_join, periodic_runs, pii, quality,
                          repetition, syncmers, whitening)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public.path(VOCABULARY), public.PATTERN).drop("text")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(_read(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_read(spark, sf_dir, "documents")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_read(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(_read(spark, sf_dir, "documents"), periodic_runs.looped))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_language_id, op3_source_mixing, op4_byte_bpe, op5_quality_classifier, op6_quality_rules,
    op7_document_fingerprints, op8_license_scan, op9_pii, op10_html_extraction,
    op11_embedding_whitening, op12_periodic_runs, op13_exact_dedup, pipeline)}

ORACLE_SQL = {"op3_source_mixing": mixing.SQL, "op8_license_scan": licenses.sql(),
              "op13_exact_dedup": exact_dedup.SQL}
