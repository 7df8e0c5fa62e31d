"""From raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``.

Defined cases are those of the operators: texts without a word or that are
null pass the quality classifier only by their score, are classes of their own
in the join, hold no personal data, are in no mix, and so never reach the
encoder; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import bpe, mixing, ngram_join, pii, quality
from postlens.session import scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learned from the labels of these documents, doesn't reject."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the shares of their sources' weights, some more than once."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mix, as little-endian unsigned 32-bit integers, and their digests."""
    import public_tokenizers as public

    out = bpe.round_trip(docs, public.path(VOCABULARY), public.PATTERN, keep="ids")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256",
                      (F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("restored"))


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_copies),
    ("personal data", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: Compression, chosen paths and belief propagation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"corpus-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
