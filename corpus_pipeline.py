"""The corpus pipeline: language, exact copies, near copies, mixture, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet on the shared storage
and reads back as the next stage's ``docs``; a lost executor costs no more than one stage. All stages but the last return
the columns of ``documents``, in their order. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing
from medgrain.llm.common import fold, stored, table, tokenizer_file

#: Language identification and the mixture are learned or drawn, so SQL cannot express the whole; see tests/llm.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents in no language: null texts and texts without a letter. Languages are learned from the
    labelled documents outside the held-out fold."""
    langs, weights = language_id.fit(docs.where(fold(F.col("doc_id")) != 0))
    return language_id.keep_known(docs, langs, weights)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id`` stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links the one with the smallest ``doc_id`` stays."""
    return jaccard_join.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: cut or repeated by blocks."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and the digests of the ids and decoded bytes."""
    import public_tokenizers

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path), "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
