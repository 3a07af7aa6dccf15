"""A corpus pipeline of five of the operators; each stage works on what its predecessor kept.

Documents whose language can't be told go; one document of each group of similar ones stays; words of
repeated passages go; documents that hold a benchmark item go; the rest is encoded. Each stage's result
is written and read again, so that a lost executor undoes a part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, decontaminate, jaccard_join, lang_id, substring_dedup
from tributary.llm.io import ready, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is determined; labels are learned from a bounded sample of them."""
    ready(spark)
    return lang_id.determined(docs, lang_id.learn(docs.where(~lang_id.held_out(F.col("doc_id")))))


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets connect: that of least doc_id."""
    ready(spark)
    return jaccard_join.one_of_each(docs)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that a document of a smaller doc_id has."""
    ready(spark)
    return substring_dedup.without_repeats(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, neither as written nor with other values."""
    ready(spark)
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    ready(spark)
    import public_tokenizers

    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_similar),
    ("substring_dedup", dedup_substrings),
    ("decontamination", decontaminate_benchmark),
    ("bpe", encode),
]

#: SQL can't express compression or the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
