"""A corpus from raw documents to token ids: toxic texts go, one of each group of near copies
stays, sources are mixed to their targets, and the mix is encoded.

Defined cases, each by the operator of the stage (see its docstring): null and empty texts are judged like others,
are near copies of nothing and weigh no words in the mix; rows with a null doc_id take part, and one of each of
their texts stays; repeated rows count once; without labels nothing is toxic; very long texts are read whole;
other columns are carried along until the last stage, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import mixing, near_dups, sentence_pieces, toxicity
from threadloom.llm.queries import piece_model
from threadloom.llm.shared import keep


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones among them, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dups.drop_near_duplicates(docs, keep(near_dups.near_duplicates(docs), "judged"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of every document of the mix, and its ids."""
    encoded = sentence_pieces.encode_documents(docs, piece_model())
    return sentence_pieces.digest_encoding(encoded, keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentence_pieces", pieces_stage),
]

#: MinHash groups are connected components and the classifier is trained: SQL can express neither.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
