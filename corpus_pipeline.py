"""From raw documents to packed sequences: reject, deduplicate, clean, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` chains them over ``documents``. All but the last give the rows
of ``docs`` with its columns, whatever these are called.

Defined cases: a null text is scored, kept and packed as an empty one, and stays
null until it is packed; a null doc_id is kept by every stage, equals no other
and takes nothing from any; of rows equal in doc_id and text the second stage
keeps one; of near-duplicates the least doc_id stays, and of several texts under
that doc_id each; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumetra.llm import jaccard_join, packing, suffix_dedup, toxicity
from lumetra.llm.base import stored, table, tokenizer_file
from lumetra.llm.registry import split_pattern


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from the labels of documents that are left."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document of least doc_id."""
    return jaccard_join.first_of_each(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that documents of smaller doc_id hold."""
    return suffix_dedup.cleaned_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), split_pattern(), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("suffix-array dedup", cut_repeated_strings),
    ("best-fit packing", pack_sequences),
]

#: Tokenisation and model fitting are not SQL; tests hold each stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
