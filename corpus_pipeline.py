"""The corpus pipeline: toxicity, near duplicates, secrets, mixing to target weights, packing.

Every stage is one operator over all that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolith.llm import jaccard_join, mixing, packing, secrets, toxicity
from neurolith.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose worst window the network rejects.

    Null and empty texts stay; very long texts are judged whole; repeated rows and copies share their fate; an empty table
    gives an empty one; other columns pass through, whatever their names.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the least doc_id.

    Of null and empty texts one is left, and one of each other text without words; repeated rows become one, null ids give
    way to others; very long texts count whole; an empty table gives an empty one; other columns pass through, whatever
    their names.
    """
    return jaccard_join.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets give way to a mask; n_chars follows the text.

    No row goes. Null and empty texts stay as they are; very long texts are redacted whole; repeated rows alike; an empty
    table gives an empty one; other columns pass through, whatever their names.
    """
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as many times as epochs take them.

    Null languages and sources are a node of their own; texts without words are in where their place lies before the end of
    the budget; rows that share an id, null too, share its fate; an empty table gives an empty one; other columns pass
    through, whatever their names.
    """
    return mixing.keep_mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which bin.

    Documents without words (null texts too) have one row without a bin; very long ones are cut in pieces; repeated rows
    are packed each; an empty table gives an empty result; other columns are not looked at.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network decides in the first stage, which SQL cannot express. Tests compare the rows of each later stage, one
#: after the other, with brute force over what the stage before it kept, and hold the first to its own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
