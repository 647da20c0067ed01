"""The corpus pipeline: quality, near copies, secrets, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import near, packing, quality, secrets
from eventloom.llm.common import cleared, forget, read, shared_dir, stored_at


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Texts without words, null ones too, are judged by the score of such a text; null ids are judged, and never learnt from;
    equal texts go or stay together; very long ones are read whole; an empty table stays empty; extra columns stay, whatever their names.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id.

    Repeated rows are copies; a row with a null id stays only if its group has no other id; null, empty and blank texts copy nothing
    and stay; very long ones are compared whole; an empty table stays empty; extra columns stay, whatever their names.
    """
    return near.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each secret in brackets in its place, and n_chars as it is then.

    Null and empty texts stay, with n_chars null and 0; every row stays, repeated rows and null ids too; very long texts are scanned
    whole; an empty table stays empty; extra columns stay, whatever their names.
    """
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in sequences of 1024.

    A null or empty text is one piece of the end mark; rows with null ids and repeated rows are packed like any other; very long
    texts are cut into pieces; an empty table gives no rows; extra columns are left out.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good), ("near copies", distinct), ("secrets", clean), ("packing", packed)]

#: The stages decide by a trained network and by tokens, which SQL cannot express: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each other stage returns is written to the shared folder and read again.

    A stage's own intermediate tables are deleted as soon as its result is written, and its predecessor's result with them.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with cleared(spark) as keep:
            docs = stored_at(stage(spark, docs, sf_dir), path)
            keep.append(path)
        if before is not None:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
