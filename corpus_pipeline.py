"""A corpus pipeline of five stages; each works on all that the one before it kept.

language ID: texts without any language go. exact dedup: of equal texts the largest doc_id stays.
near dedup: of each group of near duplicates (five-word shingles, 0.8) the smallest doc_id stays.
decontamination: documents with a word inside a benchmark window go. packing: whole texts are
cut and packed into sequences. Null and empty texts go in the first stage; an empty table gives
an empty table at each stage; columns beyond those of documents are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, exact_dedup, langid, near_dedup, packing
from cairn.llm.common import scratch, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without null texts and texts without a letter; repeated rows and all columns stay."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text of docs, that with the largest doc_id; a null text is the empty one."""
    return exact_dedup.exact_dedup(docs, "largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates of docs; texts without words stay."""
    return near_dedup.near_dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without rows that hold a benchmark window; null texts and those without words stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all rows of docs, as op6_packing gives them; a null text has a piece of one id."""
    return packing.op6(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", decontaminated),
    ("packing", packed),
]

#: Language ID and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, stored; what the stages stored on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):
                # The next stage reads it; the table of the last one outlives both scratches.
                docs = stored(stage(spark, docs, sf_dir), name, keep=True)
        return stored(docs, "pipeline", keep=True)
