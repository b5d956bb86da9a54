"""Documents to packed sequences: toxic documents go, then repeated lines, near duplicates and benchmark passages.

Every stage takes null and empty texts, null and repeated ids, texts of any length, empty tables and further columns; all
but the last return the columns of the documents. What becomes of such rows stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, line_dedup, ngram_join, packing, toxicity
from quillon.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 under a model trained on the labelled ones.

    A null or empty text has the score of no words; repeated rows stay or go together. Without labels of both kinds all
    documents have one score: they stay if there are none, or none that is toxic.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are equal to an earlier one or, by one edit for ten characters, within two of it.

    Documents that were nothing else go. A null or empty text stays as it is; of a repeated row every line stays as in
    the first; a null id comes first in the order.
    """
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more on five-word shingles hold together, the smallest id.

    Texts without words and rows without an id link with nothing and stay, as do repeated rows of the id that stays.
    """
    return ngram_join.clean(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs.

    Null and empty texts stay; items without words have no windows; without items all documents stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 1024; one row per piece of a document.

    A null or empty text is the end id alone; repeated rows and rows without an id are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Training, hashing and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the table that the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:  # its rows have been read for the last time
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
