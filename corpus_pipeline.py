"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all that the one before it kept, and hands on rows with the columns of documents; the last returns the
pieces with their places in sequences. Other columns of the input, whatever their names, are left out by each stage. An empty
table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoflow.llm import jaccard, mixing, packing, quality, secrets
from convoflow.llm.common import DOCUMENT_COLUMNS, new_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go; null languages and sources are groups of their own; repeated rows are judged alike
    and stay repeated; a value on a threshold stays; long texts are measured whole.
    """
    return quality.quality(docs.select(*DOCUMENT_COLUMNS)).where("kept").select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Null ids come last; rows that repeat an id are told apart by their texts, and of equal rows one stays; a similarity of exactly
    0.8 links; texts without words (null ones too) are near to nothing and all stay; long texts are compared whole.
    """
    return jaccard.one_of_each(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked, and n_chars counted anew where one was.

    A null text has no secrets and stays null; null ids and repeated rows are rows like any other; spans that overlap or touch the
    same characters are one mask; long texts are searched whole.
    """
    found = secrets.scan(docs.select(*DOCUMENT_COLUMNS)).withColumn("_masked", secrets.masked(F.col("text"), F.col("spans")))
    chars = F.when(F.size("spans") > 0, F.length("_masked").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("_masked"), "n_chars": chars}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in DOCUMENT_COLUMNS])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most twice.

    Null and empty texts have no words and are never taken; a null source is the last; ties of size are taken by a seeded hash of
    the whole row, and of wholly equal rows as many as the plan says; a long text counts with all its words.
    """
    return mixing.mixed(docs.select(*DOCUMENT_COLUMNS), mixing.word_count()).select(*DOCUMENT_COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences.

    A null text is empty and still gives its end token; null ids stay null; rows that repeat (as the mix makes them) give their
    pieces again, each with a place of its own; only documents longer than a sequence are cut.
    """
    return packing.pack(packing.pieces(docs.select(*DOCUMENT_COLUMNS)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Stages rest on seeded hashes, a knapsack and a genetic algorithm: the tests hold them against brute force.
ORACLE_SQL = None
