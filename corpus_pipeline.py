"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each result as
Parquet to the shared folder, reads it back and deletes what no later stage reads. Stages but the last return the columns
of documents; extra columns of the input are left out.

Odd rows: a document without text fails the quality rules. A null id is never labelled, else such a document is like any
other: it is told by its text. Rows that share an id are documents of their own. Empty tables go through all stages and
give no rows. Very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, sweeping
from lumenreel.llm.decontam import without_items
from lumenreel.llm.line_dedup import without_boilerplate
from lumenreel.llm.ngram_jaccard import first_of_class
from lumenreel.llm.packing import packed
from lumenreel.llm.quality import kept_rows
from lumenreel.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, reach the log-likelihood threshold and hold no markers of toxic ones.

    A row is judged by its own text; rows with a labelled id are what the ratio is fitted on.
    """
    return kept_rows(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that are their source's boilerplate. One whose lines all go stays, with an empty text."""
    return without_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 0.8 of their five-word shingles.

    Documents without an id come after those with one; documents without words all stay.
    """
    return first_of_class(spark, docs, percent=80, size=5).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found: none that holds 0.8 of an item's five-word shingles."""
    return without_items(spark, docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. An empty text is its end token alone."""
    return packed(spark, docs, tokenizer_path(), most=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Hashed n-grams, exact near-duplicate classes and token ids can't be had in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of sf_dir."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with sweeping():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
