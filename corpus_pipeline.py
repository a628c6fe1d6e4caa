"""Corpus cleaning pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
documents (doc_id, text, lang, source, n_chars). A stage's rows are written as Parquet in the shared
folder and read again as the next stage's documents, so a lost executor costs one stage at most.

Defined cases are those of the operators: null and blank texts go at the first stage, copies keep
their document of least id, and extra columns of documents are carried along unread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.chosen_path import thinned
from brindle.llm.common import written
from brindle.llm.packing import pack
from brindle.llm.paragraph_dedup import duplicates, remove
from brindle.llm.quality_rules import clean
from brindle.llm.string_tiling import decontaminate


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that are rejected.

    Null, empty and blank texts are rejected (fewer than twenty words), as are texts that mostly repeat themselves;
    repeated rows and rows without an id are judged each; very long texts are judged whole; extra columns stay as they are."""
    return _measured(clean(docs))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: the one of least id, then of the least hash of its text.

    Rows without an id come last in that order; rows that share an id, or have none, are rows of their own unless their
    texts are similar; a row that is repeated whole stays once; texts without words are alone and all stay."""
    return thinned(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again are cut from all documents but the first that holds them.

    Null and blank texts, and those of fewer than 24 words, stay as they are; a text of which nothing is left goes; rows
    without an id, and rows that share one, are documents of their own and come last in the order of occurrence."""
    return _measured(remove(docs, duplicates(docs)))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text covers a benchmark item go; each row is judged by its own text, whatever its id.

    Null and empty texts meet nothing and stay, and so do all rows where the benchmark is empty."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; rows without an id come first; repeated rows are packed each; texts longer
    than a window lie in several pieces; no documents give no pieces. Columns that are not packed are not read."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [("quality", quality), ("jaccard", jaccard), ("passages", passages), ("benchmark", benchmark), ("packing", packing)]

# The stages' verification, components and packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
