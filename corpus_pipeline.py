"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``, in their order, whatever else those are. Other tables are read from ``sf_dir``. An empty table gives
an empty result. Rows without an id go through every stage; columns may have any name but those that begin
with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import decontamination, jaccard, packing, templates, toxicity
from corpuscope.llm.common import checkpoint, read
from corpuscope.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier predicts toxic go.

    Null and empty texts have the score of no words, and stay unless that is toxic; equal texts stay or go together.
    """
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across unlike documents go; every document stays, ``n_chars`` follows its text.

    Null stays null; a text of recurring lines alone becomes empty; repeated rows lose the same lines.
    """
    lines = "__dropped_lines"
    out = templates.drop_recurring(docs, lines)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(lines) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more, the one with the smallest id stays.

    Null texts and those without words are linked with nothing and stay; rows that repeat an id stay or go together.
    """
    return jaccard.keep_one(docs, n=5, theta=80)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; items without an id or a word count for nothing; repeated rows stay or go together.
    """
    return decontamination.remove_affected(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed: one row a piece. Null text is packed as empty; repeated rows are packed once each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_template_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", remove_benchmark_passages),
    ("packing", pack_sequences),
]

#: No stage but the last could be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)  # the next stage reads it more than once
    return docs
