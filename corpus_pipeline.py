"""A corpus pipeline: toxicity, line deduplication, near-duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velofield.llm import decontamination, lines, near, packing, toxicity
from velofield.llm.labels import training_rows
from velofield.llm.queries import tokenizer_path
from velofield.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from the labels rejects go; null and empty texts stay, repeated rows fare alike.

    Columns other than those of documents are left behind, whatever their names; without labels nothing goes.
    """
    lexicon = toxicity.learn(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), lexicon)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that repeat stay at their first place only; every row stays, with what is left of its text.

    Null and empty texts, and rows with a null id, stay as they are.
    """
    found = lines.dedup_lines(docs, carry=("lang", "source"))
    return found.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    Null and empty texts and rows with a null id are in no group and stay; of rows with one id all stay or all go.
    """
    return near.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go; null and empty texts stay, repeated rows fare alike."""
    return decontamination.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents left, in sequences of 4096 along a space-filling curve; of null and empty texts the end id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-duplicates", dedup_near), ("decontamination", decontaminate), ("packing", pack)]

#: Automata, content-defined chunks, signatures and tokenizers are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
