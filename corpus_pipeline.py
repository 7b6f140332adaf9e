"""Cleaning a corpus in four stages: toxic documents go, near copies go, documents that hold benchmark passages
go, and what is left is encoded. Each stage reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm import bpe, decontamination, ngram_jaccard, toxicity
from churnlake.llm.common import id_remainder, sha256_text, table
from churnlake.llm.queries import TOKENIZERS
from churnlake.session import new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The score learns from the labelled documents of this stage's input. Each row is
    judged by its own text, rows without id and rows that repeat one too; null and empty texts score as texts
    without any toxic word."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), train=id_remainder(F.col("doc_id")) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id, also
    among equal texts. Documents without id, or without words, belong to no group and stay; of rows that repeat an id
    all stay or go."""
    return ngram_jaccard.drop_near_copies(docs, ngram=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item. Each row is judged by its own text; null and
    empty texts hold no window and stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the text that they spell, of every row; a null text counts as the empty
    one, which has no ids."""
    coded = bpe.encode_decode(docs, f"{TOKENIZERS}/byte_bpe_50k.json")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", sha256_text(F.col("decoded")).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("encoding", encode),
]

#: What the stages learn (a classifier, token ids) cannot be stated in SQL; the tests hold the rows
#: against a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
