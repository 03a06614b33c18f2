"""A training-corpus pipeline over the operators of larder.llm: each stage's output is written as
Parquet and read again as the next stage's documents.

Rows are judged one by one, also where they repeat a doc_id: a decision goes by doc_id and text. A null
text has no words: it is not toxic, has no copies and covers nothing, so it stays; a row without a
doc_id stays unless it is toxic. Empty tables give empty results; other columns are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.chosen_path import similarity_join
from larder.llm.packing import pack
from larder.llm.queries import byte_bpe, table
from larder.llm.scratch import Scratch, scope
from larder.llm.substring import drop_repeats
from larder.llm.tiling import contaminated
from larder.llm.toxicity import score_columns, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return score_columns(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("_hash", F.xxhash64(F.col("text").cast("string")))


def met(decided: DataFrame) -> tuple[DataFrame, Column]:
    """A table of (doc_id, text_hash) and the condition to join it with keyed rows on."""
    names = decided.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    return names, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_h"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, 0.8), the document with the least doc_id; of rows with
    the same doc_id and text, one. Near copies that share the least doc_id all stay."""
    found = Scratch(spark, "near-duplicates").keep(similarity_join(docs).select("doc_id", "text_hash", "class_id"))
    rest = keyed(docs).join(*met(found.where("doc_id <> class_id")), "left_anti")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not again.isEmpty():
        once = rest.join(*met(again), "left_semi").dropDuplicates(["doc_id", "_hash"])
        rest = rest.join(*met(again), "left_anti").unionByName(once)
    return rest.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat 50 or more in a row of a smaller doc_id. Those that lose
    nothing keep their text as it is; those that lose every word go."""
    cut = drop_repeats(docs, least=50, more=("lang", "source", "n_chars")).where("n_removed = 0 OR n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return keyed(docs).join(*met(found), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 ids: one row per piece."""
    return pack(docs, byte_bpe(), window=2048, end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

# No SQL: scores, random paths and tokens are not SQL's to express. tests/llm test the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage writes for itself goes when its output is
    written; the output goes when the next stage's is, but for the last, which the result reads."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scope():
            after = scratch.keep(stage(spark, docs, sf_dir))
        if i:
            scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
