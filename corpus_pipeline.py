"""A training-data pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) that gives a DataFrame; :func:`run` writes each
result as Parquet to the shared folder and reads it again as the next stage's documents. All stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import written
from corpuscope.llm.fm_index import contamination
from corpuscope.llm.line_dedup import drop_templates
from corpuscope.llm.ngram_join import one_of_each_class
from corpuscope.llm.packing import pack_documents
from corpuscope.llm.quality import importance_sample
from corpuscope.llm.tokens import default_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go."""
    drawn = importance_sample(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drawn.where("__selected").select(*COLUMNS)


def _cut(docs: DataFrame, changed) -> DataFrame:
    """Texts after a cut: their length anew; a text that the cut has left without words goes."""
    left = docs.where(~(changed & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates."""
    return _cut(drop_templates(docs.select(*COLUMNS)), F.col("__n_dropped") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id; repeated rows are one."""
    return one_of_each_class(docs.select(*COLUMNS), 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of benchmark items."""
    found = contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    return _cut(found, F.size("__spans") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The classifier's weights and the tokenizer have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; gives the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
