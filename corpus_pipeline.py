"""The corpus pipeline: ``STAGES`` applied one after another, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes each stage's result to the shared folder and reads it back, so a lost
executor costs a stage's tasks and not the stages before it.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.llm import mixing, ngram_join, passages, pieces, quality
from jobflow.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; empty texts go with its score for them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs, labels).where("predicted = 1").select(docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Documents with a
    null id, and empty ones, have no group and stay."""
    joined = ngram_join.join_documents(docs)
    gone = joined.where("doc_id != component_id").select("doc_id").distinct()
    gone = written(gone, "near_copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; ``n_chars`` follows the text."""
    cut = passages.dedup_passages(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length)
    return cut.select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row per draw of a document."""
    return mixing.mix(docs).select(docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids per row of the mix."""
    return pieces.encode_table(docs.select("doc_id", "source", "lang", "text"))


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("passages", passages_stage),
    ("mix", mix_stage),
    ("pieces", pieces_stage),
]
#: the classifier is not SQL; tests hold every stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
