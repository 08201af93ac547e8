"""A corpus pipeline of five operators, each stage over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import jaccard, packing, paragraphs, quality, rules
from lattica.llm.session import prepared, unused

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier does not reject (score of at least 0.3). Null and empty texts have the score of
    an empty one, equal texts equal scores; without labels all texts have one score. An empty table stays empty."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    name = unused(docs, "_score")
    return quality.scored(docs, quality.fit(docs, labels), name).where(F.col(name) >= 0.3).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the base rules and lie inside their language's perplexity band. Null, empty and short texts
    fail the base rules; equal texts of one language stay or go together; a null language is one of its own."""
    prepared(spark)
    return rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group: the one with the smallest id. Rows of one id stay or go together, and a
    null id stays."""
    prepared(spark)
    groups = jaccard.ngram_join(docs)
    return jaccard.without(docs, groups.where("component_id <> doc_id").select("doc_id").distinct().checkpoint())


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus; n_chars follows the text. A text that loses all its
    words goes; null and empty texts and rows of a null id stay as they are; rows equal in id and text are cut alike."""
    prepared(spark)
    return paragraphs.without_duplicates(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts that are left, packed into sequences of at most 2048 tokens; a null or empty text is one closing
    id, repeated rows are packed each, an empty table gives no sequence."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
