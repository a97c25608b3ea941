"""A training corpus from `documents`: five stages, each over all that the one before kept, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import decontaminate, mixture, ngram_join, quality, shards
from vexel.llm._tables import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the row with the smallest id stays, null ids last.

    Rows are told apart by a number of their own, written with them: two texts may share an id or have none.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = ngram_join.similar_documents(rows, id_col=row)
    # a row without links stays
    linked = written(found.where("n_links > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias("_component")))
    stay = linked.join(rows.select(row, "doc_id"), row).groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    gone = linked.select(row).join(stay.select(row), row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch that takes the document."""
    return mixture.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with size, shard and slot."""
    return shards.assign_shards(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("sharding", sharding),
]
#: SQL can't fit the classifier or pack bins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
