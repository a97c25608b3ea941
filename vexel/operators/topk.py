"""Ranked lists: rows (query_id, id, score), best first, ties by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(lists: list[DataFrame]) -> DataFrame:
    """All rows. Lists that are partitioned by query_id into different numbers can't be appended as they are, so it is computed anew."""
    return reduce(DataFrame.unionByName, [x.withColumn("query_id", F.col("query_id") + F.lit(0).cast("long")) for x in lists])


def ranked(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query with their rank from 1; rows are cut in each task before they move."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_top_k(lists: list[DataFrame], k: int) -> DataFrame:
    """Ranked lists of several shards as one; an id that several have keeps its best score."""
    both = union([x.select("query_id", "id", "score") for x in lists])
    return ranked(both.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def rrf(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank). A query that one list alone answers keeps its raw scores."""
    both = union([x.select("query_id", "id", "score", F.lit(n).alias("list")) for n, x in enumerate(lists)])
    marked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("score"), F.asc("id"))))
    lists_of = F.size(F.collect_set("list").over(Window.partitionBy("query_id")))  # as many as there are lists, at most
    fused = marked.withColumn("answered", lists_of).groupBy("query_id", "id").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("fused"), F.first("score").alias("raw"), F.first("answered").alias("answered"))
    return ranked(fused.select("query_id", "id", F.when(F.col("answered") == 1, F.col("raw")).otherwise(F.col("fused")).alias("score")), k)


def normalized(hits: DataFrame) -> DataFrame:
    """Scores between the least (0) and the greatest (1) of their query's list; the span is 1e-6 at least."""
    every = Window.partitionBy("query_id")
    span = F.greatest(F.max("score").over(every) - F.min("score").over(every), F.lit(1e-6))
    return hits.withColumn("score", (F.col("score") - F.min("score").over(every)) / span)


def weighted(dense: DataFrame, lexical: list[DataFrame], alpha: float, k: int) -> DataFrame:
    """alpha times the dense list plus the rest times the lexical lists, each min-max normalised; later lexical lists win an id."""
    alpha = min(1.0, max(0.0, alpha))
    parts = [normalized(dense.select("query_id", "id", "score")).withColumn("score", F.col("score") * alpha)]
    if lexical:
        both = union([x.select("query_id", "id", "score", F.lit(n).alias("list")) for n, x in enumerate(lexical)])
        # normalised together before the repeats go
        one = normalized(both).groupBy("query_id", "id").agg(F.max_by("score", "list").alias("score"))
        parts.append(one.withColumn("score", F.col("score") * (1 - alpha)))
    return ranked(union(parts).groupBy("query_id", "id").agg(F.sum("score").alias("score")), k)


def restrict(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Hits whose id is among ids; applied after the cut, so a page may be short."""
    return hits.join(ids, "id", "left_semi")
