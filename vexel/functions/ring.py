"""Placement on a consistent-hash ring: 128 points a shard, hashed with XXH64 of seed 0."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = 128


@lru_cache
def ring(shards: int) -> tuple[tuple[int, int], ...]:
    return tuple(sorted((xxhash.xxh64_intdigest(f"shard-{s}-vnode-{v}"), s) for s in range(shards) for v in range(POINTS)))


def shard_of(key: str, shards: int) -> int:
    from bisect import bisect_left

    points = ring(shards)
    at = bisect_left(points, (xxhash.xxh64_intdigest(key), -1))
    return points[at % len(points)][1]


def xxh64(key: Column) -> Column:
    """XXH64 with seed 0 of a string column, as a long; null for a null."""
    jvm = SparkContext._active_spark_context._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(jvm.scala.jdk.javaapi.CollectionConverters.asScala(jvm.java.util.List.of(bridge.expression(key.cast("string")._jc))).toSeq(), 0)
    return F.when(key.isNotNull(), Column(bridge.column(hashed)))


def shard_column(key: Column, shards: int) -> Column:
    """The shard of the first ring point at or after the key's hash, around the end; null for a null."""

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        points = ring(shards)
        at = np.searchsorted(np.array([h for h, _ in points], np.uint64), hashes.fillna(0).to_numpy().astype(np.int64).view(np.uint64))
        owners = np.array([s for _, s in points], np.int32)
        return pd.Series(owners[at % len(points)], dtype="Int32").where(hashes.notna())

    return place(xxh64(key))


def route(key: str, shards: int, nodes: list[str], placed: dict[int, list[str]] | None = None) -> tuple[int, str | None]:
    """The shard of a key and the first node that holds it: one that `placed` names for the shard, else the nodes in turn."""
    shard = shard_of(key, shards)
    held = (placed or {}).get(shard) or [nodes[shard % len(nodes)]] if nodes or (placed or {}).get(shard) else []
    return shard, held[0] if held else None


def replicas(shards: int, nodes: dict[str, list[int]]) -> dict[int, list[str]]:
    """The nodes of each shard: those that name it, then those that name none, which hold every shard."""
    return {s: [n for n, own in nodes.items() if s in own] + [n for n, own in nodes.items() if not own] for s in range(shards)}


def plan_rebalance(points: DataFrame, old_shards: int, new_shards: int) -> DataFrame:
    """shard_from, shard_to, points, moved: what a change of the number of shards moves and keeps."""
    placed = points.select(shard_column(F.col("id"), old_shards).alias("shard_from"), shard_column(F.col("id"), new_shards).alias("shard_to"))
    return placed.groupBy("shard_from", "shard_to").agg(F.count(F.lit(1)).alias("points")).withColumn("moved", F.col("shard_from") != F.col("shard_to"))


def rebalance_report(placed: DataFrame) -> DataFrame:
    """collection (null for the total), moved, kept, failed from rows collection, shard_from, shard_to; without a shard to go to, a row has failed."""
    count = lambda c: F.count(F.when(c, F.lit(1)))
    to, at = F.col("shard_to"), F.col("shard_from")
    sums = [count(to.isNotNull() & ~at.eqNullSafe(to)).alias("moved"), count(to.isNotNull() & at.eqNullSafe(to)).alias("kept"), count(to.isNull()).alias("failed")]
    return placed.rollup("collection").agg(*sums)
