"""8-bit codes by dimension: bounds of all vectors, or the bounds known when each arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import decode, encode


def _long(points: DataFrame, *keep: str) -> DataFrame:
    return points.select("id", *keep, F.posexplode("values").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def bounds(points: DataFrame) -> DataFrame:
    return _long(points).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def codes(points: DataFrame) -> DataFrame:
    """id, dim, x, code, decoded with the bounds of all vectors; the bounds have a row a dimension."""
    return _long(points).join(F.broadcast(bounds(points)), "dim").select("id", "dim", "x", encode(F.col("x"), F.col("low"), F.col("high")).alias("code"), "low", "high").withColumn("decoded", decode(F.col("code"), F.col("low"), F.col("high")))


def online_codes(points: DataFrame, order: str = "seq") -> DataFrame:
    """id, dim, code with the bounds of the vectors up to and with this one."""
    so_far = Window.partitionBy("dim").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _long(points, order).withColumns({"low": F.min("x").over(so_far), "high": F.max("x").over(so_far)})
    return rows.select("id", "dim", encode(F.col("x"), F.col("low"), F.col("high")).alias("code"))
