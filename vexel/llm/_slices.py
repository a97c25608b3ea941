"""Running sums over a hash order without one task that sees a whole key.

Rows of a key are dealt to slices of its hash range. Slices are summed, prefix sums over the few slices give each its
start, and only inside a slice are rows sorted. A key with a third of all rows takes a third of the slices' rows, still
spread over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a slice, about, until there are MAX_SLICES; beyond, slices grow instead, as a key's slices are summed in one task.
SLICE_ROWS, MAX_SLICES = 512, 20_000


def running_start(df: DataFrame, key: str, order: list[Column], amount: Column, name: str, n_rows: int, spread: Column) -> DataFrame:
    """Adds `name`: the sum of `amount` over the rows of `key` that come before in the order (slice of spread, order).

    spread is uniform in [0, 1) and must not depend on amount; equal keys are told apart by `order`.
    """
    slices = max(1, min(n_rows // SLICE_ROWS, MAX_SLICES))
    # never null, so that the sums are joined by the columns that the rows are already dealt by
    name_of = F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n"))
    dealt = df.withColumns({"_of": name_of, "_slice": F.floor(spread * slices).cast("int"), "_amount": amount.cast("long")})
    sums = dealt.groupBy("_of", "_slice").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy("_of").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_of", "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_of", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    joined = summed.join(starts, ["_of", "_slice"])
    return joined.withColumn(name, F.col("_start") + F.col("_inside")).drop("_slice", "_amount", "_inside", "_of", "_start")
