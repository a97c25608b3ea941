"""The mutation log: rows seq, op (upsert or delete), id, values, payload, sparse; the state is its fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(log: DataFrame) -> DataFrame:
    """The last row of each id, without ids whose last row deletes them. One aggregation, combined before it moves."""
    rest = [c for c in log.columns if c not in ("seq", "id")]
    last = log.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("row"))
    return last.select("id", "row.*").where("op = 'upsert'").drop("op")


def numbered_chunks(points: DataFrame, size: int, order: str = "id") -> DataFrame:
    """points with chunk: rows in order, `size` to a chunk. For batches; the order is one sequence."""
    return points.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("int"))


def log_stats(log: DataFrame, chunk: int = 500) -> DataFrame:
    """entries_before, entries_after, live: what a compaction in chunks of points leaves."""
    live = fold(log).agg(F.count(F.lit(1)).alias("live"))
    return log.agg(F.count(F.lit(1)).alias("entries_before")).crossJoin(live).withColumn("entries_after", F.ceil(F.col("live") / chunk))


def latency_summary(values: DataFrame, column: str) -> DataFrame:
    """avg and nearest-rank p50, p95, p99 of a column, from exact counts of its distinct values."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    placed = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(every)})
    pick = lambda q: F.min(F.when(F.col("upto") > F.round((F.col("all") - 1) * q), F.col("x")))
    return placed.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("avg"), *[pick(q / 100).alias(f"p{q}") for q in (50, 95, 99)])


def histogram(values: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """le (null: no bound), count, sum: how many values are at most each bound, as cumulative buckets, and what they add up to."""
    edges = sorted(bounds)
    x = F.col(column)
    each = values.where(x.isNotNull()).agg(*[F.count(F.when(x <= b, 1)).alias(f"n{k}") for k, b in enumerate(edges)], *[F.sum(F.when(x <= b, x)).alias(f"s{k}") for k, b in enumerate(edges)], F.count(x).alias("n"), F.sum(x).alias("s"))
    row = lambda le, n, s: F.struct(F.lit(le).cast("double").alias("le"), F.col(n).alias("count"), F.coalesce(F.col(s), F.lit(0)).cast("double").alias("sum"))
    return each.select(F.inline(F.array(*[row(float(b), f"n{k}", f"s{k}") for k, b in enumerate(edges)], row(None, "n", "s"))))


def merged_by_id(*sources: DataFrame) -> DataFrame:
    """Rows of several sources with an id; of those with one id, that of the last source stays."""
    rest = [c for c in sources[0].columns if c != "id"]
    every = None
    for k, s in enumerate(sources):
        own = s.select("id", F.struct(*rest).alias("row"), F.lit(k).alias("seq"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("id").agg(F.max_by("row", "seq").alias("row")).select("id", "row.*")
