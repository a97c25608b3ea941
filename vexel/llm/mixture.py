"""Mixing sources to target weights: hash-random order, distributed prefix sums of token counts, exact budgets.

Within a source, documents stand in the order of a seeded hash. Prefix sums of their token counts (see _slices) say
where each begins; the source's budget is spent in whole epochs, and the last, partial epoch stops at the exact word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._slices import running_start
from ._tables import join_groups, n_words, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
KEY_BITS = 60


def _key(id_col: str, text_col: str, seed: str):
    """A hash-random place in [0, 2**60): the first 15 hex digits of an MD5, which SQL engines share; of the text where there is no id."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, max_epochs: float = EPOCHS, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources by code point, null last, weigh `weights`, repeating. They share `share` of all sizes by weight; none gets
    more than max_epochs times its size, and what is cut off is shared by weight among the others, until none is above.
    In the order of size by weight, the sources that stop are a prefix, so one pass of prefix sums finds the level. The
    windows run over one row for each source. A source of size 0 has target 0.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", pick).withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    every = Window.partitionBy()
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({
        "_budget": F.lit(float(share)) * F.sum("source_size").over(every),
        "_caps": F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)),
        "_rest": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)),
    }).withColumn("_level", (F.col("_budget") - F.col("_caps")) / F.col("_rest"))
    full = F.col("_w") * F.col("_level") >= F.col("_cap")
    held = summed.withColumn("_level", F.max(F.when(~full, F.col("_level"))).over(every))
    target = F.when(F.col("_level").isNull() | (F.col("_w") * F.col("_level") >= F.col("_cap")), F.col("_cap")).otherwise(F.col("_w") * F.col("_level"))
    return held.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: str = SEED, share: float = SHARE, max_epochs: float = EPOCHS, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, key (its place in the source's order) of each document.

    taken counts the words that the mix takes from the document: its size times the whole epochs, and in the last epoch
    the words before the source's budget ends. A source's taken words are its target rounded down. A null or empty
    text has size 0 and takes 0; a null source is a source. Repeated rows are documents of their own; which of two
    equal ones comes first makes no difference. An empty table gives an empty result. Other columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"), _key(id_col, text_col, seed).alias("_key"))
    per_source = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    aims = written(targets(per_source, share, max_epochs, weights).withColumnRenamed("source", "_source"))
    most = per_source.agg(F.max("_rows")).first()[0] or 0
    spread = F.col("_key") / F.lit(float(1 << KEY_BITS))
    placed = running_start(sized, "source", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("text_hash")], F.col("size"), "_before", most, spread)
    joined = join_groups(placed, aims, F.col("source").eqNullSafe(F.col("_source")), F.col("_key"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return joined.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), F.col("_key").alias("key"))


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: str = SEED, **options) -> DataFrame:
    """The mix itself: docs' rows with all columns, a row for each epoch that takes the document.

    Documents stay whole: one that the budget cuts is in if at least half of it is. As a source's order is that of the
    hash keys, one key for each source says which rows the last epoch takes, and no text is shuffled. Documents of
    size 0 go along with the others of their keys. Nulls and repeats as in mix().
    """
    plan = mix(docs, text_col, source_col, id_col, seed, **options)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    inside = F.col("taken") - epochs * F.col("size")
    cuts = plan.groupBy(F.col("source").alias("_source")).agg(F.first(epochs).alias("_epochs"), F.max(F.when((inside > 0) & (inside * 2 >= F.col("size")), F.col("key"))).alias("_cut"))
    inner = [f"_c{k}" for k in range(len(docs.columns))]
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)], F.col(source_col).alias("_of"), _key(id_col, text_col, seed).alias("_key"))
    joined = join_groups(keyed, written(cuts), F.col("_of").eqNullSafe(F.col("_source")), F.col("_key"))
    times = F.col("_epochs") + F.coalesce((F.col("_key") <= F.col("_cut")).cast("int"), F.lit(0))
    return joined.withColumn("_time", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, inner, strict=True)])


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+')) AS BIGINT) AS size, ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([3.0, 1.0, 2.0]::DOUBLE[])[CAST((n - 1) % 3 + 1 AS INT)] AS w FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
  FROM w WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (SELECT *, max(CASE WHEN NOT w * lev >= cap THEN lev END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR w * level >= cap THEN cap ELSE w * level END AS target FROM m),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken FROM p
"""
