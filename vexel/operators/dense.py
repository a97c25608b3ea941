"""Dense search: exact top-k by expressions or by numpy blocks; IVF lists for approximate search; recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..types import InvalidRequest, Metric
from .topk import ranked

#: Queries in one broadcast; more are answered block by block. Vectors that are scored at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 1024
#: Hits that a task of batch() holds, about, before it passes them on, and that get their own scores at once.
HELD_HITS, OWN_BLOCK = 1 << 20, 1 << 15
#: Where all pairs are returned: pairs of one task, about, and of one Arrow batch.
TASK_PAIRS, PAIR_BLOCK = 1 << 22, 1 << 18
HIT_TYPE = "query_id long, id string, score double"


def with_norm(points: DataFrame, column: str = "values") -> DataFrame:
    return points.withColumn("norm", V.norm(V.doubles(column)))


def exact(points: DataFrame, queries: DataFrame, metric: Metric | str, k: int) -> DataFrame:
    """query_id, id, score, rank of each query (query_id, query array<double>) over all points (id, values).

    At most QUERY_BLOCK queries are broadcast; more go the way of batch().
    """
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return batch(points, queries, metric, k)
    pairs = points.select("id", V.doubles("values").alias("v")).crossJoin(F.broadcast(queries.select("query_id", V.doubles("query").alias("q"))))
    return ranked(pairs.select("query_id", "id", V.score(F.col("v"), F.col("q"), metric).alias("score")), k)


def _scores(q: np.ndarray, v: np.ndarray, metric: Metric) -> np.ndarray:
    products = q @ v.T
    if metric is Metric.DOT:
        return products
    if metric is Metric.EUCLIDEAN:
        return 0.0 - np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * products, 0)
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
    if (size > 0).all():
        return np.divide(products, size, out=products)
    return np.divide(products, size, out=np.zeros_like(products), where=size > 0)


def _best(ids: np.ndarray, scores: np.ndarray, names: np.ndarray, k: int) -> pd.DataFrame:
    """Of each row of scores the k best, ties at the edge kept for the ranking to settle."""
    k = min(k, scores.shape[1])
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    row, at = np.nonzero(scores >= edge[:, None])
    return pd.DataFrame({"query_id": names[row], "id": ids[at], "score": scores[row, at]})


def _own_scores(q: np.ndarray, v: np.ndarray, metric: Metric) -> np.ndarray:
    """The score of each row of q with the same row of v. Unlike a matrix product's it rests on these two alone, so that equal vectors tie."""
    if metric is Metric.EUCLIDEAN:
        return 0.0 - ((q - v) ** 2).sum(1)
    products = (q * v).sum(1)
    if metric is Metric.DOT:
        return products
    size = np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1))
    return np.divide(products, size, out=np.zeros_like(products), where=size > 0)


def _above(top: np.ndarray, scores: np.ndarray, doubt: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that are not below their row's k best by more than doubt, after these have been brought up to date in top."""
    k, above = top.shape[1], ~(scores < top[:, :1] - doubt)
    if 8 * np.count_nonzero(above) > above.size:
        top[:] = np.partition(np.hstack([top, scores]), -k, axis=1)[:, -k:]
        return np.nonzero(~(scores < top[:, :1] - doubt))
    row, of = np.nonzero(above)
    if len(row):  # the hits alone, each row's from the left
        found, count = scores[row, of], np.bincount(row, minlength=len(top))
        some = np.flatnonzero(count)
        fresh = np.full((len(some), count.max()), -np.inf)
        fresh[np.repeat(np.arange(len(some)), count[some]), np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])] = found
        top[some] = np.partition(np.hstack([top[some], fresh]), -k, axis=1)[:, -k:]
        still = ~(found < (top[:, :1] - doubt)[row, 0])
        row, of = row[still], of[still]
    return row, of


def _passed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """Of the hits held those that are not below the least score that counts by now."""
    row, ids, score = (np.concatenate(x) for x in zip(*held, strict=True))
    still = ~(score < least[row])
    return pd.DataFrame({"query_id": names[row[still]], "id": ids[still], "score": score[still]})


def batch(points: DataFrame, queries: DataFrame, metric: Metric | str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """exact() by matrix products: blocks of queries travel to the points, a task passes on what is not below the k best so far."""
    metric, spark = Metric.parse(metric), points.sparkSession
    found = queries.select("query_id", V.doubles("query").alias("query"))
    out, names, rows = None, [], []

    def search(names, rows):
        shared = spark.sparkContext.broadcast((np.array(names, np.int64), np.array(rows)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            who, q = shared.value
            top, held = np.full((len(q), k), -np.inf), []  # of each query the least of the k best so far first; ties are kept for the ranking to settle
            size, most, doubt = np.linalg.norm(q, axis=1)[:, None], 0.0, 0.0
            for b in batches:
                for at in range(0, len(b), ROW_BLOCK):
                    part = b.iloc[at : at + ROW_BLOCK]
                    v = np.stack(part["v"].to_numpy())
                    # more than rounding moves a matrix product's scores, which find the hits; each hit then gets its own score
                    most = max(most, np.linalg.norm(v, axis=1).max())
                    doubt = 8 * np.finfo(float).eps * (q.shape[1] + 8) * {Metric.COSINE: 1.0, Metric.DOT: size * most, Metric.EUCLIDEAN: (size + most) ** 2}[metric]
                    row, of = _above(top, _scores(q, v, metric), doubt)
                    own = [_own_scores(q[row[x : x + OWN_BLOCK]], v[of[x : x + OWN_BLOCK]], metric) for x in range(0, max(len(row), 1), OWN_BLOCK)]
                    held.append((row, part["id"].to_numpy()[of], np.concatenate(own)))
                    if sum(len(x[0]) for x in held) > HELD_HITS:
                        yield _passed(held, (top[:, :1] - doubt)[:, 0], who)
                        held = []
            if held:
                yield _passed(held, (top[:, :1] - doubt)[:, 0], who)

        return points.select("id", V.doubles("values").alias("v")).mapInPandas(run, HIT_TYPE)

    for r in found.toLocalIterator(prefetchPartitions=True):
        names.append(r.query_id)
        rows.append(r.query)
        if len(names) == block:
            part = search(names, rows)
            out, names, rows = part if out is None else out.unionByName(part), [], []
    if names:
        part = search(names, rows)
        out = part if out is None else out.unionByName(part)
    # a query is in one block, so the hits of all are ranked at once, by one exchange
    return ranked(out, k) if out is not None else spark.createDataFrame([], HIT_TYPE + ", rank int")


def _grouped(vectors: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each length of vector the places that have it and their matrix; each vector's length, -1 if it is null; which hold a null."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    holed, groups = np.zeros(len(size), bool), []
    for n in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == n)
        flat = vectors.take(pa.array(at)).flatten()
        if flat.null_count:
            holed[at] = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), n).any(1)
        groups.append((at, flat.to_numpy(zero_copy_only=False).reshape(len(at), n)))
    return groups, size, holed


def _table(v: tuple, q: tuple, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """A row for each vector and a column for each query, both _grouped(): scores as V.score() has them, and which are null."""
    (mine, size, holed), (theirs, sizes, holeds) = v, q
    out = np.zeros((len(size), len(sizes)))  # lists of different lengths score 0
    with np.errstate(all="ignore"):
        for at, x in mine:
            for to, y in theirs:
                same = x.shape[1] == y.shape[1]
                if same and x.shape[0] == len(size) and y.shape[0] == len(sizes):
                    out = _scores(x, y, metric)
                elif same:
                    out[np.ix_(at, to)] = _scores(x, y, metric)
                if same or metric is Metric.COSINE:  # what isn't a number stays so
                    out[np.ix_(at[np.isnan(x).any(1)], to)] = np.nan
                    out[np.ix_(at, to[np.isnan(y).any(1)])] = np.nan
    void = (size < 0)[:, None] | (sizes < 0)[None]
    if holed.any() or holeds.any():
        void |= (holed[:, None] | holeds[None]) & ((size[:, None] == sizes[None]) | (metric is Metric.COSINE))
    return out, void


def pairs(points: DataFrame, queries: DataFrame, metric: Metric | str, digits: int, normal: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score of every query (query_id, query) with every point (id, values), by matrix products, rounded to so many digits.

    normal: between the least (0) and the greatest (1) score of the query_id, as topk.normalized() has it. A first pass finds
    these bounds, so that no pair is shuffled.
    """
    metric, spark = Metric.parse(metric), points.sparkSession
    blocks, names, rows = [], [], []

    def put():
        blocks.append((np.array(names, np.int64), _grouped(pa.array(rows, pa.list_(pa.float64())))))
        names.clear()
        rows.clear()

    for r in queries.select("query_id", V.doubles("query").alias("query")).toLocalIterator():
        names.append(r.query_id)
        rows.append(r.query)
        if len(names) == block:
            put()
    if names:
        put()
    if not blocks:
        return spark.createDataFrame([], HIT_TYPE)
    n = points.count() * sum(len(who) for who, _ in blocks)
    v, shared = points.select("id", V.doubles("values").alias("v")).repartition(max(1, -(-n // TASK_PAIRS))), spark.sparkContext.broadcast(blocks)

    def tables(batches: Iterator[pa.RecordBatch], step):
        """(number of the block, ids, scores, nulls)"""
        for b in batches:
            for k, (who, q) in enumerate(shared.value):
                for at in range(0, b.num_rows, rows := step(len(who))):
                    part = b.slice(at, rows)
                    yield k, part.column(0), *_table(_grouped(part.column(1)), q, metric)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.full(len(who), np.nan), np.full(len(who), -np.inf)) for who, _ in shared.value]
        for k, _, s, void in tables(batches, lambda _: ROW_BLOCK):
            low, high = found[k]
            np.fmin(low, np.fmin.reduce(np.where(void, np.nan, s)), out=low)  # what isn't a number is the greatest, as in SQL
            np.maximum(high, np.where(void, -np.inf, s).max(0), out=high)
        for (who, _), (low, high) in zip(shared.value, found, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(low), pa.array(high)], ["query_id", "low", "high"])

    ends = None
    if normal:
        of = {r.query_id: (r.low, max(r.high - r.low, 1e-6) if r.high == r.high else np.nan) for r in v.mapInArrow(bounds, "query_id long, low double, high double").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        ends = spark.sparkContext.broadcast([np.array([of[x] for x in who.tolist()]).T for who, _ in blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, ids, s, void in tables(batches, lambda n: max(1, PAIR_BLOCK // n)):
            who = shared.value[k][0]
            if ends is not None:
                low, span = ends.value[k]
                s = (s - low) / span
            s = np.copysign(np.floor(np.abs(s) * 10**digits + 0.5), s) / 10**digits + 0.0  # as round() in SQL
            at = pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), len(who)))
            score = pa.array(s.ravel(), mask=void.ravel() if void.any() else None)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(who, len(ids))), ids.take(at), score], ["query_id", "id", "score"])

    return v.mapInArrow(run, HIT_TYPE)


def check_dimension(points: DataFrame, dimension: int) -> DataFrame:
    """points, failing on a vector of another length."""
    return points.withColumn("values", F.when(F.assert_true(F.size("values") == dimension, F.lit(f"vectors must have {dimension} numbers")).isNull(), F.col("values")))


class Ivf:
    """Inverted lists: k-means centroids on the driver (lists * dimension numbers), and a row for each point and each of its two nearest lists.

    Rows have id, v, list and first, the nearest one. Saved, they lie in a folder for each list, and a search reads the
    lists that its queries probe alone.
    """

    def __init__(self, centroids: np.ndarray, rows: DataFrame, metric: Metric):
        self.centroids, self.rows, self.metric = centroids, rows, metric

    @classmethod
    def build(cls, points: DataFrame, lists: int, metric: Metric | str = Metric.COSINE, rounds: int = 8, fit_rows: int = 50_000, seed: int = 3) -> Ivf:
        """Centroids from at most fit_rows points, those of least hash; every point is assigned."""
        metric = Metric.parse(metric)
        rows = points.select("id", V.doubles("values").alias("v")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows).toPandas()
        if not len(rows):
            raise InvalidRequest("an index needs points")
        x = cls._scale(np.stack(rows["v"].to_numpy()), metric)
        centers = x[: min(lists, len(x))].copy()
        for _ in range(rounds):
            near = np.argmin(((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None]), axis=1)
            for c in range(len(centers)):
                if (near == c).any():
                    centers[c] = x[near == c].mean(axis=0)
        shared = points.sparkSession.sparkContext.broadcast(centers)

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            y = cls._scale(np.stack([np.asarray(r, float) for r in v]), metric)
            c = shared.value
            return pd.Series(list(np.argsort((c * c).sum(1)[None] - 2 * y @ c.T, axis=1, kind="stable")[:, :2].astype("int32")))

        assigned = points.select("id", V.doubles("values").alias("v")).withColumn("lists", nearest("v"))
        return cls(centers, assigned.select("id", "v", F.explode("lists").alias("list"), F.col("lists")[0].alias("first")), metric)

    def save(self, path: str) -> None:
        self.rows.write.partitionBy("list").parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark, path: str, centroids: list, metric: Metric) -> Ivf:
        rows = spark.read.schema("id string, v array<double>, first int, list int").parquet(f"{path}/lists")
        return cls(np.array(centroids), rows, metric)

    @staticmethod
    def _scale(x: np.ndarray, metric: Metric) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric is Metric.COSINE else x

    def search(self, queries: DataFrame, k: int, probes: int = 8, block: int = QUERY_BLOCK, without: DataFrame | None = None) -> DataFrame:
        """Blocks of queries travel to the points of the lists that they probe; a query meets a point in the first or second list of
        it that it probes. Scores are exact. The ids in `without` are left out."""
        centers, metric, scale, spark = self.centroids, self.metric, self._scale, queries.sparkSession
        out, names, rows = None, [], []

        def find(names, rows):
            q = np.array(rows, float)
            y = scale(q, metric)
            order = np.argsort((centers * centers).sum(1)[None] - 2 * y @ centers.T, axis=1, kind="stable")[:, :probes]
            probed = np.zeros((len(q), len(centers)), bool)
            np.put_along_axis(probed, order, True, axis=1)
            shared = spark.sparkContext.broadcast((np.array(names, np.int64), q, probed))

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                who, q, probed = shared.value
                for b in batches:
                    for c, own in b.groupby("list"):
                        some = np.flatnonzero(probed[:, c])
                        for at in range(0, len(own), ROW_BLOCK):
                            part = own.iloc[at : at + ROW_BLOCK]
                            first = part["first"].to_numpy()
                            # a point is met through its second list only where its first isn't probed
                            met = (first == c)[None] | ~probed[some][:, first]
                            hits = _best(part["id"].to_numpy(), np.where(met, _scores(q[some], np.stack(part["v"].to_numpy()), metric), -np.inf), who[some], k)
                            yield hits[np.isfinite(hits["score"])]

            here = self.rows.where(F.col("list").isin(np.flatnonzero(probed.any(axis=0)).tolist()))
            here = here if without is None else here.join(without.select("id"), "id", "left_anti")
            return ranked(here.select("id", "v", "list", "first").mapInPandas(run, HIT_TYPE), k)

        for r in queries.select("query_id", V.doubles("query").alias("query")).toLocalIterator():
            names.append(r.query_id)
            rows.append(r.query)
            if len(names) == block:
                part = find(names, rows)
                out, names, rows = part if out is None else out.unionByName(part), [], []
        if names:
            part = find(names, rows)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame([], HIT_TYPE + ", rank int")


def recall(truth: DataFrame, got: DataFrame, k: int) -> DataFrame:
    """One row: the share of the true k best that the first k of got have."""
    right = truth.where(F.col("rank") <= k).select("query_id", "id")
    both = right.join(got.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return both.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
