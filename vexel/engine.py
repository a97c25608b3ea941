"""The engine: collections, mutations and searches in one place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ring import plan_rebalance, rebalance_report, shard_column
from .operators import dense, lexical, topk
from .plans.filters import compile_filter, index_bounds, is_empty, parse_filter, payload_variant
from .sources.store import Store, text_of
from .streaming.imports import import_stream
from .types import CollectionConfig, InvalidRequest, Mode, SearchRequest


@dataclass(frozen=True)
class Stored:
    """What a store keeps beside the points, each read only when a search needs it."""

    sparse: Callable[[], DataFrame]
    terms: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    index: Callable[[], tuple | None]


def run_search(points: DataFrame, config: CollectionConfig, request: SearchRequest, stored: Stored | None = None) -> DataFrame:
    """query_id, id, score, rank of one request over points (id, values, payload, sparse).

    The filter is applied to the points before the dense ranking, and to fused hits after it (filter_mode `pre` applies
    it to all lists). Each list has 2k hits before fusion. A mode whose index or query is missing gives an empty list.
    Points with index columns are cut by them first. Postings that are stored serve lists over all points; inverted lists
    serve a dense list without a filter if the request isn't for exact hits.
    """
    spark, k, mode = points.sparkSession, request.k, Mode.parse(request.mode)
    fetch = 2 * k
    rule = parse_filter(request.filter)
    bounds = index_bounds(rule, config.payload_indexes) if any(c.startswith("ix") for c in points.columns) else None
    near = points if bounds is None else points.where(bounds)
    allowed = points if is_empty(rule) else near.where(compile_filter(rule, payload_variant(F.col("payload"))))
    everything = is_empty(rule) or request.filter_mode != "pre"
    pool = points if everything else allowed
    empty = spark.createDataFrame([], dense.HIT_TYPE + ", rank int")

    def dense_hits():
        if request.vector is None or len(request.vector) != config.dimension:
            raise InvalidRequest(f"the query vector of {config.name} needs {config.dimension} numbers")
        query = spark.createDataFrame([(0, [float(x) for x in request.vector])], "query_id long, query array<double>")
        found = stored.index() if stored and not request.exact and is_empty(rule) else None
        if found is None:
            return dense.exact(allowed, query, config.metric, fetch)
        lists, changed, fresh = found
        return topk.merge_top_k([lists.search(query, fetch, request.probes, without=changed), dense.exact(fresh, query, config.metric, fetch)], fetch)

    def sparse_hits():
        if not config.sparse_enabled or not request.sparse:
            return empty
        query = spark.createDataFrame([(0, int(i), float(w)) for i, w in request.sparse.items()], "query_id long, idx long, weight double")
        return lexical.sparse_search(stored.sparse() if stored and everything else lexical.sparse_postings(pool), query, fetch)

    def bm25_hits():
        if not config.bm25_text_field or not request.text:
            return empty
        query = spark.createDataFrame([(0, request.text)], "query_id long, text string")
        if stored and everything:
            wanted = lexical.query_terms(query)
            return lexical.bm25_scores(*stored.terms(wanted), wanted, fetch)
        return lexical.bm25_search(pool.select("id", text_of(F.col("payload"), config.bm25_text_field).alias("text")), query, fetch)

    if mode is Mode.DENSE:
        hits = dense_hits()
    elif mode is Mode.SPARSE:
        hits = sparse_hits()
    elif mode is Mode.BM25:
        hits = bm25_hits()
    elif mode is Mode.RRF:
        hits = topk.rrf([dense_hits(), sparse_hits(), bm25_hits()], k)
    else:
        hits = topk.weighted(dense_hits(), [sparse_hits(), bm25_hits()], request.weight, k)
    if not is_empty(rule) and mode is not Mode.DENSE:
        hits = hits.join(allowed.select("id"), "id", "left_semi")
    hits = topk.ranked(hits.select("query_id", "id", "score"), fetch if request.raw_overfetch and is_empty(rule) else k)
    if request.filter_ids:
        hits = hits.where(F.col("id").isin(list(request.filter_ids)))
    return hits


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def create_collection(self, name: str, dimension: int, **settings) -> CollectionConfig:
        config = CollectionConfig.from_dict({"name": name, "dimension": dimension} | settings)
        self.store.create(config)
        return config

    def delete_collection(self, name: str) -> None:
        self.store.drop(name)

    def list_collections(self) -> list[str]:
        return self.store.names()

    def describe(self, name: str) -> dict:
        config = self.store.config(name)
        return {"name": name, "count": self.store.points(name).count(), "dimension": config.dimension, "metric": config.metric.value}

    def upsert(self, name: str, points: list[dict]) -> int:
        rows = [(i, str(p["id"]), [float(x) for x in p.get("values") or p["vector"]], p.get("payload"), p.get("sparse")) for i, p in enumerate(points)]
        df = self.spark.createDataFrame(rows, "at long, id string, values array<float>, payload string, sparse struct<indices:array<bigint>,values:array<float>>")
        return self.bulk_upsert(name, df, order="at")

    def bulk_upsert(self, name: str, points: DataFrame, order: str | None = None) -> int:
        return self.store.append(name, "upsert", points, order)

    def import_stream(self, name: str, source: str, checkpoint: str, **options):
        return import_stream(self.store, name, source, checkpoint, **options)

    def delete(self, name: str, ids: list[str]) -> int:
        return self.store.delete(name, ids)

    def get(self, name: str, id: str):
        return self.store.get(name, id)

    def scroll(self, name: str, cursor: str = "", limit: int = 256):
        return self.store.scroll(name, cursor, limit)

    def search(self, name: str, request: SearchRequest | None = None, **settings) -> DataFrame:
        store = self.store
        stored = Stored(lambda: store.sparse_postings(name), lambda terms: store.term_postings(name, terms), lambda: store.index(name))
        return run_search(store.points(name), store.config(name), request or SearchRequest(**settings), stored)

    def search_batch(self, name: str, queries: DataFrame, k: int = 10, filter: dict | None = None) -> DataFrame:
        config, points = self.store.config(name), self.store.points(name)
        rule = parse_filter(filter)
        return dense.batch(points if is_empty(rule) else points.where(compile_filter(rule, payload_variant(F.col("payload")))), queries, config.metric, max(1, k))

    def compact(self, name: str) -> dict:
        return self.store.compact(name)

    def snapshot(self, name: str) -> str:
        return self.store.snapshot(name)

    def snapshot_and_compact(self, name: str) -> dict:
        """A snapshot, a compaction, and a mark that the log before is in the snapshot."""
        id = self.store.snapshot(name)
        found = self.store.compact(name)
        self.store.checkpoint(name, id)
        return {"snapshot": id} | found

    def snapshots(self, name: str) -> list[dict]:
        return self.store.snapshots(name)

    def delete_snapshot(self, name: str, id: str) -> None:
        self.store.delete_snapshot(name, id)

    def restore(self, name: str, id: str) -> int:
        return self.store.restore(name, id)

    def reindex(self, name: str, lists: int = 16) -> int:
        """Builds and keeps the inverted lists anew; the number of points in them."""
        return self.store.reindex(name, lists)

    def plan_rebalance(self, name: str, old_shards: int, new_shards: int) -> DataFrame:
        return plan_rebalance(self.store.points(name), old_shards, new_shards)

    def rebalance(self, target: str, names: list[str], old_shards: int, new_shards: int, dry_run: bool = False, most: int | None = None) -> DataFrame:
        """Deals collections over `new_shards` stores below the target; collection (null for all), moved, kept, failed.

        Every shard's points become its store's collection. With dry_run nothing is
        written; `most` stops before the first collection that would bring the points moved above it.
        """
        spark, placed, moved = self.spark, None, 0
        for name in names:
            points = self.store.points(name).select("id", "values", "payload", "sparse").withColumns({"shard_from": shard_column(F.col("id"), old_shards), "shard_to": shard_column(F.col("id"), new_shards)})
            moves = points.where("shard_from <> shard_to").count()
            if most is not None and moved + moves > most:
                break
            moved += moves
            if not dry_run:
                for shard in range(new_shards):
                    store = Store(spark, f"{target}/shard-{shard}")
                    if name not in store.names():
                        store.create(self.store.config(name))
                    store.append(name, "upsert", points.where(F.col("shard_to") == shard).drop("shard_from", "shard_to"))
            own = points.select(F.lit(name).alias("collection"), "shard_from", "shard_to")
            placed = own if placed is None else placed.unionByName(own)
        if placed is None:
            placed = spark.createDataFrame([], "collection string, shard_from int, shard_to int")
        return rebalance_report(placed)

    def bootstrap(self, source: Engine) -> list[str]:
        """Copies the collections that the source has and this engine lacks; their names."""
        there = self.spark.createDataFrame([(n,) for n in source.list_collections()], "name string")
        here = self.spark.createDataFrame([(n,) for n in self.list_collections()], "name string")
        missing = sorted(r.name for r in there.join(here, "name", "left_anti").collect())
        return [n for n in missing if source.store.copy(n, self.store)]
