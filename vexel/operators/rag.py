"""Retrieval for generation: ingest documents as embedded chunks, query by variants, fuse and rerank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..types import CollectionExists
from . import dense
from .topk import rrf


def chunk_points(documents: DataFrame, dimension: int, size: int = 512, overlap_chars: int = 64, embed=None) -> DataFrame:
    """Points id `document#i`, values, payload from documents (id, text, payload map or none); chunk keys win."""
    rows = documents.select("id", *(["payload"] if "payload" in documents.columns else []), F.explode(T.chunks(F.col("text"), size, overlap_chars)).alias("c"))
    own = F.map_from_arrays(F.array(F.lit("text"), F.lit("document_id"), F.lit("chunk_index")), F.array(F.col("c.text"), F.col("id"), F.col("c.idx").cast("string")))
    base = F.coalesce(F.map_filter("payload", lambda k, _: ~k.isin("text", "document_id", "chunk_index")), F.create_map().cast("map<string,string>")) if "payload" in documents.columns else F.create_map().cast("map<string,string>")
    return rows.select(F.concat_ws("#", "id", F.col("c.idx")).alias("id"), F.to_json(F.map_concat(base, own)).alias("payload"), F.col("c.text").alias("text")).withColumn("values", T.embedder(dimension, embed)("text")).select("id", "values", "payload")


def page_points(pages: DataFrame, dimension: int, text_field: str = "text", size: int = 1200, overlap_chars: int = 150, embed=None) -> DataFrame:
    """Points `source-00000`, values, payload (text, source, chunk, page, char_start, char_end) from pages (id: the source, page, text)."""
    rows = T.page_chunks(pages, size, overlap_chars)
    payload = F.struct(F.col("text").alias(text_field), F.col("id").alias("source"), F.col("idx").alias("chunk"), "page", "char_start", "char_end")
    return rows.select(F.concat_ws("-", "id", F.format_string("%05d", "idx")).alias("id"), F.to_json(payload).alias("payload"), "text").withColumn("values", T.embedder(dimension, embed)("text")).select("id", "values", "payload")


def rerank(hits: DataFrame, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """hits (query_id, id, score, query, text) by score plus word overlap; the score stays, ties keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("reranked"), F.desc("score"), "id")
    return hits.withColumn("reranked", F.col("score") + T.overlap(F.col(query_col), F.col(text_col))).withColumn("rank", F.row_number().over(order))


class RagPipeline:
    def __init__(self, engine, collection: str, dimension: int = 64, embed=None, size: int = 512, overlap_chars: int = 64):
        self.engine, self.collection, self.dimension, self.embed, self.size, self.overlap = engine, collection, dimension, embed, size, overlap_chars

    def ensure_collection(self) -> None:
        try:
            self.engine.create_collection(self.collection, self.dimension, bm25_text_field="text")
        except CollectionExists:
            pass

    def ingest(self, documents: DataFrame) -> int:
        self.ensure_collection()
        return self.engine.bulk_upsert(self.collection, chunk_points(documents, self.dimension, self.size, self.overlap, self.embed))

    def query(self, text: str, top_k: int = 5, reranked: bool = False) -> DataFrame:
        """query_id, id, score, rank, text: hits of the query's variants, fused by rank."""
        spark, points = self.engine.spark, self.engine.store.points(self.collection)
        one = spark.createDataFrame([(0, text)], "query_id long, query string")
        variants = one.select(F.posexplode(T.expand_query(F.col("query"))).alias("variant", "v")).select(F.col("variant").cast("long").alias("query_id"), T.embedder(self.dimension, self.embed)("v").alias("query"))
        hits = dense.exact(points, variants, self.engine.store.config(self.collection).metric, 2 * top_k)
        lists = [hits.where(F.col("query_id") == n).select(F.lit(0).cast("long").alias("query_id"), "id", "score") for n in range(variants.count())]
        fused = rrf(lists, top_k)
        found = fused.join(points.select("id", F.get_json_object("payload", "$.text").alias("text")), "id")
        return rerank(found.crossJoin(one.select("query"))).drop("query") if reranked else found
