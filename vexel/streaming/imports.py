"""Streaming import: files of points become batches of the mutation log, each exactly once."""

from __future__ import annotations

from ..sources.store import Store
from ..types import POINT_SCHEMA


def import_stream(store: Store, collection: str, source: str, checkpoint: str, files_per_batch: int = 16, wait: bool = True):
    """Reads Parquet files of points from `source` until none is left; the batch's number makes a repeat harmless."""
    store.config(collection)
    stream = store.spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def put(rows, number):
        store.append(collection, "upsert", rows, batch=f"stream-{number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query
