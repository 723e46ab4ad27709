"""Streams of ops and of prefix deletes into a catalogue.

Each micro-batch becomes one generation, published with the number of the batch; a batch that Spark hands over again after
a failure is recognised and skipped, so every op is in once. Order of arrival doesn't matter, sequences decide: merges keep
the delete markers and prefix deletes that late ops must meet, unless the catalogue's settings bound their lateness. Ops
and prefix deletes are two streams into one catalogue, in any order. A source that is faster than the catalogue waits:
``max_files`` bounds a batch, and the next one starts when its generation is published and merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from catalens.schemas import OPLOG_SCHEMA, TOMB_SCHEMA
from catalens.sources.catalog import Catalog
from catalens.sources.versioned import VersionConflict


def oplog_stream(spark, folder: str, max_files: int = 100) -> DataFrame:
    """Op rows of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(OPLOG_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def tombstone_stream(spark, folder: str, max_files: int = 100) -> DataFrame:
    """Prefix deletes of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(TOMB_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest(catalog: Catalog, stream: DataFrame, checkpoint: str, name: str = "ops", available_now: bool = True) -> StreamingQuery:
    """Start writing a stream of ops into the catalogue; every ``min_merge_count`` batches generations are merged."""

    def add(batch: DataFrame, number: int) -> None:
        if catalog.append_ops(batch, name, number) and (number + 1) % catalog.config.min_merge_count == 0:
            try:
                catalog.compact()
            except VersionConflict:
                pass  # another writer was faster; the next merge takes these in

    return _started(stream.writeStream.foreachBatch(add), checkpoint, name, available_now)


def ingest_tombstones(catalog: Catalog, stream: DataFrame, checkpoint: str, name: str = "prefix-deletes", available_now: bool = True) -> StreamingQuery:
    """Start writing a stream of prefix deletes into the catalogue."""
    return _started(stream.writeStream.foreachBatch(lambda batch, number: catalog.add_tombstones(batch, name, number) and None), checkpoint, name, available_now)


def _started(writer, checkpoint: str, name: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
