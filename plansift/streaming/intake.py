"""Uploaded pages flow into the stored index as they arrive.

The batch engine rebuilds everything after an upload; a stream of new pages only
has to index those pages.  Each micro-batch becomes one index segment under its own
number, so a batch replayed after a failure replaces itself; a page that is sent again
takes the place of its earlier version.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plansift.sources import text_index


def new_files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Stream of uploaded files as ``binaryFile`` rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return (spark.readStream.format("binaryFile").schema(schema)
            .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder))


def index_stream(pages: DataFrame, key: str, columns: list[str], path: str, checkpoint: str,
                 first_batch: int = 1) -> StreamingQuery:
    """Index every page of a stream that is there now, then stop."""
    def load(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            text_index.write_segment(batch, key, columns, path, first_batch + batch_id)

    return (pages.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
