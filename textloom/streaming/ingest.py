"""An index that follows a stream of documents: each micro-batch is a segment, added once under its batch number even
if the batch runs again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.segments import GrowingIndex


def stream_index(docs: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Starts the query; it ends when the documents that are there now are added. Search with
    ``GrowingIndex(spark, path).index()``."""

    def add(batch: DataFrame, number: int) -> None:
        GrowingIndex(batch.sparkSession, path).append(batch, id_col, text_col, number)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
