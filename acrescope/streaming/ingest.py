"""Incremental ingest: only ids not seen before, safe to rerun."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acrescope.sources import bucketed


def ingest_batch(new: DataFrame, sink: str, keys: list[str], source: str, batch: int) -> None:
    """Append the rows of a batch whose key the sink does not hold; of rows with one key, the smallest by the other columns.

    The sink (``bucketed.read``) remembers the last batch of a source, so that a replayed one is
    known at once; under another source the key filters of its buckets say which files could
    hold a key of the batch, and only those are read.
    """
    bucketed.append_new(new, sink, keys, source, batch)


def ingest_available(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keys: list[str]) -> None:
    """Drain what lies in a folder as a file stream, then stop.

    The checkpoint remembers the files done, the sink the batches and ids done.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda df, epoch: ingest_batch(df, sink, keys, checkpoint, epoch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
