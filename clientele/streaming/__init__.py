"""Streams.

The analyses this library rebuilds are batch analyses; there is no stateful
streaming operator among them. ``score_stream`` applies any operator chain of
this package to each micro-batch of a stream (``foreachBatch``): inside a
batch the DataFrame is a plain static one, so aggregating operators
(sentiment per document, location resolution, model scoring) work unchanged.
Each batch is written to its own ``epoch=<id>`` folder with overwrite, so a
batch that is retried after a failure replaces its earlier output instead of
duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def score_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                 fmt: str = "parquet", trigger_seconds: int | None = None):
    """Run ``transform`` on every micro-batch of ``stream`` and write the result
    under ``sink``. ``checkpoint`` must be a shared folder (it holds the stream's
    progress)."""
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        transform(batch).write.mode("overwrite").format(fmt).save(f"{sink.rstrip('/')}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
