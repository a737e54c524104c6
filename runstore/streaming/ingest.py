"""Structured Streaming into a store: each micro-batch becomes one commit, and a repeated one is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(ops: DataFrame, store: Store, checkpoint: str, source: str, order_by: str = "seq", maintain: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Start writing a stream of operations (key, is_tombstone, value, order_by) to ``store``.

    The manifest remembers the last batch of ``source``, so a batch replayed after a failure changes nothing. Batches
    are ordered as they arrive: a write that arrives later wins, whatever its event time. After each batch at most one
    merge of runs is done. The stream's state is the store itself; no watermark is needed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store.write_batch(batch.persist(), order_by, source, batch_id)
        batch.unpersist()
        if maintain:
            store.maintain()

    return ops.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
