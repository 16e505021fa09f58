"""Starting streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers lives in RocksDB, off the heap and with incremental checkpoints."""
    if spark.conf.get(STATE_STORE, "") != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)


def to_files(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append results to parquet files exactly once; without ``every`` handle what is there and stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Run ``work(batch, batch_id)``, which must give the same outcome when a batch is repeated."""
    return _triggered(stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint), every).start()


def _triggered(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
