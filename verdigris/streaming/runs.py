"""Starting streams and reading back what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from verdigris.session import scratch_path
from verdigris.sinks.keyed import KeyedTable

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files under ``path`` as a stream; new files are picked up in order of arrival."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def use_state_store(spark: SparkSession) -> None:
    """State on local disk with changelog checkpoints in the shared folder, so a lost executor only replays."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def append_all(stream: DataFrame, name: str, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Process what is there and stop; return everything written to the target so far.

    With the same checkpoint and target a later call continues where this one ended.
    """
    spark = stream.sparkSession
    use_state_store(spark)
    target = target or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def upsert_batches(target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that is safe to replay: a batch always overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def upsert_all(
    stream: DataFrame, name: str, keys: list[str], order: list[str], output_mode: str = "append", checkpoint: str | None = None, target: str | None = None
) -> DataFrame:
    """Process what is there and stop; return the newest row per key, merged into a ``KeyedTable`` batch by batch.

    Of an update stream the newest batch counts first, else ``order`` alone. A batch that is run again changes nothing. With
    the same checkpoint and target a later call continues where this one ended.
    """
    spark = stream.sparkSession
    use_state_store(spark)
    target = target or scratch_path(spark, name)
    table = KeyedTable(spark, target, stream.schema, keys, order, buckets=16, by_arrival=output_mode == "update")
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number, name) and None)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()
