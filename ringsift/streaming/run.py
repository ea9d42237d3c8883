"""Starting streams: sources, checkpoints, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def with_event_time(df: DataFrame, ms: str | Column = "ts", delay: str = "1 day") -> DataFrame:
    c = F.col(ms) if isinstance(ms, str) else ms
    return df.withColumn("event_time", F.timestamp_millis(c)).withWatermark("event_time", delay)


def run_to_table(df: DataFrame, label: str, partition_by: list[str] | None = None, timeout: int | None = None,
                 partitions: int | None = None, base: str | None = None, idle_batches: bool = True) -> DataFrame:
    """Run a stream over all data that is there and give its output as a table.

    Output and checkpoint lie in the shared folder, or under ``base``, where a later run goes on; so the
    run survives lost executors and a restart goes on where it stopped. ``partitions`` is the number of
    state partitions, which the first start fixes: the session's default parallelism if not given.
    Without ``idle_batches`` only batches with data run: a job whose state lives by the clock would never
    be done otherwise. ``timeout`` in seconds stops a stream that takes longer with an error; off by default.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    base = base or scratch_path(spark, label)
    out, checkpoint = f"{base}/rows", f"{base}/checkpoint"
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    settings = {"spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
                "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = writer.option("path", out).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream {label} did not end within {timeout} s")
    return spark.read.schema(df.schema).parquet(out)
