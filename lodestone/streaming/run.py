"""Run a streaming query to the end of what is there and read its result as a table.

State and results live in the shared folder, so a lost executor or driver restarts from the last
committed batch. ``complete`` and ``update`` results go through ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import load
from lodestone.sources.tables import scratch


def event_stream(spark: SparkSession, folder: str, table: str = "events", ts: str = "ts") -> DataFrame:
    """A table's files as a stream; times without a zone become UTC instants, as watermarks need."""
    schema = load(spark, folder, table).schema
    # a pattern, as a plain path would have to be a folder and the table may be one file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/{table}.parque[t]")
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Process everything available and give the rows: all (append), the last state (complete) or all updates with ``batch``."""
    spark = stream.sparkSession
    out, state = scratch(spark, f"{name}-rows"), scratch(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state)
    schema = stream.schema
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(schema).parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:  # a batch that runs again writes its own folder again
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out)
