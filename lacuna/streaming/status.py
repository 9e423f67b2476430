"""Gap status from a stream of log entries: an optional extension, the batch operators being the main path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import state


def latest_status(stream: DataFrame, lateness: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Latest status per gap and window of event time; entries later than the watermark are left out by Spark."""
    marked = stream.withWatermark("ts", lateness)
    return marked.groupBy(F.window("ts", window), "gap_id").agg(F.max_by("status", F.struct("ts", "seq_no")).alias("status"))


def append_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps the latest status of every gap in versions below path, one for each micro-batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("gap_id", "ts", "seq_no", "status")
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/v={number - 1}").select("gap_id", "ts", "seq_no", "status"))
        last = new.groupBy("gap_id").agg(F.max_by(F.struct("ts", "seq_no", "status"), F.struct("ts", "seq_no")).alias("x")).select("gap_id", "x.*")
        last.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def summarise(path: str, spark, version: int) -> DataFrame:
    return state.summary(spark.read.parquet(f"{path}/v={version}"))
