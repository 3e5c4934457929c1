"""Running a streaming query to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.readwriter import DataStreamWriter

from keelson.plans.durable import fresh_path

def read_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the parquet files in ``folder`` whose name matches ``pattern``."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def drain(writer: DataStreamWriter, label: str, spark: SparkSession, checkpoint: str | None = None) -> None:
    """Run a ``foreachBatch`` writer over everything that is there."""
    query = (
        writer.option("checkpointLocation", checkpoint or fresh_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available(stream: DataFrame, label: str, output_mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process everything that is there and return what was written, as a batch table."""
    spark = stream.sparkSession
    out = fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint or fresh_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
