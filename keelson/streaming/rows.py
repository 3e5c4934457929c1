"""Streaming forms of expiry, exactly-once batches and key deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.times import with_event_time
from keelson.operators.diff import table_fingerprint
from keelson.operators.ledger import checksum_mismatch


def released(stream: DataFrame, ts: str, delay: str, whole_millis: bool = False) -> DataFrame:
    """Each row once the watermark (latest event time minus ``delay``) has passed its time.

    The native aggregation state is the buffer: it is spread by whole row, so no key can
    grow hot, and it holds the rows of the last ``delay`` only. Equal rows are counted and
    come out as often as they went in. Times count in whole milliseconds with ``whole_millis``,
    which lets the latest row out.
    """
    columns = stream.columns
    timed = with_event_time(stream, ts, "__at", delay, whole_millis)
    held = timed.groupBy("__at", *columns).agg(F.count("*").alias("__n"))
    return held.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "__n")).alias("__i")).drop("__i")


def expire_rows_stream(stream: DataFrame, ts: str, after: str) -> DataFrame:
    """The rows whose time to live ran out, each emitted when the watermark passes its expiry.

    The clock is the latest event time seen. A row that arrives after its expiry is dropped, or
    emitted at once if it was not late for the batch before.
    """
    return released(stream, ts, after)


def dedupe_stream(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Each key once, as long as its copies arrive within ``delay`` of each other."""
    return with_event_time(stream, ts, "__at", delay).dropDuplicatesWithinWatermark(key).drop("__at")


LEDGER_SCHEMA = "batch string, checksum string, run string, step bigint"
WARNING_SCHEMA = "batch string, checksum string, applied_checksum string, run string, step bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def batch_ledger(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/ledger", LEDGER_SCHEMA)


def batch_warnings(spark: SparkSession, root: str) -> DataFrame:
    """Batches that came again with other contents; they were not applied."""
    return _read(spark, f"{root}/warnings", WARNING_SCHEMA)


def apply_batches_once(
    batch: str, cols: list[str], root: str, run: str, part: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each named batch of rows once.

    Rows carry their batch name in column ``batch``. What is applied once is a batch, which
    then has to arrive within one micro-batch, or, with ``part`` (a column that names what
    never spreads over micro-batches, as the source file), each part of a batch: later parts
    of a batch are appended when they come. The checksum is an order-free sum over the rows.
    A batch (or part) already in the ledger is not applied again, and is warned about when its
    checksum changed. Everything is written under the run and epoch, so a repeated epoch
    overwrites its own output.
    """

    def apply(df: DataFrame, epoch: int) -> None:
        # three writes read the batch; a lost block is recomputed from the source
        df.persist()
        try:
            write(df, epoch)
        finally:
            df.unpersist()

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        folder = f"run={run}/step={epoch}"
        name = F.col(batch).cast("string")
        if part is not None:
            name = F.concat_ws("\n", name, F.col(part).cast("string"))
        df = df.withColumn("__unit", name)
        seen = table_fingerprint(df, ["__unit"], cols).select(
            F.col("__unit").alias("batch"), F.col("fingerprint").alias("checksum")
        )
        ledger = batch_ledger(spark, root).filter(~((F.col("run") == run) & (F.col("step") == epoch)))
        fresh = seen.join(ledger.select("batch"), "batch", "left_anti")
        changed = checksum_mismatch(seen, ledger, ["batch"])
        rows = df.join(fresh.select(F.col("batch").alias("__unit")), "__unit", "left_semi").drop("__unit")
        rows.write.mode("overwrite").parquet(f"{root}/rows/{folder}")
        changed.write.mode("overwrite").parquet(f"{root}/warnings/{folder}")
        # last: the ledger marks the batches as applied
        fresh.write.mode("overwrite").parquet(f"{root}/ledger/{folder}")

    return apply

