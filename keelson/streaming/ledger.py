"""The guarded ledger over a stream of attempted transitions.

Folder layout under ``root``, one ``step=<epoch>`` per micro-batch: ``released`` (rows the
watermark has passed), ``moves`` (their transitions and rejects), ``status`` (the state of
the jobs that moved). Every so many epochs ``snapshot/step=<epoch>`` has the state of all jobs
before that epoch, so that a micro-batch reads one snapshot and the few steps after it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.readwriter import DataStreamWriter

from keelson.operators.ledger import KEYS, ledger_transitions
from keelson.streaming.rows import released

EPOCHS_PER_SNAPSHOT = 16


def ledger_state_stream(
    stream: DataFrame,
    root: str,
    keys: list[str] = KEYS,
    ts: str = "ts",
    id: str = "event_id",
    delay: str = "0 seconds",
) -> DataStreamWriter:
    """A writer that folds the stream into ``root``; set trigger and checkpoint, then start.

    A row is applied once the watermark has passed it, so rows reach the fold in event-time
    order however they arrive; rows later than ``delay`` are dropped. Each micro-batch is
    folded by the batch operator, starting from the states so far, which spreads a hot job
    over tasks. A repeated epoch overwrites its own output.
    """
    keys = list(keys)
    states = T.StructType([stream.schema[k] for k in keys] + [T.StructField("state", T.StringType())])

    def fold(batch: DataFrame, epoch: int) -> None:
        spark, step = batch.sparkSession, f"step={epoch}"
        # written first: the stateful part of the query runs once per epoch
        batch.write.mode("overwrite").parquet(f"{root}/released/{step}")
        rows = spark.read.schema(batch.schema).parquet(f"{root}/released/{step}")
        known = _status(spark, root, states, keys, before=epoch)
        if epoch and epoch % EPOCHS_PER_SNAPSHOT == 0:
            known.write.mode("overwrite").parquet(f"{root}/snapshot/{step}")
            known = spark.read.schema(states).parquet(f"{root}/snapshot/{step}")
        moves = ledger_transitions(rows, keys, [ts, id], entry=known)
        moves.write.mode("overwrite").parquet(f"{root}/moves/{step}")
        moved = spark.read.schema(moves.schema).parquet(f"{root}/moves/{step}")
        last = moved.filter("accepted").groupBy(*keys).agg(F.max_by("state_after", F.struct(ts, id)).alias("state"))
        last.write.mode("overwrite").parquet(f"{root}/status/{step}")

    return released(stream, ts, delay, whole_millis=True).writeStream.outputMode("append").foreachBatch(fold)


def _status(spark: SparkSession, root: str, states: T.StructType, keys: list[str], before: int) -> DataFrame:
    """The state per job before epoch ``before``: the last snapshot and the steps since."""
    shape = T.StructType([*states, T.StructField("step", T.LongType())])
    since = (max(before - 1, 0) // EPOCHS_PER_SNAPSHOT) * EPOCHS_PER_SNAPSHOT
    try:
        steps = spark.read.schema(shape).parquet(f"{root}/status").filter(F.col("step").between(since, before - 1))
    except AnalysisException:
        return spark.createDataFrame([], states)
    if since:
        base = spark.read.schema(states).parquet(f"{root}/snapshot/step={since}")
        steps = steps.unionByName(base.withColumn("step", F.lit(-1).cast("bigint")))
    return steps.groupBy(*keys).agg(F.max_by("state", "step").alias("state"))


def stream_moves(spark: SparkSession, root: str) -> DataFrame:
    """Every transition and reject so far."""
    return spark.read.parquet(f"{root}/moves").drop("step")


def stream_states(spark: SparkSession, root: str, keys: list[str] = KEYS) -> DataFrame:
    """The current state per job."""
    status = spark.read.parquet(f"{root}/status")
    last = status.agg(F.max("step")).first()[0]
    return _status(spark, root, status.drop("step").schema, list(keys), last + 1)
