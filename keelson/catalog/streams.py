"""Streaming forms, run to the end of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.logs import _FOLD
from keelson.catalog.registry import query
from keelson.plans.durable import fresh_path
from keelson.streaming import rows as op
from keelson.streaming.ledger import ledger_state_stream, stream_moves, stream_states
from keelson.streaming.run import drain, read_stream, run_available

# the last watermark: the latest event time in whole milliseconds
_CLOCK = "(SELECT date_trunc('milliseconds', max(ts)) FROM events)"


@query(
    "ledger_state_stream",
    f"""
    WITH RECURSIVE {_FOLD}
    SELECT "database", job, event_id AS id, action, state_before, state_after, state_before <> state_after AS accepted
    FROM f
    """,
)
def _(t):
    moves = stream_moves(t.spark, _ledger_root(t)).withColumnRenamed("event_id", "id")
    return moves.select("database", "job", "id", "action", "state_before", "state_after", "accepted")


@query(
    "ledger_stream_states",
    f"""
    WITH RECURSIVE {_FOLD}
    SELECT "database", job, arg_max(state_after, (ts, event_id)) AS state
    FROM f WHERE state_before <> state_after GROUP BY ALL
    """,
)
def _(t):
    """The state per job that the stream has come to."""
    return stream_states(t.spark, _ledger_root(t)).select("database", "job", "state")


def _ledger_root(t) -> str:
    """The folder of a ledger stream that ran over all events."""
    events = read_stream(t.spark, t.folder, "events.parquet")
    action = F.expr(
        "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' "
        "WHEN 'view' THEN 'recover' ELSE 'retry' END"
    )
    attempts = events.select(
        F.concat(F.lit("db"), F.expr("user_id % 10")).alias("database"),
        F.col("user_id").alias("job"), "ts", "event_id", action.alias("action"),
    )
    root = fresh_path(t.spark, "ledger-stream")
    drain(ledger_state_stream(attempts, root), "ledger-stream", t.spark)
    return root


@query("expire_rows_stream", f"SELECT * FROM events WHERE ts + INTERVAL 7 DAY > {_CLOCK}")
def _(t):
    """What is left alive: the table without the rows the stream let expire."""
    gone = run_available(op.expire_rows_stream(read_stream(t.spark, t.folder, "events.parquet"), "ts", "7 days"), "expired")
    return t("events").join(gone.select("event_id"), "event_id", "left_anti")


@query("dedupe_stream", "SELECT * FROM events")
def _(t):
    """Every event twice in the stream, once in the result."""
    events = read_stream(t.spark, t.folder, "events.parquet")
    twice = events.unionByName(read_stream(t.spark, t.folder, "events.parquet"))
    return run_available(op.dedupe_stream(twice, ["event_id"], "ts", "60 days"), "deduped")


@query(
    "apply_batches_once",
    """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_rows, CAST(sum(user_id) AS BIGINT) AS users,
           dayofmonth(ts) % 4 = 0 AS warned FROM events GROUP BY ALL
    """,
)
def _(t):
    """Days of events as batches: applied, sent again, and sent again with other values."""
    root = fresh_path(t.spark, "batches")
    events = read_stream(t.spark, t.folder, "events.parquet").withColumn("day", F.col("ts").cast("date").cast("string"))
    changed = F.when(F.expr("dayofmonth(ts) % 4 = 0"), F.col("user_id") + 1).otherwise(F.col("user_id"))
    for run, stream in [("a", events), ("b", events), ("c", events.withColumn("user_id", changed))]:
        apply = op.apply_batches_once("day", ["event_id", "user_id", "event_type"], root, run)
        drain(stream.writeStream.foreachBatch(apply), "batches", t.spark)
    applied = t.spark.read.parquet(f"{root}/rows").groupBy("day").agg(
        F.count("*").alias("n_rows"), F.sum("user_id").alias("users")
    )
    warned = op.batch_warnings(t.spark, root).select(F.col("batch").alias("day")).distinct()
    flagged = applied.join(warned.withColumn("w", F.lit(True)), "day", "left")
    return flagged.select("day", "n_rows", "users", F.coalesce("w", F.lit(False)).alias("warned"))


@query("apply_split_batches", "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def _(t):
    """Days of events, each spread over four files that come one per micro-batch, and then again."""
    root, source = fresh_path(t.spark, "batches"), fresh_path(t.spark, "split-days")
    part = F.concat(F.lit("file-"), F.expr("event_id % 4").cast("string"))
    days = t("events").select("event_id", "user_id", F.col("ts").cast("date").cast("string").alias("day"), part.alias("file"))
    days.repartition(4, "file").write.parquet(source)
    for run in ("a", "b"):
        stream = read_stream(t.spark, source, "*.parquet", files_per_trigger=1)
        apply = op.apply_batches_once("day", ["event_id", "user_id"], root, run, part="file")
        drain(stream.writeStream.foreachBatch(apply), "batches", t.spark)
    return t.spark.read.parquet(f"{root}/rows").select("event_id", "user_id", "day")
