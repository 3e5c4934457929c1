"""Streams over several files give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import ledger
from keelson.plans.durable import fresh_path
from keelson.streaming import rows as op
from keelson.streaming.ledger import ledger_state_stream, stream_moves, stream_states
from keelson.streaming.run import drain, read_stream, run_available

BASE = "timestamp_ntz'2024-01-01 00:00:00'"


@pytest.fixture(scope="module")
def folder(spark):
    """Three files; rows of neighbouring files overlap by some seconds, one row is very late."""
    rng = random.Random(2)
    actions = ["start", "fail", "retry", "fail", "retry", "recover", "complete"]
    path = fresh_path(spark, "stream")
    for f in range(3):
        rows = [(f * 40 + i, rng.choice([0, 0, 1, 2]), max(0, f * 100 + rng.randint(-20, 90)), rng.choice(actions)) for i in range(40)]
        if f == 2:
            rows[5] = (85, 1, 1, "complete")
        df = spark.createDataFrame(rows, "event_id bigint, job bigint, sec int, action string")
        df = df.selectExpr("'d' AS database", "job", "event_id", "action", f"{BASE} + make_dt_interval(0, 0, 0, sec) AS ts", "sec")
        df.coalesce(1).write.parquet(f"{path}/tmp{f}")
        spark.read.parquet(f"{path}/tmp{f}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return f"{path}/in"


def test_ledger_stream_equals_batch_fold(spark, folder):
    stream = read_stream(spark, folder, "*.parquet", files_per_trigger=1)
    root = fresh_path(spark, "led")
    drain(ledger_state_stream(stream, root, delay="40 seconds"), "led", spark)
    got = stream_moves(spark, root).collect()
    batch = spark.read.parquet(folder)
    clock = batch.agg(F.max("sec")).first()[0] - 40
    on_time = batch.filter((F.col("sec") <= clock) & (F.col("event_id") != 85))
    want = ledger.ledger_transitions(on_time).collect()
    assert {r.event_id: (r.state_before, r.state_after, r.accepted) for r in got} == {
        r.event_id: (r.state_before, r.state_after, r.accepted) for r in want
    }
    assert len(got) == len(want) > 50
    states = ledger.ledger_state(on_time).collect()
    assert {r.job: r.state for r in stream_states(spark, root).collect()} == {r.job: r.status for r in states}
    # every epoch after the first started from states, and more than one epoch moved jobs
    assert spark.read.parquet(f"{root}/status").select("step").distinct().count() > 1


def test_expiry_stream(spark, folder):
    stream = read_stream(spark, folder, "*.parquet", files_per_trigger=1)
    gone = run_available(op.expire_rows_stream(stream, "ts", "100 seconds"), "exp")
    batch = spark.read.parquet(folder)
    clock = batch.agg(F.max("sec")).first()[0]
    want = batch.filter(F.col("sec") + 100 <= clock)
    assert gone.columns == batch.columns
    # the row that arrives long after its expiry may be dropped or emitted at once
    kept = lambda df: sorted(tuple(r) for r in df.collect() if r.event_id != 85)
    assert kept(gone) == kept(want)


def test_equal_rows_expire_one_by_one(spark):
    path = fresh_path(spark, "stream")
    df = spark.sql(f"SELECT {BASE} AS ts, 'a' AS v FROM range(3) UNION ALL SELECT {BASE} + INTERVAL 1 DAY, 'b'")
    df.coalesce(1).write.parquet(path)
    gone = run_available(op.expire_rows_stream(read_stream(spark, path, "*.parquet"), "ts", "1 hour"), "exp")
    assert [r.v for r in gone.collect()] == ["a"] * 3


def test_dedupe(spark, folder):
    stream = read_stream(spark, folder, "*.parquet", files_per_trigger=1)
    twice = stream.unionByName(read_stream(spark, folder, "*.parquet", files_per_trigger=1))
    got = run_available(op.dedupe_stream(twice, ["event_id"], "ts", "1 day"), "dd")
    assert sorted(r.event_id for r in got.collect()) == list(range(120))


def test_a_repeated_epoch_overwrites_its_own_output(spark):
    root = fresh_path(spark, "once")
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "batch string, v int")
    apply = op.apply_batches_once("batch", ["v"], root, "r1")
    apply(df, 0)
    apply(df, 0)
    assert spark.read.parquet(f"{root}/rows").count() == 3
    apply(df.filter("batch = 'x'").unionByName(spark.createDataFrame([("y", 4), ("z", 5)], df.schema)), 1)
    assert sorted(r.v for r in spark.read.parquet(f"{root}/rows").collect()) == [1, 2, 3, 5]
    assert [r.batch for r in op.batch_warnings(spark, root).collect()] == ["y"]
    assert sorted(r.batch for r in op.batch_ledger(spark, root).collect()) == ["x", "y", "z"]


def test_parts_of_a_split_batch_are_all_applied(spark):
    root = fresh_path(spark, "split")
    rows = [("d1", "f1", 1), ("d1", "f1", 2), ("d1", "f2", 3), ("d2", "f2", 4)]
    df = spark.createDataFrame(rows, "batch string, file string, v int")
    for run in ("a", "b"):
        apply = op.apply_batches_once("batch", ["v"], root, run, part="file")
        for epoch, file in enumerate(["f1", "f2"]):
            apply(df.filter(F.col("file") == file), epoch)
    assert sorted(r.v for r in spark.read.parquet(f"{root}/rows").collect()) == [1, 2, 3, 4]
    apply(df.filter("file = 'f2' AND batch = 'd1'").withColumn("v", F.lit(9)), 7)
    assert [r.batch for r in op.batch_warnings(spark, root).collect()] == ["d1\nf2"]


def test_states_over_many_epochs_come_from_a_snapshot_and_a_few_steps(spark, monkeypatch):
    import keelson.streaming.ledger as module

    monkeypatch.setattr(module, "EPOCHS_PER_SNAPSHOT", 2)
    path = fresh_path(spark, "stream")
    actions = ["start", "fail", "retry", "complete", "start", "fail"]
    for i, action in enumerate(actions):
        sql = f"SELECT 'd' AS database, {i % 2} AS job, {i} AS event_id, '{action}' AS action, {BASE} + make_dt_interval(0, 0, {i}) + INTERVAL 0.000123 SECOND AS ts"
        spark.sql(sql).coalesce(1).write.mode("append").parquet(path)
    root = fresh_path(spark, "led")
    drain(ledger_state_stream(read_stream(spark, path, "*.parquet", files_per_trigger=1), root), "led", spark)
    want = ledger.ledger_state(spark.read.parquet(path)).collect()
    assert {r.job: r.state for r in stream_states(spark, root).collect()} == {r.job: r.status for r in want}
    # the newest event is folded too
    assert stream_moves(spark, root).count() == len(actions)
