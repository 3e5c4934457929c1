"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from keelson.operators import diff, integrity, scripts
from keelson.operators.batching import batch_rows
from keelson.operators.evolve import expire_rows
from keelson.operators.ledger import ledger_transitions
from keelson.sources.bundle import assign_ids

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["normalize_labels", "parse_script_headers", "fingerprint_scripts", "extract_waivers", "older_than"])
def test_text_jobs_stay_in_the_jvm(spark, name):
    text = plan(entry_module.queries()[name](spark, SF))
    assert not re.search("Python|MapInPandas|ArrowEval", text)


def test_no_global_window_over_rows(spark):
    df = spark.range(100_000)
    for chunked in (batch_rows(df, ["id"], 100), assign_ids(df, 5, ["id"], "n"), batch_rows(df, ["id"], 100, chunk=F.floor(F.col("id") / 1000))):
        text = plan(chunked)
        singles = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
        # the only single task reads one row per chunk
        assert len(singles) == 1 and text.split(singles[0])[1].lstrip().splitlines()[0].strip().startswith("+- HashAggregate(keys=[__chunk")


def test_hot_job_is_spread_by_chunk(spark):
    rows = spark.range(1000).selectExpr("'d' AS database", "0 AS job", "id AS ts", "id AS event_id", "'start' AS action")
    text = plan(ledger_transitions(rows, chunk=F.floor(F.col("ts") / 10)))
    windows = [l for l in text.splitlines() if "Window [" in l and "event_id" in l]
    assert windows and all("__chunk" in w for w in windows)


def test_columns_and_filters_reach_the_scan(spark):
    child, parent = spark.read.parquet(f"{SF}/orders.parquet"), spark.read.parquet(f"{SF}/customer.parquet")
    df = integrity.fk_violations(child.select("o_orderkey", "o_custkey"), parent, ["o_custkey"], ["c_custkey"])
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_custkey)]" in text
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert set(schemas) <= {"o_orderkey:bigint,o_custkey:bigint", "o_custkey:bigint", "c_custkey:bigint"}


def test_diff_shuffles_hashes_not_rows(spark):
    a = spark.read.parquet(f"{SF}/customer.parquet")
    text = optimized(diff.table_diff(a, a.filter("c_custkey % 3 = 0"), ["c_custkey"]).filter("kind <> 'modified'"))
    assert "Join" not in text


def test_no_cross_joins_hints_or_local_checkpoints():
    import pathlib

    for path in pathlib.Path(entry_module.__file__).parent.glob("keelson/**/*.py"):
        code = path.read_text()
        for word in ("crossJoin", "localCheckpoint", "F.broadcast(", "toPandas", ".rdd."):
            assert word not in code, (path, word)


def test_no_query_plans_a_cross_product(spark):
    for name in ("suppress_issues", "retarget_dictionary", "latest_valid_checkpoint", "segment_log", "detect_dictionary_renames"):
        text = plan(entry_module.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_waiver_text_filter_is_applied_before_splitting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tables = docs.select("doc_id", F.lit("t").alias("table"))
    assert "StringContains(text" in plan(scripts.extract_waivers(docs, "doc_id", "text", tables))


def test_expiry_reaches_the_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for after in ("7 days", "1 month"):
        alive = expire_rows(events, "ts", after, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
        pushed = re.search(r"PushedFilters: \[(.*)\]", plan(alive))[1]
        assert "GreaterThan(ts" in pushed


def test_texts_are_told_apart_by_hash_before_they_move(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(integrity.unique_violations(docs, ["text"]))
    assert "Exchange hashpartitioning(__h1" not in text and "BroadcastHashJoin" in text
