"""Table sizes, and routing of expensive rewrites by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.specs import qualified

# Schemas that never count, and the default size of a large table.
SYSTEM_SCHEMAS = ("crdb_internal", "information_schema", "pg_catalog")
LARGE_TABLE_ROWS = 100_000

# Operations that are expensive on a large table, with the text that names them.
EXPENSIVE = {
    "create_index": "CREATE INDEX",
    "add_column_not_null_default": "ADD COLUMN with NOT NULL DEFAULT",
    "set_not_null": "SET NOT NULL",
    "add_foreign_key": "ADD CONSTRAINT",
    "add_check": "ADD CONSTRAINT",
    "alter_type": "ALTER COLUMN TYPE",
    "update": "UPDATE",
    "delete": "DELETE",
    "insert_select": "INSERT ... SELECT",
}


def table_sizes(tables: dict[str, DataFrame], threshold: int = LARGE_TABLE_ROWS) -> DataFrame:
    """Rows per ``schema.table``, largest first, with a ``large`` flag.

    The counts need no column, so a parquet table is counted from its footers.
    """
    limit = threshold if threshold > 0 else LARGE_TABLE_ROWS
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(qualified(name)).alias("table"), "rows")
        for name, df in tables.items()
        if qualified(name).split(".", 1)[0] not in SYSTEM_SCHEMAS
    ]
    sizes = reduce(DataFrame.unionByName, parts)
    return sizes.withColumn("large", F.col("rows") >= limit).orderBy(F.desc("rows"), "table")


def _expensive(ops: DataFrame, sizes: DataFrame) -> DataFrame:
    """The expensive operations on large tables, with their reason."""
    table = F.when(F.contains("table", F.lit(".")), F.col("table")).otherwise(F.concat(F.lit("public."), "table"))
    label = F.create_map(*[F.lit(x) for pair in EXPENSIVE.items() for x in pair])
    costly = ops.withColumn("table", table).filter(F.col("kind").isin(*EXPENSIVE))
    large = sizes.filter("large").select("table")
    link = F.when(F.col("kind") == "insert_select", " into large table ").otherwise(" on large table ")
    return costly.join(large, "table", "left_semi").select(
        "job", F.concat(F.element_at(label, F.col("kind")), link, "table").alias("reason")
    )


def route_reasons(ops: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct ``(job, reason)`` rows; a job with one is asynchronous."""
    return _expensive(ops, sizes).distinct()


def route_operations(ops: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(job, mode, expensive_ops)`` from planned operations ``(job, table, kind)``.

    One expensive operation on a large table makes the whole job async. A table without a
    size is not large. Counts are combined before the shuffle, so a job may have any number
    of operations.
    """
    jobs = ops.groupBy("job").agg(F.lit(0).cast("bigint").alias("n"))
    hits = _expensive(ops, sizes).groupBy("job").agg(F.count("*").alias("n"))
    merged = jobs.unionByName(hits).groupBy("job").agg(F.sum("n").alias("expensive_ops"))
    mode = F.when(F.col("expensive_ops") > 0, "async").otherwise("sync")
    return merged.select("job", mode.alias("mode"), "expensive_ops")
