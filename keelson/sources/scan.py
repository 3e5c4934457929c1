"""Reading a declared table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.specs import TableSpec


def scan_table(spark: SparkSession, spec: TableSpec, path: str | None = None, ordered: bool = False) -> DataFrame:
    """The insertable columns of a table, from ``path`` or the catalog.

    Computed and hidden columns never reach the scan. ``ordered`` range-partitions and
    sorts by the primary key.
    """
    df = spark.read.parquet(path) if path else spark.table(spec.name)
    df = df.select(*[c.name for c in spec.insertable()])
    return df.orderBy(*spec.primary_key) if ordered and spec.primary_key else df
