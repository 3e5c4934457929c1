"""Cutting lineage through the shared checkpoint folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    A local master, as in tests, may leave it unset; the session's warehouse is used then.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
    sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later steps neither recompute nor lose ``df``."""
    spark = df.sparkSession
    shared_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: For rows of large packed bytes: a page is measured after every row, and not compressed again. By default a page is 100
#: rows at least, and its buffers for compressing and reading lie outside the heap.
PACKED = {"compression": "none"} | {f"parquet.page.size.row.check.{x}": "1" for x in ("min", "max")}


def written(df: DataFrame, label: str, compression: str | None = None, **options: str) -> DataFrame:
    """``df`` as a columnar table in the shared folder, for readers that want few columns."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
