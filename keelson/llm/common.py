"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(doc_id: Column, mod: int, missing: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a NULL id counts as ``missing``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod, F.lit(missing)).cast("int")


def lower_ascii(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

