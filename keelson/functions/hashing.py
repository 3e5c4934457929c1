"""Row hashes, and order-free sums of them that combine across partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_text(cols: list[Column]) -> Column:
    """One unambiguous text per row: every value is length-prefixed, NULL is its own mark."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("~;")).otherwise(
            F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(";"))
        )

    return F.concat(*[part(c) for c in cols])


def row_hash(cols: list[Column]) -> Column:
    return F.sha2(row_text(cols), 256)


def hash_number(hex_hash: Column, start: int = 1) -> Column:
    """60 bits of a hex hash as a decimal wide enough to sum over 10**19 rows."""
    digits = F.substring(hex_hash, start, 15)
    return F.conv(digits, 16, 10).cast("bigint").cast("decimal(20,0)")


def compare_hash(names: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same columns, NULL positions included."""
    values: list[Column] = []
    for n in names:
        values += [F.col(n), F.col(n).isNull()]
    return F.xxhash64(*values), F.xxhash64(F.lit("keelson"), *reversed(values))
