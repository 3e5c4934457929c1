"""Ascending ranges of an integer id with about equal numbers of rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_ranges(df: DataFrame, key: str, rows_per_range: int) -> tuple[DataFrame, int]:
    """``df`` with its ``range`` (0, 1, ...), and the number of ranges; NULL is in range 0.

    Borders are quantiles over all rows, one per range, so what the driver holds is the number
    of rows divided by ``rows_per_range``. Equal ids are always in one range.
    """
    (rows,) = df.agg(F.count(F.lit(1))).first()
    n = max(1, -(-rows // rows_per_range))
    at = F.from_json(F.lit(json.dumps([k / n for k in range(1, n)])), "array<double>")
    borders = sorted(set(df.agg(F.percentile_approx(key, at, 100 * n)).first()[0] or [])) if n > 1 else []
    # halving steps over a literal array: as many as the borders have binary digits
    table = F.from_json(F.lit(json.dumps(borders)), "array<bigint>")
    found = F.lit(0)
    if borders:
        steps = [2**k for k in reversed(range(len(borders).bit_length()))]
        found = F.aggregate(
            F.from_json(F.lit(json.dumps(steps)), "array<int>"),
            F.lit(0),
            lambda pos, step: F.when(
                (pos + step <= len(borders)) & (F.get(table, pos + step - 1) <= F.col(key)), pos + step
            ).otherwise(pos),
        )
    return df.withColumn("range", found), len(borders) + 1
