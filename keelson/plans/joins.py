"""Equi joins in which NULL keys meet each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, NULL equal to NULL; the columns of ``left`` are kept once."""
    names = {c: f"__m{i}" for i, c in enumerate(cols)}
    side = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    pair = reduce(lambda a, b: a & b, [left[c].eqNullSafe(side[m]) for c, m in names.items()])
    return left.join(side, pair, how).drop(*names.values())
