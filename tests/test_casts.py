"""Guarded casts agree with try_cast everywhere, borders included."""

import pytest
from pyspark.sql import functions as F

from keelson.functions.casts import cast_or_null

EDGES = [2**7, 2**15, 2**31, 2**63]
NUMBERS = [str(s * (e + d)) for e in EDGES for d in (-2, -1, 0, 1) for s in (1, -1)]
NUMBERS += ["0", "1.5", "-1.5", "99.994", "99.995", "-99.995", "100", "999.99", "1e3", "1e30", "NaN", "Infinity", "-Infinity", "12.345"]
TEXTS = NUMBERS + ["", " 12 ", "+7", "007", "x1", "1x", "\t5\n", "- 1", "1_000", "00000000000000000000012", "٣", None]


@pytest.mark.parametrize("source", ["string", "double", "float", "bigint", "int", "smallint", "decimal(38,3)", "decimal(10,2)"])
def test_guarded_cast_is_try_cast(spark, source):
    values = TEXTS if source == "string" else NUMBERS + [None]
    df = spark.createDataFrame([(v,) for v in values], "t string").selectExpr(f"try_cast(t AS {source}) AS v")
    dtype = df.schema["v"].dataType
    targets = ["tinyint", "smallint", "int", "bigint", "double", "decimal(4,2)", "decimal(10,2)", "decimal(38,0)", "string", "date"]
    if source not in ("string",):
        targets.remove("date")
    from pyspark.sql.types import DataType

    cols = []
    for t in targets:
        # try_cast turns 2**63 as a floating number into the largest bigint; here it does not fit
        rows = F.col("v").cast("string").isNull() | ~((F.col("v").try_cast("double") == 2.0**63) & F.lit(source in ("double", "float") and t == "bigint"))
        guarded = cast_or_null(F.col("v"), dtype, DataType.fromDDL(t)).cast("string")
        cols.append(F.count_if(rows & ~guarded.eqNullSafe(F.expr(f"CAST(try_cast(v AS {t}) AS string)"))).alias(t))
    assert set(df.agg(*cols).first()) == {0}
