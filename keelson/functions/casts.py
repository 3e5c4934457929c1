"""Conversions that yield NULL for a value that does not fit.

``try_cast`` raises and catches an exception per misfit on most numeric paths, which costs
more than everything else in a scan with many misfits. A cheap range or pattern test keeps
values that cannot fit away from it; values near a border still go through it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def stored_type(dtype: T.DataType) -> T.DataType:
    """The type values are kept in; a length limit is checked separately."""
    return T.StringType() if isinstance(dtype, (T.VarcharType, T.CharType)) else dtype


def cast_or_null(value: Column, source: T.DataType, target: T.DataType) -> Column:
    target = stored_type(target)
    whole = isinstance(source, tuple(_BITS))
    fraction = isinstance(source, (T.FloatType, T.DoubleType))
    if type(target) in _BITS:
        high = 2 ** (_BITS[type(target)] - 1)
        if whole:
            if _BITS[type(source)] <= _BITS[type(target)]:
                return value.cast(target)
            return F.when(value.between(-high, high - 1), value.cast(target))
        if fraction or isinstance(source, T.DecimalType):
            limit = F.lit(float(high) if fraction else Decimal(high))
            return F.when((value < limit) & (value >= -limit - 1), value.try_cast(target))
        if isinstance(source, T.StringType):
            digits = len(str(high))
            fits = F.rlike(value, F.lit(rf"^[\x00-\x20]*[+-]?0*[0-9]{{1,{digits}}}[\x00-\x20]*$"))
            return F.when(fits, value.try_cast(target))
    if isinstance(target, T.DecimalType):
        room = 10 ** (target.precision - target.scale)
        comparable = fraction or (isinstance(source, T.DecimalType) and room < 10**38) or (whole and room < 2**63)
        if comparable:
            limit = F.lit(float(room) if fraction else room if whole else Decimal(room))
            return F.when((value < limit) & (value > -limit), value.try_cast(target))
    return value.try_cast(target)
