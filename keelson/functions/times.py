"""Event time that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(c: Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch; a time without zone is read as UTC."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def with_event_time(df: DataFrame, ts: str, name: str, delay: str, whole_millis: bool = False) -> DataFrame:
    """Add a watermarked TIMESTAMP column, which streams need for their clock.

    A watermark has whole milliseconds. With ``whole_millis`` the column has too, so that it
    passes the latest row of all.
    """
    at = micros(F.col(ts), df.schema[ts].dataType)
    if whole_millis:
        at = at - F.pmod(at, F.lit(1000))
    return df.withColumn(name, F.timestamp_micros(at)).withWatermark(name, delay)
