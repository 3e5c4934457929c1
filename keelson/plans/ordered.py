"""Running values over ordered rows when one key may hold most of them.

A window partitioned by key alone puts a hot key into one task, and a window with no key
puts the table into one task. Here rows are cut into *chunks*, ranges of (keys, order columns)
with about equal bytes: a hot key fills many chunks, and many cold keys share one. One partial
aggregate per (key, chunk) is folded into the value carried into each chunk; a carried value
enters its chunk as a seed row that sorts first, so the detail rows are shuffled once, by
(key, chunk), and need no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 64 * 2**20
# so many borders at most, whatever the size of the table: they travel with the plan
MAX_CHUNKS = 32_768
# tuples drawn per chunk, so that a chunk misses its size by a fraction only, and bytes of them in all
_DRAWN_PER_CHUNK, _DRAWN_BYTES = 32, 64 * 2**20
_FORMATS = {
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "ignoreNullFields": "true",
}


@dataclass(frozen=True)
class Running:
    """``kind`` is sum, last, first, max or min; ``last``/``first`` skip NULLs."""

    kind: str
    value: Column
    inclusive: bool = True


def _bytes(col: Column, dtype: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, (T.StringType, T.BinaryType)):
            return F.aggregate(F.coalesce(col, F.array()), F.lit(16), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 8)
        return F.greatest(F.size(col), F.lit(0)) * 16 + 16
    if isinstance(dtype, T.StructType):
        out = F.lit(8)
        for f in dtype.fields:
            out = out + _bytes(col[f.name], f.dataType)
        return out
    return F.lit(64 if isinstance(dtype, T.MapType) else 8)


def _size(df: DataFrame, cols: list[str]) -> tuple[int, int, int]:
    """Rows, about how many bytes, and how many of them in ``cols``, in one pass."""
    width = {f.name: _bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    total = lambda names: F.coalesce(F.sum(sum((width[c] for c in names), F.lit(16)).cast("bigint")), F.lit(0))
    return df.agg(F.count(F.lit(1)), total(list(width)), total([c for c in width if c in cols])).first()


def _borders(df: DataFrame, cols: list[str], chunks: int, n: int, width: int) -> list[str]:
    """First tuples of all chunks but the first, as JSON: quantiles of a uniform draw of the rows.

    How many tuples reach the driver depends on ``chunks`` and their bytes only. Rows are drawn one by
    one, so a tuple that most rows share weighs what it holds.
    """
    wanted = min(_DRAWN_PER_CHUNK * chunks, max(chunks, _DRAWN_BYTES * n // max(1, width)))
    share = wanted / n
    drawn = df.select(*cols) if share >= 1 else df.select(*cols).sample(share, seed=17)
    at = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    found = [r["at"] for r in drawn.select(at.alias("at")).orderBy("at").select(F.to_json("at", _FORMATS).alias("at")).collect()]
    picked = [found[k * len(found) // chunks] for k in range(1, chunks)] if found else []
    # the first chunk has no border, and a tuple with the rows of several chunks is one border
    return [b for before, b in zip([found[0] if found else None, *picked], picked) if b != before]


def plan_chunks(df: DataFrame, order: list[str], rows_per_chunk: int | None = None, keys: list[str] = ()) -> Column:
    """Chunk expression with about equal bytes (or ``rows_per_chunk`` rows) per chunk.

    Borders are tuples of all key and order columns, taken from the rows themselves
    and compared as Spark compares structs, so NULLs, ties in the first columns and every
    orderable type are cut alike. They are part of the expression: every use cuts the same
    way. There are at least as many chunks as the session has shuffle partitions, if there are
    rows for them, and at most ``MAX_CHUNKS``: from there on chunks grow with the table, and their
    sorts spill. Only rows that agree in all these columns stay together at any size.
    """
    spark, cols = df.sparkSession, [*keys, *order]
    n, size, width = _size(df, cols)
    chunks = -(-n // rows_per_chunk) if rows_per_chunk else max(-(-size // CHUNK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = max(1, min(chunks, n, MAX_CHUNKS))
    borders = _borders(df, cols, chunks, n, width) if chunks > 1 else []
    if not borders:
        # a column, as a literal key would be dropped and leave the rows in one task
        return F.pmod(F.hash(*cols), F.lit(1)).cast("bigint")
    shape = T.ArrayType(T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(cols)]))
    # one literal text that folds to an array; any rounding in it moves a border but keeps the order
    table = F.from_json(F.lit("[" + ",".join(borders) + "]"), shape, _FORMATS)
    at = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    steps = [2**k for k in reversed(range(len(borders).bit_length()))]

    def advance(pos: Column, step: Column) -> Column:
        ahead = pos + step
        return F.when((ahead <= len(borders)) & (F.get(table, ahead - 1) <= at), ahead).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance).cast("bigint")


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    metrics: dict[str, Running],
    chunk: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add one running column per metric. ``order`` must be unique within a key."""
    names = list(metrics)
    vals = {n: f"__v_{n}" for n in names}
    base = df.select("*", *[metrics[n].value.alias(vals[n]) for n in names])

    def over(window_cols: list, frame_end: int, *first_orders: Column):
        ordering = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
        return (
            Window.partitionBy(*window_cols)
            .orderBy(*first_orders, *ordering)
            .rowsBetween(Window.unboundedPreceding, frame_end)
        )

    def apply(kind: str, v: str, w) -> Column:
        if kind in ("last", "first"):
            return getattr(F, kind)(F.col(v), ignorenulls=True).over(w)
        return getattr(F, kind)(F.col(v)).over(w)

    def finish(rows: DataFrame, window_cols: list, *first_orders: Column) -> DataFrame:
        out = {}
        for n in names:
            m = metrics[n]
            col = apply(m.kind, vals[n], over(window_cols, 0 if m.inclusive else -1, *first_orders))
            out[n] = F.coalesce(col, F.lit(0)) if m.kind == "sum" else col
        return rows.withColumns(out).drop(*vals.values())

    if chunk is None:
        return finish(base, list(keys) or [F.lit(0)])

    base = base.withColumn("__chunk", chunk)
    position = F.struct(*order)

    def summarise(n: str) -> Column:
        v = F.col(vals[n])
        kind = metrics[n].kind
        if kind in ("last", "first"):
            newest = (kind == "last") != descending
            pick = F.max_by if newest else F.min_by
            return pick(v, F.when(v.isNotNull(), position)).alias(vals[n])
        return getattr(F, kind)(v).alias(vals[n])

    per_chunk = base.groupBy(*keys, "__chunk").agg(*[summarise(n) for n in names])
    chunk_order = F.col("__chunk").desc() if descending else F.col("__chunk").asc()
    before = (
        Window.partitionBy(*(list(keys) or [F.lit(0)]))
        .orderBy(chunk_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # the first chunk of a key has nothing carried into it
    seeds = per_chunk.select(
        *keys,
        "__chunk",
        *[apply(metrics[n].kind, vals[n], before).alias(vals[n]) for n in names],
        F.lit(0).alias("__seed"),
        F.count(F.lit(1)).over(before).alias("__earlier"),
    )
    seeds = seeds.filter("__earlier > 0").drop("__earlier")
    rows = base.withColumn("__seed", F.lit(1)).unionByName(seeds, allowMissingColumns=True)
    done = finish(rows, [*keys, "__chunk"], F.col("__seed").asc())
    return done.filter("__seed = 1").drop("__seed", "__chunk")


def number_rows(
    df: DataFrame, order: list[str], name: str, keys: list[str] = (), chunk: Column | None = None
) -> DataFrame:
    """1, 2, 3… in order, per key or over the whole table."""
    return with_running(df, list(keys), order, {name: Running("sum", F.lit(1).cast("bigint"))}, chunk)
