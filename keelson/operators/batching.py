"""Fixed-size batches and unique names, in order, without one task holding a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.durable import cut
from keelson.plans.joins import match
from keelson.plans.ordered import Running, number_rows, plan_chunks, with_running


def batch_rows(
    df: DataFrame, order: list[str], n: int, partition: list[str] = (), name: str = "batch", chunk: Column | None = None
) -> DataFrame:
    """Add a batch number: ``n`` consecutive rows share one, the last batch may be short."""
    if chunk is None:
        chunk = plan_chunks(df, order, keys=list(partition))
    numbered = number_rows(df, order, "__rn", list(partition), chunk)
    return numbered.withColumn(name, F.expr(f"(__rn - 1) div {n}")).drop("__rn")


_SUFFIXED = r"(?s)^(.*)_([2-9]|[1-9][0-9]{1,17})$"


def dedupe_names(
    df: DataFrame, order: list[str], name: str, group: list[str] = (), out: str = "unique_name", chunk: Column | None = None
) -> DataFrame:
    """Add a name that is unique within its group.

    In row order the first use keeps its name and later ones get ``_2``, ``_3``… A leading
    digit gets ``_`` first. A number is skipped when its name was already used, and a name
    that a number produced before its own first use counts as used.
    """
    group = list(group)
    if chunk is None:
        chunk = plan_chunks(df, order, keys=[*group, name])
    base = F.when(F.rlike(name, F.lit("^[0-9]")), F.concat(F.lit("_"), name)).otherwise(F.col(name))
    named = df.withColumn("__base", base)
    rows = number_rows(named, order, "__rn", [*group, "__base"], chunk)
    bases = named.select(*group, "__base").distinct()
    parent, number = (F.regexp_extract("__base", _SUFFIXED, g) for g in (1, 2))
    kids = (
        bases.filter(F.rlike("__base", F.lit(_SUFFIXED)))
        .select(*group, F.col("__base").alias("child"), parent.alias("parent"), number.cast("bigint").alias("i"))
    )
    kids = cut(match(kids, bases.withColumnRenamed("__base", "parent"), [*group, "parent"], "left_semi"))
    if kids.isEmpty():
        unique = F.when(F.col("__rn") == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", "__rn"))
        return rows.withColumn(out, unique).drop("__base", "__rn")
    rows = cut(rows)
    solved = _settle(rows, kids, group, order)
    return _with_skips(rows, solved, group, order, out)


def _settle(rows: DataFrame, kids: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Decide for every natural name ``parent_i`` whether numbering ``parent`` took it first.

    Each round numbers with the answers of the round before; answers settle from the
    smallest number and the shortest name upwards, so the rounds end at the exact result.
    Only names that can collide take part.
    """
    times = rows.select(*group, "__base", "__rn", F.struct(*order).alias("at"))
    firsts = times.filter("__rn = 1").select(*group, F.col("__base").alias("child"), F.col("at").alias("first_at"))
    state = cut(match(kids, firsts, [*group, "child"]).withColumn("taken", F.lit(False)))
    parents = kids.select(*group, F.col("parent").alias("__base")).distinct()
    slots = cut(
        match(times, parents, [*group, "__base"], "left_semi").select(
            *group, F.col("__base").alias("parent"), F.col("__rn").alias("slot"), "at"
        )
    )
    while True:
        shift = state.filter("taken").select(*group, F.col("child").alias("parent"), F.lit(1).alias("shift"))
        skipped = with_running(
            state,
            [*group, "parent"],
            ["i"],
            {"skips": Running("sum", (~F.col("taken")).cast("bigint"), inclusive=False)},
            F.floor(F.col("i") / 1_000_000),
        )
        placed = match(skipped, shift, [*group, "parent"], "left").withColumn(
            "slot", F.col("i") - F.col("skips") - F.coalesce("shift", F.lit(0))
        )
        now = F.coalesce(F.col("at") < F.col("first_at"), F.lit(False))
        state = cut(
            match(placed, slots, [*group, "parent", "slot"], "left").select(
                *group, "parent", "child", "i", "first_at", "skips", F.col("taken").alias("was"), now.alias("taken")
            )
        )
        if state.filter("was <> taken").isEmpty():
            return state


def _with_skips(rows: DataFrame, solved: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    shift = solved.filter("taken").select(*group, F.col("child").alias("__base"), F.lit(1).alias("__shift"))
    uses = match(rows, shift, [*group, "__base"], "left").withColumn(
        "__e", F.col("__rn") + F.coalesce("__shift", F.lit(0))
    )
    skips = solved.filter("NOT taken").select(
        *group, F.col("parent").alias("__base"), (F.col("i") - F.col("skips")).alias("__e"), F.col("i").alias("__i")
    )
    both = uses.withColumns({"__use": F.lit(1), "__i": F.lit(0).cast("bigint")}).unionByName(
        skips.withColumn("__use", F.lit(0)), allowMissingColumns=True
    )
    counted = with_running(
        both,
        [*group, "__base"],
        ["__e", "__use", "__i"],
        {"__k": Running("sum", (F.col("__use") == 0).cast("bigint"))},
        F.floor(F.col("__e") / 1_000_000),
    ).filter("__use = 1")
    numbered = F.concat_ws("_", "__base", F.col("__e") + F.col("__k"))
    unique = F.when(F.col("__e") == 1, F.col("__base")).otherwise(numbered)
    return counted.withColumn(out, unique).drop("__base", "__rn", "__shift", "__e", "__use", "__i", "__k")
