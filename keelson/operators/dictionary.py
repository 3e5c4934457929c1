"""Category columns and their ordered dictionaries ``(label, ordinal)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.hashing import hash_number, row_hash
from keelson.operators.evolve import Rewrite
from keelson.plans.ordered import number_rows, plan_chunks


def retarget_dictionary(df: DataFrame, column: str, labels: DataFrame) -> Rewrite:
    """Move a category column to another dictionary through its text.

    Values without a label are errors, so their rows are split off; NULL stays NULL.
    """
    known = labels.select(F.col("label").cast("string").alias("__label")).distinct()
    text = F.col(column).cast("string")
    joined = df.join(known, text == F.col("__label"), "left")
    bad = F.col("__label").isNull() & F.col(column).isNotNull()
    out = [F.col("__label").alias(column) if c == column else F.col(c) for c in df.columns]
    return Rewrite(joined.filter(~bad).select(*out), joined.filter(bad).select(*df.columns))


def dictionary_usage(df: DataFrame, column: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """Per label: kept, added, removed or unknown, and the rows that use it.

    A removed label with rows makes the removal dangerous. Reordering labels alone is no
    difference.
    """
    text = F.col(column).cast("string").alias("label")
    used = df.filter(F.col(column).isNotNull()).groupBy(text).agg(F.count("*").alias("n"))

    def tagged(labels: DataFrame, side: str) -> DataFrame:
        return labels.select("label", F.lit(True).alias(side))

    merged = (
        used.unionByName(tagged(old, "in_old"), allowMissingColumns=True)
        .unionByName(tagged(new, "in_new"), allowMissingColumns=True)
        .groupBy("label")
        .agg(
            F.bool_or("in_old").alias("in_old"),
            F.bool_or("in_new").alias("in_new"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        )
    )
    status = F.expr(
        "CASE WHEN in_old AND in_new THEN 'kept' WHEN in_new THEN 'added' WHEN in_old THEN 'removed' ELSE 'unknown' END"
    )
    return merged.select("label", status.alias("status"), "n_rows")


def detect_dictionary_renames(
    old: DataFrame, new: DataFrame, usage_old: DataFrame, usage_new: DataFrame, chunk: Column | None = None
) -> DataFrame:
    """Renames ``(schema, old_dictionary, new_dictionary)`` between two snapshots.

    ``old``/``new`` hold ``(schema, dictionary, ordinal, label)``; ``usage_*`` hold
    ``(table, column, schema, dictionary)``. A rename needs identical labels in identical
    order, exactly one dropped and one added dictionary with that label list, the same
    schema, and a column that switched from one to the other.

    The label list is compared as sums of hashes of (position, label), so a dictionary is
    never gathered into one row.
    """
    labels = old.withColumn("in_old", F.lit(True)).unionByName(new.withColumn("in_old", F.lit(False)))
    names = ["schema", "dictionary"]
    if chunk is None:
        chunk = plan_chunks(labels, ["ordinal"], keys=["in_old", *names])
    placed = number_rows(labels, ["ordinal"], "position", ["in_old", *names], chunk)
    h = row_hash([F.col("position"), F.col("label")])
    signed = (
        placed.select("in_old", *names, h.alias("h"))
        .groupBy("in_old", *names)
        .agg(
            F.count("*").alias("n"),
            F.sum(hash_number(F.col("h"), 1)).alias("a"),
            F.sum(hash_number(F.col("h"), 16)).alias("b"),
        )
    )
    # a dictionary in both snapshots is neither dropped nor added
    lone = (
        signed.groupBy(*names)
        .agg(F.count("*").alias("sides"), F.max(F.struct("in_old", "n", "a", "b")).alias("s"))
        .filter("sides = 1")
        .select(*names, "s.*")
    )
    of_side = {side: F.col("in_old") == F.lit(side) for side in (True, False)}
    pairs = (
        lone.groupBy("n", "a", "b")
        .agg(
            F.count_if(of_side[True]).alias("n_old"),
            F.count_if(of_side[False]).alias("n_new"),
            F.max(F.when(of_side[True], F.struct(*names))).alias("o"),
            F.max(F.when(of_side[False], F.struct(*names))).alias("w"),
        )
        .filter("n_old = 1 AND n_new = 1 AND o.schema = w.schema")
        .selectExpr("o.schema", "o.dictionary AS old_dictionary", "w.dictionary AS new_dictionary")
    )
    before = usage_old.selectExpr("table", "column", "schema", "dictionary AS old_dictionary")
    after = usage_new.selectExpr("table", "column", "schema", "dictionary AS new_dictionary")
    switched = (
        before.join(after, ["table", "column", "schema"])
        .filter("old_dictionary <> new_dictionary")
        .select("schema", "old_dictionary", "new_dictionary")
        .distinct()
    )
    return pairs.join(switched, ["schema", "old_dictionary", "new_dictionary"], "left_semi")
