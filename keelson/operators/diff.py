"""Comparing snapshots of a table: by key, three ways, by fingerprint, by key set.

Sides are tagged and unioned, then aggregated per key. That needs one shuffle of narrow
rows, combines before it, and treats NULL keys as equal. Wide rows are only read again for
the keys that turned out to differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.hashing import compare_hash, hash_number, row_hash
from keelson.plans.joins import match

KINDS = ("added", "removed", "modified")
# a key that a side has more than once; there is no single row to compare
DUPLICATE = "duplicate"


def _comparable(df: DataFrame) -> DataFrame:
    """Maps as sorted entries, since maps have no equality of their own."""
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    return df.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps}) if maps else df


def table_diff(left: DataFrame, right: DataFrame, key: list[str], compare: list[str] | None = None) -> DataFrame:
    """Rows ``(key…, kind, changed)`` that turn ``left`` into ``right``.

    ``changed`` lists the differing columns of a modified row in column order and is empty for
    other kinds. A key that occurs more than once on a side is one row of kind ``duplicate``.
    """
    cols = compare or [c for c in left.columns if c in right.columns and c not in key]
    left, right = (_comparable(df.select(*key, *cols)) for df in (left, right))

    def tagged(df: DataFrame, side: int) -> DataFrame:
        h1, h2 = compare_hash(cols) if cols else (F.lit(0).cast("bigint"),) * 2
        return df.select(*key, F.lit(side).alias("__side"), h1.alias("__h1"), h2.alias("__h2"))

    def times(side: int) -> Column:
        return F.count_if(F.col("__side") == side)

    def on(side: int, value: str) -> Column:
        return F.max(F.when(F.col("__side") == side, F.col(value)))

    per_key = (
        tagged(left, 0)
        .unionByName(tagged(right, 1))
        .groupBy(*key)
        .agg(
            times(0).alias("__in_left"),
            times(1).alias("__in_right"),
            *[on(s, h).alias(f"{h}_{s}") for s in (0, 1) for h in ("__h1", "__h2")],
        )
    )
    kind = (
        F.when((F.col("__in_left") > 1) | (F.col("__in_right") > 1), DUPLICATE)
        .when(F.col("__in_left") == 0, "added")
        .when(F.col("__in_right") == 0, "removed")
        .when((F.col("__h1_0") != F.col("__h1_1")) | (F.col("__h2_0") != F.col("__h2_1")), "modified")
    )
    kinds = per_key.select(*key, kind.alias("kind")).filter("kind IS NOT NULL")
    none = F.array().cast("array<string>")
    whole = kinds.filter("kind <> 'modified'").withColumn("changed", none)
    if not cols:
        return whole

    suspects = kinds.filter("kind = 'modified'").select(*key)
    old = match(left.select(*key, F.struct(*cols).alias("__old")), suspects, key, "left_semi")
    new = match(right.select(*key, F.struct(*cols).alias("__new")), suspects, key, "left_semi")
    names = F.array_compact(
        F.array(
            *[F.when(~F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}")), F.lit(c)) for c in cols]
        )
    )
    modified = (
        match(old, new, key)
        .select(*key, F.lit("modified").alias("kind"), names.alias("changed"))
        .filter(F.size("changed") > 0)
    )
    return whole.unionByName(modified)


def apply_diff(left: DataFrame, right: DataFrame, diff: DataFrame, key: list[str]) -> DataFrame:
    """``left`` with the rows named by ``diff`` removed or taken from ``right``."""
    gone = diff.filter("kind <> 'added'").select(*key)
    fresh = diff.filter("kind <> 'removed'").select(*key)
    kept = match(left, gone, key, "left_anti")
    return kept.unionByName(match(right, fresh, key, "left_semi"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Rows per kind (always all three) and whether there is any difference."""
    counts = diff.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("kind"), F.col(k).alias("n_rows"), (F.col("n") > 0).alias("has_changes")
                    )
                    for k in KINDS
                ]
            )
        )
    )


def diff_lines(diff: DataFrame, key: list[str]) -> DataFrame:
    """One readable line per difference."""
    label = F.concat_ws(", ", *[F.col(k).cast("string") for k in key])
    detail = F.when(F.size("changed") > 0, F.concat(F.lit(": "), F.array_join("changed", ", "))).otherwise("")
    return diff.select(*key, F.concat("kind", F.lit(" "), label, detail).alias("line"))


def three_way_drift(declared: DataFrame, snapshot: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Differences declared -> snapshot (``drift = 'declared'``) and snapshot -> live (``'live'``)."""
    first = table_diff(declared, snapshot, key).withColumn("drift", F.lit("declared"))
    second = table_diff(snapshot, live, key).withColumn("drift", F.lit("live"))
    return first.unionByName(second)


def drift_status(drift: DataFrame) -> DataFrame:
    """One row: differences of either kind, and ``converged`` when there is neither."""
    n = [F.count(F.when(F.col("drift") == d, 1)).alias(f"{d}_drift") for d in ("declared", "live")]
    return drift.agg(*n).withColumn("converged", F.expr("declared_drift = 0 AND live_drift = 0"))


def table_fingerprint(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Content hash per group (``by`` may be empty) that does not depend on row order.

    Count and two 60-bit sums of the row hashes combine map-side, so no group is gathered,
    and a duplicated row changes the result.
    """
    h = df.select(*by, row_hash([F.col(c) for c in cols]).alias("__h"))
    sums = h.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.sum(hash_number(F.col("__h"), 1)).alias("__a"),
        F.sum(hash_number(F.col("__h"), 16)).alias("__b"),
    )
    whole = F.concat_ws(":", "n_rows", F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0)))
    return sums.select(*by, "n_rows", F.sha2(whole, 256).alias("fingerprint"))


def _sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    def flag(df: DataFrame, in_a: bool) -> DataFrame:
        return df.select(*keys, F.lit(in_a).alias("in_a"), F.lit(not in_a).alias("in_b"))

    both = flag(a, True).unionByName(flag(b, False))
    return both.groupBy(*keys).agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))


_OVERLAP = {
    "union": "true",
    "intersect": "in_a AND in_b",
    "difference": "in_a AND NOT in_b",
    "symmetric": "in_a <> in_b",
}


def key_overlap(a: DataFrame, b: DataFrame, keys: list[str], op: str) -> DataFrame:
    """Distinct keys in either, both, only ``a``, or exactly one of the two."""
    return _sides(a, b, keys).filter(_OVERLAP[op]).select(*keys)


def overlap_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row with the number of distinct keys only in ``a``, only in ``b``, and in both."""
    return _sides(a, b, keys).agg(
        F.count_if(F.expr("in_a AND NOT in_b")).alias("only_a"),
        F.count_if(F.expr("in_b AND NOT in_a")).alias("only_b"),
        F.count_if(F.expr("in_a AND in_b")).alias("both"),
    )
