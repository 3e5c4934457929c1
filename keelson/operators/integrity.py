"""Violations of declared constraints, found in the rows.

Every check aggregates on the narrow key first, so a hot key collapses before the shuffle;
wide rows are fetched afterwards by the (usually few) offending keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.hashing import compare_hash
from keelson.plans.durable import written
from keelson.specs import TableSpec, qualified




def _all_set(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def pk_violations(df: DataFrame, pk: list[str]) -> DataFrame:
    """Key values that are NULL in part or occur more than once."""
    groups = df.groupBy(*pk).agg(F.count("*").alias("n_rows"))
    reason = F.when(_any_null(pk), "null").when(F.col("n_rows") > 1, "duplicate")
    return groups.withColumn("reason", reason).filter("reason IS NOT NULL")


def unique_violations(df: DataFrame, cols: list[str], where: str | Column | None = None) -> DataFrame:
    """Groups of rows sharing a key; NULLs are distinct, ``where`` makes the key partial.

    Keys with texts are told apart by two 64-bit hashes first; only keys whose hashes occur
    more than once are read again and compared as they are.
    """
    rows = (df.filter(where) if where is not None else df).filter(_all_set(cols))
    if any(isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType)) for c in cols):
        hashes = dict(zip(("__h1", "__h2"), compare_hash(cols)))
        seen = rows.select(*[h.alias(n) for n, h in hashes.items()])
        again = seen.groupBy("__h1", "__h2").agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
        # as a table it has a size, so a short list of suspects goes to the rows and not the other way round
        again = written(again, "suspects")
        rows = rows.select(*cols, *[h.alias(n) for n, h in hashes.items()]).join(again, ["__h1", "__h2"], "left_semi")
    return rows.groupBy(*cols).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def nullable_unique_report(df: DataFrame, cols: list[str], guarded: list[str] = ()) -> DataFrame:
    """Per key column: rows whose NULL switches the unique key off, and the duplicate
    groups that appear if NULLs were equal. ``guarded`` columns are required non-NULL by
    the key's own predicate and are exempt.
    """
    open_cols = [c for c in cols if c not in guarded]
    if not open_cols:
        return df.sparkSession.createDataFrame([], "column string, null_rows bigint, hidden_duplicates bigint")
    rows = df.filter(_all_set(list(guarded))) if guarded else df
    groups = rows.groupBy(*cols).agg(F.count("*").alias("__n"))
    aggs = []
    for i, c in enumerate(open_cols):
        is_null = F.col(c).isNull()
        aggs += [
            F.coalesce(F.sum(F.when(is_null, F.col("__n"))), F.lit(0)).alias(f"n{i}"),
            _count_if(is_null & (F.col("__n") > 1)).alias(f"d{i}"),
        ]
    return groups.agg(*aggs).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"n{i}").alias("null_rows"),
                        F.col(f"d{i}").alias("hidden_duplicates"),
                    )
                    for i, c in enumerate(open_cols)
                ]
            )
        )
    )


def not_null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL count per column, all columns in one pass."""
    counts = df.agg(*[_count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in cols]))
    )


def check_violations(df: DataFrame, expr: str | Column) -> DataFrame:
    """Rows for which the check is FALSE; a NULL outcome passes."""
    cond = F.expr(expr) if isinstance(expr, str) else expr
    return df.filter(~cond)


def _orphan_keys(child: DataFrame, parent: DataFrame, cols: list[str], ref_cols: list[str]) -> DataFrame:
    keys = child.filter(_all_set(cols)).groupBy(*cols).agg(F.count("*").alias("n_rows"))
    refs = parent.select(*[F.col(r).alias(f"__r{i}") for i, r in enumerate(ref_cols)])
    cond = [keys[c] == refs[f"__r{i}"] for i, c in enumerate(cols)]
    return keys.join(refs, cond, "left_anti")


def fk_violations(child: DataFrame, parent: DataFrame, cols: list[str], ref_cols: list[str]) -> DataFrame:
    """Child rows whose key columns are all set and match no parent row.

    The distinct child keys are tested against the parent; the wide child rows only meet
    the orphan keys, which Spark broadcasts when they are few.
    """
    orphans = _orphan_keys(child, parent, cols, ref_cols).drop("n_rows")
    return child.join(orphans, cols, "left_semi")


def self_fk_violations(df: DataFrame, pk: list[str], cols: list[str]) -> DataFrame:
    """``fk_violations`` of a table against its own primary key."""
    parent = df.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(pk)])
    return fk_violations(df, parent, cols, [f"__p{i}" for i in range(len(pk))])


def fk_target_unique(parent: DataFrame, ref_cols: list[str]) -> DataFrame:
    """Key values that stop a column set from being a foreign-key target."""
    return unique_violations(parent, sorted(ref_cols))


def suppress_issues(issues: DataFrame, waivers: DataFrame) -> DataFrame:
    """Issues not matched by a waiver ``(rule, table, constraint)``; NULL there matches all.

    One equi anti join per shape of waiver instead of one join with OR conditions.
    """
    out = issues
    for optional in ([], ["table"], ["constraint"], ["table", "constraint"]):
        unset = [c for c in ("table", "constraint") if c not in optional]
        shape = waivers.filter(_all_set(["rule", *optional]))
        for c in unset:
            shape = shape.filter(F.col(c).isNull())
        keys = ["rule", *optional]
        out = out.join(shape.select(*keys).distinct(), keys, "left_anti")
    return out.select(*issues.columns)


REPORT_SCHEMA = "table string, constraint string, kind string, severity string, violations bigint"

# Rows whose keys a task groups before the shuffle; the groups of a task are held in memory.
GROUPED_ROWS = 500_000


def _dealt(frames: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    """``frames`` of many rows in parts of ``GROUPED_ROWS``: a split of a file may hold many millions."""
    if not names:
        return {}
    sizes = [frames[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
    rows = {r["name"]: r["rows"] for r in reduce(DataFrame.unionByName, sizes).collect()}
    return {n: frames[n].repartition(-(-rows[n] // GROUPED_ROWS)) if rows[n] > GROUPED_ROWS else frames[n] for n in names}


def _key_row(number: int, role: str, values: list[Column], when: Column) -> Column:
    """One row of a constraint's key group: two 64-bit hashes stand for the key; NULL where left out."""
    parts = [x for v in values for x in (v, v.isNull())]
    row = F.struct(
        F.lit(number).alias("number"),
        F.xxhash64(*parts).alias("h1"),
        F.xxhash64(F.lit("key"), *reversed(parts)).alias("h2"),
        F.lit(1 if role == "parent" else 0).alias("parents"),
        F.lit(0 if role == "parent" else 1).alias("rows"),
        reduce(lambda x, y: x | y, [v.isNull() for v in values]).alias("has_null"),
    )
    return F.when(when, row)


def _alike(child: DataFrame, cols: tuple[str, ...], parent: DataFrame, ref_cols: tuple[str, ...]) -> tuple[list, list]:
    """The columns of both sides of a foreign key in one type, so that equal values hash alike."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    left, right = [], []
    for c, p in zip(cols, ref_cols):
        types = child.schema[c].dataType, parent.schema[p].dataType
        kind = None if types[0] == types[1] else "bigint" if all(isinstance(t, whole) for t in types) else "string"
        left.append(F.col(c).cast(kind) if kind else F.col(c))
        right.append(F.col(p).cast(kind) if kind else F.col(p))
    return left, right


def constraint_report(tables: dict[str, DataFrame], specs: list[TableSpec]) -> DataFrame:
    """One row per declared constraint with the number of rows that break it.

    NOT NULL and CHECK of a table share one wide aggregate. All keys of a table, its own and
    those it refers to, are told apart by number in one pass, and the keys of all tables are
    grouped in one shuffle of hashes. A unique key over nullable
    columns adds a warning row that counts the rows it cannot protect.
    """
    frames = {qualified(n): df for n, df in tables.items()}
    counted: list[DataFrame] = []
    keys: dict[str, list[Column]] = {}
    named: list[tuple[int, str, str, str]] = []

    def number(table: str, constraint: str, kind: str) -> int:
        named.append((len(named), table, constraint, kind))
        return len(named) - 1

    for spec in specs:
        df, own = frames[spec.name], keys.setdefault(spec.name, [])
        wide = [
            (f"{c.name}_not_null", "not_null", "error", F.col(c.name).isNull())
            for c in spec.columns
            if not c.nullable and c.name not in spec.primary_key
        ] + [(c.name, "check", "error", ~F.expr(c.expr)) for c in spec.checks]
        if spec.primary_key:
            k = number(spec.name, "primary", "primary_key")
            own.append(_key_row(k, "own", [F.col(c) for c in spec.primary_key], F.lit(True)))
        for u in spec.uniques:
            cols, meant = list(u.columns), F.expr(u.where) if u.where else F.lit(True)
            k = number(spec.name, u.label, "unique")
            own.append(_key_row(k, "own", [F.col(c) for c in cols], meant & _all_set(cols)))
            if any(spec.column(c).nullable for c in cols):
                wide.append((u.label, "nullable_unique", "warning", meant & _any_null(cols)))
        for fk in spec.foreign_keys:
            to = qualified(fk.parent)
            k = number(spec.name, fk.label, "foreign_key")
            left, right = _alike(df, fk.columns, frames[to], fk.parent_columns)
            own.append(_key_row(k, "own", left, _all_set(list(fk.columns))))
            keys.setdefault(to, []).append(_key_row(k, "parent", right, _all_set(list(fk.parent_columns))))
        if wide:
            totals = df.agg(*[_count_if(cond).alias(f"c{i}") for i, (*_, cond) in enumerate(wide)])
            rows = [
                F.struct(
                    F.lit(spec.name).alias("table"), F.lit(name).alias("constraint"), F.lit(kind).alias("kind"),
                    F.lit(severity).alias("severity"), F.col(f"c{i}").alias("violations"),
                )
                for i, (name, kind, severity, _) in enumerate(wide)
            ]
            counted.append(totals.select(F.inline(F.array(*rows))))

    if named:
        dealt = _dealt(frames, [t for t, rows in keys.items() if rows])
        spread = [df.select(F.inline(F.array_compact(F.array(*keys[t])))) for t, df in dealt.items()]
        groups = (
            reduce(DataFrame.union, spread)
            .groupBy("number", "h1", "h2")
            .agg(F.sum("parents").alias("parents"), F.sum("rows").alias("rows"), F.max("has_null").alias("has_null"))
        )
        kinds = groups.sparkSession.createDataFrame(named, "number int, table string, constraint string, kind string")
        broken = (
            F.when(F.col("kind") == "foreign_key", F.col("parents") == 0)
            .when(F.col("kind") == "primary_key", F.col("has_null") | (F.col("rows") > 1))
            .otherwise(F.col("rows") > 1)
        )
        per_key = (
            groups.join(kinds.select("number", "kind"), "number")
            .groupBy("number")
            .agg(F.sum(F.when(broken, F.col("rows"))).alias("violations"))
        )
        counted.append(
            kinds.join(per_key, "number", "left").select(
                "table", "constraint", "kind", F.lit("error").alias("severity"),
                F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"),
            )
        )
    return reduce(DataFrame.unionByName, counted)
