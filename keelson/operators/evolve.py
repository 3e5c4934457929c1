"""Column evolution as one rewrite of a dataset.

Every function only adds expressions to a projection, which Catalyst collapses into the
scan. Rows that a change cannot carry over are split off by a predicate, not cached.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.casts import cast_or_null, stored_type
from keelson.specs import Column, TableSpec, parse_type, type_change_needs_rewrite


@dataclass(frozen=True)
class Rewrite:
    """``good`` has the new shape; ``bad`` keeps the original rows that do not fit it."""

    good: DataFrame
    bad: DataFrame


class EvolutionError(ValueError):
    """All blocking problems at once."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def _dtype(text: str | T.DataType) -> T.DataType:
    return parse_type(text) if isinstance(text, str) else text


def any_of(conds: list[Col]) -> Col:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def too_long(value: Col, dtype: T.DataType) -> Col:
    if isinstance(dtype, (T.VarcharType, T.CharType)):
        return F.coalesce(F.length(value.cast("string")) > dtype.length, F.lit(False))
    return F.lit(False)


def _convert(value: Col, source: T.DataType, target: T.DataType) -> tuple[Col, Col]:
    """The converted value and whether a non-NULL value did not fit."""
    out = cast_or_null(value, source, target)
    return out, (out.isNull() & value.isNotNull()) | too_long(value, target)


def _type_of(df: DataFrame, value: Col) -> T.DataType:
    return df.select(value.alias("v")).schema["v"].dataType


def _with_error(value: Col, bad: Col, message: str) -> Col:
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def _is_empty(df: DataFrame) -> bool:
    return df.limit(1).isEmpty()


def _split(df: DataFrame, projection: list[Col], bad: Col) -> Rewrite:
    flag = F.ifnull(bad, F.lit(False))
    return Rewrite(df.filter(~flag).select(*projection), df.filter(flag))


def _replaced(df: DataFrame, name: str, value: Col) -> list[Col]:
    return [value.alias(c) if c.lower() == name.lower() else F.col(c) for c in df.columns]


def add_column(
    df: DataFrame, name: str, type: str, default: str | None = None, not_null: bool = False
) -> DataFrame:
    """Add a column: NULLs without a default, else every row is backfilled.

    NOT NULL without a default needs an empty table.
    """
    if name.lower() in (c.lower() for c in df.columns):
        raise EvolutionError([f"column {name} already exists"])
    if default is None:
        if not_null and not _is_empty(df):
            raise EvolutionError([f"column {name} is NOT NULL without a default and the table has rows"])
        return df.withColumn(name, F.lit(None).cast(stored_type(_dtype(type))))
    return df.withColumn(name, F.expr(default).cast(stored_type(_dtype(type))))


@dataclass(frozen=True)
class Dropped:
    df: DataFrame
    spec: TableSpec
    constraints: tuple[str, ...]
    partial_uniques: tuple[str, ...]


def _mentions(expr: str | None, column: str) -> bool:
    """Whether SQL text names a column (string literals left out)."""
    bare = re.sub(r"'(?:[^']|'')*'", "", expr or "")
    return re.search(rf"(?<!\w){re.escape(column)}(?!\w)", bare, re.IGNORECASE) is not None


def drop_column(df: DataFrame, spec: TableSpec, column: str) -> Dropped:
    """Drop a column with the constraints that touch it.

    Partial unique keys that only use the column in their predicate are named separately.
    """
    if column in spec.primary_key:
        raise EvolutionError([f"column {column} is part of the primary key"])
    readers = [c.name for c in spec.columns if c.name != column and _mentions(c.computed, column)]
    if readers:
        raise EvolutionError([f"column {column} is read by computed column {c}" for c in readers])
    keyed = [u for u in spec.uniques if column in u.columns]
    partial = [u for u in spec.uniques if u not in keyed and _mentions(u.where, column)]
    checks = [c for c in spec.checks if _mentions(c.expr, column)]
    fks = [f for f in spec.foreign_keys if column in f.columns]
    left = replace(
        spec,
        columns=tuple(c for c in spec.columns if c.name != column),
        uniques=tuple(u for u in spec.uniques if u not in keyed and u not in partial),
        checks=tuple(c for c in spec.checks if c not in checks),
        foreign_keys=tuple(f for f in spec.foreign_keys if f not in fks),
    )
    names = [u.label for u in keyed] + [c.name for c in checks] + [f.label for f in fks]
    return Dropped(df.drop(column), left, tuple(names), tuple(u.label for u in partial))


def widen_column(df: DataFrame, column: str, type: str) -> DataFrame:
    """A cast that every stored value survives; anything else is refused."""
    new = _dtype(type)
    old = df.schema[column].dataType
    if type_change_needs_rewrite(old, new):
        raise EvolutionError([f"{column}: {old.simpleString()} to {new.simpleString()} is not a widening"])
    return df.select(*_replaced(df, column, F.col(column).cast(stored_type(new))))


def rewrite_column(
    df: DataFrame, column: str, type: str, using: Col | str | None = None, on_error: str = "raise"
) -> DataFrame | Rewrite:
    """Convert a column by ``using`` or a cast.

    ``raise`` fails the job on the first value that does not fit, ``quarantine`` returns
    the split.
    """
    new = _dtype(type)
    source = F.expr(using) if isinstance(using, str) else using if using is not None else F.col(column)
    value, bad = _convert(source, _type_of(df, source), new)
    if on_error == "raise":
        message = f"{column}: value does not fit {new.simpleString()}"
        return df.select(*_replaced(df, column, _with_error(value, bad, message)))
    return _split(df, _replaced(df, column, value), bad)


def narrowing_report(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Per column: rows that would overflow, be too long, or lose precision. One pass."""
    aggs, rows = [], []
    for i, (column, text) in enumerate(changes.items()):
        new, c = _dtype(text), F.col(column)
        old = df.schema[column].dataType
        value = cast_or_null(c, old, new)
        back = cast_or_null(value, stored_type(new), old)
        tests = {
            "overflow": value.isNull() & c.isNotNull(),
            "too_long": too_long(c, new),
            "loses_precision": value.isNotNull() & ~back.eqNullSafe(c),
        }
        aggs += [F.count_if(t).alias(f"{k}{i}") for k, t in tests.items()]
        rows.append(
            F.struct(
                F.lit(column).alias("column"),
                F.lit(new.simpleString()).alias("target"),
                *[F.col(f"{k}{i}").alias(k) for k in tests],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def touch_on_update(
    old: DataFrame, new: DataFrame, pk: list[str], column: str, expr: str | Col
) -> DataFrame:
    """``new`` with ``column`` re-evaluated for rows that changed, kept for those that did not.

    Rows without an old version keep the value they came with.
    """
    value = F.expr(expr) if isinstance(expr, str) else expr
    others = [c for c in new.columns if c not in pk and c != column]
    before = old.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(pk)],
        F.struct(F.col(column).alias("touch"), *others).alias("__old"),
    )
    pair = reduce(lambda a, b: a & b, [new[k] == before[f"__k{i}"] for i, k in enumerate(pk)])
    changed = any_of([~F.col(c).eqNullSafe(F.col(f"__old.{c}")) for c in others])
    touched = (
        F.when(F.col("__old").isNull(), F.col(column))
        .when(changed, value)
        .otherwise(F.col("__old.touch"))
    )
    return new.join(before, pair, "left").select(*_replaced(new, column, touched))


def computed_column(df: DataFrame, name: str, expr: str, mode: str = "stored", view: str | None = None) -> DataFrame:
    """Add (or recompute) a computed column; ``virtual`` also exposes it as a temp view."""
    out = df.drop(name).withColumn(name, F.expr(expr))
    if mode == "virtual":
        out.createOrReplaceTempView(view or f"with_{name}")
    return out


def freeze_computed(spec: TableSpec, name: str) -> TableSpec:
    """Dropping STORED keeps the values: the column turns into a plain one."""
    return replace(
        spec, columns=tuple(replace(c, computed=None) if c.name == name else c for c in spec.columns)
    )


def add_computed_columns(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Add computed columns, each after the columns it reads."""
    left = dict(exprs)
    while left:
        ready = [n for n, e in left.items() if not any(_mentions(e, o) for o in left if o != n)]
        if not ready:
            raise EvolutionError([f"computed column {n} is part of a cycle" for n in left])
        df = df.withColumns({n: F.expr(left.pop(n)) for n in ready})
    return df


@dataclass(frozen=True)
class Issue:
    table: str
    column: str | None
    severity: str
    description: str


def conform_issues(columns: T.StructType | None, spec: TableSpec | None, table: str = "") -> list[Issue]:
    """What stands between rows of shape ``columns`` and the target table."""
    if spec is None:
        return [Issue(table, None, "error", f"table {table} is missing in the target")]
    have = {f.name.lower(): f.dataType for f in columns}
    out = []
    for f in columns:
        if not spec.has_column(f.name):
            out.append(Issue(spec.name, f.name, "error", f"column {f.name} is missing in the target"))
    for c in spec.columns:
        old = have.get(c.name.lower())
        if old is not None:
            if old != c.data_type:
                text = f"column {c.name} changes from {old.simpleString()} to {c.data_type.simpleString()}"
                out.append(Issue(spec.name, c.name, "warning", text))
        elif c.computed is not None or c.hidden:
            continue
        elif not c.nullable and c.default is None:
            text = f"target column {c.name} is NOT NULL, has no default and is not in the data"
            out.append(Issue(spec.name, c.name, "error", text))
        else:
            out.append(Issue(spec.name, c.name, "warning", f"target column {c.name} is filled"))
    return out


def conform_to_target(df: DataFrame, spec: TableSpec) -> Rewrite:
    """Rows in the target's shape. Conformance errors raise; rows that do not fit are split off.

    A missing column takes its default or NULL; an explicit NULL stays NULL.
    """
    errors = [i.description for i in conform_issues(df.schema, spec) if i.severity == "error"]
    if errors:
        raise EvolutionError(errors)
    have = {c.lower() for c in df.columns}
    projection, bad = [], []
    for c in spec.insertable():
        if c.name.lower() in have:
            value, old = F.col(c.name), df.schema[c.name].dataType
            if not c.nullable:
                bad.append(value.isNull())
            if old != c.data_type:
                value, misfit = _convert(value, old, c.data_type)
                bad.append(misfit)
        else:
            value = F.expr(c.default) if c.default is not None else F.lit(None)
            value = value.cast(stored_type(c.data_type))
        projection.append(value.alias(c.name))
    return _split(df, projection, any_of(bad))


def conform_report(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Per shared column: failed casts, NULLs in required columns, too-long values. One pass."""
    aggs, rows = [], []
    have = {c.lower() for c in df.columns}
    for i, c in enumerate(x for x in spec.insertable() if x.name.lower() in have):
        v = F.col(c.name)
        value = cast_or_null(v, df.schema[c.name].dataType, c.data_type)
        tests = {
            "cast_failures": value.isNull() & v.isNotNull(),
            "required_nulls": v.isNull() if not c.nullable else F.lit(False),
            "too_long": too_long(v, c.data_type),
        }
        aggs += [F.count_if(t).alias(f"{k}{i}") for k, t in tests.items()]
        rows.append(F.struct(F.lit(c.name).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in tests]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def expire_rows(
    df: DataFrame, ts: str | None = None, after: str | None = None, now: Col | None = None, expression: str | None = None
) -> DataFrame:
    """Rows still alive at ``now``.

    Either ``ts`` plus an interval such as ``'30 days'``, or an expression giving the
    expiry time. With neither the setting is off. A row without an expiry time stays.
    """
    if expression is None and after is None:
        return df
    if now is None:
        raise ValueError("now must be given")
    if expression:
        expiry = F.expr(expression)
        return df.filter(expiry.isNull() | (expiry > now))
    expiry = F.col(ts) + F.expr(f"INTERVAL {after}")
    # a bound on the bare column reaches the scan; months differ in length by days, hence its margin
    bound = now - F.expr(f"INTERVAL {after}") - F.expr("INTERVAL 4 days")
    near = F.col(ts).isNull() | (F.col(ts) > bound.cast(df.schema[ts].dataType))
    return df.filter(near & (expiry.isNull() | (expiry > now)))


@dataclass(frozen=True)
class AddColumn:
    column: Column


@dataclass(frozen=True)
class DropColumn:
    name: str


@dataclass(frozen=True)
class ChangeType:
    name: str
    type: str
    using: str | None = None


@dataclass(frozen=True)
class SetNotNull:
    name: str


@dataclass(frozen=True)
class DropNotNull:
    name: str


@dataclass(frozen=True)
class SetComputed:
    """A new expression recomputes the column; ``None`` freezes the stored values."""

    name: str
    expr: str | None


Change = AddColumn | DropColumn | ChangeType | SetNotNull | DropNotNull | SetComputed


@dataclass(frozen=True)
class Evolved:
    good: DataFrame
    bad: DataFrame
    spec: TableSpec
    dropped_constraints: tuple[str, ...] = field(default=())


def _edit(spec: TableSpec, name: str, edit: Callable[[Column], Column]) -> TableSpec:
    return replace(spec, columns=tuple(edit(c) if c.name == name else c for c in spec.columns))


def evolve_table(df: DataFrame, spec: TableSpec, changes: list[Change]) -> Evolved:
    """Apply a list of changes as one projection, whatever order they are listed in.

    New plain columns come first, then type changes, then computed columns after their
    inputs, then drops with their constraints. Blocking problems are all reported before
    anything is built. Rows that do not fit end up in ``bad`` in their old shape.
    """
    problems: list[str] = []
    by_type: dict[type, list] = {}
    for ch in changes:
        by_type.setdefault(type(ch), []).append(ch)
    adds = [a.column for a in by_type.get(AddColumn, [])]
    plain = [c for c in adds if c.computed is None]
    for c in adds:
        if spec.has_column(c.name):
            problems.append(f"column {c.name} already exists")
    known = {c.name for c in spec.columns} | {c.name for c in adds}
    for ch in changes:
        if not isinstance(ch, AddColumn) and ch.name not in known:
            problems.append(f"column {ch.name} does not exist")
    bare = [c.name for c in plain if not c.nullable and c.default is None]
    if bare and not _is_empty(df):
        problems += [f"column {n} is NOT NULL without a default and the table has rows" for n in bare]
    drops = [d.name for d in by_type.get(DropColumn, [])]
    problems += [f"column {n} is part of the primary key" for n in drops if n in spec.primary_key]
    formulas = {c.name: c.computed for c in (*spec.columns, *adds)} | {c.name: c.expr for c in by_type.get(SetComputed, [])}
    problems += [
        f"column {n} is read by computed column {c}"
        for n in drops
        for c, e in formulas.items()
        if c not in drops and _mentions(e, n)
    ]
    if problems:
        raise EvolutionError(problems)

    old_columns = df.columns
    rows = df.select(F.struct(*old_columns).alias("__row"), *old_columns)
    bad: list[Col] = []
    for c in plain:
        rows = add_column(rows, c.name, c.type, c.default)
        spec = spec.with_column(c)
    for i, ch in enumerate(by_type.get(ChangeType, [])):
        source = F.expr(ch.using) if ch.using else F.col(ch.name)
        value, misfit = _convert(source, _type_of(rows, source), _dtype(ch.type))
        rows = rows.withColumns({ch.name: value, f"__bad{i}": misfit})
        bad.append(F.col(f"__bad{i}"))
        spec = _edit(spec, ch.name, lambda c, t=ch.type: replace(c, type=t))

    computed = {c.name: c.computed for c in adds if c.computed is not None}
    for c in adds:
        if c.computed is not None:
            spec = spec.with_column(c)
    for ch in by_type.get(SetComputed, []):
        spec = _edit(spec, ch.name, lambda c, e=ch.expr: replace(c, computed=e))
        if ch.expr is not None:
            computed[ch.name] = ch.expr
            rows = rows.drop(ch.name)
    rows = add_computed_columns(rows, computed)

    required = [ch.name for ch in by_type.get(SetNotNull, [])]
    required += [c.name for c in adds if not c.nullable and c.name not in bare]
    for name in required:
        spec = _edit(spec, name, lambda c: replace(c, nullable=False))
    for ch in by_type.get(DropNotNull, []):
        spec = _edit(spec, ch.name, lambda c: replace(c, nullable=True))
    bad += [F.col(n).isNull() for n in required if n not in drops]

    gone: list[str] = []
    for name in sorted(drops, key=lambda n: spec.column(n).computed is None):
        result = drop_column(rows, spec, name)
        spec, gone = result.spec, gone + list(result.constraints + result.partial_uniques)
        rows = result.df
    split = _split(rows, [F.col(c.name) for c in spec.columns if not c.hidden], any_of(bad))
    return Evolved(split.good, split.bad.select("__row.*"), spec, tuple(gone))
