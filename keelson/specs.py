"""Declared tables. Small driver-side objects; the rows stay in DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import types as T


@lru_cache(maxsize=1024)
def parse_type(text: str) -> T.DataType:
    return T.DataType.fromDDL(text)


@dataclass(frozen=True)
class Column:
    """A declared column. ``default``, ``computed`` and ``on_update`` are Spark SQL text."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    computed: str | None = None
    stored: bool = True
    hidden: bool = False
    on_update: str | None = None

    @property
    def data_type(self) -> T.DataType:
        return parse_type(self.type)


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or "fk_" + "_".join(self.columns)


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]
    where: str | None = None
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or "unique_" + "_".join(self.columns)


@dataclass(frozen=True)
class Check:
    name: str
    expr: str


@dataclass(frozen=True)
class TableSpec:
    """A table under its qualified name, ``schema.table``."""

    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default=())

    def __post_init__(self):
        if "." not in self.name:
            object.__setattr__(self, "name", "public." + self.name)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"{self.name} has no column {name}")

    def has_column(self, name: str) -> bool:
        return any(c.name.lower() == name.lower() for c in self.columns)

    def insertable(self) -> list[Column]:
        """Columns that carry data: neither computed nor hidden."""
        return [c for c in self.columns if c.computed is None and not c.hidden]

    def self_columns(self) -> list[str]:
        """Columns of foreign keys that point back at this (qualified) table."""
        out: list[str] = []
        for fk in self.foreign_keys:
            if qualified(fk.parent) == self.name:
                out += [c for c in fk.columns if c not in out]
        return out

    def struct(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, c.data_type, c.nullable) for c in self.insertable()]
        )

    def with_column(self, col: Column) -> TableSpec:
        return replace(self, columns=self.columns + (col,))


def qualified(name: str, default_schema: str = "public") -> str:
    return name if "." in name else f"{default_schema}.{name}"


def type_change_needs_rewrite(old: T.DataType, new: T.DataType) -> bool:
    """Whether stored values have to be rewritten (and may not fit) for ``old -> new``.

    Widening inside one family is free. A decimal must keep both its scale and its integer
    digits; an unbounded string narrowed to a bounded one counts as a rewrite.
    """
    if old == new:
        return False
    ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    floats = (T.FloatType, T.DoubleType)
    for family in (ints, floats):
        if isinstance(old, family) and isinstance(new, family):
            return family.index(type(new)) < family.index(type(old))
    strings = (T.StringType, T.VarcharType, T.CharType)
    if isinstance(old, strings) and isinstance(new, strings):
        old_len, new_len = getattr(old, "length", None), getattr(new, "length", None)
        if new_len is None:
            return False
        return old_len is None or new_len < old_len
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale < old.scale or new.precision - new.scale < old.precision - old.scale
    return True
