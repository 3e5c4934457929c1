"""Column expressions for SQL text and names. All native, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.casts import cast_or_null


_NESTED = (T.ArrayType, T.MapType, T.StructType)


# six digits, so that nothing of a time is cut
_JSON = {
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


def _without_maps(c: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """A nested value with maps as arrays of entries, whose keys may be of any type."""
    if isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        return _without_maps(F.map_entries(c), T.ArrayType(entry))
    if isinstance(dtype, T.ArrayType):
        inner = _without_maps(F.lit(None), dtype.elementType)[1]
        return F.transform(c, lambda x: _without_maps(x, dtype.elementType)[0]), T.ArrayType(inner)
    if isinstance(dtype, T.StructType):
        parts = [(f.name, *_without_maps(c[f.name], f.dataType)) for f in dtype.fields]
        made = F.struct(*[value.alias(name) for name, value, _ in parts])
        return F.when(c.isNotNull(), made), T.StructType([T.StructField(n, t) for n, _, t in parts])
    return c, dtype


def _with_maps(c: Column, dtype: T.DataType) -> Column:
    """The inverse of ``_without_maps``."""
    if isinstance(dtype, T.MapType):
        pair = lambda x: F.struct(
            _with_maps(x["key"], dtype.keyType).alias("key"), _with_maps(x["value"], dtype.valueType).alias("value")
        )
        return F.map_from_entries(F.transform(c, pair))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _with_maps(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        made = F.struct(*[_with_maps(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(c.isNotNull(), made)
    return c


def to_text(c: Column, dtype: T.DataType) -> Column:
    """Any value as text: bytes as a backslash, x and hex digits, nested values as JSON."""
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit(r"\x"), F.lower(F.hex(c)))
    return F.to_json(_without_maps(c, dtype)[0], _JSON) if isinstance(dtype, _NESTED) else c.cast("string")


def from_text(c: Column, dtype: T.DataType) -> Column:
    """The inverse of ``to_text``; NULL for text that is no such value."""
    if isinstance(dtype, T.BinaryType):
        return F.when(F.startswith(c, F.lit(r"\x")), F.unhex(F.substr(c, F.lit(3))))
    if isinstance(dtype, _NESTED):
        return _with_maps(F.from_json(c, _without_maps(F.lit(None), dtype)[1], _JSON), dtype)
    return cast_or_null(c, T.StringType(), dtype)


def quote_literal(c: Column) -> Column:
    """``NULL`` or the value as quoted text with inner quotes doubled."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("NULL")).otherwise(
        F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    )


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_table(name: str) -> str:
    """``schema.table`` split at the first dot, both parts quoted."""
    return ".".join(quote_ident(p) for p in name.split(".", 1))


def pascal_case(c: Column) -> Column:
    words = F.filter(F.split(c, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    return F.array_join(
        F.transform(
            words,
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))),
        ),
        "",
    )


def kebab_case(c: Column) -> Column:
    return F.translate(c, "_", "-")


def safe_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[/\\ \-]+", "_"), F.lit("_"))


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


STYLES = {
    "pascal": pascal_case,
    "kebab": kebab_case,
    "safe": safe_name,
    "spaced": single_spaced,
}
