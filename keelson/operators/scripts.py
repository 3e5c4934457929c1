"""Jobs over a column of script texts or category labels. Column expressions only."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import STYLES, single_spaced

# Default tag of header and waiver lines, and the length of a signature.
TAG = "keelson"
SIGNATURE_LENGTH = 12
_BLANK = " \t\r\n\x0b\x0c"


def normalize_labels(df: DataFrame, column: str, style: str) -> DataFrame:
    """``(canonical, label, n_rows, collides)`` for each raw label of a category column.

    ``collides`` marks labels that share their canonical spelling with another one.
    """
    labels = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n_rows"))
    named = labels.select(STYLES[style](F.col("label")).alias("canonical"), "label", "n_rows")
    shared = named.groupBy("canonical").agg((F.count("*") > 1).alias("collides"))
    return named.join(shared, "canonical").select("canonical", "label", "n_rows", "collides")


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _has_header(text: Column, tag: str) -> Column:
    return F.startswith(F.btrim(_first_line(text), F.lit(_BLANK)), F.lit(f"-- {tag}:"))


def script_body(text: Column, tag: str = TAG) -> Column:
    """The text without its header line."""
    first = F.length(_first_line(text))
    return F.when(_has_header(text, tag), F.substr(text, first + 2)).otherwise(text)


def parse_script_headers(df: DataFrame, column: str, tag: str = TAG) -> DataFrame:
    """Add ``mode, depends_on, squash, sig, error, body`` parsed from the first line.

    The line is ``-- <tag>:key=value,…``. The first bad field is reported in ``error`` and
    leaves the other columns NULL; without a header all of them are NULL.
    """
    text = F.col(column)
    prefix = f"-- {tag}:"
    line = F.btrim(_first_line(text), F.lit(_BLANK))
    fields = F.transform(
        F.split(F.substr(line, F.lit(len(prefix) + 1)), ","),
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            F.when(F.contains(p, F.lit("=")), F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)).alias("value"),
        ),
    )

    def problem(f: Column) -> Column:
        key, value = f["key"], f["value"]
        return (
            F.when(value.isNull(), F.concat(F.lit("invalid field: "), key))
            .when((key == "mode") & ~value.isin("sync", "async"), F.concat(F.lit("invalid mode: "), value))
            .when((key == "depends_on") & (value == ""), F.lit("empty depends_on"))
            .when((key == "squash") & (value != "true"), F.lit("squash must be true"))
            .when((key == "sig") & (value == ""), F.lit("empty sig"))
            .when(~key.isin("mode", "depends_on", "squash", "sig"), F.concat(F.lit("unknown field: "), key))
        )

    def last(key: str) -> Column:
        return F.try_element_at(F.filter("__fields", lambda f: f["key"] == key), F.lit(-1))["value"]

    parsed = df.withColumn("__fields", F.when(_has_header(text, tag), fields))
    first_problem = F.try_element_at(F.array_compact(F.transform("__fields", problem)), F.lit(1))
    missing = F.when(F.col("__fields").isNotNull() & last("mode").isNull(), F.lit("missing mode"))
    parsed = parsed.withColumn("error", F.coalesce(first_problem, missing))
    valid = F.col("__fields").isNotNull() & F.col("error").isNull()
    return parsed.withColumns(
        {
            "mode": F.when(valid, last("mode")),
            "depends_on": F.when(valid, F.split(last("depends_on"), ";")),
            "squash": F.when(valid, last("squash").isNotNull()),
            "sig": F.when(valid, last("sig")),
            "body": script_body(text, tag),
        }
    ).drop("__fields")


def render_header(mode: Column, depends_on: Column, squash: Column, sig: Column, tag: str = TAG) -> Column:
    """A header line; absent parts (NULL, empty list, false) are left out."""
    deps = F.when(F.size(depends_on) > 0, F.concat(F.lit("depends_on="), F.array_join(depends_on, ";")))
    return F.concat(
        F.lit(f"-- {tag}:"),
        F.concat_ws(
            ",",
            F.concat(F.lit("mode="), mode),
            deps,
            F.when(squash, "squash=true"),
            F.when(sig != "", F.concat(F.lit("sig="), sig)),
        ),
    )


def replace_header(text: Column, header: Column, tag: str = TAG) -> Column:
    """The text with any header line exchanged for ``header``."""
    return F.concat(header, F.lit("\n"), script_body(text, tag))


def signature(mode: Column, depends_on: Column, squash: Column, body: Column) -> Column:
    """Short hash over the header's meaning and the single-spaced body."""
    content = F.concat(
        F.lit("mode="),
        mode,
        F.lit(";depends_on="),
        F.coalesce(F.array_join(F.array_sort(depends_on), ";"), F.lit("")),
        F.when(squash, ";squash=true").otherwise(""),
        F.lit(";body="),
        single_spaced(body),
    )
    return F.substring(F.sha2(content, 256), 1, SIGNATURE_LENGTH)


def fingerprint_scripts(df: DataFrame, column: str, tag: str = TAG) -> DataFrame:
    """Add ``checksum`` (SHA-256 of the body) and ``status`` (ok, missing, invalid)."""
    parsed = parse_script_headers(df, column, tag)
    expected = signature(F.col("mode"), F.col("depends_on"), F.col("squash"), F.col("body"))
    status = (
        F.when(F.col("error").isNotNull(), "invalid")
        .when(F.col("sig").isNull(), "missing")
        .when(F.col("sig") == expected, "ok")
        .otherwise("invalid")
    )
    return parsed.select(
        *df.columns, F.sha2("body", 256).alias("checksum"), status.alias("status")
    )


def signature_policy(fingerprints: DataFrame, require: bool = False) -> DataFrame:
    """Scripts per status and whether that status fails the check."""
    failing = ["invalid", "missing"] if require else ["invalid"]
    counts = fingerprints.groupBy("status").agg(F.count("*").alias("n_scripts"))
    return counts.withColumn("fails", F.col("status").isin(*failing))


def extract_waivers(
    scripts: DataFrame, file: str, column: str, tables: DataFrame, tag: str = TAG
) -> DataFrame:
    """Distinct ``(rule, table, constraint)`` from the leading comment block of each script.

    A line ``-- <tag>:lint-disable=rule[:table[.constraint]]`` without a table holds for
    every table its file defines; one with a table only counts if the file defines it.
    ``tables`` has ``(file, table)`` with qualified names.
    """
    prefix = f"-- {tag}:lint-disable="
    marked = scripts.filter(F.contains(column, F.lit(prefix)))
    lines = F.transform(F.split(column, "\n"), lambda s: F.btrim(s, F.lit(_BLANK)))
    is_code = F.transform("__lines", lambda s: (s != "") & ~F.startswith(s, F.lit("--")))
    code_at = F.array_position(is_code, True)
    leading = F.slice("__lines", 1, F.when(code_at > 0, code_at - 1).otherwise(F.size("__lines")).cast("int"))
    values = F.transform(
        F.filter(leading, lambda s: F.startswith(s, F.lit(prefix))),
        lambda s: F.btrim(F.substring_index(F.substr(s, F.lit(len(prefix) + 1)), " ", 1), F.lit(_BLANK)),
    )
    found = (
        marked.select(F.col(file).alias("file"), lines.alias("__lines"))
        .select("file", F.explode(values).alias("value"))
        .filter("value <> ''")
    )
    rest = F.when(F.contains("value", F.lit(":")), F.expr("substr(value, instr(value, ':') + 1)"))
    parts = found.select(
        "file", F.substring_index("value", ":", 1).alias("rule"), rest.alias("__rest")
    ).select(
        "file",
        "rule",
        F.when(F.col("__rest") != "", F.substring_index("__rest", ".", 1)).alias("named"),
        F.expr("CASE WHEN contains(__rest, '.') THEN nullif(substr(__rest, instr(__rest, '.') + 1), '') END").alias(
            "constraint"
        ),
    )
    qualified = F.when(F.col("named").isNotNull(), F.concat(F.lit("public."), "named"))
    joined = parts.join(tables.select(F.col(file).alias("file"), "table"), "file")
    return (
        joined.filter(F.col("named").isNull() | (F.col("table") == qualified) | (F.col("table") == F.col("named")))
        .select("rule", "table", "constraint")
        .distinct()
    )


# Nanoseconds per unit of a duration such as 1h30s.
_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_DAYS = {"d": 1, "w": 7, "m": 30}


def parse_duration(text: str) -> datetime.timedelta:
    """``7d``, ``2w``, ``3m`` (months of 30 days), else a form like ``720h`` or ``1h30s``."""
    if text and text[-1] in _DAYS:
        if not re.fullmatch(r"[+-]?\d+", text[:-1]):
            raise ValueError(f"invalid duration {text!r}")
        return datetime.timedelta(days=int(text[:-1]) * _DAYS[text[-1]])
    body = text.lstrip("+-") if len(text.lstrip("+-")) >= len(text) - 1 else ""
    if body == "0":
        return datetime.timedelta()
    part = r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)"
    if not re.fullmatch(f"(?:{part})+", body):
        raise ValueError(f"invalid duration {text!r}")
    nanos = sum(float(n) * _UNITS[u] for n, u in re.findall(part, body))
    return datetime.timedelta(microseconds=nanos / 1000) * (-1 if text.startswith("-") else 1)


def name_timestamp(name: Column) -> Column:
    """The time in the first 14 characters (yyyyMMddHHmmss); NULL when it is none."""
    def part(start: int, length: int) -> Column:
        return F.substring(name, start, length).cast("int")

    digits = F.rlike(name, F.lit("^[0-9]{14}"))
    made = F.try_make_timestamp_ntz(
        part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), part(13, 2).cast("decimal(16,6)")
    )
    return F.when(digits, F.when(F.substring(name, 13, 2) < "60", made))


def older_than(df: DataFrame, name_column: str, duration: str, now: datetime.datetime) -> DataFrame:
    """Rows whose name carries a time strictly before ``now - duration``."""
    cutoff = now - parse_duration(duration)
    limit = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
    return df.filter(name_timestamp(F.col(name_column)) < limit)
