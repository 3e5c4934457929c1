"""Tables as SQL INSERT scripts, written and read back in parallel.

Two layouts. A script folder has ``header/`` (small: version, time, table list with row counts,
schema text, sequences) and ``tables/<schema.table>/`` with the statements in order. A script
file (``write_script``, ``read_script``) has all of it in one text: header, schema block, then a section per table
and sequence. It may be cut anywhere into files whose names sort in the order of the text, and
each file into splits; what a line belongs to is carried over both.

Statements are read by column expressions: possessive patterns, which neither recurse nor go back.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keelson.functions.text import from_text, quote_ident, quote_literal, quote_table, to_text
from keelson.operators.batching import batch_rows
from keelson.operators.evolve import Rewrite, any_of, too_long
from keelson.plans.durable import written
from keelson.plans.ordered import Running, with_running
from keelson.sources.bundle import export_self_ref
from keelson.specs import TableSpec

# Markers of the script format.
MARKER = "-- keelson data dump"
VERSION = "-- version: "
CREATED = "-- created_at: "
TABLES = "-- tables: "
SCHEMA_BEGIN = "-- BEGIN SCHEMA"
SCHEMA_END = "-- END SCHEMA"
TABLE = "-- Table: "
SEQUENCE = "-- Sequence: "

# Copies of a whole script: its texts take about two thirds of the bytes of the default.
TIGHT = "zstd"


def insert_statements(
    df: DataFrame, table: str, order: list[str], batch: int = 100, chunk: Column | None = None
) -> DataFrame:
    """``(batch, statement)``: one INSERT per ``batch`` rows in key order.

    Every value is quoted text or NULL. A group is one batch, so nothing larger than a
    statement is gathered.
    """
    return _batches(df, table, order, batch, chunk).select("batch", "statement")


def _batches(df: DataFrame, table: str, order: list[str], batch: int, chunk: Column | None = None) -> DataFrame:
    """``batch, statement, n``, with the number of rows of each statement."""
    cells = [quote_literal(to_text(F.col(f.name), f.dataType)) for f in df.schema]
    values = F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"))
    head = f"INSERT INTO {quote_table(table)} ({', '.join(map(quote_ident, df.columns))}) VALUES\n"
    rows = batch_rows(df.select(*order, values.alias("__values")), order, batch, chunk=chunk)
    picked = F.array_sort(F.collect_list(F.struct(*order, "__values")))
    body = F.array_join(F.transform(picked, lambda r: r["__values"]), ",\n")
    return rows.groupBy("batch").agg(F.concat(F.lit(head), body, F.lit(";")).alias("statement"), F.count(F.lit(1)).alias("n"))


def update_statements(patch: DataFrame, table: str, pk: list[str]) -> DataFrame:
    """One UPDATE per patch row that sets its non-NULL columns by primary key."""
    def pairs(cols: list[str], joiner: str) -> Column:
        parts = [
            F.when(
                F.col(c).isNotNull(),
                F.concat(F.lit(quote_ident(c) + " = "), quote_literal(to_text(F.col(c), patch.schema[c].dataType))),
            )
            for c in cols
        ]
        return F.concat_ws(joiner, *parts)

    cols = [c for c in patch.columns if c not in pk]
    statement = F.concat(
        F.lit(f"UPDATE {quote_table(table)} SET "), pairs(cols, ", "), F.lit(" WHERE "), pairs(pk, " AND "), F.lit(";")
    )
    return patch.select(*pk, statement.alias("statement"))


def write_sql_dump(
    tables: dict[str, DataFrame],
    specs: list[TableSpec],
    out: str,
    batch: int = 100,
    schema_sql: str = "",
    sequences: dict[str, int] | None = None,
    marker: str = MARKER,
    compression: str = "none",
) -> None:
    """Write tables (in the order of ``specs``) as a script folder."""
    spark = next(iter(tables.values())).sparkSession
    sections = []
    for spec in specs:
        df = tables[spec.name].select(*[c.name for c in spec.insertable()])
        pk, path = list(spec.primary_key), f"{out}/tables/{spec.name}"
        self_cols = spec.self_columns()
        patch = None
        if self_cols:
            df, patch = export_self_ref(df, pk, self_cols)
        # counted while they are written; above the sort, as what is below it also runs for its sample
        seen, total = Observation(), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
        statements = _batches(df, spec.name, pk or df.columns, batch).orderBy("batch").observe(seen, total).select("statement")
        writer = {"lineSep": "\n\n", "compression": compression}
        statements.write.options(**writer).text(path)
        if patch is not None:
            updates = update_statements(patch, spec.name, pk).select("statement")
            updates.write.options(**writer).text(f"{out}/updates/{spec.name}")
        sections.append(f"{TABLE}{spec.name} ({seen.get['rows']} rows)")
    lines = [*_head_lines(specs, schema_sql, marker), *sections]
    for name, value in (sequences or {}).items():
        lines += [f"{SEQUENCE}{name}", f"SELECT setval('{name}', {value});"]
    header = spark.createDataFrame([("\n".join(lines),)], "value string")
    header.coalesce(1).write.text(f"{out}/header")


def _head_lines(specs: list[TableSpec], schema_sql: str, marker: str) -> list[str]:
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [marker, f"{VERSION}1", f"{CREATED}{now}", TABLES + ",".join(s.name for s in specs)]
    return [*lines, SCHEMA_BEGIN, *([schema_sql] if schema_sql else []), SCHEMA_END]


def write_script(
    tables: dict[str, DataFrame],
    specs: list[TableSpec],
    out: str,
    batch: int = 100,
    schema_sql: str = "",
    sequences: dict[str, int] | None = None,
    marker: str = MARKER,
    compression: str = "none",
) -> None:
    """Write one script, tables in the order of ``specs``, as files that joined by name are the text.

    A table that references itself has its rows first, then the updates that fill the references.
    """
    spark = next(iter(tables.values())).sparkSession
    texts, heads = None, [(0, 0, "\n".join(_head_lines(specs, schema_sql, marker)))]
    for at, spec in enumerate(specs, 1):
        df = tables[spec.name].select(*[c.name for c in spec.insertable()])
        pk, self_cols = list(spec.primary_key), spec.self_columns()
        patch = None
        if self_cols:
            df, patch = export_self_ref(df, pk, self_cols)
        statements = _batches(df, spec.name, pk or df.columns, batch)
        heads.append((at, 0, f"{TABLE}{spec.name} ({df.count()} rows)"))
        parts = [statements.select(F.lit(at).alias("section"), F.lit(1).alias("kind"), "batch", F.col("statement").alias("text"))]
        if patch is not None:
            updates = update_statements(patch, spec.name, pk).select("statement")
            parts.append(updates.select(F.lit(at), F.lit(2), F.xxhash64("statement"), "statement"))
        for part in parts:
            texts = part if texts is None else texts.union(part)
    for k, (name, value) in enumerate((sequences or {}).items()):
        heads.append((len(specs) + 1 + k, 0, f"{SEQUENCE}{name}\nSELECT setval('{name}', {value});"))
    fixed = spark.createDataFrame(heads, "section int, kind int, text string").select("section", "kind", F.lit(0).cast("long").alias("batch"), "text")
    order = ["section", "kind", "batch"]
    # drawing borders reads the shuffled batches a second time, which is less than a copy of the whole text
    ordered = texts.union(fixed).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("text").write.options(lineSep="\n\n", compression=compression).text(out)


class ScriptError(ValueError):
    pass


def parse_header(lines: list[str], marker: str = MARKER) -> dict:
    """Checked contents of a script header."""
    if not lines:
        raise ScriptError("empty script")
    if lines[0].strip() != marker:
        raise ScriptError("missing header marker")

    def field(i: int, prefix: str) -> str:
        if i >= len(lines) or not lines[i].startswith(prefix):
            raise ScriptError(f"expected a line starting with {prefix!r}")
        return lines[i][len(prefix):]

    version = field(1, VERSION)
    if not version.isdigit():
        raise ScriptError(f"invalid version {version!r}")
    created = field(2, CREATED)
    names = [n for n in field(3, TABLES).split(",") if n]
    stripped = [line.strip() for line in lines]
    if SCHEMA_BEGIN not in stripped:
        raise ScriptError("missing schema block")
    begin = stripped.index(SCHEMA_BEGIN)
    end = stripped.index(SCHEMA_END, begin) if SCHEMA_END in stripped[begin:] else len(lines)
    rows, sequences = {}, {}
    for i, line in enumerate(lines[end + 1 :], end + 1):
        if line.startswith(TABLE):
            m = re.fullmatch(r"(.*) \((\d+) rows\)", line[len(TABLE):])
            if not m:
                raise ScriptError(f"invalid row count in {line!r}")
            rows[m[1]] = int(m[2])
        elif line.startswith(SEQUENCE):
            m = re.fullmatch(r"SELECT setval\(.*, (-?\d+)\);", stripped[i + 1] if i + 1 < len(lines) else "")
            if not m:
                raise ScriptError(f"invalid sequence value after {line!r}")
            sequences[line[len(SEQUENCE):]] = int(m[1])
    return {
        "version": int(version),
        "created_at": created,
        "tables": names,
        "schema": "\n".join(lines[begin + 1 : end]).strip(),
        "rows": rows,
        "sequences": sequences,
    }


def read_header(spark: SparkSession, path: str, marker: str = MARKER) -> dict:
    return parse_header([r[0] for r in spark.read.text(f"{path}/header", wholetext=False).collect()], marker)


def read_statements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, pos, statement)`` of scripts whose statements end in ``;`` and a newline.

    A quoted value may contain that separator: a fragment that begins inside quotes (odd
    number of quotes before it in its file) is joined to the statement it continues. The
    running count is carried over file splits, so one huge file is still read in parallel.
    """
    raw = spark.read.option("lineSep", ";\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )
    # written once, so that positions are the same for everything that follows
    parts = written(raw, "script-fragments")
    quotes = (F.length("value") - F.length(F.replace("value", F.lit("'"), F.lit("")))).cast("bigint")
    whole = parts.select("file", "pos", F.col("value").alias("statement"))
    if parts.filter(quotes % 2 == 1).isEmpty():
        return whole
    narrow = parts.select("file", "block", "pos", quotes.alias("quotes"))
    block = F.col("block")
    inside = with_running(
        narrow, ["file"], ["pos"], {"before": Running("sum", F.col("quotes"), inclusive=False)}, block
    )
    start = F.when(F.col("before") % 2 == 0, F.col("pos"))
    begun = with_running(inside, ["file"], ["pos"], {"start": Running("last", start)}, block)
    pieces = whole.join(begun.select("file", "pos", "start"), ["file", "pos"])
    # one group per statement
    ordered = F.array_sort(F.collect_list(F.struct("pos", "statement")))
    return pieces.groupBy("file", "start").agg(
        F.array_join(F.transform(ordered, lambda p: p["statement"]), ";\n").alias("statement")
    ).withColumnRenamed("start", "pos")


_NAME = r'"(?:[^"]|"")*+"'
_TEXT = r"'[^']*+(?:''[^']*+)*+'"
_CELL = rf"(?:{_TEXT}|NULL\b|[^\s(),';]++)"
_ROW = rf"\(\s*+{_CELL}(?:\s*+,\s*+{_CELL})*+\s*+\)"
_TARGET = rf"{_NAME}(?:\.{_NAME})?+"
_HEAD = rf"^INSERT INTO {_TARGET}\s*+\(((?:{_NAME}|[^)\"])*+)\)\s*+VALUES\s*+"
_BODY = rf"^{_ROW}(?:\s*+,\s*+{_ROW})*+\s*+$"
_PAIR = rf"{_NAME}\s*+=\s*+{_TEXT}"
_UPDATE = rf"^UPDATE {_TARGET}\s++SET\s++{_PAIR}(?:\s*+,\s*+{_PAIR})*+\s++WHERE\s++{_PAIR}(?:\s++AND\s++{_PAIR})*+\s*+$"
_READ = "struct<names:array<string>,rows:array<array<string>>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _unquoted(token: Column, mark: str) -> Column:
    return F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit(mark * 2), F.lit(mark))


def _value(token: Column) -> Column:
    return F.when(F.startswith(token, F.lit("'")), _unquoted(token, "'")).when(token != "NULL", token)


def statement_rows(statement: Column) -> Column:
    """Column names and the values of each row of one INSERT or UPDATE; NULL unless all of it is read."""

    def insert(head: Column) -> Column:
        body = F.substring(statement, F.length(head) + 1, F.length(statement))
        names = F.transform(_found(F.regexp_extract(head, _HEAD, 1), _NAME), lambda n: _unquoted(n, '"'))
        rows = F.transform(_found(body, _ROW), lambda r: F.transform(_found(r, _CELL), _value))
        fits = lambda p: F.forall(p["rows"], lambda r: F.size(r) == F.size(p["names"]))
        read = _let(F.struct(names.alias("names"), rows.alias("rows")).cast(_READ), lambda p: F.when(fits(p), p))
        return F.when((F.length(head) > 0) & F.rlike(body, F.lit(_BODY)), read)

    def update(pairs: Column) -> Column:
        name = lambda p: _unquoted(F.regexp_extract(p, f"^{_NAME}", 0), '"')
        text = lambda p: _unquoted(F.regexp_extract(p, rf"^{_NAME}\s*+=\s*+({_TEXT})$", 1), "'")
        return F.struct(F.transform(pairs, name).alias("names"), F.array(F.transform(pairs, text)).alias("rows")).cast(_READ)

    inserted = _let(F.regexp_extract(statement, _HEAD, 0), insert)
    updated = _let(_found(statement, _PAIR), update)
    return F.when(F.startswith(statement, F.lit("INSERT")), inserted).when(F.rlike(statement, F.lit(_UPDATE)), updated)


@dataclass(frozen=True)
class ScriptRows(Rewrite):
    """``unread`` has the statements that are cut short or malformed."""

    unread: DataFrame


def _bare(statement: Column) -> Column:
    """A statement without comment lines before it and the semicolon behind it."""
    code = F.regexp_replace(statement, r"^(?:\s*+--[^\n]*+(?:\n|$)|\s++)*+", "")
    return F.regexp_replace(code, r";\s*+$", "")


def _cells(statements: DataFrame, spec: TableSpec, command: str) -> DataFrame:
    """``names, cells, unread`` of the statements of one table; a statement is read whole or is ``unread``."""
    bare = statements.select(_bare(F.col("statement")).alias("statement"))
    wanted = bare.filter(F.startswith("statement", F.lit(f"{command} {quote_table(spec.name)}")))
    read = wanted.select("statement", statement_rows(F.col("statement")).alias("read"))
    nothing = F.array(F.array(F.lit(None).cast("string")))
    each = read.select("statement", "read", F.explode(F.coalesce("read.rows", nothing)).alias("cells"))
    names = F.coalesce("read.names", F.array(F.lit("-")))
    return each.select(names.alias("names"), "cells", F.when(F.col("read").isNull(), F.col("statement")).alias("unread"))


def _typed(cells: DataFrame, spec: TableSpec, command: str) -> ScriptRows:
    columns = [c for c in spec.insertable()]
    if command == "UPDATE":
        columns = [c for c in columns if c.name in (*spec.primary_key, *spec.self_columns())]
    by_name = F.map_from_arrays("names", "cells")
    text = cells.select(*[F.element_at(by_name, F.lit(c.name)).alias(c.name) for c in columns], "unread")
    good, bad = [], []
    for c in columns:
        cell = F.col(c.name)
        value = from_text(cell, c.data_type)
        good.append(value.alias(c.name))
        bad.append((value.isNull() & cell.isNotNull()) | too_long(cell, c.data_type))
    flag = F.coalesce(any_of(bad), F.lit(False))
    read = text.filter("unread IS NULL").drop("unread")
    unread = text.filter("unread IS NOT NULL").select(F.col("unread").alias("statement"))
    return ScriptRows(read.filter(~flag).select(*good), read.filter(flag), unread)


def read_sql_dump(spark: SparkSession, paths: str | list[str], spec: TableSpec, command: str = "INSERT INTO") -> ScriptRows:
    """Typed rows of one table from its statements; cells that do not fit are split off.

    A statement that is cut short or malformed gives no rows; it is a row of ``unread``.
    ``command='UPDATE'`` reads the patch rows instead.
    """
    return _typed(_cells(read_statements(spark, paths), spec, command), spec, command)


def _counted(cells: DataFrame) -> tuple[int, int]:
    """Rows and unread statements."""
    return cells.agg(F.count_if(F.col("unread").isNull()), F.count("unread")).first()


def read_dump(spark: SparkSession, path: str, specs: list[TableSpec], marker: str = MARKER) -> dict[str, ScriptRows]:
    """The tables of a script folder, checked against its header.

    The header must be whole (marker, version, schema block), list the tables asked for, and
    give the number of rows that each section has, misfits included.
    """
    header = read_header(spark, path, marker)
    out, problems = {}, []
    for spec in specs:
        if spec.name not in header["rows"]:
            problems.append(f"{spec.name} is not in the header")
            continue
        # read once: counts and rows come from what is written
        cells = written(_cells(read_statements(spark, f"{path}/tables/{spec.name}"), spec, "INSERT INTO"), "script-cells")
        rows, unread = _counted(cells)
        if unread or rows != header["rows"][spec.name]:
            problems.append(f"{spec.name}: {header['rows'][spec.name]} rows announced, {rows} read, {unread} statements unread")
        out[spec.name] = _typed(cells, spec, "INSERT INTO")
    if problems:
        raise ScriptError("; ".join(problems))
    return out


@dataclass(frozen=True)
class Script:
    """A script that was read: ``sections`` has table, rows announced, rows read and unread statements."""

    header: dict
    sections: DataFrame
    sequences: dict[str, int]
    tables: dict[str, ScriptRows]
    patches: dict[str, ScriptRows]


_PLACE = ["file", "block", "pos"]


def _script_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )
    # written once, so that positions are the same for everything that follows
    return written(raw, "script-lines", TIGHT)


def _script_head(lines: DataFrame, marker: str) -> tuple[dict, DataFrame]:
    """The checked header, and the lines after the schema block. Only the header comes to the driver."""
    at = F.struct(*_PLACE)
    after = lambda row: F.struct(*[F.lit(row[c]).alias(c) for c in _PLACE])
    first = lambda df: df.orderBy(*_PLACE).limit(1).collect()
    fields = [r["value"] for r in lines.orderBy(*_PLACE).limit(4).collect()]
    begin = first(lines.filter(F.trim("value") == SCHEMA_BEGIN))
    end = first(lines.filter((F.trim("value") == SCHEMA_END) & (at > after(begin[0])))) if begin else []
    if not end:
        parse_header([*fields, *([SCHEMA_BEGIN] if begin else [])], marker)
        raise ScriptError("the schema block does not end")
    head = [r["value"] for r in lines.filter(at <= after(end[0])).orderBy(*_PLACE).collect()]
    return parse_header(head, marker), lines.filter(at > after(end[0]))


def _script_statements(body: DataFrame) -> tuple[list[tuple[int, str]], DataFrame]:
    """The section marks (number, line), and ``section, statement`` of the lines after the header.

    A mark, a blank line or a semicolon at the end of a line count only outside quotes; the number of quotes
    before a line, its section and its statement are running values over all splits and files.
    """
    quotes = (F.length("value") - F.length(F.replace("value", F.lit("'"), F.lit("")))).cast("bigint")
    mark = F.when(F.startswith("value", F.lit(TABLE)) | F.startswith("value", F.lit(SEQUENCE)), F.col("value"))
    narrow = body.select(
        *_PLACE, quotes.alias("quotes"), mark.alias("mark"), (F.trim("value") == "").alias("blank"), F.rlike("value", F.lit(r";\s*+$")).alias("ends")
    )
    (total,) = narrow.agg(F.sum("quotes")).first()
    if (total or 0) % 2:
        raise ScriptError("a quoted value does not end")
    split = F.struct("file", "block")
    before = with_running(narrow, [], _PLACE, {"before": Running("sum", F.col("quotes"), inclusive=False)}, split)
    outside = F.col("before") % 2 == 0
    real = outside & F.col("mark").isNotNull()
    closes = real | (((F.col("before") + F.col("quotes")) % 2 == 0) & (F.col("ends") | (F.col("blank") & outside)))
    told = before.withColumns({"real": real, "closes": closes, "empty": F.col("blank") & outside})
    running = {"section": Running("sum", F.col("real").cast("bigint")), "nth": Running("sum", F.col("closes").cast("bigint"), inclusive=False)}
    placed = written(with_running(told, [], _PLACE, running, split).select(*_PLACE, "section", "nth", "real", "empty", "mark"), "script-places")
    # one row per section
    marks = [(r["section"], r["mark"]) for r in placed.filter("real").orderBy("section").collect()]
    wanted = placed.filter("NOT real AND NOT empty").select(*_PLACE, "section", "nth")
    picked = F.array_sort(F.collect_list(F.struct(*_PLACE, "value")))
    joined = F.array_join(F.transform(picked, lambda x: x["value"]), "\n")
    # one group per statement
    statements = wanted.join(body, _PLACE).groupBy("section", "nth").agg(joined.alias("statement"))
    return marks, statements.select("section", "statement")


def read_script(spark: SparkSession, path: str, specs: list[TableSpec], marker: str = MARKER) -> Script:
    """The tables and sequences of a script file, plain or compressed, or of a folder of its parts.

    The header must be whole, every section must announce its rows, and each table asked for must have
    a section with as many rows as announced, misfits included. A table may have several sections.
    """
    header, body = _script_head(_script_lines(spark, path), marker)
    marks, statements = _script_statements(body)
    statements = written(statements, "script-statements", TIGHT)
    announced, named = [], {}
    for number, line in marks:
        if line.startswith(SEQUENCE):
            named[number] = line[len(SEQUENCE):].strip()
            continue
        m = re.fullmatch(r"(.*) \((\d+) rows\)", line[len(TABLE):].strip())
        if not m:
            raise ScriptError(f"invalid row count in {line!r}")
        announced.append((number, m[1], int(m[2])))

    sequences = {}
    of_sequences = statements.filter(F.col("section").isin(list(named))).orderBy("section")
    for row in of_sequences.collect() if named else []:
        m = re.fullmatch(r"SELECT setval\(.*, (-?\d+)\);?", row["statement"].strip())
        if not m:
            raise ScriptError(f"invalid sequence value of {named[row['section']]!r}")
        sequences.setdefault(named[row["section"]], int(m[1]))
    if missing := [n for n in named.values() if n not in sequences]:
        raise ScriptError(f"no value of {missing[0]!r}")

    tables, patches, counts, problems = {}, {}, [], []
    for spec in specs:
        numbers = [n for n, name, _ in announced if name == spec.name]
        if not numbers:
            problems.append(f"{spec.name} has no section")
            continue
        own = statements.filter(F.col("section").isin(numbers))
        cells = written(_cells(own, spec, "INSERT INTO"), "script-cells", TIGHT)
        tables[spec.name] = _typed(cells, spec, "INSERT INTO")
        if spec.self_columns():
            patches[spec.name] = _typed(_cells(own, spec, "UPDATE"), spec, "UPDATE")
        said, (rows, unread) = sum(n for _, name, n in announced if name == spec.name), _counted(cells)
        counts.append((spec.name, said, rows, unread))
        if unread or rows != said:
            problems.append(f"{spec.name}: {said} rows announced, {rows} read, {unread} statements unread")
    if problems:
        raise ScriptError("; ".join(problems))
    sections = spark.createDataFrame(counts, "table string, announced bigint, rows bigint, unread bigint")
    return Script(header, sections, sequences, tables, patches)
