"""Export and restore of a set of related tables as a folder of parquet tables.

Layout: ``manifest/`` (one JSON text file), ``data/<table>/`` and, for tables that point
at themselves, ``patch/<table>/``.

A restore can be cut off anywhere. All tables are staged under ``target/_load-…``; then one small file
``target/load.commit`` appears by a rename and says what moves in. Before it nothing has changed; after it
every move can be repeated, and ``recover`` (the first thing the next load does) finishes them.
"""

from __future__ import annotations

import datetime
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.evolve import EvolutionError, conform_issues, conform_to_target
from keelson.operators.graph import load_order
from keelson.operators.integrity import fk_violations
from keelson.plans.ordered import number_rows, plan_chunks
from keelson.specs import TableSpec, qualified

FORMAT_VERSION = 1
# tables written at a time; each is a job of its own
WRITERS = 4


def high_water_marks(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(sequence, value)``: the largest key per named sequence; an unused one is left out."""
    parts = [
        df.agg(F.max(F.col(key)).cast("bigint").alias("value")).select(F.lit(name).alias("sequence"), "value")
        for name, (df, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).filter("value IS NOT NULL")


def assign_ids(df: DataFrame, start: int | None, order: list[str], name: str, chunk: Column | None = None) -> DataFrame:
    """Continue numbering after ``start`` (None: from 1) in the given order."""
    if chunk is None:
        chunk = plan_chunks(df, order)
    numbered = number_rows(df, order, name, [], chunk)
    return numbered.withColumn(name, F.col(name) + F.lit(start or 0))


def export_self_ref(df: DataFrame, pk: list[str], self_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with their self references blank, and the patch that fills them in.

    The patch holds a row only where some self column is set.
    """
    if not pk:
        raise ValueError("a table that references itself needs a primary key")
    base = df.select(
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) if c in self_cols else F.col(c) for c in df.columns]
    )
    patch = df.select(*pk, *self_cols).filter(F.coalesce(*[F.col(c).cast("string") for c in self_cols]).isNotNull())
    return base, patch


def apply_patch(base: DataFrame, patch: DataFrame, pk: list[str]) -> DataFrame:
    """Set the non-NULL patch columns by primary key and leave everything else."""
    cols = [c for c in patch.columns if c not in pk]
    side = patch.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(pk)], *[F.col(c).alias(f"__p_{c}") for c in cols]
    )
    pair = reduce(lambda a, b: a & b, [base[k] == side[f"__k{i}"] for i, k in enumerate(pk)])
    return base.join(side, pair, "left").select(
        *[F.coalesce(F.col(f"__p_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns]
    )


def _write_counted(df: DataFrame, path: str, codec: str = "snappy") -> int:
    """Write ``df`` and return its number of rows, from the footers of what was written."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def export_database(
    tables: dict[str, DataFrame],
    specs: list[TableSpec],
    out: str,
    sequences: dict[str, tuple[DataFrame, str]] | None = None,
    compression: str | None = None,
) -> dict:
    """Write every table, parents first, and a manifest with the rows written per table.

    A name ending in ``.gz`` turns gzip on. Returns the manifest.
    """
    spark = next(iter(tables.values())).sparkSession
    frames = {qualified(n): df for n, df in tables.items()}
    by_name = {s.name: s for s in specs}
    codec = compression or ("gzip" if out.endswith(".gz") else "snappy")
    order = load_order(specs)
    entries = []
    for name in order:
        spec = by_name[name]
        df = frames[name].select(*[c.name for c in spec.insertable()])
        self_cols = spec.self_columns()
        if self_cols:
            df, patch = export_self_ref(df, list(spec.primary_key), self_cols)
            patch.write.option("compression", codec).parquet(f"{out}/patch/{name}")
        rows = _write_counted(df, f"{out}/data/{name}", codec)
        entries.append({"table": name, "rows": rows, "self_columns": self_cols, "schema": df.schema.jsonValue()})
    marks = {r["sequence"]: r["value"] for r in high_water_marks(sequences).collect()} if sequences else {}
    manifest = {
        "version": FORMAT_VERSION,
        "created_at": datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "tables": entries,
        "sequences": marks,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{out}/manifest")
    return manifest


def read_manifest(spark: SparkSession, bundle: str) -> dict:
    row = spark.read.text(f"{bundle}/manifest").first()
    if row is None:
        raise ValueError("empty manifest")
    manifest = json.loads(row[0])
    if manifest.get("version") != FORMAT_VERSION:
        raise ValueError(f"unsupported bundle version {manifest.get('version')}")
    return manifest


def manifest_tables(spark: SparkSession, bundle: str) -> DataFrame:
    """One row per exported table, from the manifest."""
    rows = [(i, e["table"], e["rows"]) for i, e in enumerate(read_manifest(spark, bundle)["tables"])]
    return spark.createDataFrame(rows, "load_order bigint, table string, rows bigint")


def load_summary(spark: SparkSession, bundle: str) -> DataFrame:
    """Tables, rows and sequences of a bundle, without touching its data."""
    m = read_manifest(spark, bundle)
    row = (len(m["tables"]), sum(e["rows"] for e in m["tables"]), len(m["sequences"]))
    return spark.createDataFrame([row], "tables bigint, rows bigint, sequences bigint")


@dataclass(frozen=True)
class LoadResult:
    """``sequences`` holds the last value per sequence; ``assign_ids`` goes on from there."""

    tables: int
    rows: int
    fk_violations: dict[str, DataFrame]
    sequences: dict[str, int]


def _exists(spark: SparkSession, path: str, spec: TableSpec) -> bool:
    try:
        spark.read.schema(spec.struct()).parquet(path)
        return True
    except AnalysisException:
        return False


class _Files:
    """The few file operations of a restore, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, target: str):
        # PySpark has no file API of its own; this is Hadoop's, which Spark's writers use
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(path))]

    def rename(self, source: str, to: str) -> None:
        self.fs.mkdirs(self.path(to).getParent())
        if not self.fs.rename(self.path(source), self.path(to)):
            raise OSError(f"cannot move {source} to {to}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def _commit(spark: SparkSession, files: _Files, staging: str, target: str, tables: list[str], replace: bool) -> None:
    """From here on the load is done or will be finished by ``recover``."""
    plan = json.dumps({"staging": staging.rsplit("/", 1)[1], "tables": tables, "replace": replace})
    spark.createDataFrame([(plan,)], "value string").coalesce(1).write.text(f"{staging}/_plan")
    part = [n for n in files.names(f"{staging}/_plan") if n.startswith("part-")]
    files.rename(f"{staging}/_plan/{part[0]}", f"{target}/load.commit")


def recover(spark: SparkSession, target: str) -> bool:
    """Finish a committed load that was cut off; whether there was one. May be repeated at any point."""
    files, mark = _Files(spark, target), f"{target}/load.commit"
    if not files.exists(mark):
        return False
    plan = json.loads(spark.read.text(mark).first()[0])
    staging = f"{target}/{plan['staging']}"
    for name in plan["tables"]:
        staged, table = f"{staging}/{name}", f"{target}/{name}"
        if not files.exists(staged):
            continue  # moved in before
        if plan["replace"] and files.exists(table):
            files.rename(table, f"{staging}/_old/{name}")
        if not files.exists(table):
            files.rename(staged, table)
            continue
        for part in files.names(staged):
            if part.startswith("part-"):
                files.rename(f"{staged}/{part}", f"{table}/{part}")
    files.delete(mark)
    files.delete(staging)
    return True


def load_database(
    spark: SparkSession, bundle: str, target: str, specs: list[TableSpec], mode: str = "append"
) -> LoadResult:
    """Load a bundle into ``target/<table>``.

    Modes: ``append``, ``truncate`` (empty the bundle's tables first), ``create`` (the
    target must not exist) and ``dry-run``. Conformance errors are raised before anything
    is written. Every table is written once, under ``target/_load-…``; a row that does not fit
    leaves the target as it was, and the staged tables are moved in when all of them are whole. A load that
    was cut off after its commit is finished first, by any mode but ``dry-run``. Empty tables
    exist in the target but are not counted. Truncation is refused when a
    table outside the bundle references one inside it. After the load the foreign keys of
    the loaded tables are checked; the orphan rows come back lazily per key.
    """
    if mode not in ("append", "truncate", "create", "dry-run"):
        raise ValueError(f"unknown mode {mode}")
    manifest = read_manifest(spark, bundle)
    by_name = {s.name: s for s in specs}
    entries = {e["table"]: e for e in manifest["tables"]}
    shapes = {n: T.StructType.fromJson(e["schema"]) for n, e in entries.items()}
    problems = []
    for name, schema in shapes.items():
        problems += [
            i.description for i in conform_issues(schema, by_name.get(name), name) if i.severity == "error"
        ]
    if problems:
        raise EvolutionError(problems)
    if mode == "dry-run":
        return LoadResult(len(entries), sum(e["rows"] for e in entries.values()), {}, manifest["sequences"])
    recover(spark, target)
    if mode == "truncate":
        outside = [
            f"{s.name} references {qualified(f.parent)}"
            for s in specs
            if s.name not in entries
            for f in s.foreign_keys
            if qualified(f.parent) in entries
        ]
        if outside:
            raise EvolutionError(outside)
    if mode == "create":
        there = [n for n in entries if _exists(spark, f"{target}/{n}", by_name[n])]
        if there:
            raise EvolutionError([f"{n} exists in the target" for n in there])
    staging = f"{target}/_load-{uuid.uuid4().hex}"

    def stage(name: str) -> None:
        entry, spec, shape = entries[name], by_name[name], shapes[name]
        df = spark.read.schema(shape).parquet(f"{bundle}/data/{name}")
        if entry["self_columns"]:
            keys = [f for f in shape if f.name in (*spec.primary_key, *entry["self_columns"])]
            patch = spark.read.schema(T.StructType(keys)).parquet(f"{bundle}/patch/{name}")
            df = apply_patch(df, patch, list(spec.primary_key))
        split = conform_to_target(df, spec)
        fitting = _write_counted(split.good, f"{staging}/{name}")
        if fitting < entry["rows"]:
            example = [r.asDict() for r in split.bad.take(1)]
            raise EvolutionError([f"{name}: {entry['rows'] - fitting} rows do not fit the target, e.g. {example}"])

    order = load_order([by_name[n] for n in entries])
    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(stage, order))
    _commit(spark, _Files(spark, target), staging, target, order, mode == "truncate")
    recover(spark, target)
    loaded, rows = sum(e["rows"] > 0 for e in entries.values()), sum(e["rows"] for e in entries.values())
    present = {
        n: spark.read.schema(by_name[n].struct()).parquet(f"{target}/{n}")
        for n in {*entries, *(qualified(f.parent) for e in entries for f in by_name[e].foreign_keys)}
        if n in by_name and _exists(spark, f"{target}/{n}", by_name[n])
    }
    orphans = {
        f"{name}.{fk.label}": fk_violations(
            present[name], present[qualified(fk.parent)], list(fk.columns), list(fk.parent_columns)
        )
        for name in entries
        for fk in by_name[name].foreign_keys
        if name in present and qualified(fk.parent) in present
    }
    return LoadResult(loaded, rows, orphans, manifest["sequences"])
