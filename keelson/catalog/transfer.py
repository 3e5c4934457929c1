"""Export, restore, scripts, numbering, sizes and dependency order."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.integrity import PART_TREE, part_tree
from keelson.catalog.registry import Tables, query
from keelson.catalog.tables import SPECS
from keelson.operators import graph
from keelson.operators import stats
from keelson.operators.batching import batch_rows
from keelson.plans.durable import fresh_path
from keelson.sources import bundle, script
from keelson.sources.scan import scan_table
from keelson.specs import Column, ForeignKey, TableSpec

# every table, in the order in which they load
RELATED = [
    "benchmark", "conversations", "documents", "embeddings", "pages", "part", "region",
    "labels", "nation", "customer", "supplier", "events", "orders", "lineitem",
]
_RELATED_COUNTS = "\nUNION ALL ".join(f"SELECT 'public.{n}' AS \"table\", count(*) AS rows FROM {n}" for n in RELATED)


@query("scan_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables):
    spec = SPECS["nation"].with_column(Column("label", "string", computed="upper(n_name)"))
    return scan_table(t.spark, spec, f"{t.folder}/nation.parquet", ordered=True)


def _exported(t: Tables) -> str:
    out = fresh_path(t.spark, "export")
    bundle.export_database(
        {n: t(n) for n in RELATED},
        [SPECS[n] for n in RELATED],
        out,
        sequences={"public.orders_seq": (t("orders"), "o_orderkey"), "public.part_seq": (t("part"), "p_partkey")},
    )
    return out


@query(
    "export_database",
    f"""
    WITH c AS ({_RELATED_COUNTS}), o("table", load_order) AS (VALUES
      {", ".join(f"('public.{n}', {i})" for i, n in enumerate(RELATED))})
    SELECT CAST(o.load_order AS BIGINT) AS load_order, c."table", c.rows FROM c JOIN o USING ("table")
    """,
)
def _(t):
    return bundle.manifest_tables(t.spark, _exported(t))


@query(
    "load_summary",
    f"SELECT count(*) AS tables, CAST(sum(rows) AS BIGINT) AS rows, CAST(2 AS BIGINT) AS sequences FROM ({_RELATED_COUNTS})",
)
def _(t):
    return bundle.load_summary(t.spark, _exported(t))


@query(
    "load_database",
    f"""
    WITH c AS ({_RELATED_COUNTS}), o("table", n) AS (
      SELECT 'public.events', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'public.labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
      UNION ALL SELECT 'public.orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    SELECT "table", rows + CASE WHEN "table" = 'public.orders' THEN rows ELSE 0 END AS rows, coalesce(n, 0) AS orphans
    FROM c LEFT JOIN o USING ("table")
    """,
)
def _(t):
    """Create, reload with truncation, then append one more table."""
    out, target = _exported(t), fresh_path(t.spark, "target")
    specs = [SPECS[n] for n in RELATED]
    bundle.load_database(t.spark, out, target, specs, "create")
    result = bundle.load_database(t.spark, out, target, specs, "truncate")
    more = fresh_path(t.spark, "export")
    bundle.export_database({"orders": t("orders")}, [SPECS["orders"]], more)
    bundle.load_database(t.spark, more, target, specs, "append")
    parts = None
    for n in RELATED:
        name = f"public.{n}"
        rows = t.spark.read.schema(SPECS[n].struct()).parquet(f"{target}/{name}").agg(F.count("*").alias("rows"))
        part = rows.select(F.lit(name).alias("table"), "rows")
        parts = part if parts is None else parts.unionByName(part)
    orphans = None
    for key, df in result.fk_violations.items():
        table = ".".join(key.split(".")[:2])
        part = df.agg(F.count("*").alias("orphans")).select(F.lit(table).alias("table"), "orphans")
        orphans = part if orphans is None else orphans.unionByName(part)
    bad = orphans.groupBy("table").agg(F.sum("orphans").alias("orphans"))
    return parts.join(bad, "table", "left").select("table", "rows", F.coalesce("orphans", F.lit(0)).alias("orphans"))


_STATEMENT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "write_sql_dump",
    """
    WITH r AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch, o_orderkey,
      '(''' || o_orderkey || ''', ' || coalesce('''' || nullif(o_custkey % 5, 0) || '''', 'NULL') || ', '
      || '''' || o_orderstatus || '''''s'', ''' || o_orderpriority || ''')' AS v FROM orders)
    SELECT batch, sha256('INSERT INTO "public"."orders" ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority") VALUES' || chr(10)
      || string_agg(v, ',' || chr(10) ORDER BY o_orderkey) || ';') AS digest
    FROM r GROUP BY batch
    """,
)
def _(t):
    df = t("orders").select(*_STATEMENT_COLUMNS).withColumns(
        {"o_custkey": F.expr("nullif(o_custkey % 5, 0)"), "o_orderstatus": F.concat("o_orderstatus", F.lit("'s"))}
    )
    out = script.insert_statements(df, "public.orders", ["o_orderkey"])
    return out.select("batch", F.sha2("statement", 256).alias("digest"))


def _script_round_trip(t: Tables, *names: str) -> str:
    out = fresh_path(t.spark, "script")
    script.write_sql_dump({SPECS[n].name: t(n) for n in names}, [SPECS[n] for n in names], out)
    return out


@query("read_sql_dump", "SELECT * FROM customer")
def _(t):
    out = _script_round_trip(t, "nation", "customer")
    return script.read_sql_dump(t.spark, f"{out}/tables/*", SPECS["customer"]).good


@query("read_sql_dump_text", "SELECT doc_id, text || ';' || chr(10) || 'it''s' AS text, lang, source, n_chars FROM documents")
def _(t):
    """Whole texts with line breaks, quotes and statement separators inside the values."""
    spec = SPECS["documents"]
    out = fresh_path(t.spark, "script")
    df = t("documents").withColumn("text", F.concat("text", F.lit(";\nit's")))
    script.write_sql_dump({spec.name: df}, [spec], out)
    return script.read_sql_dump(t.spark, f"{out}/tables/*", spec).good


@query("read_sql_dump_embeddings", "SELECT vec_id, embedding, label FROM embeddings")
def _(t):
    """Arrays of floats through a script."""
    out = _script_round_trip(t, "embeddings")
    return script.read_dump(t.spark, out, [SPECS["embeddings"]])["public.embeddings"].good


NESTED_SPEC = TableSpec(
    "nested",
    (
        Column("event_id", "bigint", False),
        Column("times", "array<timestamp_ntz>"),
        Column("counts", "map<int,string>"),
        Column("pair", "struct<at:timestamp_ntz,m:map<int,array<double>>>"),
    ),
    ("event_id",),
)


@query("read_sql_dump_nested", "SELECT event_id, ts AS first_time, event_type AS label, value AS v, ts AS at FROM events")
def _(t):
    """Times with microseconds and maps with integer keys, inside arrays and structs."""
    nested = t("events").selectExpr(
        "event_id", "array(ts, NULL) AS times", "map(1, event_type) AS counts", "named_struct('at', ts, 'm', map(2, array(value))) AS pair"
    )
    out = fresh_path(t.spark, "script")
    script.write_sql_dump({NESTED_SPEC.name: nested}, [NESTED_SPEC], out)
    back = script.read_dump(t.spark, out, [NESTED_SPEC])[NESTED_SPEC.name].good
    return back.selectExpr("event_id", "times[0] AS first_time", "counts[1] AS label", "pair.m[2][0] AS v", "pair.at AS at")


def _script_file(t: Tables, frames: dict, specs: list, **how) -> script.Script:
    """A script of one text, written and read back."""
    out = fresh_path(t.spark, "script-file")
    script.write_script(frames, specs, out, **how)
    return script.read_script(t.spark, out, specs)


@query("read_script", "SELECT doc_id, text || ';' || chr(10) || chr(10) || '-- Table: x (1 rows)' || chr(10) || 'it''s' AS text, lang, source, n_chars FROM documents")
def _(t):
    """Three sections of one text; values hold separators, blank lines and section marks."""
    text = F.concat("text", F.lit(";\n\n-- Table: x (1 rows)\nit's"))
    specs = [SPECS["region"], SPECS["documents"], SPECS["nation"]]
    frames = {s.name: t(s.name.split(".")[1]) for s in specs} | {"public.documents": t("documents").withColumn("text", text)}
    return _script_file(t, frames, specs).tables["public.documents"].good


@query(
    "read_script_sections",
    """
    SELECT 'public.nation' AS name, count(*) AS announced, count(*) AS rows, CAST(NULL AS BIGINT) AS value FROM nation
    UNION ALL SELECT 'public.customer', count(*), count(*), NULL FROM customer
    UNION ALL SELECT 'public.orders', count(*), count(*), NULL FROM orders
    UNION ALL SELECT 'orders_id', NULL, NULL, max(o_orderkey) FROM orders
    UNION ALL SELECT 'customer_id', NULL, NULL, max(c_custkey) FROM customer
    """,
)
def _(t):
    """Rows announced and read per section of one compressed text, and its sequences."""
    names = ["nation", "customer", "orders"]
    marks = {"orders_id": t("orders").agg(F.max("o_orderkey")).first()[0], "customer_id": t("customer").agg(F.max("c_custkey")).first()[0]}
    how = {"sequences": marks, "compression": "gzip", "schema_sql": "CREATE TABLE nation (n_name STRING); -- isn't all"}
    read = _script_file(t, {SPECS[n].name: t(n) for n in names}, [SPECS[n] for n in names], **how)
    values = t.spark.createDataFrame(list(read.sequences.items()), "name string, value bigint")
    none = F.lit(None).cast("bigint")
    return read.sections.select(F.col("table").alias("name"), "announced", "rows", none.alias("value")).union(
        values.select("name", none, none, "value")
    )


TREE_SPEC = TableSpec(
    "part_tree",
    (Column("p_partkey", "bigint", False), Column("parent", "bigint")),
    ("p_partkey",),
    foreign_keys=(ForeignKey(("parent",), "part_tree", ("p_partkey",)),),
)


@query(
    "export_self_ref",
    f"""
    WITH tree AS ({PART_TREE})
    SELECT 1 AS phase, p_partkey, CAST(NULL AS BIGINT) AS parent FROM tree
    UNION ALL SELECT 2, p_partkey, parent FROM tree WHERE parent IS NOT NULL
    """,
)
def _(t):
    base, patch = bundle.export_self_ref(part_tree(t), ["p_partkey"], ["parent"])
    return base.withColumn("phase", F.lit(1)).unionByName(patch.withColumn("phase", F.lit(2)))


@query("apply_patch", PART_TREE)
def _(t):
    base, patch = bundle.export_self_ref(part_tree(t), ["p_partkey"], ["parent"])
    return bundle.apply_patch(base, patch, ["p_partkey"])


@query("read_sql_dump_self_ref", PART_TREE)
def _(t):
    """Inserts and updates of a self-referencing table, written as a script and read back."""
    out = fresh_path(t.spark, "script")
    script.write_sql_dump({TREE_SPEC.name: part_tree(t)}, [TREE_SPEC], out)
    base = script.read_sql_dump(t.spark, f"{out}/tables/*", TREE_SPEC).good
    patch = script.read_sql_dump(t.spark, f"{out}/updates/*", TREE_SPEC, "UPDATE").good
    return bundle.apply_patch(base, patch, ["p_partkey"])


@query("read_script_self_ref", PART_TREE)
def _(t):
    """Inserts and updates of a self-referencing table in one section."""
    read = _script_file(t, {TREE_SPEC.name: part_tree(t)}, [TREE_SPEC])
    return bundle.apply_patch(read.tables[TREE_SPEC.name].good, read.patches[TREE_SPEC.name].good, ["p_partkey"])


@query(
    "high_water_marks",
    """
    SELECT 'orders' AS sequence, max(o_orderkey) AS value FROM orders
    UNION ALL SELECT 'part', max(p_partkey) FROM part
    UNION ALL SELECT 'events', max(event_id) FROM events
    """,
)
def _(t):
    return bundle.high_water_marks(
        {
            "orders": (t("orders"), "o_orderkey"),
            "part": (t("part"), "p_partkey"),
            "events": (t("events"), "event_id"),
            "unused": (t("events").filter("event_id < 0"), "event_id"),
        }
    )


@query(
    "assign_ids",
    """
    SELECT event_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY ts, event_id) AS new_id FROM events
    """,
)
def _(t):
    mark = bundle.high_water_marks({"orders": (t("orders"), "o_orderkey")}).first()["value"]
    return bundle.assign_ids(t("events").select("event_id", "ts"), mark, ["ts", "event_id"], "new_id").drop("ts")


@query(
    "batch_rows",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders",
)
def _(t):
    return batch_rows(t("orders").select("o_orderkey"), ["o_orderkey"], 100)


@query(
    "batch_rows_by_key",
    """
    SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS batch FROM events
    """,
)
def _(t):
    df = t("events").select("event_id", "user_id", "ts")
    return batch_rows(df, ["ts", "event_id"], 10, ["user_id"]).drop("ts")


@query(
    "table_sizes",
    "\nUNION ALL ".join(
        f"SELECT 'public.{n}' AS \"table\", count(*) AS rows, count(*) >= 10000 AS large FROM {n}" for n in SPECS
    ),
)
def _(t):
    return stats.table_sizes({n: t(n) for n in SPECS} | {"pg_catalog.hidden": t("region")}, 10_000)


_OPS_SQL = """
    SELECT user_id AS job, CASE WHEN event_id % 3 = 0 THEN 'part' WHEN event_id % 3 = 1 THEN 'orders' ELSE 'nowhere' END AS "table",
           CASE event_type WHEN 'view' THEN 'create_table' WHEN 'click' THEN 'add_column_nullable'
                WHEN 'signup' THEN 'insert_values' WHEN 'error' THEN 'insert_select' ELSE 'create_index' END AS kind
    FROM events
"""


def _ops(t: Tables):
    t("events").createOrReplaceTempView("events")
    return t.spark.sql(_OPS_SQL.replace('"table"', "table"))


def _sizes(t: Tables):
    return stats.table_sizes({"part": t("part"), "orders": t("orders")}, 10_000)


_BIG = """(SELECT 'public.part' AS "table", count(*) AS rows FROM part UNION ALL SELECT 'public.orders', count(*) FROM orders)"""


@query(
    "route_operations",
    f"""
    WITH ops AS ({_OPS_SQL}), x AS (
      SELECT job, kind IN ('create_index', 'insert_select') AND coalesce(b.rows >= 10000, false) AS hit
      FROM ops LEFT JOIN {_BIG} b ON b."table" = 'public.' || ops."table")
    SELECT job, CASE WHEN bool_or(hit) THEN 'async' ELSE 'sync' END AS mode, count(*) FILTER (hit) AS expensive_ops
    FROM x GROUP BY job
    """,
)
def _(t):
    return stats.route_operations(_ops(t), _sizes(t))


@query(
    "route_reasons",
    f"""
    WITH ops AS ({_OPS_SQL})
    SELECT DISTINCT job, CASE kind WHEN 'create_index' THEN 'CREATE INDEX on large table ' ELSE
           'INSERT ... SELECT into large table ' END || b."table" AS reason
    FROM ops JOIN {_BIG} b ON b."table" = 'public.' || ops."table"
    WHERE kind IN ('create_index', 'insert_select') AND b.rows >= 10000
    """,
)
def _(t):
    return stats.route_reasons(_ops(t), _sizes(t))


@query(
    "dependency_levels",
    """
    WITH RECURSIVE walk(node, level) AS (
      SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey <= 1
      UNION ALL SELECT p.p_partkey, w.level + 1 FROM part p JOIN walk w ON p.p_partkey // 2 = w.node WHERE p.p_partkey > 1)
    SELECT node, level FROM walk
    """,
)
def _(t):
    tree = part_tree(t)
    edges = tree.filter("parent IS NOT NULL").selectExpr("p_partkey AS child", "parent")
    return graph.dependency_levels(tree.selectExpr("p_partkey AS node"), edges)


@query(
    "dependency_cycles",
    """
    WITH s AS (SELECT p_partkey AS p FROM part WHERE p_partkey % 97 = 1 AND p_partkey > 1
               AND p_partkey * 2 IN (SELECT p_partkey FROM part))
    SELECT p AS node FROM s UNION SELECT p * 2 FROM s
    """,
)
def _(t):
    """The part tree, with some parents made to depend on their own child."""
    tree = part_tree(t)
    edges = tree.filter("parent IS NOT NULL").selectExpr("p_partkey AS child", "parent")
    back = tree.filter("p_partkey % 97 = 1 AND p_partkey > 1").selectExpr("p_partkey AS child", "p_partkey * 2 AS parent")
    return graph.dependency_cycles(tree.selectExpr("p_partkey AS node"), edges.unionByName(back))


@query(
    "dependency_cycles_mixed",
    """
    WITH RECURSIVE n AS (SELECT c_custkey AS i FROM customer),
    e AS (SELECT i AS child, CASE WHEN i % 10 = 3 THEN i - 2 WHEN i % 10 = 6 THEN i - 1 WHEN i % 10 = 0 THEN i - 9
            ELSE i + 1 END AS parent FROM n
          UNION ALL SELECT i, i - 1 FROM n WHERE i % 10 = 5),
    k AS (SELECT child, parent FROM e WHERE parent IN (FROM n)),
    r AS (SELECT child AS a, parent AS b FROM k UNION SELECT r.a, k.parent FROM r JOIN k ON r.b = k.child)
    SELECT DISTINCT a AS node FROM r WHERE a = b
    """,
)
def _(t):
    """Per ten customers a cycle of three, one of two, paths between them and tails."""
    nodes = t("customer").selectExpr("c_custkey AS node")
    next_one = "CASE WHEN node % 10 = 3 THEN node - 2 WHEN node % 10 = 6 THEN node - 1 WHEN node % 10 = 0 THEN node - 9 ELSE node + 1 END"
    edges = nodes.selectExpr("node AS child", f"{next_one} AS parent").unionByName(
        nodes.filter("node % 10 = 5").selectExpr("node AS child", "node - 1 AS parent")
    )
    return graph.dependency_cycles(nodes, edges)
