"""Constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keelson.catalog.registry import Tables, query
from keelson.catalog.tables import SPECS
from keelson.operators import integrity as op


@query(
    "pk_violations",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows, 'duplicate' AS reason
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """,
)
def _(t: Tables):
    return op.pk_violations(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "unique_violations",
    "SELECT text, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
)
def _(t):
    return op.unique_violations(t("documents"), ["text"])


@query(
    "unique_violations_partial",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
    WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """,
)
def _(t):
    return op.unique_violations(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag = 'R'")


@query(
    "nullable_unique_report",
    """
    WITH k AS (SELECT nullif(o_custkey % 5, 0) AS a, nullif(o_custkey % 7, 0) AS b FROM orders),
    g AS (SELECT a, b, count(*) AS n FROM k GROUP BY a, b)
    SELECT 'a' AS "column", CAST(sum(n) FILTER (a IS NULL) AS BIGINT) AS null_rows,
           count(*) FILTER (a IS NULL AND n > 1) AS hidden_duplicates FROM g
    UNION ALL
    SELECT 'b', CAST(sum(n) FILTER (b IS NULL) AS BIGINT), count(*) FILTER (b IS NULL AND n > 1) FROM g
    """,
)
def _(t):
    k = t("orders").selectExpr("nullif(o_custkey % 5, 0) AS a", "nullif(o_custkey % 7, 0) AS b")
    return op.nullable_unique_report(k, ["a", "b"])


@query(
    "not_null_violations",
    """
    SELECT 'a' AS "column", count(*) FILTER (nullif(o_custkey % 5, 0) IS NULL) AS violations FROM orders
    UNION ALL SELECT 'b', count(*) FILTER (nullif(o_custkey % 7, 0) IS NULL) FROM orders
    UNION ALL SELECT 'o_orderkey', count(*) FILTER (o_orderkey IS NULL) FROM orders
    """,
)
def _(t):
    k = t("orders").selectExpr("nullif(o_custkey % 5, 0) AS a", "nullif(o_custkey % 7, 0) AS b", "o_orderkey")
    return op.not_null_violations(k, ["a", "b", "o_orderkey"])


@query("check_violations", "SELECT * FROM lineitem WHERE NOT (l_discount <= 0.05)")
def _(t):
    return op.check_violations(t("lineitem"), "l_discount <= 0.05")


@query(
    "fk_violations",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_custkey IS NOT NULL
      AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
    """,
)
def _(t):
    child = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return op.fk_violations(child, t("customer").filter("c_custkey % 7 <> 0"), ["o_custkey"], ["c_custkey"])


@query(
    "fk_violations_composite",
    """
    WITH child AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_suppkey % 9, 0) AS s FROM lineitem),
    parent AS (SELECT DISTINCT l_partkey AS p, l_suppkey % 9 AS s FROM lineitem WHERE l_linenumber > 2)
    SELECT * FROM child c WHERE c.s IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM parent q WHERE q.p = c.l_partkey AND q.s = c.s)
    """,
)
def _(t):
    line = t("lineitem")
    child = line.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "nullif(l_suppkey % 9, 0) AS s")
    parent = line.filter("l_linenumber > 2").selectExpr("l_partkey AS p", "l_suppkey % 9 AS s")
    return op.fk_violations(child, parent, ["l_partkey", "s"], ["p", "s"])


PART_TREE = """
    SELECT p_partkey, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part
"""


def part_tree(t: Tables) -> DataFrame:
    return t("part").selectExpr("p_partkey", "CASE WHEN p_partkey > 1 THEN p_partkey DIV 2 END AS parent")


@query(
    "self_fk_violations",
    f"""
    WITH tree AS ({PART_TREE}), holes AS (SELECT * FROM tree WHERE p_partkey % 11 <> 5)
    SELECT p_partkey, parent FROM holes
    WHERE parent IS NOT NULL AND parent NOT IN (SELECT p_partkey FROM holes)
    """,
)
def _(t):
    return op.self_fk_violations(part_tree(t).filter("p_partkey % 11 <> 5"), ["p_partkey"], ["parent"])


@query(
    "fk_target_unique",
    "SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def _(t):
    return op.fk_target_unique(t("lineitem"), ["l_orderkey"])


@query(
    "suppress_issues",
    """
    WITH issues AS (
      SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'fk' ELSE 'pk' END AS rule, o_orderpriority AS "table",
             o_orderstatus AS "constraint", o_orderkey FROM orders)
    SELECT * FROM issues
    WHERE NOT (rule = 'pk' AND "table" = '1-URGENT')
      AND NOT ("constraint" = 'P')
      AND NOT (rule = 'pk' AND "table" = '5-LOW' AND "constraint" = 'F')
    """,
)
def _(t):
    orders = t("orders")
    issues = orders.selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN 'fk' ELSE 'pk' END AS rule",
        "o_orderpriority AS table", "o_orderstatus AS constraint", "o_orderkey",
    )
    pairs = orders.select("o_orderpriority", "o_orderstatus").distinct()
    waivers = pairs.selectExpr(
        "CASE WHEN o_orderpriority = '2-HIGH' THEN 'fk' ELSE 'pk' END AS rule",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS table",
        "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN NULL ELSE o_orderstatus END AS constraint",
    ).filter(
        "(o_orderpriority = '1-URGENT') OR (o_orderstatus = 'P') "
        "OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')"
    )
    return op.suppress_issues(issues, waivers)


def _report_sql() -> str:
    parts = []

    def row(table, constraint, kind, severity, value):
        parts.append(
            f"SELECT 'public.{table}' AS \"table\", '{constraint}' AS \"constraint\", '{kind}' AS kind, "
            f"'{severity}' AS severity, CAST(({value}) AS BIGINT) AS violations"
        )

    for table, s in SPECS.items():
        for c in s.columns:
            if not c.nullable and c.name not in s.primary_key:
                row(table, f"{c.name}_not_null", "not_null", "error",
                    f"SELECT count(*) FROM {table} WHERE {c.name} IS NULL")
        for c in s.checks:
            row(table, c.name, "check", "error", f"SELECT count(*) FROM {table} WHERE NOT ({c.expr})")
        dup = "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {t} {w} GROUP BY {k} HAVING count(*) > 1)"
        row(table, "primary", "primary_key", "error", dup.format(t=table, w="", k=", ".join(s.primary_key)))
        for u in s.uniques:
            row(table, u.label, "unique", "error", dup.format(t=table, w="", k=", ".join(u.columns)))
            if any(s.column(c).nullable for c in u.columns):
                row(table, u.label, "nullable_unique", "warning",
                    f"SELECT count(*) FROM {table} WHERE " + " OR ".join(f"{c} IS NULL" for c in u.columns))
        for fk in s.foreign_keys:
            (c,), (r,) = fk.columns, fk.parent_columns
            row(table, fk.label, "foreign_key", "error",
                f"SELECT count(*) FROM {table} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {r} FROM {fk.parent})")
    return "\nUNION ALL ".join(parts)


@query("constraint_report", _report_sql())
def constraint_report(t: Tables) -> DataFrame:
    return op.constraint_report({n: t(n) for n in SPECS}, list(SPECS.values()))
