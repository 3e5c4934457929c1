"""Snapshot comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.registry import Tables, query
from keelson.operators import diff as op

CUSTOMER_NEXT = """
    SELECT c_custkey, c_name,
           CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
           CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM customer WHERE c_custkey % 13 <> 0
    UNION ALL
    SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer WHERE c_custkey % 17 = 0
"""

DIFF_SQL = f"""
    WITH nxt AS ({CUSTOMER_NEXT}), d AS (
      SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey,
             CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'modified' END AS kind,
             CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN '' ELSE concat_ws(',',
               CASE WHEN a.c_name IS DISTINCT FROM b.c_name THEN 'c_name' END,
               CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END,
               CASE WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN 'c_acctbal' END,
               CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END) END AS changed
      FROM customer a FULL OUTER JOIN nxt b ON a.c_custkey = b.c_custkey)
    SELECT * FROM d WHERE kind <> 'modified' OR changed <> ''
"""


def customer_next(t: Tables):
    t("customer").createOrReplaceTempView("customer")
    return t.spark.sql(CUSTOMER_NEXT)


def customer_diff(t: Tables):
    return op.table_diff(t("customer"), customer_next(t), ["c_custkey"])


@query("table_diff", DIFF_SQL)
def _(t):
    return customer_diff(t).withColumn("changed", F.array_join("changed", ","))


@query(
    "diff_summary",
    f"""
    WITH x AS ({DIFF_SQL})
    SELECT k.kind, count(x.kind) AS n_rows, (SELECT count(*) > 0 FROM x) AS has_changes
    FROM (VALUES ('added'), ('removed'), ('modified')) k(kind) LEFT JOIN x ON x.kind = k.kind GROUP BY k.kind
    """,
)
def _(t):
    return op.diff_summary(customer_diff(t))


@query(
    "diff_lines",
    f"""
    SELECT c_custkey, kind || ' ' || c_custkey || CASE WHEN changed <> '' THEN ': ' || replace(changed, ',', ', ') ELSE '' END AS line
    FROM ({DIFF_SQL})
    """,
)
def _(t):
    return op.diff_lines(customer_diff(t), ["c_custkey"])


@query(
    "table_diff_lineitem",
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    r AS (SELECT l_orderkey, l_linenumber, count(*) AS n,
            min(CASE WHEN l_partkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END) AS q, min(l_partkey) AS p
          FROM lineitem WHERE l_partkey % 13 > 0 GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, CASE WHEN l.n > 1 OR r.n > 1 THEN 'duplicate' WHEN r.n IS NULL THEN 'removed' ELSE 'modified' END AS kind,
      CASE WHEN l.n = 1 AND r.n = 1 THEN 'l_quantity' ELSE '' END AS changed
    FROM l LEFT JOIN r USING (l_orderkey, l_linenumber) WHERE l.n > 1 OR r.n IS NULL OR l.q <> r.q
    """,
)
def _(t):
    """The declared key of lineitem repeats; such keys are told apart from real changes."""
    old = t("lineitem")
    new = old.filter("l_partkey % 13 > 0").withColumn("l_quantity", F.expr("CASE WHEN l_partkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END"))
    diff = op.table_diff(old, new, ["l_orderkey", "l_linenumber"])
    return diff.withColumn("changed", F.array_join("changed", ","))


SNAPSHOT = "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier"
LIVE = f"SELECT * FROM ({SNAPSHOT}) WHERE s_suppkey % 9 <> 0"


@query(
    "three_way_drift",
    """
    SELECT s_suppkey, 'declared' AS drift, 'modified' AS kind, 's_nationkey' AS changed
    FROM supplier WHERE s_suppkey % 7 = 0
    UNION ALL SELECT s_suppkey, 'live', 'removed', '' FROM supplier WHERE s_suppkey % 9 = 0
    """,
)
def _(t):
    t("supplier").createOrReplaceTempView("supplier")
    declared = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    drift = op.three_way_drift(declared, t.spark.sql(SNAPSHOT), t.spark.sql(LIVE), ["s_suppkey"])
    return drift.withColumn("changed", F.array_join("changed", ","))


@query(
    "drift_status",
    """
    SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = 0) AS declared_drift,
           (SELECT count(*) FROM supplier WHERE s_suppkey % 9 = 0) AS live_drift, false AS converged
    """,
)
def _(t):
    t("supplier").createOrReplaceTempView("supplier")
    declared = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    return op.drift_status(
        op.three_way_drift(declared, t.spark.sql(SNAPSHOT), t.spark.sql(LIVE), ["s_suppkey"])
    )


def _row_text(*cols: str) -> str:
    return " || ".join(
        f"CASE WHEN {c} IS NULL THEN '~;' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) || ';' END"
        for c in cols
    )


@query(
    "table_fingerprint",
    f"""
    WITH h AS (SELECT o_custkey, sha256({_row_text("o_orderkey", "o_orderstatus", "o_orderpriority")}) AS h FROM orders)
    SELECT o_custkey, count(*) AS n_rows,
           sha256(count(*) || ':' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || ':'
                  || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT))) AS fingerprint
    FROM h GROUP BY o_custkey
    """,
)
def _(t):
    return op.table_fingerprint(t("orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"
_OPS = {
    "union": f"SELECT k FROM ({_A}) UNION SELECT k FROM ({_B})",
    "intersect": f"SELECT k FROM ({_A}) INTERSECT SELECT k FROM ({_B})",
    "difference": f"SELECT k FROM ({_A}) EXCEPT SELECT k FROM ({_B})",
    "symmetric": f"((SELECT k FROM ({_A})) UNION (SELECT k FROM ({_B}))) EXCEPT ((SELECT k FROM ({_A})) INTERSECT (SELECT k FROM ({_B})))",
}


@query(
    "key_overlap",
    "\nUNION ALL ".join(f"SELECT '{name}' AS op, k FROM ({sql})" for name, sql in _OPS.items()),
)
def _(t):
    a = t("customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    b = t("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    out = None
    for name in _OPS:
        part = op.key_overlap(a, b, ["k"], name).select(F.lit(name).alias("op"), "k")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "overlap_counts",
    """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events)
    SELECT count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b,
           count(*) FILTER (a.k = b.k) AS "both"
    FROM a FULL OUTER JOIN b ON a.k = b.k
    """,
)
def _(t):
    a, b = t("orders").selectExpr("o_custkey AS k"), t("events").selectExpr("user_id AS k")
    return op.overlap_counts(a, b, ["k"])
