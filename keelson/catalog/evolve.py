"""Column evolution and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.registry import query
from keelson.catalog.tables import SPECS
from keelson.operators import dictionary as dic
from keelson.operators import evolve as op
from keelson.specs import Column, TableSpec


@query(
    "add_column",
    """
    SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS note, CAST(o_orderkey % 3 AS INTEGER) AS region_id,
           'open' AS state FROM orders
    """,
)
def _(t):
    df = t("orders").select("o_orderkey", "o_custkey")
    df = op.add_column(df, "note", "string")
    df = op.add_column(df, "region_id", "int", default="o_orderkey % 3", not_null=True)
    return op.add_column(df, "state", "string", default="'open'", not_null=True)


@query("drop_column", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def _(t):
    return op.drop_column(t("lineitem"), SPECS["lineitem"], "l_discount").df


@query("widen_column", "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def _(t):
    return op.widen_column(t("part").select("p_partkey", "p_name", "p_size"), "p_size", "bigint")


@query(
    "rewrite_column",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
           CAST(l_extendedprice AS DECIMAL(7, 2)) AS l_extendedprice, 'good' AS part
    FROM lineitem WHERE l_extendedprice < 100000
    UNION ALL
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, NULL, 'bad'
    FROM lineitem WHERE l_extendedprice >= 100000
    """,
)
def _(t):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]
    out = op.rewrite_column(t("lineitem").select(*cols), "l_extendedprice", "decimal(7,2)", on_error="quarantine")
    bad = out.bad.withColumn("l_extendedprice", F.lit(None).cast("decimal(7,2)"))
    return out.good.withColumn("part", F.lit("good")).unionByName(bad.withColumn("part", F.lit("bad")))


@query(
    "rewrite_column_using",
    "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS o_orderpriority FROM orders",
)
def _(t):
    df = t("orders").select("o_orderkey", "o_orderpriority")
    return op.rewrite_column(df, "o_orderpriority", "int", using="substr(o_orderpriority, 1, 1)")


@query(
    "narrowing_report",
    """
    SELECT 'l_extendedprice' AS "column", 'decimal(6,1)' AS target,
           count(*) FILTER (l_extendedprice >= 99999.95) AS overflow, CAST(0 AS BIGINT) AS too_long,
           count(*) FILTER (l_extendedprice < 99999.95 AND round(l_extendedprice * 100) % 10 <> 0) AS loses_precision
    FROM lineitem
    UNION ALL
    SELECT 'l_returnflag', 'varchar(1)', 0, count(*) FILTER (length(l_returnflag) > 1), 0 FROM lineitem
    UNION ALL
    SELECT 'l_orderkey', 'smallint', count(*) FILTER (l_orderkey > 32767), 0, 0 FROM lineitem
    """,
)
def _(t):
    changes = {"l_extendedprice": "decimal(6,1)", "l_returnflag": "varchar(1)", "l_orderkey": "smallint"}
    return op.narrowing_report(t("lineitem"), changes)


@query(
    "retarget_dictionary",
    """
    SELECT o_orderkey, o_orderpriority, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS rejected FROM orders
    """,
)
def _(t):
    df = t("orders").select("o_orderkey", "o_orderpriority")
    # the new dictionary: labels whose rank digit is at most 3
    labels = df.filter("substr(o_orderpriority, 1, 1) <= '3'").selectExpr(
        "o_orderpriority AS label", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS ordinal"
    ).distinct()
    out = dic.retarget_dictionary(df, "o_orderpriority", labels)
    return out.good.withColumn("rejected", F.lit(False)).unionByName(out.bad.withColumn("rejected", F.lit(True)))


_CUST_V2 = """
    SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
           c_mktsegment, c_custkey AS version FROM customer
    UNION ALL SELECT c_custkey + 1000000, c_acctbal, c_mktsegment, 7 FROM customer WHERE c_custkey % 17 = 0
"""


@query(
    "touch_on_update",
    f"""
    WITH v2 AS ({_CUST_V2})
    SELECT v2.c_custkey, v2.c_acctbal, v2.c_mktsegment,
           CASE WHEN c.c_custkey IS NULL THEN v2.version WHEN v2.c_acctbal <> c.c_acctbal THEN v2.version + 100
                ELSE -1 END AS version
    FROM v2 LEFT JOIN customer c ON c.c_custkey = v2.c_custkey
    """,
)
def _(t):
    old = t("customer").selectExpr("c_custkey", "c_acctbal", "c_mktsegment", "CAST(-1 AS BIGINT) AS version")
    t("customer").createOrReplaceTempView("customer")
    return op.touch_on_update(old, t.spark.sql(_CUST_V2), ["c_custkey"], "version", "version + 100")


@query("computed_column_virtual", "SELECT c_custkey, c_name, c_acctbal, upper(c_mktsegment) AS label FROM customer")
def _(t):
    """A computed column read through its view, and then frozen: the spec keeps it as a plain one."""
    spec = SPECS["customer"].with_column(Column("label", "string", computed="upper(c_mktsegment)"))
    op.computed_column(t("customer"), "label", spec.column("label").computed, "virtual", "customer_labelled")
    frozen = op.freeze_computed(spec, "label")
    kept = [c.name for c in frozen.insertable() if c.name in ("c_custkey", "c_name", "c_acctbal", "label")]
    return t.spark.table("customer_labelled").select(*kept)


@query(
    "computed_column",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
           l_extendedprice * (1 - l_discount) AS revenue,
           l_extendedprice * (1 - l_discount) / l_quantity AS unit_revenue
    FROM lineitem
    """,
)
def _(t):
    base = t("lineitem")
    out = op.add_computed_columns(
        base, {"per_unit": "revenue_raw / l_quantity", "revenue_raw": "l_extendedprice * (1 - l_discount)"}
    )
    return out.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "revenue_raw AS revenue", "per_unit AS unit_revenue",
    )


ORDERS_TARGET = TableSpec(
    "orders",
    (
        Column("o_orderkey", "int", nullable=False),
        Column("o_custkey", "bigint", nullable=False),
        Column("o_orderpriority", "varchar(8)", nullable=False),
        Column("o_orderstatus", "string"),
        Column("channel", "string", nullable=False, default="'unknown'"),
        Column("comment", "string"),
        Column("is_final", "boolean", computed="o_orderstatus = 'F'"),
    ),
    ("o_orderkey",),
)
_ORDERS_IN = "SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '2-HIGH') AS o_orderpriority, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders"


@query(
    "conform_to_target",
    f"""
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_custkey, o_orderpriority, o_orderstatus,
           'unknown' AS channel, CAST(NULL AS VARCHAR) AS comment
    FROM ({_ORDERS_IN}) WHERE o_orderpriority IS NOT NULL AND length(o_orderpriority) <= 8
    """,
)
def _(t):
    t("orders").createOrReplaceTempView("orders")
    return op.conform_to_target(t.spark.sql(_ORDERS_IN), ORDERS_TARGET).good


@query(
    "conform_to_target_rejects",
    f"SELECT * FROM ({_ORDERS_IN}) WHERE o_orderpriority IS NULL OR length(o_orderpriority) > 8",
)
def _(t):
    t("orders").createOrReplaceTempView("orders")
    return op.conform_to_target(t.spark.sql(_ORDERS_IN), ORDERS_TARGET).bad


@query(
    "conform_report",
    f"""
    WITH i AS ({_ORDERS_IN})
    SELECT 'o_orderkey' AS "column", count(*) FILTER (o_orderkey > 2147483647) AS cast_failures,
           count(*) FILTER (o_orderkey IS NULL) AS required_nulls, CAST(0 AS BIGINT) AS too_long FROM i
    UNION ALL SELECT 'o_custkey', 0, count(*) FILTER (o_custkey IS NULL), 0 FROM i
    UNION ALL SELECT 'o_orderpriority', 0, count(*) FILTER (o_orderpriority IS NULL),
                     count(*) FILTER (length(o_orderpriority) > 8) FROM i
    UNION ALL SELECT 'o_orderstatus', 0, 0, 0 FROM i WHERE o_orderkey = 1
    """,
)
def _(t):
    t("orders").createOrReplaceTempView("orders")
    return op.conform_report(t.spark.sql(_ORDERS_IN), ORDERS_TARGET)


@query("expire_rows", "SELECT * FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-31 00:00:00'")
def _(t):
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    return op.expire_rows(t("events"), "ts", "7 days", now)


@query(
    "expire_rows_expression",
    """
    SELECT event_id, ts, user_id FROM events
    WHERE event_type = 'purchase'
       OR ts + CASE WHEN event_type = 'error' THEN INTERVAL 14 DAY ELSE INTERVAL 3 DAY END > TIMESTAMP '2024-01-31 00:00:00'
    """,
)
def _(t):
    expiry = (
        "CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'error' THEN ts + INTERVAL 14 days "
        "ELSE ts + INTERVAL 3 days END"
    )
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    return op.expire_rows(t("events"), now=now, expression=expiry).select("event_id", "ts", "user_id")


@query(
    "evolve_table",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
           CAST(l_quantity AS DECIMAL(4, 0)) AS l_quantity, l_extendedprice, l_tax, l_linestatus, l_shipdate,
           CAST(0 AS BIGINT) AS committed, CAST(l_quantity AS BIGINT) AS available
    FROM lineitem WHERE nullif(l_returnflag, 'R') IS NOT NULL
    """,
)
def _(t):
    df = t("lineitem").withColumn("l_returnflag", F.expr("nullif(l_returnflag, 'R')"))
    result = op.evolve_table(
        df,
        SPECS["lineitem"],
        [
            op.AddColumn(Column("available", "bigint", computed="CAST(l_quantity - committed AS BIGINT)")),
            op.DropColumn("l_discount"),
            op.AddColumn(Column("committed", "bigint", nullable=False, default="0")),
            op.ChangeType("l_quantity", "decimal(4,0)"),
            op.ChangeType("l_linenumber", "bigint"),
            op.SetNotNull("l_returnflag"),
        ],
    )
    return result.good.drop("l_returnflag")


@query(
    "dictionary_usage",
    """
    WITH o(label) AS (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view'),
    n(label) AS (SELECT DISTINCT upper(event_type) FROM events WHERE event_type = 'click'
                 UNION SELECT DISTINCT event_type FROM events WHERE event_type IN ('error', 'signup')),
    u AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1),
    k AS (SELECT label FROM o UNION SELECT label FROM n UNION SELECT label FROM u)
    SELECT k.label, CASE WHEN o.label IS NOT NULL AND n.label IS NOT NULL THEN 'kept'
                         WHEN n.label IS NOT NULL THEN 'added' WHEN o.label IS NOT NULL THEN 'removed'
                         ELSE 'unknown' END AS status, coalesce(u.n, 0) AS n_rows
    FROM k LEFT JOIN o USING (label) LEFT JOIN n USING (label) LEFT JOIN u USING (label)
    """,
)
def _(t):
    events = t("events")
    seen = events.select(F.col("event_type").alias("label")).distinct()
    old = seen.filter("label <> 'view'")
    new = seen.filter("label IN ('click', 'error', 'signup')").withColumn(
        "label", F.expr("CASE WHEN label = 'click' THEN upper(label) ELSE label END")
    )
    return dic.dictionary_usage(events, "event_type", old, new)


# customers stand for dictionaries: labels are the priorities and states of their orders,
# in the order they first appear
_DICTS = """
    SELECT 's' || CAST(o_custkey % 3 AS VARCHAR) AS "schema", 'd' || CAST(o_custkey AS VARCHAR) AS dictionary, o_custkey,
           min(o_orderkey) AS ordinal, o_orderpriority || '-' || o_orderstatus AS label
    FROM orders GROUP BY o_custkey, o_orderpriority, o_orderstatus
"""
_NEW_NAME = "CASE WHEN o_custkey % 4 = 0 THEN 'v2_' || dictionary ELSE dictionary END"
_NEW_LABEL = "CASE WHEN o_custkey % 8 = 0 THEN label || '!' ELSE label END"


@query(
    "detect_dictionary_renames",
    f"""
    WITH old AS ({_DICTS}), new AS (SELECT * REPLACE ({_NEW_NAME} AS dictionary, {_NEW_LABEL} AS label) FROM old),
    os AS (SELECT "schema", dictionary, any_value(o_custkey) AS k, string_agg(label, '","' ORDER BY ordinal) AS sig
           FROM old GROUP BY ALL),
    ns AS (SELECT "schema", dictionary, any_value(o_custkey) AS k, string_agg(label, '","' ORDER BY ordinal) AS sig
           FROM new GROUP BY ALL),
    od AS (SELECT * FROM os WHERE NOT EXISTS (SELECT 1 FROM ns WHERE ns."schema" = os."schema" AND ns.dictionary = os.dictionary)),
    na AS (SELECT * FROM ns WHERE NOT EXISTS (SELECT 1 FROM os WHERE ns."schema" = os."schema" AND ns.dictionary = os.dictionary)),
    o1 AS (SELECT sig FROM od GROUP BY sig HAVING count(*) = 1), n1 AS (SELECT sig FROM na GROUP BY sig HAVING count(*) = 1)
    SELECT od."schema", od.dictionary AS old_dictionary, na.dictionary AS new_dictionary
    FROM od JOIN na ON od.sig = na.sig AND od."schema" = na."schema"
    WHERE od.sig IN (SELECT sig FROM o1) AND od.sig IN (SELECT sig FROM n1) AND od.k = na.k AND od.k % 12 <> 0
    """,
)
def _(t):
    t("orders").createOrReplaceTempView("orders")
    old = t.spark.sql(_DICTS.replace('"schema"', "schema").replace("VARCHAR", "STRING"))
    new = old.withColumns({"label": F.expr(_NEW_LABEL), "dictionary": F.expr(_NEW_NAME)})
    labels = ["schema", "dictionary", "ordinal", "label"]

    def usage(df):
        return df.selectExpr("o_custkey AS table", "'kind' AS column", "schema", "dictionary").distinct()

    before, after = usage(old.filter("o_custkey % 12 <> 0")), usage(new.filter("o_custkey % 12 <> 0"))
    return dic.detect_dictionary_renames(old.select(*labels), new.select(*labels), before, after)
