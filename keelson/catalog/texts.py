"""Script headers, signatures, waivers and label spelling."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from keelson.catalog.registry import Tables, query
from keelson.operators import scripts as op

_TYPES = """
    SELECT p_type || CASE p_size % 3 WHEN 0 THEN ' brass' WHEN 1 THEN '-Brass' ELSE '_BRASS' END AS label FROM part
"""


@query(
    "normalize_labels",
    f"""
    WITH l AS (SELECT label, count(*) AS n_rows FROM ({_TYPES}) GROUP BY label),
    c AS (SELECT upper(label[1]) || lower(regexp_replace(label[2:], '[ _-].*', '')) || 'Brass' AS canonical, * FROM l)
    SELECT canonical, label, n_rows, count(*) OVER (PARTITION BY canonical) > 1 AS collides FROM c
    """,
)
def _(t: Tables):
    suffix = F.expr("CASE p_size % 3 WHEN 0 THEN ' brass' WHEN 1 THEN '-Brass' ELSE '_BRASS' END")
    return op.normalize_labels(t("part").select(F.concat("p_type", suffix).alias("label")), "label", "pascal")


@query(
    "normalize_labels_safe",
    """
    WITH l AS (SELECT o_orderpriority AS label, count(*) AS n_rows FROM orders GROUP BY 1)
    SELECT replace(replace(label, '-', '_'), ' ', '_') AS canonical, label, n_rows, false AS collides FROM l
    """,
)
def _(t):
    return op.normalize_labels(t("orders"), "o_orderpriority", "safe")


# header lines laid over the documents, one kind per remainder of doc_id
_HEADERS = """
    SELECT doc_id, CASE doc_id % 10
        WHEN 0 THEN '-- keelson:mode=sync' || chr(10) WHEN 1 THEN '  -- keelson:mode=async,depends_on=b;a' || chr(10)
        WHEN 2 THEN '-- keelson:mode=later' || chr(10) WHEN 3 THEN '-- keelson:depends_on=a' || chr(10)
        WHEN 4 THEN '-- keelson:mode=sync,squash=true,sig=0123456789ab' || chr(10)
        WHEN 5 THEN '-- keelson:mode=sync,depends_on=' || chr(10) WHEN 6 THEN '-- keelson:mode=sync,color=red' || chr(10)
        WHEN 7 THEN '-- keelson:mode=sync,mode=async' || chr(10) WHEN 8 THEN '-- keelson:mode=sync,sig' || chr(10)
        ELSE '' END || text AS script, text FROM documents
"""


def _scripts(t: Tables):
    t("documents").createOrReplaceTempView("documents")
    return t.spark.sql(_HEADERS)


@query(
    "parse_script_headers",
    f"""
    SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'sync' WHEN 1 THEN 'async' WHEN 4 THEN 'sync' WHEN 7 THEN 'async' END AS mode,
           CASE doc_id % 10 WHEN 1 THEN 'b;a' END AS depends_on,
           CASE WHEN doc_id % 10 IN (0, 1, 4, 7) THEN doc_id % 10 = 4 END AS squash,
           CASE doc_id % 10 WHEN 4 THEN '0123456789ab' END AS sig,
           CASE doc_id % 10 WHEN 2 THEN 'invalid mode: later' WHEN 3 THEN 'missing mode' WHEN 5 THEN 'empty depends_on'
                WHEN 6 THEN 'unknown field: color' WHEN 8 THEN 'invalid field: sig' END AS error,
           text AS body
    FROM ({_HEADERS})
    """,
)
def _(t):
    parsed = op.parse_script_headers(_scripts(t).select("doc_id", "script"), "script")
    return parsed.drop("script").withColumn("depends_on", F.array_join("depends_on", ";"))


_SIGNED = """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '-- keelson:mode=sync,depends_on=b;a,sig='
        || substr(sha256('mode=sync;depends_on=a;b;body=' || trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 1, 12) || chr(10)
      WHEN 1 THEN '-- keelson:mode=async,sig=000000000000' || chr(10) WHEN 2 THEN '-- keelson:mode=sync' || chr(10)
      ELSE '-- keelson:nothing' || chr(10) END || text AS script, text FROM documents
"""


@query(
    "fingerprint_scripts",
    f"""
    SELECT doc_id, sha256(text) AS checksum, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 2 THEN 'missing' ELSE 'invalid' END AS status
    FROM ({_SIGNED})
    """,
)
def _(t):
    docs = t("documents")
    lit = F.lit
    sync, empty = lit("sync"), lit(None).cast("array<string>")
    deps = F.array(lit("b"), lit("a"))
    sig = op.signature(sync, deps, lit(False), F.col("text"))
    header = (
        F.when(F.expr("doc_id % 4 = 0"), op.render_header(sync, deps, lit(False), sig))
        .when(F.expr("doc_id % 4 = 1"), op.render_header(lit("async"), empty, lit(False), lit("000000000000")))
        .when(F.expr("doc_id % 4 = 2"), op.render_header(sync, empty, lit(False), lit(None).cast("string")))
        .otherwise("-- keelson:nothing")
    )
    signed = docs.select("doc_id", op.replace_header(F.col("text"), header).alias("script"))
    return op.fingerprint_scripts(signed, "script").drop("script")


@query(
    "signature_policy",
    """
    SELECT CASE doc_id % 2 WHEN 0 THEN 'missing' ELSE 'invalid' END AS status, count(*) AS n_scripts, doc_id % 2 = 1 AS fails
    FROM documents GROUP BY ALL
    """,
)
def _(t):
    header = F.expr("CASE doc_id % 2 WHEN 0 THEN '' ELSE '-- keelson:mode=never\n' END")
    scripts = t("documents").select("doc_id", F.concat(header, "text").alias("script"))
    return op.signature_policy(op.fingerprint_scripts(scripts, "script"))


@query(
    "extract_waivers",
    """
    SELECT DISTINCT 'fk' AS rule, 'public.' || source AS "table", CAST(NULL AS VARCHAR) AS "constraint" FROM documents WHERE doc_id % 3 = 0
    UNION SELECT DISTINCT 'unique', 'public.' || source, 'u_' || lang FROM documents WHERE doc_id % 3 = 1
    """,
)
def _(t):
    """The file of a document defines its source; a third name another one, which has no effect."""
    docs = t("documents")
    head = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN '-- notes\n\n-- keelson:lint-disable=fk why not\n' "
        "WHEN 1 THEN concat('-- keelson:lint-disable=unique:', source, '.u_', lang, '\n') "
        "ELSE '-- keelson:lint-disable=pk:elsewhere\n' END"
    )
    late = F.lit("\nSELECT 1;\n-- keelson:lint-disable=late\n")
    scripts = docs.select("doc_id", F.concat(head, F.lit("CODE "), "text", late).alias("script"))
    tables = docs.select("doc_id", F.concat(F.lit("public."), "source").alias("table"))
    return op.extract_waivers(scripts, "doc_id", "script", tables)


@query(
    "older_than",
    """
    SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '_job' END AS name FROM events
    WHERE event_id % 10 <> 0 AND date_trunc('second', ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY
    """,
)
def _(t):
    name = F.expr(
        "CASE WHEN event_id % 10 = 0 THEN concat('v', date_format(ts, 'yyyyMMddHHmmss')) "
        "ELSE concat(date_format(ts, 'yyyyMMddHHmmss'), CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '_job' END) END"
    )
    names = t("events").select("event_id", name.alias("name"))
    return op.older_than(names, "name", "2w", datetime.datetime(2024, 1, 31))
