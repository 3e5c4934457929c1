"""Run logs, ledgers, change logs and marked logs, all derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.diff import _row_text
from keelson.catalog.registry import Tables, query
from keelson.operators import changelog, ledger, segments
from keelson.operators.batching import dedupe_names

ACTIONS_SQL = """
    SELECT 'db' || CAST(user_id % 10 AS VARCHAR) AS "database", user_id AS job, ts, event_id,
           CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail'
                WHEN 'view' THEN 'recover' ELSE 'retry' END AS action
    FROM events
"""
_FOLD = f"""
    a AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS rn FROM ({ACTIONS_SQL})),
    f AS (
      SELECT "database", job, ts, event_id, action, rn, 'absent' AS state_before,
             CASE WHEN action = 'start' THEN 'pending' ELSE 'absent' END AS state_after FROM a WHERE rn = 1
      UNION ALL
      SELECT a."database", a.job, a.ts, a.event_id, a.action, a.rn, f.state_after,
             CASE WHEN f.state_after = 'absent' AND a.action = 'start' THEN 'pending'
                  WHEN f.state_after = 'pending' AND a.action = 'complete' THEN 'succeeded'
                  WHEN f.state_after = 'pending' AND a.action = 'fail' THEN 'failed'
                  WHEN f.state_after = 'failed' AND a.action = 'recover' THEN 'recovered'
                  WHEN f.state_after = 'failed' AND a.action = 'retry' THEN 'pending'
                  ELSE f.state_after END
      FROM f JOIN a ON a.job = f.job AND a.rn = f.rn + 1)
"""
LEDGER_STATE_SQL = f"""
    WITH RECURSIVE {_FOLD}, x AS (SELECT *, state_before <> state_after AS accepted FROM f),
    l AS (SELECT job, arg_max(action, rn) AS action, max(ts) AS ts FROM x WHERE accepted GROUP BY job)
    SELECT x."database", x.job, arg_max(state_after, rn) AS status,
           max(x.ts) FILTER (accepted AND x.action IN ('start', 'retry')) AS started_at,
           CASE WHEN any_value(l.action) NOT IN ('start', 'retry') THEN any_value(l.ts) END AS completed_at,
           count(*) FILTER (NOT accepted) AS rejected
    FROM x JOIN l ON x.job = l.job GROUP BY x."database", x.job
"""


def actions(t: Tables):
    t("events").createOrReplaceTempView("events")
    return t.spark.sql(ACTIONS_SQL.replace('"database"', "database").replace("VARCHAR", "STRING"))


@query("ledger_state", LEDGER_STATE_SQL)
def _(t):
    return ledger.ledger_state(actions(t))


@query(
    "ledger_rejects",
    f"""
    WITH RECURSIVE {_FOLD}
    SELECT "database", job, ts, event_id, action, state_before FROM f WHERE state_before = state_after
    """,
)
def _(t):
    """Cut by day, so that every job spans many chunks."""
    return ledger.ledger_rejects(actions(t), chunk=F.dayofyear("ts").cast("bigint"))


# customers stand for jobs, 25 databases; every third one has not run yet
JOBS_SQL = """
    SELECT CAST(c_custkey % 25 AS VARCHAR) AS "database", c_custkey AS job, sha256(c_name) AS checksum,
           CASE WHEN c_custkey % 5 = 0 THEN 'async' ELSE 'sync' END AS mode, c_custkey % 11 = 0 AS squash FROM customer
"""
LEDGER_SQL = """
    SELECT CAST(c_custkey % 25 AS VARCHAR) AS "database", c_custkey AS job,
           CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 8 = 0 THEN sha256(c_mktsegment) ELSE sha256(c_name) END AS checksum,
           CASE WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 7 = 1 THEN 'pending'
                WHEN c_custkey % 7 = 2 THEN 'recovered' ELSE 'succeeded' END AS status,
           c_custkey % 5 = 0 AS async FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 25 <> 24
"""
_DEPS_SQL = """
    SELECT CAST(c_custkey % 25 AS VARCHAR) AS "database", c_custkey AS job, c_custkey - d.back AS dependency
    FROM customer, (VALUES (25), (50)) d(back) WHERE c_custkey >= d.back
"""
_CTX = f"WITH jobs AS ({JOBS_SQL}), ledger AS ({LEDGER_SQL}), deps AS ({_DEPS_SQL})"


def _spark_sql(t: Tables, sql: str):
    t("customer").createOrReplaceTempView("customer")
    text = sql.replace('"database"', "database").replace("VARCHAR", "STRING")
    return t.spark.sql(text.replace("sha256(c_name)", "sha2(c_name, 256)").replace("sha256(c_mktsegment)", "sha2(c_mktsegment, 256)"))


def jobs(t: Tables):
    back = F.array(F.col("job") - 25, F.col("job") - 50)
    return _spark_sql(t, JOBS_SQL).withColumn("depends_on", F.filter(back, lambda d: d >= 0))


def job_ledger(t: Tables):
    return _spark_sql(t, LEDGER_SQL)


@query(
    "pending_items",
    f'{_CTX} SELECT "database", job, mode FROM jobs WHERE job NOT IN (SELECT job FROM ledger)',
)
def _(t):
    return ledger.pending_items(jobs(t), job_ledger(t)).select("database", "job", "mode")


@query(
    "checksum_mismatch",
    f"""
    {_CTX} SELECT j."database", j.job, j.checksum, l.checksum AS applied_checksum FROM jobs j JOIN ledger l ON j.job = l.job
    WHERE l.checksum <> '' AND l.checksum <> j.checksum
    """,
)
def _(t):
    return ledger.checksum_mismatch(jobs(t).select("database", "job", "checksum"), job_ledger(t))


@query(
    "unmet_dependencies",
    f"""
    {_CTX} SELECT "database", job, dependency FROM deps
    WHERE dependency NOT IN (SELECT job FROM ledger WHERE status IN ('succeeded', 'recovered'))
    """,
)
def _(t):
    return ledger.unmet_dependencies(jobs(t), job_ledger(t))


@query(
    "last_writer_dependencies",
    """
    WITH n AS (SELECT event_id, ts, 'u' || user_id AS name FROM events
               UNION ALL SELECT event_id, ts, 'v' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) FROM events),
    p AS (SELECT event_id AS job, lag(event_id) OVER (PARTITION BY name ORDER BY ts, event_id) AS dependency FROM n)
    SELECT DISTINCT job, dependency FROM p WHERE dependency IS NOT NULL
    """,
)
def _(t):
    """Every event touches its user and its rounded value, as a new job and in the log."""
    events = t("events")
    names = F.array(
        F.concat(F.lit("u"), "user_id"), F.concat(F.lit("v"), F.floor("value").cast("string")), F.lit("schema:public")
    )
    log = events.select(F.col("event_id").alias("job"), "ts", "event_id", F.explode(names).alias("name"))
    return ledger.last_writer_dependencies(log, log, order=["ts", "event_id"])


@query(
    "reconcile_ledger",
    f"""
    {_CTX}, r AS (SELECT j."database", j.job, l.status AS old_status,
           CASE WHEN l.status IS NULL OR l.status = 'pending' THEN 'succeeded' WHEN l.status = 'failed' THEN 'recovered'
                ELSE l.status END AS status FROM jobs j LEFT JOIN ledger l ON j.job = l.job)
    SELECT *, status IS DISTINCT FROM old_status AS changed FROM r
    """,
)
def _(t):
    return ledger.reconcile_ledger(jobs(t), job_ledger(t))


@query(
    "adopted_jobs",
    f"""{_CTX} SELECT "database", job, 'succeeded' AS status FROM jobs WHERE "database" = '24'""",
)
def _(t):
    all_jobs = jobs(t).select("database", "job")
    targets = all_jobs.groupBy("database").agg((F.count("*") > 0).alias("has_objects"))
    return ledger.adopted_jobs(all_jobs, job_ledger(t), targets)


@query(
    "ready_set",
    f"""
    {_CTX}, unmet AS (SELECT DISTINCT job FROM deps
      WHERE dependency NOT IN (SELECT job FROM ledger WHERE status IN ('succeeded', 'recovered'))),
    busy AS (SELECT DISTINCT "database" FROM ledger WHERE async AND status = 'pending')
    SELECT "database", job, mode,
           CASE WHEN job IN (SELECT job FROM unmet) THEN 'hold_dependency'
                WHEN mode = 'async' AND "database" IN (SELECT "database" FROM busy) THEN 'hold_async'
                WHEN squash THEN 'record' ELSE 'run' END AS action
    FROM jobs WHERE job NOT IN (SELECT job FROM ledger)
    """,
)
def _(t):
    return ledger.ready_set(jobs(t), job_ledger(t), "all")


def _ready_sql(mode: str) -> str:
    return f"""
    {_CTX}, unmet AS (SELECT DISTINCT job FROM deps
      WHERE dependency NOT IN (SELECT job FROM ledger WHERE status IN ('succeeded', 'recovered'))),
    busy AS (SELECT DISTINCT "database" FROM ledger WHERE async AND status = 'pending')
    SELECT "database", job, mode,
           CASE WHEN job IN (SELECT job FROM unmet) THEN 'hold_dependency'
                WHEN mode = 'async' AND "database" IN (SELECT "database" FROM busy) THEN 'hold_async'
                WHEN squash THEN 'record' ELSE 'run' END AS action
    FROM jobs WHERE job NOT IN (SELECT job FROM ledger) AND mode = '{mode}'
    """


@query("ready_set_sync", _ready_sql("sync"))
def _(t):
    return ledger.ready_set(jobs(t), job_ledger(t), "sync")


@query("ready_set_async", _ready_sql("async"))
def _(t):
    return ledger.ready_set(jobs(t), job_ledger(t), "async")


@query(
    "first_blocker",
    f"""
    {_CTX} SELECT "database",
      min(job) FILTER (status = 'failed' OR (status = 'pending' AND NOT async)) AS blocker,
      min(job) FILTER (status = 'pending' AND async) AS running_async
    FROM ledger GROUP BY "database" HAVING blocker IS NOT NULL OR running_async IS NOT NULL
    """,
)
def _(t):
    return ledger.first_blocker(job_ledger(t))


_LAST = """
    SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
           arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
    FROM events {where} GROUP BY user_id
"""
_CUTOFF = "TIMESTAMP '2024-01-15 00:00:00'"
_LOG_COLUMNS = ["user_id", "ts", "event_id", "event_type", "value"]


@query(
    "compact_changelog",
    f"""
    SELECT user_id, (SELECT max(ts) FROM events WHERE ts < {_CUTOFF}) AS ts, event_id, event_type, value, true AS folded
    FROM ({_LAST.format(where=f"WHERE ts < {_CUTOFF}")})
    UNION ALL SELECT user_id, ts, event_id, event_type, value, false FROM events WHERE ts >= {_CUTOFF}
    """,
)
def _(t):
    log = t("events").select(*_LOG_COLUMNS)
    return changelog.compact_changelog(log, ["user_id"], "ts", F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), ["event_id"])


@query("replay_from_checkpoint", f"SELECT * FROM ({_LAST.format(where='')}) WHERE event_type <> 'error'")
def _(t):
    log = t("events").select(*_LOG_COLUMNS)
    cutoff = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    snapshot = changelog.replay(log.filter(F.col("ts") < cutoff), ["user_id"], ["ts", "event_id"])
    gone = F.col("event_type") == "error"
    return changelog.replay_from_checkpoint(
        snapshot, log, ["user_id"], ["ts", "event_id"], F.col("ts") >= cutoff, gone
    )


def _hashed(source: str) -> str:
    h = _row_text("turn", "role", "text")
    return f"""
      SELECT conv_id, turn, sha256(n || ':' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) OVER w || ':'
             || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) OVER w) AS prefix_hash
      FROM (SELECT *, sha256({h}) AS h FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {source}))
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
    """


@query("prefix_hash", _hashed("conversations"))
def _(t):
    hashed = changelog.prefix_hash(t("conversations"), ["conv_id"], ["turn"], ["role", "text"])
    return hashed.select("conv_id", "turn", "prefix_hash")


_DAMAGED = "SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 AND turn >= 2 THEN text || '?' ELSE text END AS text FROM conversations"


@query(
    "latest_valid_checkpoint",
    f"""
    WITH now AS ({_hashed(f"({_DAMAGED})")}), was AS ({_hashed("conversations")}),
    c AS (SELECT conv_id, turn, text AS content, sha256(CASE WHEN conv_id % 4 = 0 AND turn > 1 THEN text || '!' ELSE text END) AS content_hash
          FROM conversations WHERE turn % 2 = 1),
    v AS (SELECT c.*, was.prefix_hash, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS rn
          FROM c JOIN was USING (conv_id, turn) JOIN now USING (conv_id, turn)
          WHERE was.prefix_hash = now.prefix_hash AND sha256(c.content) = c.content_hash)
    SELECT conv_id, turn, content, content_hash, prefix_hash FROM v WHERE rn = 1
    """,
)
def _(t):
    """Checkpoints at odd turns; some contents and some log rows were damaged since."""
    def hashed(df):
        return changelog.prefix_hash(df, ["conv_id"], ["turn"], ["role", "text"])

    t("conversations").createOrReplaceTempView("conversations")
    content = F.expr("sha2(CASE WHEN conv_id % 4 = 0 AND turn > 1 THEN text || '!' ELSE text END, 256)")
    checkpoints = hashed(t("conversations")).filter("turn % 2 = 1").select(
        "conv_id", "turn", F.col("text").alias("content"), content.alias("content_hash"), "prefix_hash"
    )
    now = hashed(t.spark.sql(_DAMAGED))
    return changelog.latest_valid_checkpoint(checkpoints, now, ["conv_id"], ["turn"])


_MARK = "CASE event_type WHEN 'signup' THEN 'C' WHEN 'purchase' THEN 'B' END"
_SECTIONS = f"""
    e AS (SELECT user_id, ts, event_id, {_MARK} AS marker FROM events),
    m AS (SELECT *, count(marker) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM e),
    s AS (SELECT user_id, section, max(marker) AS opener, count(*) FILTER (marker IS NULL) AS n_rows FROM m GROUP BY ALL),
    k AS (SELECT *, lead(opener) OVER (PARTITION BY user_id ORDER BY section) AS closer FROM s),
    sec AS (SELECT user_id, section, n_rows, CASE WHEN opener = 'C' AND coalesce(closer, 'B') = 'B' THEN 'outside' ELSE 'inside' END AS kind
            FROM k WHERE n_rows > 0)
"""


@query(
    "segment_log",
    f"""
    WITH {_SECTIONS}
    SELECT user_id, ts, event_id, section, kind, CASE WHEN kind = 'inside' THEN
           (row_number() OVER (PARTITION BY user_id, section ORDER BY ts, event_id) - 1) // 3 ELSE 0 END AS piece
    FROM m JOIN sec USING (user_id, section) WHERE marker IS NULL
    """,
)
def _(t):
    log = t("events").select("user_id", "ts", "event_id", "event_type")
    return segments.segment_log(log, ["user_id"], ["ts", "event_id"], F.expr(_MARK), 3).drop("event_type")


@query(
    "coalesce_segments",
    f"""
    WITH {_SECTIONS}, p AS (SELECT *, lag(kind) OVER w AS prev, row_number() OVER w AS number FROM sec
      WINDOW w AS (PARTITION BY user_id ORDER BY section))
    SELECT user_id, section, n_rows, kind, number,
           CASE WHEN prev IS NULL THEN CASE kind WHEN 'outside' THEN 'C' ELSE '' END
                WHEN prev = 'inside' AND kind = 'inside' THEN 'C,B' WHEN prev = 'inside' THEN 'C'
                WHEN kind = 'inside' THEN 'B' ELSE 'B,C' END AS markers
    FROM p
    """,
)
def _(t):
    sections = segments.log_sections(t("events"), ["user_id"], ["ts", "event_id"], F.expr(_MARK))
    return segments.coalesce_segments(sections, ["user_id"])


@query(
    "dedupe_names",
    """
    SELECT p_partkey, p_brand, CASE WHEN rn = 1 THEN p_name ELSE p_name || '_' || rn END AS unique_name
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS rn FROM part)
    """,
)
def _(t):
    parts = t("part").select("p_partkey", "p_brand", "p_name")
    return dedupe_names(parts, ["p_partkey"], "p_name", ["p_brand"]).drop("p_name")


@query(
    "dedupe_names_colliding",
    """
    WITH RECURSIVE p AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) AS rn,
      CASE WHEN p_partkey % 3 = 0 AND p_size BETWEEN 2 AND 9 THEN p_name || '_' || p_size ELSE p_name END AS name FROM part),
    q AS (SELECT *, CASE WHEN regexp_matches(name, '^[0-9]') THEN '_' || name ELSE name END AS base FROM p),
    b AS (SELECT q.*, (SELECT count(*) FROM q o WHERE starts_with(o.base, q.base)) AS near FROM q),
    w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS pick
      UNION ALL SELECT rn, list_append(used, pick), pick FROM (SELECT b.rn, w.used,
        CASE WHEN NOT list_contains(w.used, b.base) THEN b.base ELSE b.base || '_' ||
          list_min([i for i in range(2, b.near + 3) if NOT list_contains(w.used, b.base || '_' || i)]) END AS pick
        FROM w JOIN b ON b.rn = w.rn + 1))
    SELECT p_partkey, p_brand, name, pick AS unique_name FROM w JOIN b USING (rn)
    """,
)
def _(t):
    """Sizes 2 to 9 leave their number in some names, so numbered and natural names meet."""
    name = F.expr("CASE WHEN p_partkey % 3 = 0 AND p_size BETWEEN 2 AND 9 THEN concat(p_name, '_', p_size) ELSE p_name END")
    return dedupe_names(t("part").select("p_partkey", "p_brand", name.alias("name")), ["p_partkey"], "name")
