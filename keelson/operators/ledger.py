"""The run log of jobs over many databases, and what can be read off it.

A ledger has one row per key (default ``database, job``) with ``status``, ``checksum`` and
``async``. The log that produces it has one row per attempted transition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.plans.joins import match
from keelson.plans.ordered import Running, plan_chunks, with_running

KEYS = ("database", "job")
DONE = ("succeeded", "recovered")

# The allowed transitions; any other attempt leaves the state as it is.
TRANSITIONS = {
    ("record", "absent"): "succeeded",
    ("start", "absent"): "pending",
    ("complete", "pending"): "succeeded",
    ("fail", "pending"): "failed",
    ("recover", "failed"): "recovered",
    ("retry", "failed"): "pending",
}


def _next_state(action: Column, state: Column) -> Column:
    """The state an allowed transition leads to, NULL for a rejected one."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for (a, s), to in TRANSITIONS.items():
        out = out.when((action == a) & (state == s), to)
    return out


# Entry states a chunk can still change; the others are final.
_LIVE = ("absent", "pending", "failed")
_CHUNKS_PER_BLOCK = 256


def _walk(rows: DataFrame, window_keys: list[str], order: list[Column], entry: Column) -> DataFrame:
    """Add ``state_before`` from running windows over one chunk of one job.

    The state is set by the entry state or the row that opens the job, toggled by fail and
    retry, and ended by the first complete (while pending) or recover (while failed).
    """
    before = Window.partitionBy(*window_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    action = F.col("action")
    opens = F.when(action == "record", "succeeded").when(action == "start", "pending")
    rows = rows.withColumn("__open", F.coalesce(entry, F.first(opens, ignorenulls=True).over(before)))
    toggle = F.when(
        F.col("__open").isNotNull(), F.when(action == "fail", "failed").when(action == "retry", "pending")
    )
    rows = rows.withColumn(
        "__now", F.coalesce(F.last(toggle, ignorenulls=True).over(before), F.col("__open"))
    )
    ends = F.when((action == "complete") & (F.col("__now") == "pending"), "succeeded").when(
        (action == "recover") & (F.col("__now") == "failed"), "recovered"
    )
    rows = rows.withColumn("__end", F.first(ends, ignorenulls=True).over(before))
    state = (
        F.when(F.col("__open").isNull(), "absent")
        .when(F.col("__open").isin(*DONE), F.col("__open"))
        .otherwise(F.coalesce("__end", "__now"))
    )
    return rows.withColumn("state_before", state).drop("__open", "__now", "__end")


def _chunk_effects(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per (key, chunk): the state that each live entry state leads to."""
    variants = F.explode(F.array(*[F.lit(s) for s in _LIVE])).alias("__from")
    tried = rows.select(*keys, "__chunk", *order, "action", variants)
    entry = F.when(F.col("__from") != "absent", F.col("__from"))
    walked = _walk(tried, [*keys, "__chunk", "__from"], [F.col(o) for o in order], entry)
    after = F.coalesce(_next_state(F.col("action"), F.col("state_before")), F.col("state_before"))
    last = walked.groupBy(*keys, "__chunk", "__from").agg(F.max_by(after, F.struct(*order)).alias("to"))
    return last.groupBy(*keys, "__chunk").agg(
        *[F.max(F.when(F.col("__from") == s, F.col("to"))).alias(s) for s in _LIVE]
    )


def _lead_to(effect: Column, state: Column) -> Column:
    """The state after an effect (a struct with one field per live state); done states stay."""
    after = F.when(state == _LIVE[0], effect[_LIVE[0]])
    for s in _LIVE[1:]:
        after = after.when(state == s, effect[s])
    return after.otherwise(state)


def _states_before(items: Column, start: Column, label: str, kind: str) -> Column:
    """``(label, state)`` of every item of an ordered array of effects, ``state`` holding before it."""
    begin = F.struct(start.alias("state"), F.array().cast(f"array<struct<{label}:{kind},state:string>>").alias("seen"))

    def step(acc: Column, c: Column) -> Column:
        passed = F.struct(c[label].alias(label), acc["state"].alias("state"))
        return F.struct(_lead_to(c, acc["state"]).alias("state"), F.concat(acc["seen"], F.array(passed)).alias("seen"))

    return F.aggregate(items, begin, step, lambda acc: acc["seen"])


def _entry_states(effects: DataFrame, keys: list[str], entry: DataFrame | None) -> DataFrame:
    """Per (key, chunk): the state before its first row.

    Effects compose, so a job's chunks are folded in two levels: blocks of a few hundred
    chunks into one effect each, the blocks of a job from its entry state, and then the chunks of each
    block from the state before the block.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__chunk")) - 1
    blocks = (
        effects.withColumn("__rank", rank)
        .withColumn("__block", F.expr(f"__rank div {_CHUNKS_PER_BLOCK}").cast("int"))
        .groupBy(*keys, "__block")
        .agg(F.array_sort(F.collect_list(F.struct("__chunk", *_LIVE))).alias("chunks"))
    )
    through = [F.aggregate("chunks", F.lit(s), lambda state, c: _lead_to(c, state)).alias(s) for s in _LIVE]
    whole = blocks.select(*keys, "__block", *through)
    jobs = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__block", *_LIVE))).alias("blocks"))
    if entry is None:
        jobs = jobs.withColumn("state", F.lit("absent"))
    else:
        jobs = jobs.join(entry, keys, "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    before = jobs.select(*keys, F.inline(_states_before(F.col("blocks"), F.col("state"), "__block", "int")))
    inside = match(blocks, before, [*keys, "__block"])
    return inside.select(*keys, F.inline(_states_before(F.col("chunks"), F.col("state"), "__chunk", "bigint")))


def ledger_transitions(
    events: DataFrame,
    keys: list[str] = KEYS,
    order: list[str] = ("ts", "event_id"),
    chunk: Column | None = None,
    entry: DataFrame | None = None,
) -> DataFrame:
    """Every attempted transition with ``state_before``, ``state_after`` and ``accepted``.

    ``entry`` gives the state ``(keys…, state)`` of jobs that are already known.

    A job's rows are cut into chunks so that a hot job is spread over tasks. Each chunk is
    walked once per possible entry state, which gives a small table of effects; folding
    those per job gives the entry state of every chunk, and that enters the second walk as
    a seed row.
    """
    keys, order = list(keys), list(order)
    if chunk is None:
        chunk = plan_chunks(events, order, keys=keys)
    after = _next_state(F.col("action"), F.col("state_before"))
    outcome = {"accepted": after.isNotNull(), "state_after": F.coalesce(after, F.col("state_before"))}
    ordering = [F.col(o) for o in order]
    window_keys, rows = [*keys, "__chunk"], events.withColumn("__chunk", chunk)
    seeds = _entry_states(_chunk_effects(rows, keys, order), keys, entry)
    seeds = seeds.filter("state <> 'absent'").select(
        *window_keys, F.lit(0).alias("__seed"), F.col("state").alias("__entry")
    )
    both = rows.withColumn("__seed", F.lit(1)).unionByName(seeds, allowMissingColumns=True)
    seed_first = [F.col("__seed"), *ordering]
    before = Window.partitionBy(*window_keys).orderBy(*seed_first).rowsBetween(Window.unboundedPreceding, -1)
    known = F.first("__entry", ignorenulls=True).over(before)
    walked = _walk(both.withColumn("__from", known), window_keys, seed_first, F.col("__from"))
    return walked.withColumns(outcome).filter("__seed = 1").drop("__chunk", "__seed", "__entry", "__from")


def ledger_state(
    events: DataFrame,
    keys: list[str] = KEYS,
    order: list[str] = ("ts", "event_id"),
    chunk: Column | None = None,
) -> DataFrame:
    """The ledger: one row per job that was ever recorded or started.

    ``fail`` keeps statement and message, ``recover`` and ``retry`` clear them. ``rejected``
    counts the transitions that were not allowed.
    """
    moves = ledger_transitions(events, keys, order, chunk)
    at, ts = F.struct(*order), F.col(order[0])

    def latest(value: Column, *actions: str) -> Column:
        return F.max_by(value, F.when(F.col("accepted") & F.col("action").isin(*actions), at))

    aggs = [
        F.max_by("state_after", F.when(F.col("accepted"), at)).alias("status"),
        latest(ts, "start", "retry").alias("started_at"),
        F.max_by(F.when(F.col("action").isin("start", "retry"), None).otherwise(ts), F.when(F.col("accepted"), at)).alias(
            "completed_at"
        ),
        F.count_if(~F.col("accepted")).alias("rejected"),
    ]
    for name in ("failed_statement", "error_msg"):
        if name in events.columns:
            kept = F.when(F.col("action") == "fail", F.col(name))
            aggs.append(F.max_by(kept, F.when(F.col("accepted"), at)).alias(name))
    if "checksum" in events.columns:
        aggs.append(latest(F.col("checksum"), "record", "start", "retry").alias("checksum"))
    if "async" in events.columns:
        aggs.append(latest(F.col("async"), "record", "start").alias("async"))
    return moves.groupBy(*keys).agg(*aggs).filter("status IS NOT NULL")


def ledger_rejects(
    events: DataFrame, keys: list[str] = KEYS, order: list[str] = ("ts", "event_id"), chunk: Column | None = None
) -> DataFrame:
    """The transitions that were not allowed, with the state they met."""
    return ledger_transitions(events, keys, order, chunk).filter(~F.col("accepted")).drop("accepted", "state_after")


def pending_items(items: DataFrame, ledger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Items without a ledger row, ordered by key."""
    return items.join(ledger.select(*keys), list(keys), "left_anti").orderBy(*keys)


def checksum_mismatch(items: DataFrame, ledger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Items whose ledger row has another, non-empty checksum."""
    stored = ledger.select(*keys, F.col("checksum").alias("applied_checksum")).filter("applied_checksum <> ''")
    return items.join(stored, list(keys)).filter("checksum <> applied_checksum")


def unmet_dependencies(jobs: DataFrame, ledger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``(database, job, dependency)`` for every dependency that is not done.

    A dependency without a ledger row is unmet. The distinct dependencies are looked up,
    so one that most jobs share is looked up once.
    """
    scope, name = list(keys)[:-1], list(keys)[-1]
    wanted = jobs.select(*keys, F.explode("depends_on").alias("dependency"))
    done = ledger.filter(F.col("status").isin(*DONE)).select(*scope, F.col(name).alias("dependency"))
    on = [*scope, "dependency"]
    unmet = wanted.select(*on).distinct().join(done, on, "left_anti")
    return wanted.join(unmet, on, "left_semi").select(*keys, "dependency")


def last_writer_dependencies(
    new: DataFrame,
    log: DataFrame,
    name: str = "name",
    order: list[str] = ("seq",),
    job: str = "job",
    scope: list[str] = (),
    chunk: Column | None = None,
) -> DataFrame:
    """Distinct ``(job, dependency)``: for each name a new job touches, the latest earlier job.

    ``new`` and ``log`` have one row per (job, name) with the order columns. Names of whole
    schemas (``schema:…``) are too general and left out. Both sides are unioned and the
    last writer is carried forward per name, so a hot name is never joined with itself.
    """
    order = list(order)

    def side(df: DataFrame, is_log: bool) -> DataFrame:
        kept = df.filter(~F.startswith(F.col(name).cast("string"), F.lit("schema:")))
        # at equal order the log row comes after the new row, so it is not earlier
        return kept.select(*scope, name, *order, F.col(job).alias("__job"), F.lit(is_log).alias("__log"))

    rows = side(new, False).unionByName(side(log, True))
    if chunk is None:
        chunk = plan_chunks(rows, order, keys=[*scope, name])
    writer = F.when(F.col("__log"), F.struct("__job"))
    seen = with_running(
        rows, [*scope, name], [*order, "__log", "__job"], {"__last": Running("last", writer, inclusive=False)}, chunk
    )
    return (
        seen.filter("NOT __log AND __last IS NOT NULL")
        .select(*scope, F.col("__job").alias(job), F.col("__last.__job").alias("dependency"))
        .filter(F.col(job) != F.col("dependency"))
        .distinct()
    )


def reconcile_ledger(jobs: DataFrame, ledger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every job with the status that marks it done and whether its row changes."""
    old = ledger.select(*keys, F.col("status").alias("old_status"))
    merged = jobs.select(*keys).join(old, list(keys), "left")
    status = (
        F.when(F.col("old_status").isNull(), "succeeded")
        .when(F.col("old_status") == "failed", "recovered")
        .when(F.col("old_status") == "pending", "succeeded")
        .otherwise(F.col("old_status"))
    )
    return merged.withColumns({"status": status, "changed": ~status.eqNullSafe(F.col("old_status"))})


def adopted_jobs(jobs: DataFrame, ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """Jobs of databases that hold objects but have no ledger yet: recorded as done, not run.

    ``targets`` has ``(database, has_objects)``.
    """
    fresh = targets.filter("has_objects").select("database").join(
        ledger.select("database").distinct(), "database", "left_anti"
    )
    return jobs.join(fresh, "database", "left_semi").withColumn("status", F.lit("succeeded"))


def ready_set(jobs: DataFrame, ledger: DataFrame, mode: str = "sync", keys: list[str] = KEYS) -> DataFrame:
    """Pending jobs admitted by ``mode`` (sync, all, async) with an action.

    ``hold_dependency`` and ``hold_async`` wait, ``record`` is a squash job that is noted
    without running, ``run`` is the rest. An async job is held while another async job of
    its database is pending.
    """
    if mode not in ("sync", "all", "async"):
        raise ValueError(f"unknown mode {mode}")
    scope = list(keys)[:-1]
    pending = jobs.join(ledger.select(*keys), list(keys), "left_anti")
    if mode != "all":
        pending = pending.filter(F.col("mode") == mode)
    unmet = unmet_dependencies(pending, ledger, keys).select(*keys).distinct().withColumn("__unmet", F.lit(True))
    busy = (
        ledger.filter("async AND status = 'pending'").select(*scope).distinct().withColumn("__busy", F.lit(True))
    )
    action = (
        F.when(F.col("__unmet"), "hold_dependency")
        .when((F.col("mode") == "async") & F.col("__busy"), "hold_async")
        .when(F.col("squash"), "record")
        .otherwise("run")
    )
    joined = pending.join(unmet, list(keys), "left").join(busy, scope, "left")
    return joined.select(*keys, "mode", action.alias("action"))


def first_blocker(ledger: DataFrame, group: list[str] = ("database",), name: str = "job") -> DataFrame:
    """Per group: the first job that blocks, and the first pending async job.

    Failed jobs block, and so do pending ones unless they are async.
    """
    pending = F.col("status") == "pending"
    blocks = (F.col("status") == "failed") | (pending & ~F.col("async"))
    out = ledger.groupBy(*group).agg(
        F.min(F.when(blocks, F.col(name))).alias("blocker"),
        F.min(F.when(pending & F.col("async"), F.col(name))).alias("running_async"),
    )
    return out.filter("blocker IS NOT NULL OR running_async IS NOT NULL")
