"""Ledger, segments, change logs against sequential rules."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import changelog, ledger, segments
from keelson.operators.ledger import TRANSITIONS

ACTIONS = ["record", "start", "complete", "fail", "recover", "retry", "nonsense"]


def attempts(seed=0, n=900):
    rng = random.Random(seed)
    weights = [1, 3, 2, 8, 1, 8, 1]
    jobs = [rng.choice([0] * 10 + list(range(1, 20))) for _ in range(n)]
    return [(j % 3, j, t // 2, t, rng.choices(ACTIONS, weights)[0], f"s{t}") for t, j in enumerate(jobs)]


def fold(rows):
    state, out = {}, {}
    for db, job, ts, eid, action, text in rows:
        s = state.get(job, "absent")
        after = TRANSITIONS.get((action, s))
        out[eid] = (s, after or s, after is not None)
        if after:
            state[job] = after
    return state, out


@pytest.mark.parametrize("width", [None, 20, 200])
def test_guarded_fold(spark, width):
    rows = attempts()
    df = spark.createDataFrame(rows, "database int, job int, ts int, event_id int, action string, failed_statement string")
    chunk = F.floor(F.col("ts") / width) if width else None
    state, moves = fold(rows)
    got = ledger.ledger_transitions(df, chunk=chunk).collect()
    assert {r.event_id: (r.state_before, r.state_after, r.accepted) for r in got} == moves
    table = {r.job: r for r in ledger.ledger_state(df, chunk=chunk).collect()}
    assert {j: r.status for j, r in table.items()} == state
    for job, r in table.items():
        mine = [x for x in rows if x[1] == job and moves[x[3]][2]]
        assert r.rejected == sum(1 for x in rows if x[1] == job) - len(mine)
        assert r.failed_statement == (mine[-1][5] if r.status == "failed" else None)
        assert r.completed_at == (None if r.status == "pending" else mine[-1][2])
    rejects = ledger.ledger_rejects(df, chunk=chunk)
    assert rejects.count() == sum(1 for m in moves.values() if not m[2])


@pytest.mark.parametrize("width", [None, 30])
def test_fold_in_two_halves(spark, width):
    rows = attempts(4)
    df = spark.createDataFrame(rows, "database int, job int, ts int, event_id int, action string, text string")
    first, second = df.filter("ts < 200"), df.filter("ts >= 200")
    chunk = F.floor(F.col("ts") / width) if width else None
    entry = ledger.ledger_state(first).select("database", "job", F.col("status").alias("state"))
    got = ledger.ledger_transitions(second, chunk=chunk, entry=entry).collect()
    moves = fold(rows)[1]
    assert len(got) == second.count()
    assert all((r.state_before, r.state_after, r.accepted) == moves[r.event_id] for r in got)


@pytest.fixture
def jobs(spark):
    rows = [("d", "a", "1", "sync", [], False), ("d", "b", "2", "sync", ["a"], False), ("d", "c", "3", "async", ["x"], True)]
    return spark.createDataFrame(
        rows, "database string, job string, checksum string, mode string, depends_on array<string>, squash boolean"
    )


def led(spark, *rows):
    return spark.createDataFrame(list(rows), "database string, job string, checksum string, status string, async boolean")


def test_pending_and_checksums(spark, jobs):
    one = led(spark, ("d", "a", "1", "succeeded", False))
    assert [r.job for r in ledger.pending_items(jobs, one).collect()] == ["b", "c"]
    assert ledger.checksum_mismatch(jobs, one).isEmpty()
    assert ledger.checksum_mismatch(jobs, led(spark, ("d", "a", "", "succeeded", False))).isEmpty()
    changed = ledger.checksum_mismatch(jobs, led(spark, ("d", "a", "9", "succeeded", False)))
    assert [r.job for r in changed.collect()] == ["a"]


@pytest.mark.parametrize("status,unmet", [("succeeded", 1), ("recovered", 1), ("pending", 2), ("failed", 2), (None, 2)])
def test_dependencies(spark, jobs, status, unmet):
    rows = [("d", "a", "1", status, False)] if status else []
    rows += [("other", "x", "1", "succeeded", False)]
    assert ledger.unmet_dependencies(jobs, led(spark, *rows)).count() == unmet


def test_last_writers(spark):
    log = [("m1", 1, "users"), ("m2", 2, "users"), ("m3", 3, "posts"), ("m3", 3, "schema:public")]
    log = spark.createDataFrame(log, "job string, seq int, name string")
    def deps(*names):
        new = spark.createDataFrame([("new", 9, n) for n in names], "job string, seq int, name string")
        return sorted(r.dependency for r in ledger.last_writer_dependencies(new, log).collect())
    assert deps("users") == ["m2"]
    assert deps("users", "posts") == ["m2", "m3"]
    assert deps("schema:public", "other") == []


def test_blockers(spark):
    rows = [("a", "j2", "", "failed", False), ("a", "j1", "", "pending", True), ("b", "j1", "", "pending", False), ("c", "j", "", "succeeded", False)]
    got = {r.database: (r.blocker, r.running_async) for r in ledger.first_blocker(led(spark, *rows)).collect()}
    assert got == {"a": ("j2", "j1"), "b": ("j1", None)}


def test_reconcile_and_adoption(spark, jobs):
    rows = [("d", "a", "", "failed", False), ("d", "b", "", "recovered", False)]
    got = {r.job: (r.status, r.changed) for r in ledger.reconcile_ledger(jobs, led(spark, *rows)).collect()}
    assert got == {"a": ("recovered", True), "b": ("recovered", False), "c": ("succeeded", True)}
    targets = spark.createDataFrame([("d", True)], "database string, has_objects boolean")
    assert ledger.adopted_jobs(jobs, led(spark), targets).count() == 3
    assert ledger.adopted_jobs(jobs, led(spark, *rows), targets).isEmpty()


def test_ready_set(spark, jobs):
    def actions(ledger_rows, mode):
        return {r.job: r.action for r in ledger.ready_set(jobs, led(spark, *ledger_rows), mode).collect()}
    assert actions([], "sync") == {"a": "run", "b": "hold_dependency"}
    done = [("d", "a", "", "succeeded", False), ("d", "x", "", "recovered", False)]
    assert actions(done, "all") == {"b": "run", "c": "record"}
    busy = done + [("d", "y", "", "pending", True)]
    assert actions(busy, "async") == {"c": "hold_async"}


def chunk_rule(items, limit):
    """The sequential rule: pieces of one ordered list of 'C', 'B' and statements."""
    pieces, current, outside = [], [], False

    def flush(as_outside):
        nonlocal current
        if current:
            if as_outside:
                pieces.append(("outside", current))
            else:
                pieces.extend(("inside", current[i : i + limit]) for i in range(0, len(current), limit))
        current = []

    i = 0
    while i < len(items):
        if items[i] == "C":
            flush(False)
            outside = not (i + 1 < len(items) and items[i + 1] == "B")
            i += not outside
        elif items[i] == "B":
            flush(outside)
            outside = False
        else:
            current.append(items[i])
        i += 1
    flush(outside)
    return pieces


def segmented(spark, logs, limit, width):
    rows = [(p, i, x) for p, items in logs.items() for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "part int, i int, x string")
    marker = F.expr("CASE WHEN x IN ('C', 'B') THEN x END")
    chunk = F.floor(F.col("i") / width) if width else None
    got = {}
    for r in segments.segment_log(df, ["part"], ["i"], marker, limit, chunk).orderBy("i").collect():
        got.setdefault(r.part, {}).setdefault((r.section, r.piece, r.kind), []).append(r.x)
    out = {p: [(k[2], v) for k, v in sorted(g.items(), key=lambda kv: kv[0][:2])] for p, g in got.items()}
    sections = segments.log_sections(df, ["part"], ["i"], marker, chunk)
    return out, segments.coalesce_segments(sections, ["part"], 3)


def test_segment_cases(spark):
    logs = {1: ["s1", "s2"], 2: ["s1", "C", "B", "s2"], 3: ["s1", "C", "s2", "B", "s3"], 4: ["C", "B"], 5: [f"s{i}" for i in range(5)]}
    got, _ = segmented(spark, logs, 2, None)
    assert got == {p: chunk_rule(x, 2) for p, x in logs.items() if chunk_rule(x, 2)}
    assert got[3] == [("inside", ["s1"]), ("outside", ["s2"]), ("inside", ["s3"])]


@pytest.mark.parametrize("width", [None, 7])
def test_segments_match_the_sequential_rule(spark, width):
    rng = random.Random(5)
    parts = [None, *range(60)]
    logs = {p: [rng.choice(["C", "B", f"s{i}", f"s{i}"]) for i in range(rng.randint(1, 40))] for p in parts}
    got, joined = segmented(spark, logs, 3, width)
    assert got == {p: w for p, x in logs.items() if (w := chunk_rule(x, 3))}
    # replaying the minimal markers gives the same sections
    by_part = {}
    for r in joined.orderBy("number").collect():
        by_part.setdefault(r.part, []).append(r)
    for p, rows in by_part.items():
        flat = []
        for r in rows:
            flat += [m for m in r.markers.split(",") if m] + [f"x{r.number}_{i}" for i in range(r.n_rows)]
        again = chunk_rule(flat, 10**6)
        assert [(k, len(v)) for k, v in again] == [(r.kind, r.n_rows) for r in rows]
        assert [r.number for r in rows] == list(range(1, len(rows) + 1))


def test_compaction_refuses_and_keeps(spark):
    log = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c"), (2, 99, "d"), (3, None, "e")], "k int, ts int, v string")
    got = changelog.compact_changelog(log, ["k"], "ts", F.lit(50))
    assert sorted((r.k, r.ts, r.v, r.folded) for r in got.fillna(-1).collect()) == [
        (1, 20, "b", True), (2, 20, "c", True), (2, 99, "d", False), (3, -1, "e", False)
    ]
    with pytest.raises(ValueError, match="at least 2"):
        changelog.compact_changelog(log, ["k"], "ts", F.lit(6))


def test_replay_from_any_checkpoint_is_the_full_replay(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9), i, rng.choice(["x", "y", "gone"])) for i in range(200)]
    log = spark.createDataFrame(rows, "k int, seq int, v string")
    gone = F.col("v") == "gone"
    full = sorted(map(tuple, changelog.replay(log, ["k"], ["seq"], gone).collect()))
    for at in (0, 57, 199):
        snapshot = changelog.replay(log.filter(F.col("seq") <= at), ["k"], ["seq"])
        got = changelog.replay_from_checkpoint(snapshot, log, ["k"], ["seq"], F.col("seq") > at, gone)
        assert sorted(map(tuple, got.collect())) == full


def test_prefix_hash_depends_on_order_and_not_on_chunks(spark):
    rows = [(0, i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "part int, i int, text string")

    def hashes(d, chunk=None):
        return {r.i: r.prefix_hash for r in changelog.prefix_hash(d, ["part"], ["i"], ["text"], chunk).collect()}

    base = hashes(df)
    assert hashes(df, F.floor(F.col("i") / 7)) == base
    swapped = hashes(df.withColumn("text", F.expr("CASE i WHEN 20 THEN 't21' WHEN 21 THEN 't20' ELSE text END")))
    assert [i for i in range(50) if swapped[i] != base[i]] == list(range(20, 50))
