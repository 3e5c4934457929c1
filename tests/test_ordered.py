"""Running values across chunks against a sequential scan."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.operators.batching import batch_rows, dedupe_names
from keelson.plans import ordered
from keelson.plans.ordered import Running, number_rows, plan_chunks, with_running


def hot_rows(n=600, seed=1):
    """A third of the rows share one key; another key is NULL."""
    rng = random.Random(seed)
    keys = [rng.choice([0, 0, 0, 1, 2, 3, 4, None, 5]) for _ in range(n)]
    pos = rng.sample(range(10 * n), n)
    return [(k, p, rng.choice([None, 1, 2, 5])) for k, p in zip(keys, pos)]


def sequential(rows, descending):
    out = {}
    by_key = {}
    for k, p, v in rows:
        by_key.setdefault(k, []).append((p, v))
    for k, items in by_key.items():
        total, last, first, peak = 0, None, None, None
        for p, v in sorted(items, reverse=descending):
            before = last
            total += v or 0
            last = v if v is not None else last
            first = v if first is None else first
            peak = v if peak is None or (v or 0) > peak else peak
            out[(k, p)] = (total, before, first, peak)
    return out


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("width", [None, 100, 1000])
def test_running_matches_sequential_scan(spark, width, descending):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, p int, v int")
    v = F.col("v")
    metrics = {
        "total": Running("sum", v),
        "before": Running("last", v, inclusive=False),
        "first": Running("first", v),
        "peak": Running("max", v),
    }
    chunk = F.floor(F.col("p") / width) if width else None
    got = with_running(df, ["k"], ["p"], metrics, chunk, descending)
    assert got.columns == ["k", "p", "v", "total", "before", "first", "peak"]
    want = sequential(rows, descending)
    assert {(r.k, r.p): (r.total, r.before, r["first"], r.peak) for r in got.collect()} == want


def cuts_of(df, order, rows_per_chunk=None, keys=()):
    """Rows by chunk; fails unless chunks follow the order of keys and order columns."""
    chunk = plan_chunks(df, order, rows_per_chunk, list(keys))
    rows = df.withColumn("__c", chunk).orderBy(*keys, *order).collect()
    chunks = [r["__c"] for r in rows]
    assert None not in chunks and chunks == sorted(chunks)
    return {c: chunks.count(c) for c in set(chunks)}


def test_planned_chunks_keep_the_order_of_every_type(spark):
    df = spark.range(2000).selectExpr(
        "id", "CAST(id AS double) / 7 AS d", "format_string('Customer#%09d', id) AS s", "id % 2 = 1 AS b",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 61.000001) AS t", "date_add(date'2024-01-01', CAST(id AS int)) AS day",
        "CAST(id AS decimal(38,2)) AS m", "id + 9007199254740993 AS big", "encode(string(id + 1000), 'UTF-8') AS bytes",
        "named_struct('x', id % 3, 'y', string(id)) AS pair", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS z",
    )
    for c in ["id", "d", "s", "t", "day", "m", "big", "bytes", "pair", "z"]:
        sizes = cuts_of(df, [c], 100)
        assert 15 <= len(sizes) <= 30 and max(sizes.values()) <= 200, c
        numbered = number_rows(df.select(c), [c], "n", chunk=plan_chunks(df, [c], 100)).orderBy(c).collect()
        assert [r.n for r in numbered] == list(range(1, 2001))


def test_planned_chunks_of_one_value_or_no_rows(spark):
    same = spark.range(500).selectExpr("7 AS x", "id")
    assert sum(cuts_of(same, ["x"], 10).values()) == 500
    assert cuts_of(same.filter("id < 0"), ["x"], 10) == {}
    assert number_rows(same.filter("id < 0"), ["id"], "n", chunk=plan_chunks(same.filter("id < 0"), ["id"])).count() == 0


@pytest.mark.parametrize("first", [
    "CASE WHEN id % 3 = 0 THEN 700 ELSE id END", "7", "CASE WHEN id % 2 = 0 THEN 1e300 ELSE id / 3D END",
    "CASE WHEN id % 3 = 0 THEN NULL ELSE 5 END", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, CASE WHEN id % 5 < 3 THEN 1 ELSE id / 1000 END)",
    "CASE WHEN id % 10 = 0 THEN id END", "CAST(id % 2 AS decimal(20,1))",
])
def test_a_value_that_fills_many_chunks_is_cut_by_the_next_column(spark, first):
    df = spark.range(3000).selectExpr(f"{first} AS a", "(id * 7919) % 3000 AS b")
    sizes = cuts_of(df, ["a", "b"], 100)
    assert max(sizes.values()) <= 200 and len(sizes) > 15
    rows = df.orderBy("a", "b").collect()
    numbered = number_rows(df, ["a", "b"], "n", chunk=plan_chunks(df, ["a", "b"], 100)).orderBy("n").collect()
    assert [(r.a, r.b) for r in numbered] == [(r.a, r.b) for r in rows]
    assert [r.n for r in numbered] == list(range(1, 3001))


def test_third_columns_and_outliers_are_cut(spark):
    third = spark.range(20_000).selectExpr("7 AS a", "NULL AS b", "id AS c")
    assert max(cuts_of(third.withColumn("b", F.col("b").cast("int")), ["a", "b", "c"], 1000).values()) <= 2000
    urls = spark.range(20_000).selectExpr("concat('https://host.example.com/', id) AS u").union(spark.sql("SELECT 'a' UNION ALL SELECT 'z'"))
    assert max(cuts_of(urls, ["u"], 1000).values()) <= 2000


def test_infinities_and_nan_keep_their_place(spark):
    first = "CASE WHEN id % 4 = 0 THEN double('-Infinity') WHEN id % 4 = 1 THEN double('Infinity') WHEN id % 4 = 2 THEN double('NaN') ELSE id END"
    df = spark.range(2000).selectExpr(f"{first} AS a", "id AS b")
    assert max(cuts_of(df, ["a", "b"], 100).values()) <= 200


def test_hot_keys_fill_many_chunks_and_cold_ones_share(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 0 ELSE id END AS k", "id AS p", "id % 4 AS v")
    assert max(cuts_of(df, ["p"], 100, ["k"]).values()) <= 200
    chunk = plan_chunks(df, ["p"], 100, ["k"])
    cuts = {r.k: r.c for r in df.groupBy("k").agg(F.count_distinct(chunk).alias("c")).collect()}
    assert cuts[None] > 5 and cuts[0] > 5 and all(c == 1 for k, c in cuts.items() if k)
    got = with_running(df, ["k"], ["p"], {"s": Running("sum", F.col("v"))}, chunk)
    want = with_running(df, ["k"], ["p"], {"s": Running("sum", F.col("v"))})
    assert got.exceptAll(want).isEmpty() and got.count() == 3000


def test_nulls_in_the_order_column_come_first(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (15, 3), (25, 4)], "p int, id int")
    got = number_rows(df, ["p"], "n", chunk=F.floor(F.col("p") / 10))
    assert {r.id: r.n for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_batches_of_two(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "id bigint")
    for chunk in (None, F.floor(F.col("id") / 2)):
        got = batch_rows(df, ["id"], 2, chunk=chunk).collect()
        assert {r.id: r.batch for r in got} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}


def sequential_names(names):
    seen, out = set(), []
    for name in names:
        base = "_" + name if name[:1].isdigit() else name
        pick, i = base, 2
        while pick in seen:
            pick, i = f"{base}_{i}", i + 1
        seen.add(pick)
        out.append(pick)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_match_a_sequential_scan(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "a_2", "a_3", "a_2_2", "a_4", "a_2_3", "b", "9x", "_9x_2", "a_02", "", "_2", "a_1"]
    rows, want = [], {}
    for g in [0, 1, 2, 3, 4, None]:
        names = [rng.choice(pool[: rng.randint(1, len(pool))]) for _ in range(25)]
        for i, (name, unique) in enumerate(zip(names, sequential_names(names))):
            rows.append((g, i, name))
            want[(g, i)] = unique
    df = spark.createDataFrame(rows, "g int, i int, name string")
    chunk = F.floor(F.col("i") / 4) if seed % 2 else None
    got = dedupe_names(df, ["i"], "name", ["g"], chunk=chunk)
    assert {(r.g, r.i): r.unique_name for r in got.collect()} == want


def test_borders_do_not_grow_with_the_table(spark, monkeypatch):
    """A few borders, from a few drawn rows, cut a table of many rows evenly; a hot tuple is one chunk."""
    monkeypatch.setattr(ordered, "MAX_CHUNKS", 6)
    df = spark.range(300_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS v", "cast(id AS string) AS s")
    drawn = []
    plain = ordered._borders
    monkeypatch.setattr(ordered, "_borders", lambda *a: drawn.append(a) or plain(*a))
    chunk = ordered.plan_chunks(df, ["v", "s"], rows_per_chunk=1000)
    sizes = [r["n"] for r in df.groupBy(chunk.alias("c")).agg(F.count("*").alias("n")).collect()]
    assert drawn[0][2] == 6 and len(sizes) == 6 and max(sizes) < 2 * min(sizes)
    hot = ordered.plan_chunks(df, ["v"], rows_per_chunk=1000)
    sizes = sorted(r["n"] for r in df.groupBy(hot.alias("c")).agg(F.count("*").alias("n")).collect())
    assert len(sizes) <= 6 and 100_000 <= sizes[-1] < 160_000
