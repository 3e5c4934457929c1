import random

from pyspark.sql import functions as F

from keelson.operators import diff as op


def table(spark, seed):
    rng = random.Random(seed)
    keys = rng.sample(range(60), 40) + [None]
    rows = [(k, rng.choice(["x", "y", None]), rng.choice([0.0, 1.5, None])) for k in keys]
    return spark.createDataFrame(rows, "k int, a string, b double")


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_no_difference_with_itself(spark):
    a = table(spark, 1)
    d = op.table_diff(a, a, ["k"])
    assert d.isEmpty()
    assert [(r.n_rows, r.has_changes) for r in op.diff_summary(d).collect()] == [(0, False)] * 3


def test_diff_applied_to_the_left_gives_the_right(spark):
    for seed in range(3):
        a, b = table(spark, seed), table(spark, seed + 10)
        d = op.table_diff(a, b, ["k"])
        assert as_set(op.apply_diff(a, b, d, ["k"])) == as_set(b)


def test_changed_columns_and_null_moves(spark):
    a = spark.createDataFrame([(1, None, "v"), (2, "v", "w"), (3, "p", "q"), (4, "z", "z")], "k int, a string, b string")
    b = spark.createDataFrame([(1, "v", None), (2, "v", "x"), (3, "p", "q"), (5, "n", "n")], "k int, a string, b string")
    got = {r.k: (r.kind, r.changed) for r in op.table_diff(a, b, ["k"]).collect()}
    assert got == {1: ("modified", ["a", "b"]), 2: ("modified", ["b"]), 4: ("removed", []), 5: ("added", [])}
    lines = {r.line for r in op.diff_lines(op.table_diff(a, b, ["k"]), ["k"]).collect()}
    assert "modified 1: a, b" in lines and "added 5" in lines


def test_three_way(spark):
    a, b = table(spark, 4), table(spark, 5)
    status = lambda d, s, l: op.drift_status(op.three_way_drift(d, s, l, ["k"])).first()
    assert status(a, a, a).converged
    r = status(a, a, b)
    assert (r.declared_drift, r.converged) == (0, False) and r.live_drift > 0


def test_fingerprint_ignores_order_and_sees_duplicates(spark):
    a = table(spark, 6)
    fp = lambda df: op.table_fingerprint(df, [], ["k", "a", "b"]).first().fingerprint
    assert fp(a) == fp(a.orderBy(F.rand(3)).repartition(5))
    assert fp(a) != fp(a.union(a)) and fp(a) != fp(a.filter("k <> 7 OR k IS NULL").union(a.limit(1)))
    # two equal extra rows do not cancel
    assert fp(a.union(a.limit(1)).union(a.limit(1))) != fp(a)


def test_set_laws(spark):
    a, b = table(spark, 7).select("a", "b"), table(spark, 8).select("a", "b").filter("b = 1.5")
    sets = {n: set(map(tuple, op.key_overlap(a, b, ["a", "b"], n).collect())) for n in ("union", "intersect", "difference", "symmetric")}
    x, y = set(map(tuple, a.collect())), set(map(tuple, b.collect()))
    assert sets == {"union": x | y, "intersect": x & y, "difference": x - y, "symmetric": x ^ y}
    assert tuple(op.overlap_counts(a, b, ["a", "b"]).first()) == (len(x - y), len(y - x), len(x & y))


def test_nested_columns(spark):
    text = "SELECT 1 AS k, map('a', 1, 'b', 2) AS m, array(1D, NULL) AS x, struct(1 AS p) AS s"
    a = spark.sql(text)
    same = spark.sql(text.replace("'a', 1, 'b', 2", "'b', 2, 'a', 1"))
    other = spark.sql(text.replace("'b', 2", "'b', 3").replace("1D, NULL", "NULL, 1D"))
    assert op.table_diff(a, same, ["k"]).isEmpty()
    assert op.table_diff(a, other, ["k"]).first().changed == ["m", "x"]


def test_repeated_keys_are_reported(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "q"), (None, "n")], "k int, v string")
    for left, right in ((a, b), (b, a)):
        got = {r.k: r.kind for r in op.table_diff(left, right, ["k"]).collect()}
        assert got == {1: "duplicate", 2: "modified", None: "duplicate"}
