"""NULL rules differ per constraint; each one is checked with NULLs present."""

import pytest

from keelson.operators import integrity as op
from keelson.specs import Check, Column, ForeignKey, TableSpec, Unique


@pytest.fixture
def rows(spark):
    data = [(1, "a", 5), (1, "a", None), (2, None, 9), (None, None, 3), (3, "b", -1), (3, "c", 0)]
    return spark.createDataFrame(data, "id int, name string, n int")


def test_primary_key(rows):
    got = {(r.id, r.n_rows, r.reason) for r in op.pk_violations(rows, ["id"]).collect()}
    assert got == {(1, 2, "duplicate"), (3, 2, "duplicate"), (None, 1, "null")}


def test_unique_treats_nulls_as_distinct(rows):
    assert [tuple(r) for r in op.unique_violations(rows, ["name"]).collect()] == [("a", 2)]
    assert op.unique_violations(rows, ["name"], "n IS NOT NULL").isEmpty()


def test_nullable_unique(spark, rows):
    got = {r.column: (r.null_rows, r.hidden_duplicates) for r in op.nullable_unique_report(rows, ["id", "name"]).collect()}
    assert got == {"id": (1, 0), "name": (2, 0)}
    twice = spark.createDataFrame([(1, None), (1, None), (2, None), (None, "x")], "id int, ext string")
    got = {r.column: (r.null_rows, r.hidden_duplicates) for r in op.nullable_unique_report(twice, ["id", "ext"]).collect()}
    assert got == {"id": (1, 0), "ext": (3, 1)}
    # both columns guarded by the key's predicate: nothing to report
    assert op.nullable_unique_report(twice, ["id", "ext"], ["id", "ext"]).isEmpty()


def test_not_null_and_check(rows):
    assert {tuple(r) for r in op.not_null_violations(rows, ["id", "name", "n"]).collect()} == {("id", 1), ("name", 2), ("n", 1)}
    assert [r.n for r in op.check_violations(rows, "n > 0").orderBy("n").collect()] == [-1, 0]


def test_foreign_key_match_simple(spark):
    child = spark.createDataFrame([(1, 1, "ok"), (1, None, "null"), (None, 9, "null"), (2, 2, "bad"), (2, 2, "bad")], "a int, b int, t string")
    parent = spark.createDataFrame([(1, 1), (1, 1), (None, 2)], "x int, y int")
    got = op.fk_violations(child, parent, ["a", "b"], ["x", "y"])
    assert [r.t for r in got.collect()] == ["bad", "bad"]
    assert op.fk_target_unique(parent, ["y", "x"]).count() == 1


def test_self_reference(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id int, parent int")
    assert [r.id for r in op.self_fk_violations(tree, ["id"], ["parent"]).collect()] == [4]


def test_self_columns_compare_qualified_names():
    spec = TableSpec("a.t", (Column("id", "int"), Column("p", "int"), Column("q", "int")), ("id",), foreign_keys=(
        ForeignKey(("p",), "b.t", ("id",)), ForeignKey(("q",), "a.t", ("id",))))
    assert spec.self_columns() == ["q"]


def test_waivers(spark):
    issues = spark.createDataFrame(
        [("r1", "t1", "c1"), ("r1", "t1", None), ("r1", "t2", "c1"), ("r2", "t1", "c1"), ("r3", "t1", "c9"), ("r4", "t", "c")],
        "rule string, table string, constraint string")
    waivers = spark.createDataFrame(
        [("r1", "t1", None), ("r2", None, None), ("r3", "t1", "c1"), ("r4", None, "c")], issues.schema)
    got = sorted(tuple(r) for r in op.suppress_issues(issues, waivers).collect())
    assert got == [("r1", "t2", "c1"), ("r3", "t1", "c9")]


def test_report_counts_rows_and_warns(spark, rows):
    spec = TableSpec("t", (Column("id", "int", False), Column("name", "string"), Column("n", "int", False)), ("id",),
                     (Unique(("name",)),), (Check("positive", "n > 0"),), (ForeignKey(("n",), "t", ("id",)),))
    got = {(r.constraint, r.kind): (r.severity, r.violations) for r in op.constraint_report({"t": rows}, [spec]).collect()}
    assert got == {
        ("primary", "primary_key"): ("error", 5),
        ("n_not_null", "not_null"): ("error", 1),
        ("positive", "check"): ("error", 2),
        ("unique_name", "unique"): ("error", 2),
        ("unique_name", "nullable_unique"): ("warning", 2),
        ("fk_n", "foreign_key"): ("error", 4),
    }


def test_report_groups_keys_of_bounded_parts(spark, monkeypatch):
    """Rows beyond the bound are dealt out before their keys are grouped, without columns that no key needs."""
    spec = TableSpec(
        "t", (Column("id", "bigint", False), Column("up", "bigint"), Column("wide", "string")), ("id",),
        foreign_keys=(ForeignKey(("up",), "t", ("id",)),),
    )
    rows = spark.range(90).selectExpr("id DIV 2 * 2 AS id", "id + 1 AS up", "repeat('x', 50) AS wide")
    monkeypatch.setattr(op, "GROUPED_ROWS", 20)
    report = op.constraint_report({"t": rows}, [spec])
    assert {(r.kind, r.violations) for r in report.collect()} == {("primary_key", 90), ("foreign_key", 46)}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 5, true" in plan and "repeat" not in plan
