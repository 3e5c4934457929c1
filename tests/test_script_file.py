"""Scripts of one text: sections carried over splits and files, statements read by column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from keelson import Column, ForeignKey, TableSpec
from keelson.plans.durable import fresh_path
from keelson.sources import script

NOTES = TableSpec("notes", (Column("id", "bigint", False), Column("body", "string"), Column('odd"name', "string")), ("id",))
EMPTY = TableSpec("nothing", (Column("id", "bigint", False),), ("id",))
TREE = TableSpec(
    "tree", (Column("id", "bigint", False), Column("up", "bigint")), ("id",), foreign_keys=(ForeignKey(("up",), "tree", ("id",)),)
)
PIECES = ["it's", "'", "''", ";\n", "\n\n", "\n-- Table: public.tree (9 rows)\n", "-- Sequence: x", "NULL", "(1, 2)", ",", " ", "\\", "é\r", "INSERT INTO", '"']


def rows():
    rng = random.Random(11)
    return [(k, None if k % 9 == 0 else "".join(rng.choices(PIECES, k=rng.randint(0, 9))), rng.choice(["", None, "x"])) for k in range(300)]


@pytest.fixture(scope="module")
def written_script(spark):
    out = fresh_path(spark, "script-file")
    notes = spark.createDataFrame(rows(), NOTES.struct())
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 3)], TREE.struct())
    frames = {NOTES.name: notes, EMPTY.name: notes.select("id").filter("false"), TREE.name: tree}
    script.write_script(frames, [NOTES, EMPTY, TREE], out, batch=7, sequences={"public.ids": 41, "other": -2}, schema_sql="CREATE TABLE a (b STRING);\n-- that's it")
    return out


@pytest.mark.parametrize("split", ["128m", "300"])
def test_everything_comes_back(spark, written_script, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = script.read_script(spark, written_script, [TREE, NOTES, EMPTY])
        assert sorted(tuple(r) for r in got.tables[NOTES.name].good.collect()) == sorted(rows())
        assert sorted(tuple(r) for r in got.tables[TREE.name].good.collect()) == [(1, None), (2, None), (3, None)]
        assert sorted(tuple(r) for r in got.patches[TREE.name].good.collect()) == [(2, 1), (3, 3)]
        assert got.tables[EMPTY.name].good.collect() == []
        assert {tuple(r) for r in got.sections.collect()} == {(NOTES.name, 300, 300, 0), (EMPTY.name, 0, 0, 0), (TREE.name, 3, 3, 0)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got.sequences == {"public.ids": 41, "other": -2}
    assert got.header["schema"] == "CREATE TABLE a (b STRING);\n-- that's it"


HEAD = "-- keelson data dump\n-- version: 1\n-- created_at: 2024-01-01T00:00:00Z\n-- tables: public.tree\n-- BEGIN SCHEMA\n-- END SCHEMA\n"
ONE = '\n-- Table: public.tree (1 rows)\n\nINSERT INTO "public"."tree" ("id", "up") VALUES\n(\'1\', NULL);\n'


@pytest.mark.parametrize(
    "text,error",
    [
        ("", "empty script"),
        ("-- other\n" + HEAD, "missing header marker"),
        (HEAD.replace("version: 1", "version: one") + ONE, "invalid version"),
        (HEAD.replace("-- created_at", "-- made"), "expected a line"),
        (HEAD.split("-- BEGIN")[0] + ONE, "missing schema block"),
        (HEAD.split("-- END")[0] + ONE, "does not end"),
        (HEAD + ONE.replace("1 rows", "one rows"), "invalid row count"),
        (HEAD + ONE.replace("1 rows", "2 rows"), "2 rows announced, 1 read"),
        (HEAD + ONE.replace("NULL)", "NULL"), "1 statements unread"),
        (HEAD + ONE.replace("'1'", "'1"), "does not end"),
        (HEAD, "has no section"),
        (HEAD + ONE + "\n-- Sequence: s\nSELECT 1;\n", "invalid sequence value"),
        (HEAD + ONE + "\n-- Sequence: s\n", "no value"),
    ],
)
def test_errors_of_a_script(spark, tmp_path, text, error):
    (tmp_path / "dump.sql").write_text(text)
    with pytest.raises(script.ScriptError, match=error):
        script.read_script(spark, str(tmp_path / "dump.sql"), [TREE])


def test_plain_layout_with_blank_lines_and_no_last_semicolon(spark, tmp_path):
    text = HEAD + ONE.replace("1 rows", "2 rows") + '\n\nINSERT INTO "public"."tree" ("up", "id") VALUES ( \'1\' ,\n \'5\' )\n\n-- Sequence: s\n\nSELECT setval(\'s\', 7);'
    (tmp_path / "dump.sql").write_text(text)
    got = script.read_script(spark, str(tmp_path / "dump.sql"), [TREE])
    assert sorted(tuple(r) for r in got.tables[TREE.name].good.collect()) == [(1, None), (5, 1)] and got.sequences == {"s": 7}


def test_statements_stay_in_the_jvm_and_do_not_recurse(spark, written_script):
    plan = script.read_script(spark, written_script, [NOTES]).tables[NOTES.name].good
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString() and "MapIn" not in plan._jdf.queryExecution().executedPlan().toString()
    long = "a''b" * 500_000
    body = f"INSERT INTO \"public\".\"notes\" (\"id\", \"body\") VALUES ('1', '{long}'), " + ", ".join(f"('{k}', NULL)" for k in range(2, 50_000))
    one = spark.createDataFrame([(body,)], "statement string").select(script.statement_rows(F.col("statement")).alias("r"))
    got = one.select(F.size("r.rows").alias("n"), F.length(F.col("r.rows")[0][1]).alias("m")).first()
    assert tuple(got) == (49_999, len(long) - 500_000)


def test_a_script_is_written_without_copies(spark, tmp_path, monkeypatch):
    """The text itself is all that is written; rows are announced as many as there are."""
    labels, copy = [], script.written
    monkeypatch.setattr(script, "written", lambda df, label, *how: (labels.append(label), copy(df, label, *how))[1])
    rows = spark.range(250).selectExpr("id", "id - 1 AS parent", "'a;\n\n' AS note")
    spec = TableSpec("few", (Column("id", "bigint", False), Column("parent", "bigint"), Column("note", "string")), ("id",))
    out = str(tmp_path / "script")
    script.write_script({spec.name: rows}, [spec], out)
    assert labels == []
    got = script.read_script(spark, out, [spec])
    assert [(r.announced, r.rows) for r in got.sections.collect()] == [(250, 250)]
    assert got.tables[spec.name].good.exceptAll(rows).isEmpty()
