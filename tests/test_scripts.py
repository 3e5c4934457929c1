import datetime

import pytest
from pyspark.sql import functions as F

from keelson.functions import text as fx
from keelson.operators import scripts as op


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_spelling(spark):
    assert apply(spark, fx.pascal_case, ["user_status", "UserStatus", "some_kebab-case_mix", "For Sale", "", "éa_b2"]) == [
        "UserStatus", "Userstatus", "SomeKebabCaseMix", "ForSale", "", "ÉaB2"]
    assert apply(spark, fx.safe_name, ["add//users--table", "/ - /", "/add_users", "a__b"]) == ["add_users_table", "", "add_users", "a__b"]
    assert apply(spark, fx.quote_literal, [None, "hello", "it's", "42", ""]) == ["NULL", "'hello'", "'it''s'", "'42'", "''"]
    assert apply(spark, fx.kebab_case, ["a_b_c"]) == ["a-b-c"]
    assert apply(spark, fx.single_spaced, [" a \n\t b "]) == ["a b"]
    assert fx.quote_table('my.ta"b.le') == '"my"."ta""b.le"'


@pytest.mark.parametrize("text,days", [("7d", 7), ("2w", 14), ("3m", 90), ("720h", 30)])
def test_durations(text, days):
    assert op.parse_duration(text) == datetime.timedelta(days=days)


def test_other_durations():
    assert op.parse_duration("1h30s") == datetime.timedelta(seconds=3630)
    assert op.parse_duration("1.5h") == datetime.timedelta(minutes=90)
    for bad in ("", "abcd", "xw", "1h30m", "5", "h"):
        with pytest.raises(ValueError):
            op.parse_duration(bad)


def test_older_than(spark):
    names = ["20240101000000_a", "20240110000000_b", "20240109235959", "2024", "20241301000000_x", "20240101000060_y", "abc", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = op.older_than(df, "name", "7d", datetime.datetime(2024, 1, 17))
    assert sorted(r.name for r in got.collect()) == ["20240101000000_a", "20240109235959"]


def headers(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return op.parse_script_headers(df, "t").orderBy("i").collect()


def test_headers(spark):
    rows = headers(
        spark,
        "-- keelson:mode=sync\nSELECT 1;",
        "-- keelson:mode=async,depends_on=a;b,squash=true,sig=abc\nx",
        "-- keelson:mode=sync",
        "SELECT 1;\n-- keelson:mode=sync",
        "-- keelson:mode=sync,sig=a=b\n",
        "",
    )
    assert [(r.mode, r.depends_on, r.squash, r.sig, r.body) for r in rows] == [
        ("sync", None, False, None, "SELECT 1;"),
        ("async", ["a", "b"], True, "abc", "x"),
        ("sync", None, False, None, ""),
        (None, None, None, None, "SELECT 1;\n-- keelson:mode=sync"),
        ("sync", None, False, "a=b", ""),
        (None, None, None, None, ""),
    ]
    assert all(r.error is None for r in rows)


def test_bad_headers(spark):
    rows = headers(spark, *[f"-- keelson:{h}\nb" for h in ("mode=later", "depends_on=a", "mode=sync,color=red", "mode=sync,depends_on=", "mode=sync,squash=no", "mode=sync,sig=", "mode", "")])
    assert all(r.error and r.mode is None and r.body == "b" for r in rows)


def test_signature_survives_formatting_not_edits(spark):
    lit = F.lit
    deps = F.array(lit("b"), lit("a"))
    sign = lambda body: op.signature(lit("sync"), deps, lit(False), lit(body))
    df = spark.range(1).select(sign("a  b\n").alias("x"), sign("a b").alias("y"), sign("a c").alias("z"))
    r = df.first()
    assert r.x == r.y != r.z and len(r.x) == 12
    head = op.render_header(lit("sync"), deps, lit(True), lit("s"))
    text = spark.range(1).select(op.replace_header(lit("-- keelson:old\nbody"), head)).first()[0]
    assert text == "-- keelson:mode=sync,depends_on=b;a,squash=true,sig=s\nbody"


def test_waivers_stop_at_code(spark):
    text = "\n-- note\n-- keelson:lint-disable=r1 because\n-- keelson:lint-disable=r2:t1.c1\n-- keelson:lint-disable=\n-- keelson:lint-disable=r3:zz\nCREATE;\n-- keelson:lint-disable=late"
    scripts = spark.createDataFrame([("f", text)], "file string, text string")
    tables = spark.createDataFrame([("f", "public.t1"), ("f", "public.t2"), ("g", "public.zz")], "file string, table string")
    got = sorted(map(tuple, op.extract_waivers(scripts, "file", "text", tables).collect()), key=repr)
    assert got == [("r1", "public.t1", None), ("r1", "public.t2", None), ("r2", "public.t1", "c1")]


def test_normalised_labels(spark):
    df = spark.createDataFrame([("a b",), ("a-b",), ("a b",), ("c",)], "v string")
    got = {r.label: (r.canonical, r.n_rows, r.collides) for r in op.normalize_labels(df, "v", "safe").collect()}
    assert got == {"a b": ("a_b", 2, True), "a-b": ("a_b", 1, True), "c": ("c", 1, False)}
