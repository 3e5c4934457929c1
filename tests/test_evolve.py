import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators import dictionary as dic
from keelson.operators import evolve as op
from keelson.specs import Check, Column, TableSpec, Unique, type_change_needs_rewrite


@pytest.mark.parametrize("old,new,rewrite", [
    ("int", "bigint", False), ("float", "double", False), ("varchar(100)", "varchar(200)", False),
    ("varchar(100)", "string", False), ("decimal(10,2)", "decimal(15,4)", False),
    ("bigint", "int", True), ("varchar(200)", "varchar(100)", True), ("string", "varchar(100)", True),
    ("decimal(15,4)", "decimal(10,2)", True), ("int", "string", True),
    ("decimal(38,18)", "decimal(10,2)", True), ("decimal(10,2)", "decimal(10,4)", True),
])
def test_type_changes(spark, old, new, rewrite):
    of = T.DataType.fromDDL
    assert type_change_needs_rewrite(of(old), of(new)) is rewrite


@pytest.fixture
def stock(spark):
    df = spark.createDataFrame([(1, 10), (2, 4)], "id bigint, quantity bigint")
    return df, TableSpec("stock", (Column("id", "bigint", False), Column("quantity", "bigint")), ("id",))


def test_add_column(spark, stock):
    df, _ = stock
    assert op.add_column(df, "x", "int").filter("x IS NULL").count() == 2
    assert op.add_column(df, "x", "int", "7", True).filter("x = 7").count() == 2
    with pytest.raises(op.EvolutionError, match="NOT NULL"):
        op.add_column(df, "x", "int", not_null=True)
    assert op.add_column(df.filter("id > 9"), "x", "int", not_null=True).columns[-1] == "x"


def test_inventory_scenario_builds_inputs_first(stock):
    df, spec = stock
    out = op.evolve_table(df, spec, [
        op.AddColumn(Column("available", "bigint", computed="quantity - committed")),
        op.AddColumn(Column("committed", "bigint", False, default="0")),
    ])
    assert [tuple(r) for r in out.good.orderBy("id").collect()] == [(1, 10, 0, 10), (2, 4, 0, 4)]
    assert out.bad.isEmpty() and [c.name for c in out.spec.columns] == ["id", "quantity", "committed", "available"]


def test_all_problems_at_once(stock):
    df, spec = stock
    with pytest.raises(op.EvolutionError) as e:
        op.evolve_table(df, spec, [
            op.AddColumn(Column("quantity", "int")), op.AddColumn(Column("n", "int", False)), op.DropColumn("nope"), op.DropColumn("id"),
        ])
    assert len(e.value.problems) == 4


def test_rows_that_do_not_fit_keep_their_old_shape(spark):
    df = spark.createDataFrame([(1, "12", None), (2, "x", "a"), (3, "300", "b"), (4, None, "c")], "id int, v string, w string")
    spec = TableSpec("t", (Column("id", "int"), Column("v", "string"), Column("w", "string")), ("id",))
    out = op.evolve_table(df, spec, [op.ChangeType("v", "tinyint"), op.SetNotNull("w")])
    assert [tuple(r) for r in out.good.collect()] == [(4, None, "c")]
    assert sorted(map(tuple, out.bad.collect())) == [(1, "12", None), (2, "x", "a"), (3, "300", "b")]


def test_drop_takes_constraints_with_it(spark):
    df = spark.createDataFrame([(1, 5, 6, 7)], "id int, age int, min_age int, max_age int")
    cols = tuple(Column(c, "int") for c in df.columns)
    spec = TableSpec("t", cols, ("id",), (Unique(("age",)), Unique(("max_age",), "age IS NOT NULL")),
                     (Check("adult", "age > 0"), Check("span", "min_age < max_age"), Check("text", "max_age <> 'age'")))
    out = op.drop_column(df, spec, "age")
    assert out.constraints == ("unique_age", "adult") and out.partial_uniques == ("unique_max_age",)
    assert [c.name for c in out.spec.checks] == ["span", "text"]
    assert op.drop_column(df, spec, "min_age").constraints == ("span",)


def test_rewrite_raise_and_quarantine(spark):
    df = spark.createDataFrame([(1, 1.235), (2, 1e9), (3, None)], "id int, p double")
    split = op.rewrite_column(df, "p", "decimal(6,2)", on_error="quarantine")
    assert {r.id: str(r.p) for r in split.good.collect()} == {1: "1.24", 3: "None"}
    assert [r.id for r in split.bad.collect()] == [2]
    with pytest.raises(Exception, match="does not fit"):
        op.rewrite_column(df, "p", "decimal(6,2)").collect()
    words = spark.createDataFrame([("abc",), ("abcd",)], "w string")
    assert op.rewrite_column(words, "w", "varchar(3)", on_error="quarantine").bad.first().w == "abcd"


def test_touch_only_changed_rows(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "c", 5)], "id int, v string, at int")
    got = {r.id: r.at for r in op.touch_on_update(old, new, ["id"], "at", "99").collect()}
    assert got == {1: 0, 2: 99, 3: 5}


@pytest.mark.parametrize("target,severity", [
    ((), None), ((Column("x", "int", False),), "error"), ((Column("x", "int"),), "warning"),
    ((Column("x", "int", False, default="1"),), "warning"), ((Column("x", "int", computed="1"),), None),
])
def test_conformance(spark, target, severity):
    shape = spark.createDataFrame([], "id bigint, name string").schema
    base = (Column("id", "bigint", False), Column("name", "string"))
    found = [i.severity for i in op.conform_issues(shape, TableSpec("t", base + target))]
    assert found == ([severity] if severity else [])
    assert op.conform_issues(shape, None, "t")[0].severity == "error"
    assert op.conform_issues(shape, TableSpec("t", base[:1]))[0].severity == "error"
    changed = TableSpec("t", (base[0], Column("name", "bigint")))
    assert [i.severity for i in op.conform_issues(shape, changed)] == ["warning"]


def test_conform_keeps_explicit_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, name string")
    spec = TableSpec("t", (Column("id", "bigint"), Column("name", "string", default="'d'"), Column("tag", "string", default="'d'")))
    assert sorted(map(tuple, op.conform_to_target(df, spec).good.collect())) == [(1, None, "d"), (2, "x", "d")]
    with pytest.raises(op.EvolutionError):
        op.conform_to_target(df.withColumn("extra", F.lit(1)), spec)


def test_expiry_set_changed_and_off(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-03-01' - make_dt_interval(CAST(id * 10 AS int)) AS at FROM range(5)")
    df = df.unionByName(spark.sql("SELECT 9L AS id, CAST(NULL AS timestamp_ntz) AS at"))
    now = F.expr("timestamp_ntz'2024-03-01'")
    alive = lambda **kw: sorted(r.id for r in op.expire_rows(df, "at", now=now, **kw).collect())
    assert alive(after="30 days") == [0, 1, 2, 9]
    assert alive(after="7 days") == [0, 9]
    assert alive() == [0, 1, 2, 3, 4, 9]


def labels(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, ordinal int")


def test_dictionary_moves_through_text(spark):
    jobs = spark.createDataFrame([(1, "email"), (2, "fax"), (3, None)], "id int, target string")
    out = dic.retarget_dictionary(jobs, "target", labels(spark, "email", "sms", "push"))
    assert {r.id: r.target for r in out.good.collect()} == {1: "email", 3: None}
    assert [r.id for r in out.bad.collect()] == [2]
    use = dic.dictionary_usage(jobs, "target", labels(spark, "email", "fax", "old"), labels(spark, "push", "email"))
    assert {r.label: (r.status, r.n_rows) for r in use.collect()} == {
        "email": ("kept", 1), "fax": ("removed", 1), "old": ("removed", 0), "push": ("added", 0)}
    same = dic.dictionary_usage(jobs, "target", labels(spark, "email", "fax"), labels(spark, "fax", "email"))
    assert {r.status for r in same.collect()} == {"kept"}


@pytest.mark.parametrize("new,renamed", [
    ([("public", "kind2", ["refund", "exchange"])], True),
    ([("public", "kind2", ["exchange", "refund"])], False),
    ([("public", "kind2", ["refund", "exchange", "push"])], False),
    ([("other", "kind2", ["refund", "exchange"])], False),
    ([("public", "kind2", ["refund", "exchange"]), ("public", "kind3", ["refund", "exchange"])], False),
    ([("public", "kind2", ["refund", "exchange"]), ("public", "kind", ["refund", "exchange"])], False),
])
def test_dictionary_renames(spark, new, renamed):
    def frame(dicts):
        rows = [(s, d, 10 * i + 3, x) for s, d, xs in dicts for i, x in enumerate(xs)]
        return spark.createDataFrame(rows, "schema string, dictionary string, ordinal int, label string")

    def usage(schema, d):
        return spark.createDataFrame([("returns", "kind", schema, d)], "table string, column string, schema string, dictionary string")

    old = frame([("public", "kind", ["refund", "exchange"])])
    got = dic.detect_dictionary_renames(old, frame(new), usage("public", "kind"), usage("public", "kind2"))
    assert got.count() == int(renamed)
    unused = dic.detect_dictionary_renames(old, frame(new), usage("public", "x"), usage("public", "y"))
    assert unused.isEmpty()
