import pytest
from pyspark.sql import functions as F

from keelson.operators import graph, stats
from keelson.operators.evolve import EvolutionError
from keelson.plans.durable import fresh_path
from keelson.sources import bundle, script
from keelson.specs import Column, ForeignKey, TableSpec

USERS = TableSpec("users", (Column("id", "bigint", False), Column("name", "string", False)), ("id",))
POSTS = TableSpec("posts", (Column("id", "bigint", False), Column("user_id", "bigint"), Column("title", "string")), ("id",),
                  foreign_keys=(ForeignKey(("user_id",), "users", ("id",)),))
CATEGORIES = TableSpec("categories", (Column("id", "bigint", False), Column("name", "string", False), Column("parent_id", "bigint")),
                       ("id",), foreign_keys=(ForeignKey(("parent_id",), "public.categories", ("id",)),))


@pytest.fixture
def tables(spark):
    return {
        "users": spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id bigint, name string"),
        "posts": spark.createDataFrame([(1, 2, "Hi")], "id bigint, user_id bigint, title string"),
        "categories": spark.createDataFrame([(1, "Root", None), (2, "Child", 1), (3, "Grandchild", 2)], "id bigint, name string, parent_id bigint"),
    }


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_export_and_restore_is_the_identity(spark, tables):
    out, target = fresh_path(spark, "t"), fresh_path(spark, "t")
    specs = [POSTS, CATEGORIES, USERS]
    manifest = bundle.export_database(tables, specs, out, {"users_id_seq": (tables["users"], "id"), "none": (tables["posts"].filter("false"), "id")})
    assert [e["table"] for e in manifest["tables"]] == ["public.categories", "public.users", "public.posts"]
    assert manifest["sequences"] == {"users_id_seq": 2}
    assert rows(spark.read.parquet(f"{out}/data/public.categories").filter("parent_id IS NOT NULL")) == []
    dry = bundle.load_database(spark, out, target, specs, "dry-run")
    assert (dry.tables, dry.rows) == (3, 6)
    result = bundle.load_database(spark, out, target, specs, "create")
    assert (result.tables, result.rows) == (3, 6)
    for name, df in tables.items():
        assert rows(spark.read.parquet(f"{target}/public.{name}")) == rows(df), name
    assert all(df.isEmpty() for df in result.fk_violations.values())
    with pytest.raises(Exception):
        bundle.load_database(spark, out, target, specs, "create")


def test_truncate_first_and_empty_tables(spark, tables):
    out, target = fresh_path(spark, "t") + ".gz", fresh_path(spark, "t")
    spark.createDataFrame([(99, "PreExisting")], "id bigint, name string").write.parquet(f"{target}/public.users")
    frames = {"users": tables["users"].limit(1), "posts": tables["posts"].filter("false")}
    bundle.export_database(frames, [USERS, POSTS], out)
    result = bundle.load_database(spark, out, target, [USERS, POSTS], "truncate")
    assert (result.tables, result.rows) == (1, 1)
    assert spark.read.parquet(f"{target}/public.users").count() == 1
    with pytest.raises(EvolutionError, match="references"):
        lone = fresh_path(spark, "t")
        bundle.export_database({"users": tables["users"]}, [USERS], lone)
        bundle.load_database(spark, lone, target, [USERS, POSTS], "truncate")


def test_conformance_errors_write_nothing(spark, tables):
    out, target = fresh_path(spark, "t"), fresh_path(spark, "t")
    bundle.export_database({"users": tables["users"]}, [USERS], out)
    strict = TableSpec("users", (*USERS.columns, Column("email", "string", False)), ("id",))
    with pytest.raises(EvolutionError):
        bundle.load_database(spark, out, target, [strict])
    assert not bundle._exists(spark, f"{target}/public.users", USERS)


def test_script_round_trip_with_awkward_values(spark):
    values = ["it's a test", None, "", "a;\nb", "'", "x';\n'y", "(1, 2),\n(3)", "NULL", "\\n", "ends;", "-- Table: t (3 rows)\n\nmore"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, val string")
    spec = TableSpec("data", (Column("id", "bigint", False), Column("val", "string")), ("id",))
    out = fresh_path(spark, "s")
    script.write_sql_dump({spec.name: df}, [spec], out, batch=4, schema_sql="CREATE TABLE data (id INT)", sequences={"s": 7})
    assert rows(script.read_sql_dump(spark, f"{out}/tables/*", spec).good.filter("val IS NOT NULL")) == rows(df.filter("val IS NOT NULL"))
    head = script.read_header(spark, out)
    assert head["rows"] == {"public.data": 11} and head["sequences"] == {"s": 7} and head["version"] == 1
    assert script.insert_statements(df, spec.name, ["id"], 4).count() == 3


def test_script_carries_every_type(spark):
    df = spark.sql(
        "SELECT id, CAST(concat('b;\n', id) AS binary) AS b, array(CAST(id / 3 AS float), NULL) AS a, map('k', id) AS m, "
        "struct(id AS p, 'x, (y)' AS q) AS s, timestamp_ntz'2024-01-01 01:02:03.000004' AS t, date'2024-02-29' AS d, "
        "id % 2 = 0 AS f, CAST(id AS decimal(20, 5)) AS c, id / 7 AS x, CAST(NULL AS array<int>) AS n, X'00FF' AS raw FROM range(5)"
    )
    spec = TableSpec("types", tuple(Column(f.name, f.dataType.simpleString()) for f in df.schema), ("id",))
    out = fresh_path(spark, "s")
    script.write_sql_dump({spec.name: df}, [spec], out, batch=2)
    got = script.read_sql_dump(spark, f"{out}/tables/*", spec)
    assert got.bad.isEmpty()
    assert sorted(map(repr, got.good.collect())) == sorted(map(repr, df.collect()))


def test_script_split_inside_a_value(spark):
    """Small file splits: statements and quoted values cross their borders."""
    df = spark.range(300).selectExpr("id", "repeat(concat('it''s;\n', id), 1 + CAST(id % 7 AS int)) AS val")
    spec = TableSpec("data", (Column("id", "bigint", False), Column("val", "string")), ("id",))
    out = fresh_path(spark, "s")
    script.write_sql_dump({spec.name: df.coalesce(1)}, [spec], out, batch=11)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        raw = spark.read.option("lineSep", ";\n").text(f"{out}/tables/*")
        assert raw.rdd.getNumPartitions() > 4
        assert rows(script.read_sql_dump(spark, f"{out}/tables/*", spec).good) == rows(df)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_script_cells_that_do_not_fit(spark):
    path = fresh_path(spark, "s")
    text = 'INSERT INTO "public"."t" ("id", "n") VALUES\n(\'1\', \'x\'),\n(2, NULL);\n\nINSERT INTO "public"."other" ("id") VALUES\n(\'9\');\n'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    spec = TableSpec("t", (Column("id", "bigint"), Column("n", "int")))
    out = script.read_sql_dump(spark, path, spec)
    assert rows(out.good) == [(2, None)] and rows(out.bad) == [("1", "x")] and out.unread.isEmpty()


@pytest.mark.parametrize("broken", [
    """INSERT INTO "public"."t" ("id", "n") VALUES\n('1', '2'),\n('3""",
    """INSERT INTO "public"."t" ("id", "n") VALUES\n('1', '2') x;\n""",
    """INSERT INTO "public"."t" ("id", "n") VALUES\n('1');\n""",
    """INSERT INTO "public"."t" ("id", "n") VALUES\n('1', '2'),;\n""",
])
def test_cut_or_malformed_statements_are_not_read(spark, broken):
    path = fresh_path(spark, "s")
    good = """INSERT INTO "public"."t" ("id", "n") VALUES\n('7', '8');\n"""
    spark.createDataFrame([(good + broken,)], "value string").coalesce(1).write.text(path)
    out = script.read_sql_dump(spark, path, TableSpec("t", (Column("id", "bigint"), Column("n", "int"))))
    assert rows(out.good) == [(7, 8)] and out.bad.isEmpty() and out.unread.count() == 1


def test_rows_announced_in_the_header_must_be_there(spark):
    spec = TableSpec("t", (Column("id", "bigint", False),), ("id",))
    out = fresh_path(spark, "s")
    script.write_sql_dump({spec.name: spark.range(5).toDF("id")}, [spec], out)
    assert script.read_dump(spark, out, [spec])[spec.name].good.count() == 5
    more = """INSERT INTO "public"."t" ("id") VALUES\n('9');"""
    spark.createDataFrame([(more,)], "value string").coalesce(1).write.mode("append").text(f"{out}/tables/public.t")
    with pytest.raises(script.ScriptError, match="5 rows announced, 6 read"):
        script.read_dump(spark, out, [spec])


def test_a_misfit_leaves_the_target_as_it_was(spark):
    a = TableSpec("a", (Column("x", "bigint", False),), ("x",))
    b = TableSpec("b", (Column("x", "bigint", False), Column("y", "string")), ("x",))
    empty = TableSpec("e", (Column("x", "bigint", False),), ("x",))
    out, target = fresh_path(spark, "export"), fresh_path(spark, "target")
    tables = {"a": spark.range(3).toDF("x"), "b": spark.sql("SELECT 1L AS x, 'long' AS y"), "e": spark.range(0).toDF("x")}
    bundle.export_database(tables, [a, b, empty], out, sequences={"s": (tables["a"], "x")})
    narrow = TableSpec("b", (Column("x", "bigint", False), Column("y", "varchar(2)")), ("x",))
    with pytest.raises(Exception, match="do not fit"):
        bundle.load_database(spark, out, target, [a, narrow, empty], "create")
    result = bundle.load_database(spark, out, target, [a, b, empty], "create")
    assert (result.tables, result.rows, result.sequences) == (2, 4, {"s": 2})
    assert spark.read.parquet(f"{target}/public.e").count() == 0
    ids = bundle.assign_ids(spark.range(2).toDF("k"), result.sequences["s"], ["k"], "x").collect()
    assert sorted(r.x for r in ids) == [3, 4]


@pytest.mark.parametrize("lines,message", [
    ([], "empty"), (["x"], "marker"), (["-- keelson data dump", "-- version: one"], "version"),
    (["-- keelson data dump", "-- version: 1", "-- created_at: now", "-- tables: a"], "schema"),
    (["-- keelson data dump", "-- version: 1", "-- created_at: now", "-- tables: a", "-- BEGIN SCHEMA", "-- END SCHEMA", "-- Table: a (x rows)"], "row count"),
])
def test_script_header_errors(lines, message):
    with pytest.raises(script.ScriptError, match=message):
        script.parse_header(lines)


def test_self_reference_patch(spark, tables):
    base, patch = bundle.export_self_ref(tables["categories"], ["id"], ["parent_id"])
    assert base.filter("parent_id IS NULL").count() == 3 and rows(patch) == [(2, 1), (3, 2)]
    assert rows(bundle.apply_patch(base, patch, ["id"]).fillna(0)) == rows(tables["categories"].fillna(0))
    with pytest.raises(ValueError, match="primary key"):
        bundle.export_self_ref(tables["categories"], [], ["parent_id"])
    updates = [r.statement for r in script.update_statements(patch, "public.categories", ["id"]).orderBy("id").collect()]
    assert updates[0] == """UPDATE "public"."categories" SET "parent_id" = '1' WHERE "id" = '2';"""


CASES = [
    (["users"], [], ["users"]), (["users", "products"], [], ["products", "users"]),
    (["comments", "posts", "users"], [("comments", "posts"), ("posts", "users")], ["users", "posts", "comments"]),
    (["d", "c", "b", "a"], [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], ["a", "b", "c", "d"]),
    (["categories"], [("categories", "categories")], ["categories"]),
    (["child1", "child2", "child3", "parent"], [("child1", "parent"), ("child2", "parent"), ("child3", "parent")], ["parent", "child1", "child2", "child3"]),
]


@pytest.mark.parametrize("names,edges,order", CASES)
def test_dependency_order(spark, names, edges, order):
    specs = [TableSpec(n, (Column("x", "int"),), foreign_keys=tuple(ForeignKey(("x",), p, ("x",)) for c, p in edges if c == n)) for n in names]
    assert graph.load_order(specs) == [f"public.{n}" for n in order]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    frame = spark.createDataFrame(edges + [("users", "unknown")], "child string, parent string")
    got = graph.dependency_levels(nodes, frame).orderBy("level", "node").collect()
    assert [r.node for r in got] == order


def test_cycles(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "e"), ("f", "f")], "child string, parent string")
    assert sorted(r.node for r in graph.dependency_cycles(nodes, edges).collect()) == ["a", "b", "c"]
    with pytest.raises(graph.CycleError) as e:
        graph.dependency_levels(nodes, edges)
    assert e.value.members == ["a", "b", "c"]
    assert graph.dependency_cycles(nodes, edges.filter("child <> 'c'")).isEmpty()


def test_nodes_between_cycles_are_on_none(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "a"), ("e", "c"), ("d", "e"), ("e", "d"), ("z", "d"), ("b", "y")]
    nodes = spark.createDataFrame([(n,) for n in "abcdeyz"], "node string")
    edges = spark.createDataFrame(pairs, "child string, parent string")
    assert sorted(r.node for r in graph.dependency_cycles(nodes, edges).collect()) == ["a", "b", "d", "e"]
    with pytest.raises(graph.CycleError) as e:
        graph.dependency_levels(nodes, edges)
    assert e.value.members == ["a", "b"]


ROUTED = [(k, t, "sync" if t == "small_table" else "async") for k in stats.EXPENSIVE for t in ("posts", "small_table")] + [
    ("create_table", "posts", "sync"), ("add_unique", "posts", "sync"), ("add_check_not_valid", "posts", "sync"),
    ("insert_values", "posts", "sync"), ("update", "unknown", "sync"),
]


def test_routing(spark):
    ops = [(i, t, k) for i, (k, t, _) in enumerate(ROUTED)] + [(999, "posts", "create_table"), (999, "users", "update"), (999, "small_table", "update")]
    frame = spark.createDataFrame(ops, "job int, table string, kind string")
    sizes = spark.createDataFrame([("public.posts", 15_000_000, True), ("public.users", 500_000, True), ("public.small_table", 50, False)],
                                  "table string, rows bigint, large boolean")
    got = {r.job: r.mode for r in stats.route_operations(frame, sizes).collect()}
    assert got == {i: m for i, (_, _, m) in enumerate(ROUTED)} | {999: "async"}
    reasons = [r.reason for r in stats.route_reasons(frame, sizes).filter("job = 999").collect()]
    assert reasons == ["UPDATE on large table public.users"]
    assert {r.mode for r in stats.route_operations(frame, sizes.limit(0)).collect()} == {"sync"}


def test_sizes(spark, tables):
    got = stats.table_sizes(tables | {"pg_catalog.x": tables["users"]}, 3).collect()
    assert [(r.table, r.rows, r.large) for r in got] == [("public.categories", 3, True), ("public.users", 2, False), ("public.posts", 1, False)]
    assert not stats.table_sizes(tables, 0).filter("large").count()


def test_ids_continue(spark):
    df = spark.createDataFrame([(c,) for c in "dacb"], "v string")
    got = bundle.assign_ids(df, 41, ["v"], "id", chunk=F.ascii("v")).orderBy("v").collect()
    assert [r.id for r in got] == [42, 43, 44, 45]
