"""Deep and wide dependency graphs: levels, cycles and the number of rounds."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import graph


@pytest.fixture
def rounds(monkeypatch):
    """Counts the intermediate tables, of which a round has one."""
    seen, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (seen.append(1), cut(df))[1])
    return seen


def _levels(nodes, pairs):
    parents = {n: {p for c, p in pairs if c == n and p != n} for n in nodes}
    out = {}
    while len(out) < len(nodes):
        ready = [n for n in nodes if n not in out and all(p in out for p in parents[n])]
        out |= {n: max([out[p] + 1 for p in parents[n]], default=0) for n in ready}
    return out


def test_long_chain_takes_few_rounds(spark, rounds):
    nodes = spark.range(2000).withColumnRenamed("id", "node")
    edges = nodes.filter("node > 0").select(F.col("node").alias("child"), (F.col("node") - 1).alias("parent"))
    got = graph.dependency_levels(nodes, edges)
    assert got.filter("level <> node").isEmpty() and got.count() == 2000
    assert len(rounds) < 40


def test_long_ladder_with_shortcuts_to_the_top(spark, rounds):
    nodes = spark.range(64).withColumnRenamed("id", "node")
    rung = nodes.filter("node > 0").select(F.col("node").alias("child"), (F.col("node") - 1).alias("parent"))
    top = nodes.filter("node > 0").select(F.col("node").alias("child"), F.lit(0).cast("long").alias("parent"))
    assert graph.dependency_levels(nodes, rung.union(top)).filter("level <> node").isEmpty()
    assert len(rounds) < 40


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    nodes = list(range(16))
    pairs = [(c, draw.randrange(c)) for c in nodes[1:] for _ in range(draw.choice([0, 1, 1, 1, 2, 3]))]
    frame = spark.createDataFrame([(n,) for n in nodes], "node int")
    got = graph.dependency_levels(frame, spark.createDataFrame(pairs, "child int, parent int"))
    assert {r.node: r.level for r in got.collect()} == _levels(nodes, pairs)


def test_long_cycle_between_chains(spark, rounds):
    """A chain into a cycle of 40 nodes, and a chain out of it: only the cycle is named."""
    nodes = spark.range(60).withColumnRenamed("id", "node")
    edges = nodes.filter("node > 0").select(F.col("node").alias("child"), (F.col("node") - 1).alias("parent"))
    edges = edges.union(spark.sql("SELECT 10L AS child, 49L AS parent"))
    with pytest.raises(graph.CycleError) as e:
        graph.dependency_levels(nodes, edges)
    assert "10; the 40 members are in" in str(e.value) and e.value.members == list(range(10, 50))
    assert len(rounds) < 150


def test_no_edges_and_no_nodes(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("a",)], "node string")
    none = spark.createDataFrame([], "child string, parent string")
    assert sorted(map(tuple, graph.dependency_levels(nodes, none).collect())) == [("a", 0), ("b", 0)]
    assert graph.dependency_levels(nodes.limit(0), none).isEmpty()
    assert graph.dependency_cycles(nodes, none).isEmpty()


def test_searches_end_when_only_circles_are_left(spark, rounds):
    """A thousand circles of four: no search goes on for as many rounds as a chain of all nodes would take."""
    nodes = spark.range(4000).withColumnRenamed("id", "node")
    edges = nodes.select("node", F.expr("node - node % 4 + (node + 1) % 4").alias("root"), F.lit(1).cast("long").alias("d"))
    got = graph._followed(edges)
    assert got.count() == 4000 and got.filter("node <> root OR d <> 0").isEmpty() and len(rounds) <= 4
    rounds.clear()
    graph._with_shortcuts(edges.selectExpr("root AS source", "node AS target"))
    assert len(rounds) <= 7


def test_shortcuts_cross_a_long_circle(spark, rounds):
    nodes = spark.range(500).withColumnRenamed("id", "node")
    edges = nodes.selectExpr("node AS child", "(node + 499) % 500 AS parent")
    assert graph.dependency_cycles(nodes, edges).count() == 500
    assert len(rounds) < 70


def test_rounds_do_not_add_up_partitions(spark):
    rows = graph.cut(spark.range(64).repartition(8))
    for _ in range(4):
        rows = graph.cut(rows.union(rows.filter("id < 0")))
    assert rows.rdd.getNumPartitions() <= 16 and rows.count() == 64
