"""Dependency order of nodes, for rows and for the few tables of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.plans.durable import fresh_path, written
from keelson.specs import TableSpec, qualified


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which ends its lineage and its plan.

    A checkpoint hands the constraints of its plan on to the next one: round by round they grow until the
    optimizer is busy with nothing else. It also keeps the partitions, which every union adds up.
    """
    return written(df, "graph")


class CycleError(ValueError):
    """``members`` are the nodes of a cycle. Those of a table are not gathered for the message: they are
    in the shared folder, at ``path``, and only read when ``members`` is asked for."""

    def __init__(self, members: list | DataFrame, path: str | None = None):
        if isinstance(members, DataFrame):
            n, least = members.agg(F.count(F.lit(1)), F.min("node")).first()
            text = f"dependency cycle through {least}; the {n} members are in {path}"
        else:
            text = "dependency cycle through " + ", ".join(map(str, members))
        super().__init__(text)
        self._members, self.path = members, path

    @property
    def members(self) -> list:
        if isinstance(self._members, DataFrame):
            return [r[0] for r in self._members.orderBy("node").toLocalIterator()]
        return self._members


def _pending(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with a NULL parent, plus one row per real edge between known nodes."""
    names = nodes.select("node").distinct()
    real = (
        edges.filter("child <> parent")
        .select(F.col("child").alias("node"), "parent")
        .distinct()
        .join(names, "node", "left_semi")
        .join(names.select(F.col("node").alias("parent")), "parent", "left_semi")
    )
    return names.select("node", F.lit(None).cast(names.schema["node"].dataType).alias("parent")).unionByName(
        real.select("node", "parent")
    )


def _followed(pointers: DataFrame) -> DataFrame:
    """``node, root, d``: every pointer followed to its end, with the steps on the way summed.

    Pointers double their reach in every round, so a chain of n nodes takes log2(n) rounds. An end is
    a root that has no pointer itself, or NULL. Who runs in a circle points at itself in the end.
    Where an open node has an end, one on its way is just near enough to find it in the next round:
    a round that finds no end leaves only circles and what leads into them.
    """
    way = ["node", "root", "d"]
    every = cut(pointers.select(*way, F.col("root").isNotNull().alias("open")))
    before, left = None, every.filter("open").count()
    while left != before:
        if not left:
            return every.select(*way)
        ends = every.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("d").alias("more"), F.lit(True).alias("met"))
        moved = every.filter("open").join(ends, "root", "left").select(
            "node", F.when(F.col("met"), F.col("next")).otherwise(F.col("root")).alias("root"),
            (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"),
            (F.col("met").isNotNull() & F.col("next").isNotNull()).alias("open"),
        )
        every = cut(every.filter("NOT open").unionByName(moved))
        before, left = left, every.filter("open").count()
    ring = every.filter("open").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("d"))
    return cut(every.filter("NOT open").select(*way).unionByName(ring))


def _needed(rows: DataFrame) -> DataFrame:
    """``node, parent, w, n``: the longest way per parent, and from how many parents a level comes.

    A NULL parent stands for level 0. It says nothing where another parent is at least as far away.
    """
    longest = rows.groupBy("node", "parent").agg(F.max("w").alias("w"))
    w, real = F.col("w"), F.col("parent").isNotNull()
    per_node = longest.groupBy("node").agg(
        F.count("parent").alias("reals"), F.max(F.when(real, w)).alias("far"), F.max(F.when(~real, w)).alias("base")
    )
    based = F.coalesce((F.col("far").isNull() & F.col("base").isNotNull()) | (F.col("base") > F.col("far")), F.lit(False))
    counts = per_node.select("node", based.alias("based"), (F.col("reals") + based.cast("long")).alias("n"))
    return longest.join(counts, "node").filter(F.col("parent").isNotNull() | F.col("based")).drop("based")


def _levels(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, level)`` of the nodes that have one, and what is pending for the others.

    Nodes with one parent hang together in trees. They are contracted into pointers to the
    next node with several parents, however long the chain; then those nodes see each other
    directly, and some have a single parent now. A round settles at least the nodes that have only
    chains above them, usually many levels at once.
    """
    spark = pending.sparkSession
    pending, path, step = cut(pending), fresh_path(pending.sparkSession, "levels"), 0
    edges = pending.filter("parent IS NOT NULL")
    below = cut(edges.select("node").distinct())
    tops = pending.select("node").distinct().join(below, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level"))
    one = F.lit(1).cast("long").alias("w")
    inner = edges.join(below.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent", one)
    first = edges.join(below.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node").distinct()
    rows = inner.unionByName(first.select("node", F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), one))
    shape = None
    while True:
        rows = cut(_needed(rows))
        lone = rows.filter("n = 1").select("node", F.col("parent").alias("root"), F.col("w").alias("d"))
        if lone.isEmpty():
            break
        ends = _followed(lone)
        shape = ends.schema
        ends.write.parquet(f"{path}/step={step}")
        step += 1
        many = rows.filter("n > 1").drop("n")
        there = ends.select(F.col("node").alias("parent"), F.col("root").alias("next"), F.col("d").alias("more"), F.lit(True).alias("met"))
        moved = many.filter("parent IS NOT NULL").join(there, "parent", "left").select(
            "node", F.when(F.col("met"), F.col("next")).otherwise(F.col("parent")).alias("parent"),
            (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
        )
        rows = moved.unionByName(many.filter("parent IS NULL"))
    if shape is None:
        found = tops
    else:
        parts = spark.read.schema(shape).parquet(*[f"{path}/step={k}" for k in range(step)])
        found = tops.unionByName(_followed(parts).filter("root IS NULL").select("node", F.col("d").alias("level")))
    found = cut(found)
    stuck = cut(below.join(found, "node", "left_anti"))
    waiting = pending.join(stuck, "node", "left_semi")
    held = waiting.filter("parent IS NOT NULL").join(stuck.withColumnRenamed("node", "parent"), "parent", "left_semi")
    return found, cut(held.select("node", "parent").unionByName(waiting.filter("parent IS NULL").select("node", "parent")))


def _with_shortcuts(edges: DataFrame) -> DataFrame:
    """``edges`` and, along chains of nodes with a single source, edges over 2, 4, 8, ... nodes.

    Whatever passes along the edges then crosses a chain of n nodes in log2(n) rounds. A round in which no
    chain ends and no stretch gets a smaller least node is the last: every node then has the least one
    before it within reach, also in a circle, which has no end.
    """
    edges = cut(edges.distinct())
    lone = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source")).filter("n = 1")
    reach = cut(lone.select("source", "target", F.least("source", "target").alias("low"), F.lit(True).alias("fell")))
    every, before, left = edges, None, reach.count()
    while left and (left != before or not reach.filter("fell").isEmpty()):
        on = reach.select(F.col("source").alias("before"), F.col("target").alias("source"), F.col("low").alias("lower"))
        reach = cut(
            reach.join(on, "source").select(
                F.col("before").alias("source"), "target", F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("fell")
            )
        )
        every = every.unionByName(reach.select("source", "target"))
        before, left = left, reach.count()
    return cut(every.filter("source <> target").distinct())


def _reached(edges: DataFrame, label: DataFrame) -> DataFrame:
    """``(node, label)`` grown along ``edges`` (source, target) until no label gets smaller."""
    label = cut(label)
    while True:
        passed = edges.join(label.withColumnRenamed("node", "source"), "source").select(
            F.col("target").alias("node"), "label"
        )
        grown = cut(
            label.withColumn("was", F.col("label"))
            .unionByName(passed, allowMissingColumns=True)
            .groupBy("node")
            .agg(F.min("label").alias("label"), F.max("was").alias("was"))
        )
        label = grown.select("node", "label")
        if grown.filter(~F.col("label").eqNullSafe(F.col("was"))).isEmpty():
            return label


def _components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the strongly connected components of two nodes and more.

    Every node gets the least node that reaches it. The nodes with one such label that
    also reach it are the component of that least node; the rest goes on without them.
    """
    # a shortcut stays true when nodes of a found component go, and never ties two components together
    edges, path, step = _with_shortcuts(edges), fresh_path(edges.sparkSession, "components"), 0
    shape = None
    while not edges.isEmpty():
        nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        ahead = _reached(edges, nodes.withColumn("label", F.col("node")))
        inside = (
            edges.join(ahead.select(F.col("node").alias("source"), F.col("label").alias("a")), "source")
            .join(ahead.select(F.col("node").alias("target"), F.col("label").alias("b")), "target")
            .filter("a = b")
            .select("source", "target", F.col("a").alias("label"))
        )
        inside = cut(inside)
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        roots = inside.select("label").distinct().select(F.col("label").alias("node"), "label")
        found = _reached(back, roots).withColumnRenamed("label", "component")
        part = f"{path}/step={step}"
        found.write.parquet(part)
        shape = found.schema
        done = edges.sparkSession.read.schema(shape).parquet(part)
        gone = done.select(F.col("node").alias("source"))
        left = inside.select("source", "target").join(gone, "source", "left_anti")
        edges = cut(left.join(gone.withColumnRenamed("source", "target"), "target", "left_anti").select("source", "target"))
        step += 1
    if shape is None:
        return edges.select(F.col("source").alias("node"), F.col("target").alias("component"))
    every = edges.sparkSession.read.schema(shape).parquet(*[f"{path}/step={k}" for k in range(step)])
    size = every.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    return every.join(size, "component", "left_semi").select("node", "component")


def _on_cycles(stuck: DataFrame) -> DataFrame:
    """Components among nodes that wait for ever: what only leads to a cycle is taken off first."""
    back = stuck.filter("parent IS NOT NULL").select(F.col("parent").alias("child"), F.col("node").alias("parent"))
    _, core = _levels(_pending(stuck.select("node").distinct(), back))
    edges = core.filter("parent IS NOT NULL").select(F.col("parent").alias("source"), F.col("node").alias("target"))
    return _components(edges)


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, level)``: parents sit on a lower level than their children.

    ``nodes`` has ``node``; ``edges`` has ``(child, parent)``. Self edges and edges to
    unknown nodes do not count. Ordering by level then node is a load order; the reverse
    is a truncation order. A cycle raises; the error names the least node on a cycle, and
    the members of its component are written as a table. ``dependency_cycles`` gives all. Rounds
    grow with the logarithm of a chain's length, not with the number of levels.
    """
    found, stuck = _levels(_pending(nodes, edges))
    if not stuck.isEmpty():
        on_cycles = cut(_on_cycles(stuck))
        least = on_cycles.agg(F.min("component")).first()[0]
        path = fresh_path(stuck.sparkSession, "cycle")
        on_cycles.filter(F.col("component") == F.lit(least)).select("node").write.parquet(path)
        raise CycleError(stuck.sparkSession.read.schema(on_cycles.select("node").schema).parquet(path), path)
    return found


def dependency_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that lie on a cycle, and no others."""
    _, stuck = _levels(_pending(nodes, edges))
    return _on_cycles(stuck).select("node")


def load_order(specs: list[TableSpec]) -> list[str]:
    """Qualified table names, parents first, ties alphabetical. Driver-side, a few tables."""
    names = {s.name for s in specs}
    waiting = {
        s.name: {qualified(f.parent) for f in s.foreign_keys} & names - {s.name} for s in specs
    }
    order: list[str] = []
    while waiting:
        free = sorted(n for n, parents in waiting.items() if not parents)
        if not free:
            raise CycleError(sorted(waiting))
        order += free
        waiting = {n: parents - set(free) for n, parents in waiting.items() if n not in free}
    return order
