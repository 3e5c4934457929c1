"""A restore that is cut off before, between and after its moves."""

import pytest

from keelson import Column, TableSpec
from keelson.operators.evolve import EvolutionError
from keelson.plans.durable import fresh_path
from keelson.sources import bundle

A = TableSpec("a", (Column("id", "bigint", False),), ("id",))
B = TableSpec("b", (Column("id", "bigint", False), Column("note", "string")), ("id",))
OLD, NEW = {"a": [1, 2], "b": [1]}, {"a": [10], "b": [11, 12, 13]}


class Cut(Exception):
    pass


def exported(spark, ids):
    out = fresh_path(spark, "export")
    frames = {"a": spark.createDataFrame([(i,) for i in ids["a"]], "id bigint"), "b": spark.createDataFrame([(i, "x") for i in ids["b"]], "id bigint, note string").repartition(3)}
    bundle.export_database(frames, [A, B], out)
    return out


def state(spark, target):
    return {n: sorted(r.id for r in spark.read.parquet(f"{target}/public.{n}").collect()) for n in "ab"}


@pytest.mark.parametrize("mode", ["truncate", "append"])
def test_cut_off_at_every_step(spark, monkeypatch, mode):
    old, new = exported(spark, OLD), exported(spark, NEW)
    whole = NEW if mode == "truncate" else {n: sorted(OLD[n] + NEW[n]) for n in OLD}
    steps = {"rename": bundle._Files.rename, "delete": bundle._Files.delete}
    for stop in range(20):
        target, left = fresh_path(spark, "target"), [stop]
        bundle.load_database(spark, old, target, [A, B], "create")

        def cut(step):
            def run(self, *paths):
                if not left[0]:
                    raise Cut()
                left[0] -= 1
                steps[step](self, *paths)

            return run

        with monkeypatch.context() as m:
            for name in steps:
                m.setattr(bundle._Files, name, cut(name))
            try:
                bundle.load_database(spark, new, target, [A, B], mode)
                done = True
            except Cut:
                done = False
        if done:
            assert stop > 3 and state(spark, target) == whole
            return
        # nothing before the commit; all of it after the next call
        committed = bundle.recover(spark, target)
        assert state(spark, target) == (whole if committed or stop else OLD)
        assert not bundle.recover(spark, target)
        bundle.load_database(spark, new, target, [A, B], "truncate")
        assert state(spark, target) == NEW
    raise AssertionError("never done")


def test_a_load_finishes_the_one_before(spark, monkeypatch):
    target = fresh_path(spark, "target")
    bundle.load_database(spark, exported(spark, OLD), target, [A, B], "create")
    with monkeypatch.context() as m:
        m.setattr(bundle, "recover", lambda *a: False)
        bundle.load_database(spark, exported(spark, NEW), target, [A, B], "truncate")
    assert state(spark, target) == OLD
    bundle.load_database(spark, exported(spark, {"a": [20], "b": [21]}), target, [A, B], "append")
    assert state(spark, target) == {"a": [10, 20], "b": [11, 12, 13, 21]}


def test_a_row_that_does_not_fit_changes_nothing(spark):
    target = fresh_path(spark, "target")
    bundle.load_database(spark, exported(spark, OLD), target, [A, B], "create")
    narrow = TableSpec("b", (Column("id", "tinyint", False), Column("note", "string")), ("id",))
    with pytest.raises(EvolutionError, match="do not fit"):
        bundle.load_database(spark, exported(spark, {"a": [5], "b": [1000]}), target, [A, narrow], "append")
    assert state(spark, target) == OLD
