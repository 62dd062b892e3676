"""Tables in versions: two writers, crashes between any two steps, rows added once."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cadastra.operators import versions as vs
from cadastra.operators.gates import GateError
from cadastra.operators.sync import unseen

SCHEMA = "k long, v string"


def _rows(spark, path, version=None):
    return sorted(tuple(r) for r in vs.read(spark, path, SCHEMA, version).collect())


def _add(spark, path, *rows, **more):
    batch = spark.createDataFrame(rows, SCHEMA)
    return vs.update(spark, path, SCHEMA, lambda old: unseen(batch, old, ["k"], "v"), keep=True, **more)


@pytest.mark.parametrize("linked", [("file",), ()])
def test_the_second_of_two_writers_begins_again(spark, tmp_path, monkeypatch, linked):
    monkeypatch.setattr(vs, "LINKED", linked)
    path, asked = f"{tmp_path}/t", []
    assert _add(spark, path, (1, "a")) == (1, 1)
    batch = spark.createDataFrame([(2, "mine"), (3, "c")], SCHEMA)

    def change(old):
        asked.append(sorted(r["k"] for r in old.collect()))
        if len(asked) == 1:
            assert _add(spark, path, (2, "theirs")) == (2, 1)
        return unseen(batch, old, ["k"], "v")

    assert vs.update(spark, path, SCHEMA, change, keep=True) == (3, 1)
    assert asked == [[1], [1, 2]]
    assert _rows(spark, path) == [(1, "a"), (2, "theirs"), (3, "c")]
    assert _rows(spark, path, 1) == [(1, "a")] and _rows(spark, path, 0) == []
    with pytest.raises(vs.Conflict):
        vs.commit(spark, path, 3, [])
    with pytest.raises(vs.Conflict):
        vs.update(spark, path, SCHEMA, lambda old: (_add(spark, path, (9, "z")), batch)[1], attempts=1)
    assert len([f for f in os.listdir(path) if f.startswith("rows")]) == 4


def test_rows_are_added_once_and_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert _add(spark, path, (1, "b"), (1, "a"), (2, "c")) == (1, 2)
    assert _add(spark, path, (1, "x"), (2, "y")) == (1, 0)
    assert vs.update(spark, path, SCHEMA, lambda old: old.where("k = 2").withColumn("v", F.upper("v"))) == (2, 1)
    assert _rows(spark, path) == [(2, "C")] and _rows(spark, path, 1) == [(1, "a"), (2, "c")]
    assert vs.update(spark, path, SCHEMA, lambda old: old.limit(0)) == (3, 0)
    assert _rows(spark, path) == []


@pytest.mark.parametrize("step", ["create", "link", "gate"])
def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/t"
    _add(spark, path, (1, "a"))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "create":
            m.setattr(vs, "commit", dies)
        if step == "link":
            m.setattr(vs.os, "link", dies)
        with pytest.raises((RuntimeError, GateError)):
            _add(spark, path, (2, "b"), gates={"no rows": lambda written: written} if step == "gate" else None)
    assert vs.latest(spark, path) == 1 and _rows(spark, path) == [(1, "a")]
    assert _add(spark, path, (2, "b")) == (2, 1)
    assert _rows(spark, path) == [(1, "a"), (2, "b")]
