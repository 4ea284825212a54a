import os

import pytest

from factlake import session


def test_scratch_drops_its_own_tables_only(spark):
    scratch, other = session.Scratch(spark), session.Scratch(spark)
    a, b = scratch.table(spark.range(5)), scratch.table(spark.range(3))
    c = other.table(spark.range(2))
    folders = [t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for t in (a, b, c)]
    scratch.drop(a, c)
    assert [os.path.isdir(f) for f in folders] == [False, True, True]
    assert b.count() == 3
    scratch.drop(a)
    scratch.drop_all(b)
    assert b.count() == 3
    scratch.drop_all()
    assert [os.path.isdir(f) for f in folders] == [False, False, True]
    assert c.count() == 2


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_temporary_tables_are_dropped_also_after_a_failure(spark):
    with session.temporary_tables(spark):
        inside = session.materialized(spark.range(4))
        folder = inside.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert inside.count() == 4 and os.path.isdir(folder)
    assert not os.path.isdir(folder)
    with pytest.raises(ValueError):
        with session.temporary_tables(spark):
            folder = session.materialized(spark.range(4)).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
            raise ValueError
    assert not os.path.isdir(folder)
    assert session.materialized(spark.range(2)).count() == 2


def test_written_once_tells_whole_tables_from_parts(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"{tmp_path}/t"
    spark.range(9).write.parquet(path)
    os.remove(f"{path}/_SUCCESS")  # as a killed run leaves it
    assert session.written_once(spark, make, path).count() == 3
    assert session.written_once(spark, make, path).count() == 3 and len(made) == 1


def test_bucketed_tables_join_without_moving(spark):
    scratch = session.Scratch(spark)
    rows = spark.range(1000).selectExpr("id % 50 AS k", "id AS v")
    table = scratch.bucketed(rows.groupBy("k").agg({"v": "max"}), "k")
    assert table.count() == 50
    joined = table.groupBy("k").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    scratch.drop_all()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("factlake_")]
