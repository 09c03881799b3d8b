"""Publishing: tests ride on the write, all tables move together or none, partitions are replaced alone."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from feedloom.sources.publish import Model, Run, Tests, TestsFailed, publish, refresh_partitions


def frame(spark, rows, schema="k string, v int"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def database(spark):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def rows_of(spark, table):
    return sorted(tuple(r) for r in spark.table(table).collect())


def test_every_kind_of_violation_is_counted(spark, tmp_path):
    run = Run(spark, str(tmp_path))
    run.write(Model("dim", lambda t: frame(spark, [("a", 1), ("a", 1), ("b", 1)])))
    run.write(Model("fact", lambda t: frame(spark, [("a", 1), ("a", 2), ("a", 9), ("b", None), ("b", 5), ("c", 5), (None, 5), (None, 7)]),
                    Tests(("k", "v"), ("k", "v"), {"v": [1, 2, 5]}, {"v": (1, 6)}, {"k": ("dim", "k")})))
    assert {(name, c): n for _, name, c, n, _ in run.report} == {
        ("not_null", "k"): 2, ("not_null", "v"): 1, ("unique", "k"): 2, ("unique", "v"): 1, ("accepted_values", "v"): 2, ("in_range", "v"): 2, ("relationships", "k"): 1}
    assert run.counts == {"dim": 3, "fact": 8} and run.tables["fact"].columns == ["k", "v"] and run.tables["fact"].count() == 8
    assert run.report_frame().filter("passed").count() == 0


def test_a_model_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf(LongType())
    def counted(v):
        seen.add(1)
        return v

    counted = counted.asNondeterministic()
    run = Run(spark, str(tmp_path))
    run.write(Model("a", lambda t: spark.range(50).select(counted("id").alias("id")), Tests(("id",), ("id",), ranges={"id": (0, 49)})))
    run.write(Model("b", lambda t: t["a"].where("id < 10")))
    assert seen.value == 50 and run.counts == {"a": 50, "b": 10} and all(ok for *_, ok in run.report)


def test_tables_move_together_or_not_at_all(spark, database, tmp_path):
    def models(a, b):
        return [Model("step", lambda t: a), Model("x", lambda t: t["step"], Tests(("k",), ("k",)), True), Model("y", lambda t: b, Tests(("k",)), True)]

    first = publish(spark, models(frame(spark, [("a", 1)]), frame(spark, [("p", 1)])), database, str(tmp_path))
    assert rows_of(spark, f"{database}.x") == [("a", 1)] and not spark.catalog.tableExists(f"{database}.step")
    publish(spark, models(frame(spark, [("a", 2), ("b", 3)]), frame(spark, [("p", 2)])), database, str(tmp_path))
    assert rows_of(spark, f"{database}.x") == [("a", 2), ("b", 3)] and rows_of(spark, f"{database}.y") == [("p", 2)]
    for a, b in (([("a", 4), ("a", 5)], [("p", 9)]), ([("c", 4)], [(None, 9)])):
        with pytest.raises(TestsFailed) as failed:
            publish(spark, models(frame(spark, a), frame(spark, b)), database, str(tmp_path))
        assert len(failed.value.report) == 3 and "x.k: unique 1" in str(failed.value) or "y.k: not_null 1" in str(failed.value)
        assert rows_of(spark, f"{database}.x") == [("a", 2), ("b", 3)] and rows_of(spark, f"{database}.y") == [("p", 2)]
    # other columns: the table is made anew; an older run's files are still there
    publish(spark, [Model("x", lambda t: frame(spark, [("a", 1, 2)], "k string, v int, w int"), published=True)], database, str(tmp_path))
    assert rows_of(spark, f"{database}.x") == [("a", 1, 2)]
    assert spark.read.parquet(first.paths["x"]).count() == 1


def test_an_empty_model_is_published(spark, database, tmp_path):
    run = publish(spark, [Model("x", lambda t: frame(spark, []), Tests(("k",), ("k",)), True)], database, str(tmp_path))
    assert run.counts == {"x": 0} and rows_of(spark, f"{database}.x") == []


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "daily")
    refresh_partitions(frame(spark, [("a", 1), ("b", 1), ("c", 2)]), path, ("v",))
    refresh_partitions(frame(spark, [("z", 2), ("y", 3)]), path, ("v",), Tests(("k",), ("k",)))
    with pytest.raises(TestsFailed):
        refresh_partitions(frame(spark, [(None, 1)]), path, ("v",), Tests(("k",)))
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 1), ("y", 3), ("z", 2)]


def test_unique_test_reuses_the_partitioning_of_a_keyed_table(spark):
    from pyspark.sql import Window

    from feedloom.operators.staging import latest_copy
    rows = latest_copy(frame(spark, [("a", 1), ("a", 2)], "review_id string, scraped_at int"), tie_break=())
    numbered = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("review_id").orderBy("review_id")))
    assert numbered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
