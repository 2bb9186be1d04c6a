"""Committed tables and scratch scopes."""

import glob
import os
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ebbline.plans import run
from ebbline.plans.contract import Contract, Metric
from ebbline.sources import sinks


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _new():
    return "file://" + tempfile.mkdtemp(prefix="spark-sink-", dir="/tmp") + "/t"


def _results(df, path):
    return sinks.commit(df, path, form="json", by=("metric",))


def test_rerun_replaces_and_failed_run_leaves_the_old(spark):
    path = _new()
    with pytest.raises(ValueError):
        sinks.committed(spark, path)
    first = spark.createDataFrame([("a", 1, None), (None, 2, 0.5), ("b c/d", 3, 1.0)], "metric string, n int, v double")
    assert _results(first, path).rows == 3
    assert _rows(sinks.committed(spark, path)) == _rows(first)
    broken = first.withColumn("n", F.when(F.col("n") == 3, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(PySparkException):
        _results(broken, path)
    assert _rows(sinks.committed(spark, path)) == _rows(first)
    second = first.filter("n = 1").withColumn("more", F.lit("x"))
    assert (_results(second, path).number, sinks.latest_commit(spark, path).rows) == (2, 1)
    assert _rows(sinks.committed(spark, path)) == _rows(second) and _rows(sinks.committed(spark, path, 1)) == _rows(first)
    assert sinks.vacuum(spark, path) == 2 and sinks.vacuum(spark, path) == 0
    assert _rows(sinks.committed(spark, path)) == _rows(second)


def test_a_table_may_be_made_from_itself_and_be_empty(spark):
    path = _new()
    sinks.commit(spark.range(5), path)
    for _ in range(2):
        sinks.commit(sinks.committed(spark, path).select((F.col("id") * 2).alias("id")), path)
    assert [r.id for r in sinks.committed(spark, path).orderBy("id").collect()] == [0, 4, 8, 12, 16]
    assert sinks.commit(sinks.committed(spark, path).limit(0), path).rows == 0
    assert sinks.committed(spark, path).columns == ["id"] and sinks.committed(spark, path).count() == 0
    text = spark.createDataFrame([("x;y", 1)], "k string, n int")
    sinks.commit(text, path, form="csv", header="true", sep=";")
    assert _rows(sinks.committed(spark, path)) == [("x;y", 1)]


def test_unfinished_commit_line_is_no_commit(spark):
    path = _new()
    sinks.commit(spark.range(3), path)
    with open(f"{path.removeprefix('file://')}/commits/part-99999-broken.txt", "w") as f:
        f.write('{"number": 9, "fol')
    assert sinks.latest_commit(spark, path).number == 1 and sinks.committed(spark, path).count() == 3


def test_scope_drops_scratch(spark):
    made = []
    with pytest.raises(KeyError), sinks.dropped_after(spark):
        sinks.kept(spark.range(3), "outer")
        with sinks.dropped_after(spark):
            made.append(sinks.kept(spark.range(3), "inner").inputFiles()[0])
        assert not os.path.exists(made[0].removeprefix("file://"))
        made.append(sinks.kept(spark.range(3), "second").inputFiles()[0])
        raise KeyError
    assert made and not any(os.path.exists(f.removeprefix("file://")) for f in made)


def test_run_leaves_results_alone(spark):
    c = Contract("c", "period", "monthly", (Metric("m", column="v"),), hierarchies={"h": ("r", "p")})
    days = [f"{y}-{m:02d}-28" for y in (2020, 2021, 2022) for m in range(1, 13)]
    fact = spark.createDataFrame([(d, r, f"{r}{k}", float(100 + 7 * k + 40 * (i == 30 and k == 1))) for i, d in enumerate(days) for r in "xy" for k in range(3)], "period string, r string, p string, v double").withColumn("period", F.to_date("period"))
    top, folder = sinks.shared_path(spark, "probe").rsplit("/", 1)[0], _new()
    before = set(glob.glob(top.removeprefix("file://") + "/*"))
    for number in (1, 2):
        run.run(fact, c, "m", "h", folder)
        assert sinks.latest_commit(spark, f"{folder}/m/profiles").number == number
    assert sinks.committed(spark, f"{folder}/m/profiles").count() == 6 and sinks.committed(spark, f"{folder}/m/level_statistics").count() > 0
    assert set(glob.glob(top.removeprefix("file://") + "/*")) == before
