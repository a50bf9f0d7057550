"""Large groups: no task gets all rows of one, and a table is read a fixed number of times."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arterion.operators import accuracy, models, quantiles
from arterion.plans import catalog

N = 24_000


def most_read(spark, job):
    """(result, the most rows that a task of ``job`` read of a shuffle)."""
    group = f"hot-{np.random.randint(1 << 40)}"
    spark.sparkContext.setJobGroup(group, group)
    out = job()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, most = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        for k in range(tasks.size()):
            metrics = tasks.apply(k).taskMetrics()
            if metrics.isDefined():
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return out, most


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"a": rng.integers(0, 400, N) / 8, "b": rng.integers(0, 11, N) / 100, "subject_id": rng.integers(0, 300, N)})
    rows["sbp_mmhg"], rows["dbp_mmhg"] = 100 + rows["a"], 60 + rows["b"] * 100
    rows = spark.createDataFrame(rows).repartition(4).cache()
    rows.count()
    return rows


def test_f5_f6_medians_of_a_regression_move_no_rows(spark, study, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles.medians, "__kwdefaults__", {"few": 50})
    model, most = most_read(spark, lambda: models.Ridge(["a", "b"]).fit(study))
    assert np.allclose(model.middle, study.toPandas()[["a", "b"]].median()) and most < N / 4


def test_f7_a_table_is_read_once_and_weights_count(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    x = np.random.default_rng(3).normal(size=N)
    rows = spark.createDataFrame(pd.DataFrame({"x": x})).mapInArrow(seen, "x double")
    got, most = most_read(spark, lambda: [r["value"] for r in quantiles.quantiles(rows, "x", (0.05, 0.5), few=1000).orderBy("share").collect()])
    assert np.allclose(got, np.quantile(x, (0.05, 0.5)), rtol=1e-12) and reads.value == N and most < N / 2
    w = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 2), (float("nan"), 3)], "x double, w int")
    assert [r["value"] for r in quantiles.quantiles(w, "x", (0.5,), weight="w").collect()] == [1.0]
    assert np.isnan(quantiles.quantiles(w, "x", (0.9,), weight="w", nan=True).first()["value"])


def test_f8_folds_count_values_before_they_are_repeated(spark, study):
    out, most = most_read(spark, lambda: models.cross_validated(study, ["a", "b"], "subject_id", 3).toPandas())
    assert len(out) == N and out["pred_sbp_mmhg"].notna().all() and most < N / 2


@pytest.mark.parametrize("name", ["acc_method_summary", "acc_percentiles"])
def test_f9_f10_no_task_gathers_the_values_of_a_method(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_f9_f10_percentiles_are_those_of_spark(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.hash("id") / 1e4).alias("x"))
    got = {r["g"]: (r["x_p50"], r["x_p95"]) for r in accuracy.percentiles(rows, {"x": F.col("x")}, "g").collect()}
    want = {r["g"]: (round(r["a"], 4), round(r["b"], 4)) for r in rows.groupBy("g").agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.95).alias("b")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
