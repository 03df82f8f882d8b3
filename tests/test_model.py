"""Group forests (M3-M5, U2): rows only, reproducible, gate report for skipped groups; with Spark ML's fits where ``trainer="ml"``."""

import pytest
from pyspark.sql import functions as F

from regiopanel.operators.model import ForestParams, fit_group_forests


def _frame(spark):
    rows = []
    for region in ("a", "b"):
        for year in range(1990, 2020):
            rows.append((region, "NOX", year, float(year - 1980) * (2 if region == "a" else 3), float(year * 7 % 13)))
    rows += [("c", "NOX", y, 1.0, 1.0) for y in range(2000, 2005)]  # below the gate
    df = spark.createDataFrame(rows, "region string, pollutant string, period int, label double, traffic double")
    return df.withColumn("year_feature", F.col("period").cast("double"))


@pytest.mark.parametrize("trainer", ["levels", "ml"])
def test_group_forests_reproducible(spark, trainer):
    params = ForestParams(trainer=trainer, num_trees=5, max_depth=3)
    a = fit_group_forests(_frame(spark), params=params)
    b = fit_group_forests(_frame(spark), params=params)
    pa = sorted(tuple(r) for r in a.predictions.collect())
    pb = sorted(tuple(r) for r in b.predictions.collect())
    assert pa == pb and len(pa) > 0
    metrics = {r["region"]: r for r in a.metrics.collect()}
    assert set(metrics) == {"a", "b"}
    assert all(m["n_train"] + m["n_test"] == 30 for m in metrics.values())
    gate = {r["region"]: r["eligible"] for r in a.gate.collect()}
    assert gate == {"a": True, "b": True, "c": False}


@pytest.mark.parametrize("trainer", ["levels", "ml"])
def test_group_forests_random_split_reproducible(spark, trainer):
    params = ForestParams(trainer=trainer, num_trees=3, max_depth=2, split="random")
    a = sorted(tuple(r) for r in fit_group_forests(_frame(spark), params=params).predictions.collect())
    b = sorted(tuple(r) for r in fit_group_forests(_frame(spark), params=params).predictions.collect())
    assert a == b and len(a) > 0


@pytest.mark.parametrize("trainer", ["levels", "ml"])
def test_group_without_test_rows_reports_null_metrics(spark, trainer):
    params = ForestParams(trainer=trainer, num_trees=2, max_depth=2, train_share=1.0)  # every bucket trains
    res = fit_group_forests(_frame(spark), params=params)
    rows = res.metrics.collect()
    assert {r["region"] for r in rows} == {"a", "b"}
    assert all(r["n_test"] == 0 and r["rmse"] is None and r["r2"] is None for r in rows)
    assert res.predictions.count() == 0


def test_jvm_model_path_equals_pipeline_path(spark):
    base = dict(num_trees=4, max_depth=3)
    jvm = fit_group_forests(_frame(spark), params=ForestParams(trainer="ml", **base))
    py = fit_group_forests(_frame(spark), params=ForestParams(trainer="ml", **base, python_model=True))
    assert sorted(tuple(r) for r in jvm.predictions.collect()) == sorted(tuple(r) for r in py.predictions.collect())


@pytest.mark.parametrize("trainer", ["levels", "ml"])
def test_any_key_value_and_a_whole_number_label(spark, trainer):
    rows = [(r, "NOX", y, y % 7, float(y)) for r in ("", "a/b", "x=1", "null") for y in range(1990, 2015)]
    df = spark.createDataFrame(rows, "region string, pollutant string, period int, label bigint, traffic double")
    res = fit_group_forests(df.withColumn("year_feature", F.col("period").cast("double")), params=ForestParams(trainer=trainer, num_trees=2, max_depth=2))
    assert {r["region"] for r in res.metrics.collect()} == {"", "a/b", "x=1", "null"}
    assert dict(res.predictions.dtypes)["actual"] == "double" and res.predictions.count() > 0
    assert {r["error"] for r in res.gate.collect()} == {None}


def test_a_failed_group_is_reported_and_stops_no_other(spark, monkeypatch):
    from regiopanel.operators import model

    real = model._score

    def score(forest, assembler, train, test, params):
        if train.first()["region"] == "a":
            raise ValueError("cannot be fitted")
        return real(forest, assembler, train, test, params)

    monkeypatch.setattr(model, "_score", score)
    res = fit_group_forests(_frame(spark), params=ForestParams(trainer="ml", num_trees=2, max_depth=2))
    assert {r["region"] for r in res.metrics.collect()} == {"b"}
    assert {r["region"]: r["error"] for r in res.gate.collect()} == {"a": "ValueError: cannot be fitted", "b": None, "c": None}


def test_a_large_group_is_split_over_files(spark, monkeypatch):
    from regiopanel.operators import model

    plain = fit_group_forests(_frame(spark), params=ForestParams(trainer="ml", num_trees=3, max_depth=3))
    monkeypatch.setattr(model, "ROWS_PER_FILE", 7)
    a, b = (fit_group_forests(_frame(spark), params=ForestParams(trainer="ml", num_trees=3, max_depth=3)) for _ in range(2))
    rows = lambda r: sorted(map(tuple, r.predictions.collect()))
    assert rows(a) == rows(b)
    assert [x[:4] for x in rows(a)] == [x[:4] for x in rows(plain)]


def test_public_path_without_the_jvm_handle(spark, monkeypatch):
    params = ForestParams(trainer="ml", num_trees=2, max_depth=2)
    expected = sorted(map(tuple, fit_group_forests(_frame(spark), params=params).predictions.collect()))
    from regiopanel.operators import model

    monkeypatch.setattr(model, "is_remote", lambda: True)
    assert sorted(map(tuple, fit_group_forests(_frame(spark), params=params).predictions.collect())) == expected
