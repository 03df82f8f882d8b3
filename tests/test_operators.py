"""Operators: schema, reshape, joins, aggregates, metrics, reports; traps T4-T14."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiopanel.operators import (
    describe,
    drop_incomplete,
    drop_unnamed,
    exact_quantiles,
    fill_nulls,
    hash_split,
    intersect_values,
    keep_common,
    left_join_keys,
    metric_matrix,
    metric_summary,
    min_sample_gate,
    pivot_categories,
    profile_shape,
    regression_metrics,
    safe_names,
    top_k_per_group,
    trim_names,
    unpivot_digit_columns,
)


def test_trim_and_safe_names(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, `PM2.5` int")
    assert safe_names(trim_names(df)).columns == ["a", "PM2_5"]
    with pytest.raises(ValueError):
        safe_names(spark.createDataFrame([(1, 2)], "`a.b` int, a_b int"))


def test_drop_unnamed_only_when_empty(spark):
    df = spark.createDataFrame([(1, None, "x", float("nan"))], "a int, _c1 string, _c2 string, `Unnamed: 3` double")
    assert drop_unnamed(df).columns == ["a", "_c2"]


def test_unpivot_years_keeps_nulls_and_sorts(spark):
    df = spark.createDataFrame([("W", "3", None, "1")], "Bundesland string, `2000` string, `1990` string, `1980` string")
    rows = unpivot_digit_columns(df, ["Bundesland"], "YEAR", "v").collect()
    assert [r["YEAR"] for r in rows] == [1980, 1990, 2000]
    assert rows[1]["v"] is None
    with pytest.raises(ValueError):
        unpivot_digit_columns(spark.createDataFrame([(1,)], "a int"), ["a"])


def test_pivot_null_category_and_value_list(spark):
    df = spark.createDataFrame([("r", 1, "NOX", 1.0), ("r", 1, "NOX", 3.0), ("r", 1, None, 5.0)],
                               "Region string, Jahr int, Schadstoff string, Werte double")
    assert "null" in pivot_categories(df, ["Region", "Jahr"], "Schadstoff", "Werte").columns  # T7
    fixed = pivot_categories(df, ["Region", "Jahr"], "Schadstoff", "Werte", values=["NOX", "PM2.5"], safe=r"\.")
    row = fixed.first()
    assert fixed.columns == ["Region", "Jahr", "NOX", "PM2_5"] and row["NOX"] == 2.0 and row["PM2_5"] is None


def test_left_join_keeps_unmatched_and_fill(spark):
    panel = spark.createDataFrame([("a", 1), ("a", 2), ("a", None)], "Region string, Jahr int")
    traffic = spark.createDataFrame([("a", 1, 10.0), ("a", 3, float("nan"))], "Region string, YEAR int, t double")
    joined = left_join_keys(panel, traffic, ["Region", "Jahr"], ["Region", "YEAR"])
    assert joined.columns == ["Region", "Jahr", "t"]
    filled = {r["Jahr"]: r["t"] for r in fill_nulls(joined, {"t": 0.0}).collect()}
    assert filled == {1: 10.0, 2: 0.0, None: 0.0}  # T6 / T17


def test_na_drop_treats_nan_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert drop_incomplete(df, ["x"]).count() == 1


def test_semi_join_and_intersect(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "Region string, v int")
    b = spark.createDataFrame([("x",), ("z",), ("x",)], "Region string")
    assert keep_common(a, b, "Region").count() == 2
    assert [r[0] for r in intersect_values(a, b, "Region").collect()] == ["x"]


def test_min_sample_gate_reports_skipped(spark):
    rows = [("a", "NOX", float(i), 1.0) for i in range(12)] + [("b", "NOX", float(i), None) for i in range(12)]
    rows += [("b", "SO2", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "region string, pollutant string, label double, f double")
    gate = {(r["region"], r["pollutant"]): (r["n_rows"], r["eligible"])
            for r in min_sample_gate(df, ["region", "pollutant"], ["label", "f"], 10).collect()}
    assert gate == {("a", "NOX"): (12, True), ("b", "SO2"): (1, False)}


@pytest.mark.parametrize("n,dupes", [(1, False), (2, False), (1001, False), (5000, True)])
def test_exact_quantiles_match_numpy(spark, n, dupes):
    rnd = random.Random(n)
    values = [float(rnd.randint(0, 5)) if dupes else rnd.gauss(0, 100) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, "x", probs, accuracy=100, max_bracket=50)  # force the narrowing rounds
    want = np.quantile(np.array(values), probs)
    for p, w in zip(probs, want):
        assert got[p] == pytest.approx(w, rel=1e-12, abs=1e-9)


def test_describe_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    row = describe(df, ["v"]).first()
    assert (row["p25"], row["p50"], row["p75"]) == (1.75, 2.5, 3.25)
    assert row["count"] == 4 and row["std"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))


def test_metrics_edge_cases(spark):
    rows = [("one", 5.0, 3.0), ("exact", 2.0, 2.0), ("fit", 1.0, 1.5), ("fit", 2.0, 2.0), ("fit", 3.0, 2.5)]
    df = spark.createDataFrame(rows, "g string, actual double, predicted double")
    m = {r["g"]: r for r in regression_metrics(df, ["g"]).collect()}
    assert m["one"]["r2"] == -math.inf  # T9: single test row
    assert math.isnan(m["exact"]["r2"])
    assert m["fit"]["r2"] == pytest.approx(1 - 0.5 / 2.0)
    assert m["fit"]["rmse"] == pytest.approx(math.sqrt(0.5 / 3))


def test_summary_nan_and_single_region(spark):
    rows = [("a", "NOX", 1.0, 0.5), ("b", "NOX", 3.0, float("nan")), ("a", "SO2", 2.0, 0.1)]
    df = spark.createDataFrame(rows, "region string, pollutant string, rmse double, r2 double")
    s = {r["pollutant"]: r for r in metric_summary(df).collect()}
    assert s["NOX"]["r2_mean"] == 0.5 and s["NOX"]["r2_median"] == 0.5  # T12: NaN skipped
    assert s["NOX"]["rmse_median"] == 2.0 and s["NOX"]["n_regions"] == 2
    assert s["SO2"]["r2_std"] is None


def test_top_k_nan_last(spark):
    rows = [("r1", "P", float("nan")), ("r2", "P", 0.1), ("r3", "P", 0.9), ("r4", "P", None), ("r5", "P", 0.9)]
    df = spark.createDataFrame(rows, "region string, pollutant string, r2 double")
    top = top_k_per_group(df, "pollutant", "r2", k=3).orderBy("rank").collect()
    assert [r["region"] for r in top] == ["r3", "r5", "r2"]  # T11


def test_matrix_sorted_rows(spark):
    df = spark.createDataFrame([("b", "A-F", 0.1), ("a", "A-F", 0.2), ("a", "N-O", 0.3)],
                               "region string, pollutant string, r2 double")
    m = metric_matrix(df)
    assert m.columns == ["region", "A_F", "N_O"]
    assert [r["region"] for r in m.collect()] == ["a", "b"]


def test_hash_split_is_partition_independent(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    a = {r["k"]: r["is_train"] for r in hash_split(df.repartition(3), ["k"]).collect()}
    b = {r["k"]: r["is_train"] for r in hash_split(df.repartition(7), ["k"]).collect()}
    assert a == b and 0.7 < sum(a.values()) / len(a) < 0.9


def test_profile_shape(spark):
    row = profile_shape(spark.range(7).withColumn("x", F.lit(1))).first()
    assert (row["n_rows"], row["n_cols"]) == (7, 2)


def test_build_panel_trims_keeps_common_and_imputes(spark):
    from regiopanel.operators import build_panel, panel_features

    measure = spark.createDataFrame(
        [(" Wien", 1990, "NOX", 1.0), ("Wien", 1990, "NOX", 3.0), ("Wien", 1991, "PM2.5", 2.0),
         ("Tirol", 1990, "NOX", 5.0), ("AT", 1990, "NOX", 9.0)],
        "Region string, Jahr int, Schadstoff string, Werte double")
    traffic = spark.createDataFrame([("Wien ", 1990, 10.0), ("Wien", 1990, 20.0), ("AT", 1990, 1.0)],
                                    "Region string, Jahr int, t double")
    panel = build_panel(measure, traffic, ["NOX", "PM2.5", "SO2"], "Region", "Jahr", "Schadstoff", "Werte",
                        "t", exclude_regions=("AT",))
    assert panel.columns == ["Region", "Jahr", "NOX", "PM2_5", "SO2", "t"]
    rows = {r["Jahr"]: r for r in panel.collect()}
    assert set(rows) == {1990, 1991}  # Tirol has no traffic (J2), AT is excluded (T13)
    assert rows[1990]["NOX"] == 2.0 and rows[1990]["t"] == 15.0 and rows[1991]["t"] is None
    long = panel_features(panel, ["NOX", "PM2_5", "SO2"], "Region", "Jahr", "t").collect()
    assert sorted((r["pollutant"], r["Jahr"], r["t"]) for r in long) == [("NOX", 1990, 15.0), ("PM2_5", 1991, 0.0)]


def test_sort_spreads_a_hot_key_over_partitions(spark):
    from regiopanel.operators import sort_frame

    hot = spark.range(40000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    cold = spark.range(2000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("k"),
                                    F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sort_frame(hot.unionByName(cold).repartition(8), "k")
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        keys = [r["k"] for r in out.select("k").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in sizes) < 40000  # the hot key is split across range partitions
    assert keys == sorted(keys)


def test_describe_many_columns_matches_numpy(spark):
    rnd = random.Random(7)
    rows = [(rnd.gauss(0, 1), float(rnd.randint(0, 3)), None if i % 5 == 0 else rnd.random() * 100)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    from regiopanel.operators.aggregate import multi_quantiles

    q, _ = multi_quantiles(df, ["a", "b", "c"], [0.1, 0.5, 0.9], accuracy=50, max_bracket=40)
    for idx, name in enumerate(["a", "b", "c"]):
        values = np.array([r[idx] for r in rows if r[idx] is not None])
        for p in (0.1, 0.5, 0.9):
            assert q[name][p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-9)
    d = {r["column"]: r for r in describe(df, ["a", "c"]).collect()}
    assert d["c"]["count"] == 2400 and d["a"]["p50"] == pytest.approx(np.median([r[0] for r in rows]))


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=300))
def test_quantiles_property_heavy_duplicates(spark, values):
    from regiopanel.operators.aggregate import multi_quantiles

    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.3, 0.5, 0.99, 1.0]
    q, _ = multi_quantiles(df, ["x"], probs, accuracy=10, max_bracket=3)
    want = np.quantile(np.array(values, dtype=float), probs)
    for p, w in zip(probs, want):
        assert q["x"][p] == pytest.approx(w, abs=1e-9)


def test_operators_under_a_hot_key(spark):
    """One region holds a third of the rows: results stay whole and exact."""
    from collections import defaultdict

    from regiopanel.operators import mean_by

    rnd = random.Random(3)
    rows = [("HOT" if i % 3 == 0 else f"r{i % 40}", i % 12, float(rnd.randint(0, 1000))) for i in range(30000)]
    df = spark.createDataFrame(rows, "region string, period int, v double").repartition(8)
    got = {(r["region"], r["period"]): r["m"] for r in mean_by(df, ["region", "period"], "v", "m").collect()}
    sums, counts = defaultdict(float), defaultdict(int)
    for reg, per, v in rows:
        sums[(reg, per)] += v
        counts[(reg, per)] += 1
    assert got.keys() == sums.keys()
    assert all(got[k] == pytest.approx(sums[k] / counts[k]) for k in got)

    dims = spark.createDataFrame([("HOT", "h")] + [(f"r{i}", "c") for i in range(40)], "region string, kind string")
    joined = left_join_keys(df, dims, ["region"])
    assert joined.count() == len(rows) and joined.filter("kind = 'h'").count() == 10000

    top = top_k_per_group(df.withColumnRenamed("v", "r2").withColumnRenamed("period", "pollutant"),
                          "region", "r2", k=3, tie="pollutant")
    assert top.filter("region = 'HOT'").count() == 3


def test_describe_skips_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,), (None,)], "v double")
    r = describe(df, "v").first()
    assert (r["count"], r["min"], r["max"], r["p50"]) == (3, 1.0, 4.0, 2.0) and abs(r["mean"] - 7 / 3) < 1e-12
