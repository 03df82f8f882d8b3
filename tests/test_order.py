"""Order statistics, quotas, positions, pivots in blocks, mixed documents and decimal text, on odd data."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiopanel.functions.locale import format_decimal
from regiopanel.operators import quantiles
from regiopanel.operators.evaluate import quota_split
from regiopanel.operators.order import with_positions
from regiopanel.operators.quantiles import group_quantiles
from regiopanel.operators.reshape import pivot_blocks
from regiopanel.sources.delimited import read_delimited, save_decimal_csv
from regiopanel.sources.variant import field_schema, kind_of, read_mixed_documents, typed_field


@pytest.mark.parametrize("bins", [2, 1024])
def test_group_quantiles_of_odd_values(spark, bins):
    r = random.Random(1)
    rows = []
    for g in ("a", None, "", "c"):
        rows += [(g, r.choice([r.gauss(0, 1), r.random() * 1e300, -r.random() * 1e-300, 0.0, -0.0, 5.0, 5.0, 5e-324, float(r.randrange(9))])) for _ in range(301)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("inf", float("inf")), ("inf", -float("inf")), ("inf", 1.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in group_quantiles(df, "k", "v", (0.0, 0.25, 0.5, 0.9, 1.0), bins).collect()}
    for k in {r[0] for r in rows}:
        x = np.sort([v for g, v in rows if g == k and v is not None and not math.isnan(v)])
        if k == "inf":
            assert got[k][1] == -math.inf and got[k][3] == 1.0
            continue
        expected = [float(np.quantile(x, p)) for p in (0.0, 0.25, 0.5, 0.9, 1.0)] if len(x) else [None] * 5
        assert got[k] == (len(x), *[pytest.approx(e, rel=1e-12, abs=0) if e is not None else None for e in expected])


def test_quantile_plan_has_no_group_buffer(spark, monkeypatch):
    plans = []
    real = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) as k", "cast(id * 37 % 1009 as double) as v")
    group_quantiles(df, "k", "v").collect()
    assert len(plans) > 3 and not any(w in p for p in plans for w in ("percentile", "median", "collect_list", "SinglePartition"))


def test_quotas_hold_to_the_row(spark):
    rows = [("hot", i, "x") for i in range(1000)] + [(f"g{i % 40}", i, "y") for i in range(400)] + [("one", 1, "z")] + [("same", 7, "w")] * 50 + [(None, i, None) for i in range(11)]
    df = spark.createDataFrame(rows, "g0 string, id int, t string")
    a = quota_split(df.repartition(5), "g0", "id")
    got = {r["g0"]: (r["n"], r["t"]) for r in a.groupBy("g0").agg(F.count("*").alias("n"), F.count(F.when(~F.col("is_train"), 1)).alias("t")).collect()}
    assert got == {"hot": (1000, 200), "one": (1, 0), "same": (50, 10), None: (11, 2)} | {f"g{i}": (10, 2) for i in range(40)}
    b = quota_split(df.coalesce(1), "g0", "id")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.columns == ["g0", "id", "t", "is_train"]
    small = quota_split(spark.createDataFrame([("s", 1), ("s", 2)], "g0 string, id int"), "g0", "id")
    assert small.where("not is_train").count() == 1


def test_positions_in_a_total_order(spark):
    rows = [(i % 3, "hot" if i % 3 else str(i), float(i * 7 % 50)) for i in range(700)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "a int, b string, c double")
    got = with_positions(df.repartition(9), F.desc("c"), "a", "b")
    found = sorted(got.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in found] == list(range(1, len(rows) + 1))
    key = lambda r: (r["c"] is None, -(r["c"] or 0), (r["a"] is not None, r["a"] or 0), r["b"] or "")
    assert [key(r) for r in found] == sorted(map(key, found))
    assert sorted(map(tuple, with_positions(df.coalesce(1), F.desc("c"), "a", "b").collect()), key=str) == sorted(map(tuple, found), key=str)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert with_positions(df.limit(0), "a").count() == 0


def test_pivot_beyond_ten_thousand_columns(spark):
    df = spark.range(30_000).selectExpr("id % 3 as k", "if(id = 5, null, id % 15000) as c", "id as v")
    cells, columns = pivot_blocks(df, "k", "c", F.sum("v"))
    assert columns.count() == 15_001 and columns.where("column = 0").first()["category"] is None
    back = cells.select("k", F.explode("cells").alias("column", "value")).join(columns, "column")
    expected = df.groupBy("k", "c").agg(F.sum("v").alias("v"))
    assert sorted(map(str, back.select("k", "category", "value").collect())) == sorted(str(r).replace("c=", "category=").replace("v=", "value=") for r in expected.collect())
    assert cells.selectExpr("max(size(cells)) as m").first()["m"] <= 4096


def test_mixed_documents_keep_their_types(spark, tmp_dir):
    docs = [{"v": 1}, {"v": 2.5}, {"v": "3"}, {"v": {"a": 1}}, {"v": [1, 2]}, {"v": None}, {}, {"v": True}]
    with open(os.path.join(tmp_dir, "d.json"), "w") as f:
        f.write("\n".join(json.dumps(d) for d in docs) + "\nnot json\n")
    df = read_mixed_documents(spark, tmp_dir)
    df.write.parquet(f"{tmp_dir}/stored")
    df = spark.read.parquet(f"{tmp_dir}/stored")
    rows = [(r["n"], r["t"], r["b"]) for r in df.select(typed_field("doc", "v", "double").alias("n"), typed_field("doc", "v", "string").alias("t"),
                                                      typed_field("doc", "v", "boolean").alias("b")).collect()]
    assert sorted(rows, key=str) == sorted([(1.0, None, None), (2.5, None, None), (None, "3", None), (None, None, True)] + [(None, None, None)] * 5, key=str)
    kinds = {r["k"] for r in df.select(kind_of("doc", "v").alias("k")).collect()}
    assert {"BIGINT", "STRING", "BOOLEAN", "VOID", None} <= kinds
    assert "VARIANT" in field_schema(df)


def test_decimal_text_of_exponents_and_floats(spark, tmp_dir):
    values = [1e7, 1.5e7, 123456789.25, 1e29, 1.7976931348623157e308, 1e-3, 9.99e-4, 1e-30, 1.5e-30, 4.9e-324, -2.5e10, -1e-5, 1.0, 0.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["t"] for r in df.select(format_decimal("v").alias("t")).collect()]
    assert got == ["10000000,0", "15000000,0", "123456789,25", "1" + "0" * 29 + ",0", "1,7976931348623157E308", "0,001", "0,000999",
                   "0," + "0" * 29 + "1", "1,5E-30", "4,9E-324", "-25000000000,0", "-0,00001", "1,0", "0,1"]
    save_decimal_csv(df.selectExpr("cast(v as float) as f").where("f between -1e6 and 1e6"), f"{tmp_dir}/f")
    back = read_delimited(spark, f"{tmp_dir}/f")
    assert {"0,1", "0,000999", "1,0"} <= {r["f"] for r in back.collect()}
