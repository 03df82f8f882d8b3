"""Collections never lose rows: layouts, streams, key types; unique ids; finds that skip row groups."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from regiopanel.sources.collection import append_to_collection, collection_scan, read_collection
from regiopanel.sources.payload import payload_schema
from regiopanel.sources.unique import append_unique, id_table, rebuild_ids, refuse_known
from regiopanel.streaming import land_payloads


def _land(folder, name, hours):
    os.makedirs(folder, exist_ok=True)
    doc = {"site": "wien", "hourly": {"time": [f"2025-12-05T{h:02d}:00" for h in hours], "pm10": [10.0 + h for h in hours]}}
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(json.dumps(doc) + "\n")


@pytest.fixture()
def schema(spark):
    return payload_schema({"pm10": "double"}, keys={"site": "string"})


def test_plain_and_partitioned_appends_of_one_schema(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    df = spark.range(10).selectExpr("id", "cast(id % 3 as string) as k", "id * 2 as v")
    assert append_to_collection(df, path) + append_to_collection(df, path, partition_by="k") + append_to_collection(df, path, partition_by=["k", "id"]) == 30
    got = collection_scan(spark, path)
    assert got.count() == 30 and got.groupBy("id", "k", "v").count().where("count = 3").count() == 10
    assert got.columns == ["id", "k", "v", "_imported_at", "_id"]


def test_landing_and_append_into_one_collection(spark, tmp_dir, schema):
    path = os.path.join(tmp_dir, "c")
    _land(f"{tmp_dir}/landing", "a.json", range(2))
    land_payloads(spark, f"{tmp_dir}/landing", schema, path, f"{tmp_dir}/ckpt", keep=["site"]).awaitTermination()
    rows = collection_scan(spark, path).select("time", "site", "pm10")
    assert append_to_collection(rows, path) == 2
    assert collection_scan(spark, path).count() == 4


def test_a_new_checkpoint_at_an_old_path_overwrites_nothing(spark, tmp_dir, schema):
    path, ckpt = os.path.join(tmp_dir, "c"), os.path.join(tmp_dir, "ckpt")
    _land(f"{tmp_dir}/one", "a.json", range(2))
    land_payloads(spark, f"{tmp_dir}/one", schema, path, ckpt, keep=["site"]).awaitTermination()
    shutil.rmtree(ckpt)
    _land(f"{tmp_dir}/two", "b.json", range(5, 6))
    land_payloads(spark, f"{tmp_dir}/two", schema, path, ckpt, keep=["site"]).awaitTermination()
    got = collection_scan(spark, path).collect()
    assert sorted(r["pm10"] for r in got) == [10.0, 11.0, 15.0]
    assert len({r["stream"] for r in got}) == 2 and {r["epoch"] for r in got} == {0}


def test_partition_columns_keep_their_types(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    df = spark.createDataFrame([("01", 1, 7), ("1e3", 2, 8), (None, 3, 9)], "code string, n int, v int")
    append_to_collection(df, path, partition_by=["code", "n"])
    got = collection_scan(spark, path)
    assert dict(got.dtypes)["code"] == "string" and dict(got.dtypes)["n"] == "int"
    assert sorted((r["code"] or "", r["n"], r["v"]) for r in got.collect()) == [("", 3, 9), ("01", 1, 7), ("1e3", 2, 8)]
    assert [r["v"] for r in collection_scan(spark, path, {"code": "01"}).collect()] == [7]


def test_a_group_without_committed_rows_is_empty(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "c")
    append_to_collection(spark.range(3), path)
    bad = spark.range(2).selectExpr("id", "raise_error('lost') as w")
    with pytest.raises(Exception, match="lost"):
        append_to_collection(bad, path)
    assert collection_scan(spark, path).count() == 3


def _docs(spark, ids, tag):
    return spark.createDataFrame([(i, tag) for i in ids], "_id string, tag string")


def test_equal_ids_are_refused(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    assert append_unique(_docs(spark, ["a", "b", "b", None, None], "one"), path) == (4, 1)
    assert append_unique(_docs(spark, ["b", "c", "d", "c"], "two"), path) == (2, 2)
    assert append_unique(_docs(spark, ["a", "b", "c", "d"], "three"), path) == (0, 4)
    assert append_unique(spark.range(5), path) == (5, 0)  # generated ids
    got = collection_scan(spark, path)
    assert got.count() == 11 and got.select("_id").distinct().count() == 11
    assert {r["_id"]: r["tag"] for r in got.where("_id in ('a', 'b', 'c', 'd')").collect()} == {"a": "one", "b": "one", "c": "two", "d": "two"}


def test_only_the_batch_is_shuffled_to_the_old_ids(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    append_unique(spark.range(2000).selectExpr("cast(id as string) as _id", "id"), path, buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = refuse_known(spark.range(1990, 2010).selectExpr("cast(id as string) as _id", "id"), path)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert new.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    old = plan[:plan.index("Bucketed: true")]
    assert "SortMergeJoin" in plan and "Exchange" not in old[old.rindex("SortMergeJoin"):].split(":- ")[-1].split("+- Sort")[-1]
    assert "SelectedBucketsCount: 8 out of 8" in plan


def test_ids_are_rebuilt_from_the_documents(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    append_to_collection(_docs(spark, ["x", "y"], "plain"), path)  # without the table of ids
    rebuild_ids(spark, path)
    rebuild_ids(spark, path)
    assert append_unique(_docs(spark, ["x", "z"], "more"), path) == (1, 1)
    assert sorted(r["_id"] for r in spark.table(id_table(spark, path)).collect()) == ["x", "y", "z"]


def _rows_scanned(df):
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan"):
        node = node.executedPlan() if node.nodeName().startswith("Adaptive") else node.children().apply(0) if node.children().length() else node.child()
    return node.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("layout", ["ranges", "bloom"])
def test_a_find_by_id_skips_row_groups(spark, tmp_dir, layout):
    path = os.path.join(tmp_dir, "c")
    docs = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("_id"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    spark.conf.set("parquet.block.size", str(64 << 10))  # small row groups
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2000")
    try:
        if layout == "ranges":
            append_to_collection(docs, path, add_meta=False, cluster_by="_id")
        else:
            append_to_collection(docs.repartition(8), path, add_meta=False, bloom="_id")
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    wanted = docs.where("n = 12345").first()["_id"]
    found = read_collection(spark, path).where(F.col("_id") == wanted)
    assert [r["n"] for r in found.collect()] == [12345]
    assert _rows_scanned(read_collection(spark, path).where(F.col("_id") == wanted)) <= 4000


def test_hot_value_in_cluster_ranges(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    docs = spark.range(9000).selectExpr("case when id % 3 = 0 then 7 else id end as k", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is too small for many files otherwise
    try:
        assert append_to_collection(docs, path, cluster_by="k") == 9000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = collection_scan(spark, path, {"k": 7}).select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1 and collection_scan(spark, path, {"k": 7}).count() == 3001
