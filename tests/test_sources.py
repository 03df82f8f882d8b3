"""Sources and sinks: IO1-IO10 on small inline fixtures (rebuilt in code, not read from the reference)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from regiopanel.sources import (
    append_to_collection,
    collection_scan,
    export_csv,
    load_locale_csv,
    payload_rows,
    ragged_union,
    read_delimited,
    read_document_dump,
    read_export,
    read_payloads,
    save_decimal_csv,
)


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    full = os.path.join(path, name)
    with open(full, "w", encoding="utf-8") as fh:
        fh.write(text)
    return full


LONG_TRAFFIC = (
    "NUTS1;NUTS2;NUTS3;DISTRICT_CODE;SUB_DISTRICT_CODE;YEAR;UNIT;REF_YEAR;ROAD_TRAFFIC;SCWR_CALC\n"
    "AT1;AT13;AT130;90001;0;1990;1.000 t;2022;2162,23; 1.344,17 \n"
    "AT1;AT13;AT130;90001;0;1991;1.000 t;2022;2396,25; 1.386,75 \n"
)


def test_locale_typed_load_golden_row(spark, tmp_dir):
    path = _write(tmp_dir, "long.csv", LONG_TRAFFIC)
    df = load_locale_csv(spark, path)
    types = dict(df.dtypes)
    assert types["YEAR"] == "bigint" and types["DISTRICT_CODE"] == "bigint"
    assert types["UNIT"] == "string" and types["NUTS1"] == "string"
    assert types["ROAD_TRAFFIC"] == "double" and types["SCWR_CALC"] == "double"
    row = df.orderBy("YEAR").first()
    assert row["ROAD_TRAFFIC"] == pytest.approx(2162.23)
    assert row["SCWR_CALC"] == pytest.approx(1344.17)
    assert row["UNIT"] == "1.000 t"


def test_locale_typed_load_all_or_nothing(spark, tmp_dir):
    path = _write(tmp_dir, "mixed.csv", "a;b;c\n1;1,5;x\n2;;3\nNA;2;4\n")
    df = load_locale_csv(spark, path)
    types = dict(df.dtypes)
    assert types["a"] == "double"  # a missing value: numeric but not integer (pandas gives float)
    assert types["b"] == "double"
    assert types["c"] == "string"  # one value does not parse: the column stays text


def test_delimited_scan_strings_and_trailing_column(spark, tmp_dir):
    path = _write(tmp_dir, "wide.csv", "_id;1980;1990;Bundesland;\nx;277000;393000;Burgenland;\n")
    df = read_delimited(spark, path)
    assert all(t == "string" for _, t in df.dtypes)
    assert df.columns[-1] == "_c4"


def test_payload_rows_sorted_and_typed(spark, tmp_dir):
    doc = {"hourly": {"time": ["2025-12-05T01:00", "2025-12-05T00:00"], "pm10": [2.0, 1.0],
                      "us_aqi": [20, 10]}}
    path = _write(tmp_dir, "p.json", json.dumps(doc) + "\n")
    rows = payload_rows(read_payloads(spark, path)).collect()
    assert [r["pm10"] for r in rows] == [1.0, 2.0]
    assert rows[0]["time"].isoformat() == "2025-12-05T00:00:00"
    assert rows[0].__fields__[0] == "time"


def test_payload_unequal_arrays_raise(spark, tmp_dir):
    doc = {"hourly": {"time": ["2025-12-05T00:00", "2025-12-05T01:00"], "pm10": [1.0]}}
    path = _write(tmp_dir, "bad.json", json.dumps(doc) + "\n")
    with pytest.raises(Exception):
        payload_rows(read_payloads(spark, path)).collect()


def test_payload_without_hourly_is_empty(spark, tmp_dir):
    path = _write(tmp_dir, "none.json", json.dumps({"latitude": 48.2}) + "\n")
    out = payload_rows(read_payloads(spark, path))
    assert out.columns == ["time"] and out.count() == 0


def test_collection_append_and_scan(spark, tmp_dir):
    col = os.path.join(tmp_dir, "coll")
    a = spark.createDataFrame([("Wien", 1), ("Tirol", 2)], "Bundesland string, v int")
    b = spark.createDataFrame([("Wien", 3.5)], "Bundesland string, w double")
    assert append_to_collection(a, col) == 2
    assert append_to_collection(b, col) == 1
    all_docs = collection_scan(spark, col)
    assert set(all_docs.columns) >= {"Bundesland", "v", "w", "_id", "_imported_at"}  # IO7 ragged
    assert all_docs.select("_imported_at").distinct().count() == 2  # one stamp per call (T18)
    wien = collection_scan(spark, col, query={"Bundesland": "Wien"}, projection={"v": 1, "_id": 0})
    assert wien.columns == ["v"] and sorted(r["v"] for r in wien.collect() if r["v"]) == [1]
    limited = collection_scan(spark, col, query={"v": {"$gte": 1}}, limit=1, order_by="v")
    assert [r["v"] for r in limited.collect()] == [1]
    dropped = collection_scan(spark, col, projection={"_imported_at": 0})
    assert "_imported_at" not in dropped.columns


def test_ragged_union(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, 3.0)], "k int, b double")
    rows = ragged_union([a, b]).orderBy("k").collect()
    assert rows[0]["b"] is None and rows[1]["a"] is None


def test_decimal_csv_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, 1234.5, "a b", None), (2, -0.25, "", float("nan"))],
                               "id int, x double, s string, y double")
    out = os.path.join(tmp_dir, "export")
    save_decimal_csv(df, out)
    lines = []
    for name in sorted(os.listdir(out)):
        if name.endswith(".csv"):
            with open(os.path.join(out, name), encoding="utf-8") as fh:
                lines += [ln.rstrip("\n") for ln in fh]
    assert "id;x;s;y" in lines
    assert "1;1234,5;a b;" in lines
    assert "2;-0,25;;" in lines


def test_typed_document_dump(spark, tmp_dir):
    docs = [{"1980": 277000, "_id": {"$oid": "6960fb9f07813795b1f3129f"}, "Bundesland": "Burgenland",
             "Unnamed: 28": {"$numberDouble": "NaN"}, "_imported_at": {"$date": "2026-01-09T12:59:11.483Z"}}]
    path = _write(tmp_dir, "dump.json", json.dumps(docs))
    df = read_document_dump(spark, path, multi_line=True)
    row = df.first()
    assert row["_id"] == "6960fb9f07813795b1f3129f"
    assert row["_imported_at"].isoformat() == "2026-01-09T12:59:11.483000"
    assert dict(df.dtypes)["Unnamed: 28"] == "double"
    assert row["1980"] == 277000


def test_partitioned_collection_prunes(spark, tmp_dir):
    col = os.path.join(tmp_dir, "by_region")
    df = spark.createDataFrame([("Wien", 1990, 1.0), ("Tirol", 1990, 2.0), ("Wien", 1991, 3.0)],
                               "Region string, Jahr int, v double")
    assert append_to_collection(df, col, partition_by="Region") == 3
    scan = collection_scan(spark, col, query={"Region": "Wien"}, projection={"Jahr": 1, "v": 1, "_id": 0})
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Region" in plan
    assert sorted(r["v"] for r in scan.collect()) == [1.0, 3.0]


def test_typed_dump_millis_date_ignores_session_zone(spark, tmp_dir):
    path = _write(tmp_dir, "millis.json", json.dumps({"d": {"$date": {"$numberLong": "1767963551483"}}}) + "\n")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = read_document_dump(spark, path, multi_line=False).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["d"].isoformat() == "2026-01-09T12:59:11.483000"


def test_locale_typed_load_padded_marker_is_text(spark, tmp_dir):
    path = _write(tmp_dir, "padded.csv", "a;b\n1;2\n NA ;NA\n")
    types = dict(load_locale_csv(spark, path).dtypes)
    assert types["a"] == "string"  # ' NA ' is no marker and no number
    assert types["b"] == "double"  # 'NA' is a marker: numeric with a missing value


def test_payload_pretty_printed_document(spark, tmp_dir):
    doc = {"latitude": 48.2, "hourly": {"time": ["2025-12-05T00:00", "2025-12-05T01:00"],
                                        "pm10": [19.3, 19.3], "us_aqi": [83, 82]}}
    path = _write(tmp_dir, "pretty.json", json.dumps(doc, indent=2))
    rows = payload_rows(read_payloads(spark, path, multi_line=True), keep=["latitude"]).collect()
    assert [(r["time"].hour, r["us_aqi"], r["latitude"]) for r in rows] == [(0, 83, 48.2), (1, 82, 48.2)]


def test_payload_from_dict(spark):
    from regiopanel.sources import payload_dict_rows

    payload = {"hourly": {"time": ["2025-12-05T01:00", "2025-12-05T00:00"], "ozone": [24.0, 28.0]}}
    rows = payload_dict_rows(spark, payload).collect()
    assert [r["ozone"] for r in rows] == [28.0, 24.0] and rows[0]["time"].hour == 0
    assert payload_dict_rows(spark, {"latitude": 1.0}).count() == 0


def test_csv_text_roundtrip(spark, tmp_dir):
    rows = [(1, "  pad  "), (2, 'a "quote"'), (3, "line\nbreak; and \"both\""), (4, '"'), (5, "back\\slash"), (6, "\ttab\t"), (7, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    path = os.path.join(tmp_dir, "text")
    save_decimal_csv(df, path)
    back = read_delimited(spark, path, multi_line=True).select(F.col("id").cast("int"), "text")
    assert sorted(map(tuple, back.collect())) == rows
    path = os.path.join(tmp_dir, "plain")
    export_csv(df, path)
    assert sorted(map(tuple, read_export(spark, path, df.schema, multi_line=True).collect())) == rows


def test_typed_load_keeps_codes_and_types_truth_values(spark, tmp_dir):
    path = os.path.join(tmp_dir, "codes.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("code;flag;gap;num;hex;exp\n12D;True;TRUE;1.000,5;0x1A;1e3\n5F;false;;2;NaNx;-2,5E-3\n")
    df = load_locale_csv(spark, path)
    assert df.dtypes == [("code", "string"), ("flag", "boolean"), ("gap", "boolean"), ("num", "double"), ("hex", "string"), ("exp", "double")]
    assert [tuple(r) for r in df.collect()] == [("12D", True, True, 1000.5, "0x1A", 1000.0), ("5F", False, None, 2.0, "NaNx", -0.0025)]


def test_collection_with_differing_types_is_read(spark, tmp_dir):
    path = os.path.join(tmp_dir, "mixed")
    for kind, value in (("bigint", 1), ("double", 2.5), ("string", "x"), ("int", 4)):
        append_to_collection(spark.createDataFrame([(value, kind)], f"v {kind}, k string"), path, add_meta=False)
    got = {r["k"]: r["v"] for r in collection_scan(spark, path).collect()}
    assert got == {"bigint": "1", "double": "2.5", "string": "x", "int": "4"}
    path = os.path.join(tmp_dir, "numbers")
    for kind, value in (("bigint", 1), ("double", 2.5), ("int", 4)):
        append_to_collection(spark.createDataFrame([(value, kind)], f"v {kind}, {kind}_only string"), path)
    df = collection_scan(spark, path, query={"v": {"$gte": 2}})
    assert dict(df.dtypes)["v"] == "double" and sorted(r["v"] for r in df.collect()) == [2.5, 4.0]


def test_find_semantics(spark, tmp_dir):
    path = os.path.join(tmp_dir, "find")
    rows = [("1", 1, "a"), ("2", 2, None), ("3", None, "b"), ("4", None, None)]
    append_to_collection(spark.createDataFrame(rows, "_id string, n int, t string"), path, add_meta=False)
    ids = lambda q: sorted(r["_id"] for r in collection_scan(spark, path, q).collect())
    assert ids({"n": {"$ne": 1}}) == ["2", "3", "4"]
    assert ids({"n": {"$eq": None}}) == ids({"n": None}) == ids({"n": {"$exists": False}}) == ["3", "4"]
    assert ids({"n": {"$ne": None}}) == ids({"n": {"$exists": True}}) == ["1", "2"]
    assert ids({"n": {"$nin": [1]}}) == ["2", "3", "4"] and ids({"n": {"$nin": [1, None]}}) == ["2"]
    assert ids({"n": {"$in": [2, None]}}) == ["2", "3", "4"]
    assert ids({"$or": [{"n": 1}, {"t": "b"}]}) == ["1", "3"] and ids({"$and": [{"n": 1}, {"t": "b"}]}) == []
    assert ids({"$nor": [{"n": 1}, {"t": "b"}]}) == ["2", "4"]
    assert ids({"n": {"$not": {"$gt": 1}}}) == ["1", "3", "4"] and ids({"t": {"$regex": "^[ab]$"}}) == ["1", "3"]
    assert ids({"other": None}) == ["1", "2", "3", "4"] and ids({"other": 1}) == [] and ids({"other": {"$ne": 1}}) == ["1", "2", "3", "4"]
    assert collection_scan(spark, path, projection={"_id": 1}).columns == ["_id"]
    with pytest.raises(ValueError):
        collection_scan(spark, path, {"n": {"$near": 1}})
    plan = collection_scan(spark, path, {"n": {"$ne": 1}, "t": "a"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t,a)" in plan and "Or(IsNull(n)" in plan


def test_payloads_with_differing_variables(spark, tmp_dir):
    path = os.path.join(tmp_dir, "payload.json")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('{"hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "a": [1.0, 2.0]}}\n')
        fh.write('{"hourly": {"time": ["2025-01-01T02:00"], "b": [3.0]}}\n')
    rows = payload_rows(read_payloads(spark, path)).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1.0, None), (2.0, None), (None, 3.0)]
