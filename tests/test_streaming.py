"""Payload landing as a file stream: incremental, one epoch folder per micro-batch."""

import json
import os

from regiopanel.sources.collection import collection_scan
from regiopanel.sources.payload import payload_schema
from regiopanel.streaming import land_payloads


def _land(folder, name, hours, base):
    doc = {"site": "wien", "hourly": {"time": [f"2025-12-05T{h:02d}:00" for h in hours],
                                      "pm10": [base + h for h in hours]}}
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(json.dumps(doc) + "\n")


def test_landing_is_incremental(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    coll = os.path.join(tmp_dir, "coll")
    ckpt = os.path.join(tmp_dir, "ckpt")
    schema = payload_schema({"pm10": "double"}, keys={"site": "string"})
    _land(landing, "a.json", range(0, 3), 10.0)
    land_payloads(spark, landing, schema, coll, ckpt, keep=["site"]).awaitTermination()
    assert collection_scan(spark, coll).count() == 3
    _land(landing, "b.json", range(3, 5), 10.0)
    land_payloads(spark, landing, schema, coll, ckpt, keep=["site"]).awaitTermination()
    rows = collection_scan(spark, coll).orderBy("time").collect()
    assert [r["pm10"] for r in rows] == [10.0, 11.0, 12.0, 13.0, 14.0]
    assert {r["site"] for r in rows} == {"wien"}
    assert len({r["epoch"] for r in rows}) == 2


def test_two_streams_into_one_collection_keep_all_rows_and_a_replay_none_twice(spark, tmp_dir):
    coll = os.path.join(tmp_dir, "coll")
    schema = payload_schema({"pm10": "double"}, keys={"site": "string"})
    for name in ("one", "two"):
        landing = os.path.join(tmp_dir, name)
        os.makedirs(landing)
        _land(landing, "a.json", range(0, 2), 10.0)
        land_payloads(spark, landing, schema, coll, os.path.join(tmp_dir, "ckpt-" + name), keep=["site"]).awaitTermination()
    assert collection_scan(spark, coll).count() == 4
    # the commit of stream one's epoch is lost: the epoch is run again and replaces its folder
    for name in ("0", ".0.crc"):
        os.remove(os.path.join(tmp_dir, "ckpt-one", "commits", name))
    land_payloads(spark, os.path.join(tmp_dir, "one"), schema, coll, os.path.join(tmp_dir, "ckpt-one"), keep=["site"]).awaitTermination()
    assert collection_scan(spark, coll).count() == 4
