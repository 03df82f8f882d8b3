"""bench.py keeps the driver's contract: one JSON line with metric, value, unit, queries, sf."""

import json
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_QUERIES="filter_eq,profile_shape",
               BENCH_WARMUP_DIR="/nonexistent")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    record = json.loads(out[0])
    assert record["unit"] == "sec" and record["sf"] == 0.001 and record["metric"]
    assert set(record["queries"]) == {"filter_eq", "profile_shape"}
    assert record["value"] == pytest.approx(sum(record["queries"].values()), abs=0.01)
