"""The whole analysis on small text exports rebuilt in code (shapes as in FIXTURES §1-2)."""

import os

import pytest

from regiopanel.operators.model import ForestParams
from regiopanel.plans.analysis import analyse_regions, export_reports
from regiopanel.sources import read_delimited

YEARS = list(range(1990, 2022))
STATES = {"Niederoesterreich": 900, "Wien": 400, "OESTERREICH": 5000}


def _german(x: float) -> str:
    whole, frac = f"{x:,.2f}".split(".")
    return whole.replace(",", ".") + "," + frac


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")
    return os.path.join(folder, name)


def test_analysis_end_to_end(spark, tmp_dir):
    header = ["_id"] + [str(y) for y in YEARS] + ["Bundesland", "Unnamed: 28", "_imported_at"]
    rows = [";".join(header)]
    for i, (state, base) in enumerate(STATES.items()):
        cells = [f"id{i}"] + [_german(base * 1000 + 37.5 * (y - 1990)) for y in YEARS]
        rows.append(";".join(cells + [state, "", "2026-01-09 12:59:11.483"]))
    traffic = read_delimited(spark, _write(tmp_dir, "traffic.csv", rows))

    air = ["Region;Jahr;Schadstoff;Werte"]
    for region, base in (("Niederoestereich", 10.0), ("AT", 50.0), ("Wien", 5.0), ("Tirol", 7.0)):
        for y in YEARS:
            air.append(f"{region};{y};NOX;{_german(base + (y - 1990) * 0.5)}")
            air.append(f" {region} ;{y};PM2.5;{_german(base / 2 + (y % 5))}")
            air.append(f"{region};{y};NOX;{_german(base + (y - 1990) * 0.5 + 1)}")  # a duplicate load
    air_df = read_delimited(spark, _write(tmp_dir, "air.csv", air))

    result = analyse_regions(traffic, air_df, labels=("NOX", "PM2.5"),
                             params=ForestParams(num_trees=5, max_depth=3))
    assert result.panel.columns == ["Region", "Jahr", "NOX", "PM2_5", "traffic_road_traffic_avg"]
    panel = {(r["Region"], r["Jahr"]): r for r in result.panel.collect()}
    assert {k[0] for k in panel} == {"Niederoestereich", "AT", "Wien"}  # recoded; Tirol has no traffic
    assert panel[("Wien", 1990)]["NOX"] == 5.5  # duplicates averaged
    assert panel[("AT", 1991)]["traffic_road_traffic_avg"] == 5000037.5
    metrics = result.metrics.collect()
    assert {(r["region"], r["pollutant"]) for r in metrics} == {
        (reg, p) for reg in ("Niederoestereich", "AT", "Wien") for p in ("NOX", "PM2_5")}
    assert all(r["n_train"] + r["n_test"] == len(YEARS) for r in metrics)
    assert result.matrix.columns == ["region", "NOX", "PM2_5"]
    assert {r["pollutant"] for r in result.summary.collect()} == {"NOX", "PM2_5"}
    assert result.top.count() == 6

    paths = export_reports(result, os.path.join(tmp_dir, "reports"))
    regions = sorted(d for d in os.listdir(paths["metrics_by_region"]) if d.startswith("region="))
    assert regions == ["region=AT", "region=Niederoestereich", "region=Wien"]
    back = spark.read.option("header", "true").csv(paths["matrix"])
    assert back.columns == ["region", "NOX", "PM2_5"] and back.count() == 3
    predictions = spark.read.option("header", "true").csv(paths["predictions"])
    assert predictions.columns == ["Jahr", "actual", "predicted", "region", "pollutant"]
    assert predictions.count() == sum(r["n_test"] for r in metrics)
    bounds = spark.read.option("header", "true").csv(paths["scatter_bounds"])
    assert bounds.count() == 6 and {"lo", "hi"} <= set(bounds.columns)
    assert spark.read.option("header", "true").csv(paths["skipped_groups"]).count() == 0


@pytest.mark.parametrize("spelling", ["PM2.5", "PM2_5"])
def test_either_spelling_of_a_label_and_a_label_without_data(spark, tmp_dir, spelling):
    traffic = ["Bundesland;" + ";".join(map(str, YEARS)), "Wien;" + ";".join(_german(1.0 + y) for y in YEARS)]
    air = ["Region;Jahr;Schadstoff;Werte"] + [f"Wien;{y};{spelling};{_german(y % 9)}" for y in YEARS]
    result = analyse_regions(read_delimited(spark, _write(tmp_dir, "t.csv", traffic)),
                             read_delimited(spark, _write(tmp_dir, "a.csv", air)), labels=("PM2.5", "SO2"),
                             params=ForestParams(num_trees=2, max_depth=2))
    assert [r["pollutant"] for r in result.metrics.collect()] == ["PM2_5"]
    gate = {r["pollutant"]: (r["n_rows"], r["eligible"], r["error"]) for r in result.gate.collect()}
    assert gate == {"PM2_5": (len(YEARS), True, None), "SO2": (0, False, None)}
    skipped = spark.read.option("header", "true").csv(export_reports(result, os.path.join(tmp_dir, "r"))["skipped_groups"])
    assert [r["pollutant"] for r in skipped.collect()] == ["SO2"]


def test_analysis_command_line(tmp_dir):
    import subprocess
    import sys

    traffic = ["Bundesland;" + ";".join(str(y) for y in YEARS)]
    traffic += [f"{s};" + ";".join(_german(b * 10.0 + y) for y in YEARS) for s, b in STATES.items()]
    air = ["Region;Jahr;Schadstoff;Werte"] + [f"Wien;{y};NOX;{_german(5 + (y % 7))}" for y in YEARS]
    out = os.path.join(tmp_dir, "cli-out")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-m", "regiopanel.plans.analysis", _write(tmp_dir, "t.csv", traffic),
         _write(tmp_dir, "a.csv", air), out, "--trees", "3", "--depth", "2"],
        cwd=root, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "summary:" in done.stdout
    assert os.path.isdir(os.path.join(out, "metrics_by_region", "region=Wien"))
