"""The whole regional analysis as one call: text tables in, panel, forests and report frames out.

Input shapes (as exported from the document store):
  traffic_wide: one row per state, the state name in ``region_col``, one text column per year
                (digit names), local number format; other columns (_id, stamps, an empty
                trailing column) are ignored.
  air_long:     ``Region, Jahr, Schadstoff, Werte`` as text, local number format.

Every step is a DataFrame operator over all regions at once; the only driver loop left is the
bounded set of model fits inside ``fit_group_forests``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.functions.locale import locale_number, year_int
from regiopanel.functions.recode import REGION_MAP, recode
from regiopanel.operators.model import ForestParams, GroupForests, fit_group_forests
from regiopanel.operators.panel import build_panel, panel_features
from regiopanel.operators.report import metric_summary, metrics_by_region, scatter_bounds, sort_frame, top_k_per_group
from regiopanel.operators.reshape import metric_matrix, unpivot_digit_columns
from regiopanel.operators.schema import trim_names
from regiopanel.session import clear_scratch
from regiopanel.sources.delimited import export_csv

# The pollutant labels modelled by default and the two feature column names.
LABELS = ("NOX", "SO2", "NMVOC", "NH3", "PM2.5")
TRAFFIC_FEATURE = "traffic_road_traffic_avg"
YEAR_FEATURE = "year_feature"


@dataclass
class RegionalAnalysis:
    panel: DataFrame      # Region, Jahr, one column per label, traffic_road_traffic_avg
    features: DataFrame   # Region, pollutant, Jahr, label, traffic_road_traffic_avg, year_feature
    forests: GroupForests
    metrics: DataFrame    # region, pollutant, n_train, n_test, rmse, r2
    summary: DataFrame    # A6 per pollutant
    matrix: DataFrame     # R3 region x pollutant of r2
    top: DataFrame        # O2 best regions per pollutant
    gate: DataFrame       # A5: every region with every listed label, also those without a row


def traffic_long_from_wide(wide: DataFrame, region_col: str = "Bundesland", region_map=REGION_MAP,
                           year: str = "Jahr", value: str = "traffic", on_error: str = "fail") -> DataFrame:
    """SC1 -> SC3/R1 -> P7 -> P1 -> P9: (Region, year, value) from the wide text export."""
    wide = trim_names(wide)
    long = unpivot_digit_columns(wide, [region_col], "__year", "__raw", name_type=None)
    return long.select(recode(F.trim(F.col(region_col)), region_map).alias("Region"),
                       year_int(F.col("__year"), on_error).alias(year),
                       locale_number(F.col("__raw")).alias(value))


def measures_from_text(air: DataFrame, year: str = "Jahr", value: str = "Werte",
                       on_error: str = "fail") -> DataFrame:
    """SC1 -> P7 -> P1 on the long pollutant export."""
    air = trim_names(air)
    return (air.withColumn(year, year_int(F.col(year), on_error))
            .withColumn(value, locale_number(F.col(value))))


def analyse_regions(traffic_wide: DataFrame, air_long: DataFrame, labels=LABELS,
                    params: ForestParams = ForestParams(), impute_missing: float | None = 0.0,
                    exclude_regions=(), region_map=REGION_MAP, region_col: str = "Bundesland",
                    top_k: int = 5, on_error: str = "fail") -> RegionalAnalysis:
    """The reference's analysis for every region: panel, one forest per (region, pollutant),
    metrics, summary, R² matrix and top-k, all as DataFrames."""
    traffic = traffic_long_from_wide(traffic_wide, region_col, region_map, "Jahr", TRAFFIC_FEATURE, on_error)
    air = measures_from_text(air_long, "Jahr", "Werte", on_error)
    panel = build_panel(air, traffic, labels, region="Region", period="Jahr", category="Schadstoff",
                        value="Werte", traffic_value=TRAFFIC_FEATURE, exclude_regions=exclude_regions)
    label_cols = list(dict.fromkeys(c.replace(".", "_") for c in labels))
    features = panel_features(panel, label_cols, region="Region", period="Jahr",
                              traffic_value=TRAFFIC_FEATURE, impute_missing=impute_missing)
    forests = fit_group_forests(features, keys=("Region", "pollutant"), label="label",
                                features=(TRAFFIC_FEATURE, YEAR_FEATURE), order="Jahr", params=params)
    metrics = forests.metrics.withColumnRenamed("Region", "region")
    listed = panel.select("Region").distinct().withColumn("pollutant", F.explode(F.array(*map(F.lit, label_cols))))
    gate = listed.join(forests.gate, ["Region", "pollutant"], "left").select(
        F.col("Region").alias("region"), "pollutant", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("eligible", F.lit(False)).alias("eligible"), "error")
    return RegionalAnalysis(
        panel=panel, features=features, forests=forests, metrics=metrics,
        summary=metric_summary(metrics, by="pollutant", group="region"),
        matrix=metric_matrix(metrics, "region", "pollutant", "r2", values=sorted(label_cols)),
        top=top_k_per_group(metrics, "pollutant", "r2", k=top_k, tie="region"), gate=gate)


#: Files that a model's exported predictions are spread over.
EXPORT_SALTS = 4


def export_reports(result: RegionalAnalysis, out_dir: str) -> dict[str, str]:
    """IO9 for the whole analysis: the report tables as CSV folders, one distributed write each.

    ``metrics_by_region/region=<r>/`` holds each region's table (sorted by pollutant when read in
    ``position`` order), ``top_by_pollutant/pollutant=<p>/`` each pollutant's best regions;
    ``predictions/region=<r>/pollutant=<p>/`` a model's test rows with their predictions; the
    all-regions table, the per-pollutant summary, the R² matrix, the scatter bounds per model and the
    groups without a model (too few rows, or a failed fit) are single folders.
    Returns the folder of each report.
    """
    out = out_dir.rstrip("/")
    paths = {
        "metrics_by_region": f"{out}/metrics_by_region",
        "all_metrics": f"{out}/all_metrics",
        "summary": f"{out}/summary",
        "matrix": f"{out}/matrix",
        "top_by_pollutant": f"{out}/top_by_pollutant",
        "predictions": f"{out}/predictions",
        "scatter_bounds": f"{out}/scatter_bounds",
        "skipped_groups": f"{out}/skipped_groups",
    }
    metrics = result.metrics.select("region", "pollutant", "rmse", "r2")
    export_csv(metrics_by_region(metrics), paths["metrics_by_region"], partition_by="region")
    export_csv(sort_frame(metrics, "region", "pollutant"), paths["all_metrics"])
    export_csv(result.summary, paths["summary"])
    export_csv(result.matrix, paths["matrix"])
    export_csv(result.top.select("pollutant", "rank", "region", "rmse", "r2"), paths["top_by_pollutant"],
               partition_by="pollutant")
    predictions = result.forests.predictions.withColumnRenamed("Region", "region")
    # A model's rows go to as many tasks, and files, as ``EXPORT_SALTS``, told apart by a hash of the row: none writes a large group alone.
    salt = F.pmod(F.xxhash64("Jahr", "actual", "predicted"), F.lit(EXPORT_SALTS))
    export_csv(predictions.repartition("region", "pollutant", salt).sortWithinPartitions("region", "pollutant", "Jahr"),
               paths["predictions"], partition_by=["region", "pollutant"])
    export_csv(scatter_bounds(predictions, ["region", "pollutant"]), paths["scatter_bounds"])
    export_csv(result.gate.where("not eligible or error is not null"), paths["skipped_groups"])
    return paths


def main(argv=None) -> int:
    """Command line: ``python -m regiopanel.plans.analysis TRAFFIC_CSV POLLUTANT_CSV OUT_DIR``.

    Reads both ';' exports as text, runs the analysis and writes the report folders. Under
    spark-submit the submitted session is used; run directly it starts a local one.
    """
    import argparse

    from pyspark.sql import SparkSession

    from regiopanel.sources.delimited import read_delimited

    ap = argparse.ArgumentParser(description=main.__doc__.splitlines()[0])
    ap.add_argument("traffic_csv")
    ap.add_argument("pollutant_csv")
    ap.add_argument("out_dir")
    ap.add_argument("--sep", default=";")
    ap.add_argument("--trees", type=int, default=ForestParams.num_trees)
    ap.add_argument("--depth", type=int, default=ForestParams.max_depth)
    ap.add_argument("--exclude", nargs="*", default=[], help="regions to leave out, e.g. AT")
    args = ap.parse_args(argv)
    spark = SparkSession.getActiveSession()
    if spark is None:
        from regiopanel.session import local_session

        spark = local_session()
    result = analyse_regions(read_delimited(spark, args.traffic_csv, sep=args.sep),
                             read_delimited(spark, args.pollutant_csv, sep=args.sep),
                             params=ForestParams(num_trees=args.trees, max_depth=args.depth),
                             exclude_regions=tuple(args.exclude))
    for name, path in export_reports(result, args.out_dir).items():
        print(f"{name}: {path}")
    clear_scratch(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
