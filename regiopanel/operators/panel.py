"""The regional panel (J1, J2, A1, A2, R2, P16, P17, M1) for all regions in one plan.

The reference loops over regions: filter the measurements of one region, average and pivot them,
left-join that region's yearly traffic, fill, add the year feature, then loop over the labels.
Here the region is a key column, so the same result for every region comes from one keyed plan:
one partial aggregation + shuffle for the pivot, one for the traffic mean, one join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.operators.aggregate import mean_by
from regiopanel.operators.joins import keep_common, left_join_keys
from regiopanel.operators.nulls import drop_incomplete, fill_nulls
from regiopanel.operators.reshape import pivot_categories


def build_panel(measure: DataFrame, traffic: DataFrame, labels, region: str = "region",
                period: str = "period", category: str = "category", value: str = "value",
                traffic_value: str = "traffic", exclude_regions=(), common_only: bool = True,
                safe: str | None = r"\.") -> DataFrame:
    """Wide panel: ``region, period, <one column per label>, traffic``.

    - regions are trimmed once on BOTH sides before matching (T4: the reference trims only the
      measurement side, which loses regions that occur only padded);
    - ``common_only``: only regions present in both inputs (J2, a semi join on the distinct
      traffic regions); ``exclude_regions`` drops e.g. the national row (T13);
    - measurement values are averaged per (region, period, label) and pivoted with the explicit
      ``labels`` list (A2 + R2), so absent labels still get a (null) column and no discovery job
      runs; ``safe`` rewrites characters in the label column names (SC2, T16) and in the categories
      alike, so a category is found in either spelling (``PM2.5`` and ``PM2_5``);
    - traffic is averaged per (region, period) (A1) and left-joined (J1): periods without traffic
      keep their row with a null traffic.
    """
    m = measure.withColumn(region, F.trim(F.col(region)))
    t = traffic.withColumn(region, F.trim(F.col(region)))
    if exclude_regions:
        m = m.filter(~F.col(region).isin(*exclude_regions))
        t = t.filter(~F.col(region).isin(*exclude_regions))
    labels = list(labels)
    if safe:
        m = m.withColumn(category, F.regexp_replace(F.trim(F.col(category)), safe, "_"))
        labels = list(dict.fromkeys(re.sub(safe, "_", name) for name in labels))
    # Both sides are aggregated before they meet: a row per region and period, however many measurements there are.
    pivot = pivot_categories(m, [region, period], category, value, values=labels, agg="avg")
    tmean = mean_by(t, [region, period], traffic_value, traffic_value)
    if common_only:
        pivot = keep_common(pivot, tmean, region)
    return left_join_keys(pivot, tmean, [region, period])


def panel_features(panel: DataFrame, label_columns, region: str = "region", period: str = "period",
                   traffic_value: str = "traffic", impute_missing: float | None = 0.0,
                   label_name: str = "pollutant") -> DataFrame:
    """Long modelling frame: ``region, pollutant, period, label, traffic, year_feature`` (M1).

    Missing traffic becomes ``impute_missing`` (T17, on by default; ``None`` keeps it missing);
    ``year_feature`` is the period as double (P8); rows with a missing label or feature are
    dropped (P17), which also removes rows with a null period (T6).
    """
    if impute_missing is not None:
        panel = fill_nulls(panel, {traffic_value: float(impute_missing)})
    panel = panel.withColumn("year_feature", F.col(period).cast("double"))
    long = panel.unpivot([region, period, traffic_value, "year_feature"], list(label_columns), label_name, "label")
    return drop_incomplete(long, ["label", traffic_value, "year_feature"]).select(
        region, label_name, period, "label", traffic_value, "year_feature")
