"""Report frames behind the reference's charts and CSVs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def metric_summary(metrics: DataFrame, by: str = "pollutant", group: str = "region",
                   measures=("r2", "rmse")) -> DataFrame:
    """Mean, exact median and sample std of each measure per ``by``, plus distinct groups.

    NaN is treated as missing (T12): it is skipped by mean and median, and the std of a single
    value is null. The metric frame has one row per (region, pollutant), so a median buffer holds
    at most one value per region.
    """
    aggs = []
    for m in measures:
        x = _nan_to_null(F.col(m))
        aggs += [F.avg(x).alias(f"{m}_mean"), F.median(x).alias(f"{m}_median"),
                 F.stddev_samp(x).alias(f"{m}_std")]
    aggs.append(F.countDistinct(F.col(group)).alias(f"n_{group}s"))
    return metrics.groupBy(by).agg(*aggs).orderBy(by)


def error_bars(summary: DataFrame, measures=("r2", "rmse")) -> DataFrame:
    """V4: mean - std and mean + std next to the summary (the bar and its whiskers)."""
    out = summary
    for m in measures:
        out = (out.withColumn(f"{m}_lo", F.col(f"{m}_mean") - F.col(f"{m}_std"))
               .withColumn(f"{m}_hi", F.col(f"{m}_mean") + F.col(f"{m}_std")))
    return out


def scatter_bounds(preds: DataFrame, keys, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per group, the joint min and max of actual and predicted (the diagonal's ends)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return preds.groupBy(*keys).agg(
        F.least(F.min(actual), F.min(predicted)).alias("lo"),
        F.greatest(F.max(actual), F.max(predicted)).alias("hi"),
        F.count(F.lit(1)).alias("n_points"))


def metrics_by_region(metrics: DataFrame, region: str = "region", pollutant: str = "pollutant") -> DataFrame:
    """M8 / V3: every region's metric table in one frame, with each row's place in its region's
    pollutant-sorted table. Written with ``export_csv(..., partition_by='region')`` it gives one
    file per region."""
    w = Window.partitionBy(region).orderBy(pollutant)
    return metrics.withColumn("position", F.row_number().over(w)).orderBy(region, pollutant)


def spread_ties(df: DataFrame) -> Column:
    """A deterministic hash of the whole row, used as the last sort key.

    A range-partitioned sort cannot split one key value across partitions, so a value held by a
    third of the rows would sort in one task. With the row hash after the real keys, equal keys
    still come out together and in order, but the range boundaries can fall inside them.
    """
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def sort_frame(df: DataFrame, *cols, tie_spread: bool = True) -> DataFrame:
    """O1: global sort (range-partitioned; scales, unlike a driver-side sort)."""
    keys = list(cols) + ([spread_ties(df)] if tie_spread else [])
    return df.orderBy(*keys)


def top_k_per_group(df: DataFrame, group: str, score: str, k: int = 5, tie: str = "region") -> DataFrame:
    """O2 / V6: the ``k`` best rows per group by ``score`` descending.

    T11: NaN sorts last (as the reference's sort does), then nulls; ``tie`` breaks ties
    deterministically. ``row_number() <= k`` is planned with a per-task group limit before the
    shuffle, so a group never ships more than ``k`` rows per task.
    """
    s = F.col(score)
    w = Window.partitionBy(group).orderBy(F.isnan(s).asc_nulls_last(), s.desc_nulls_last(), F.col(tie).asc())
    return (df.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= F.lit(k)))
