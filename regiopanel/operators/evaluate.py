"""Hash split (M2) and regression metrics for all groups in one aggregate (M6, M7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiopanel.operators.order import with_positions
from regiopanel.operators.quantiles import keyed, order_statistics
from regiopanel.session import materialize


def split_bucket(*keys) -> Column:
    """0..99 bucket of a row from the md5 of its keys joined by '|' (T8).

    Unlike ``randomSplit`` it does not depend on partitioning, and DuckDB computes the same value:
    ``('0x' || substr(md5(k1 || '|' || k2 ...), 1, 8))::BIGINT % 100``.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
                              for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def hash_split(df: DataFrame, keys, train_share: float = 0.8, out: str = "is_train") -> DataFrame:
    """M2: deterministic train/test flag; ``train_share`` of the 100 buckets go to training."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cut = int(round(train_share * 100))
    return df.withColumn(out, split_bucket(*keys) < F.lit(cut))


def quota_split(df: DataFrame, group, keys, test_share: float = 0.2, least: int = 1, out: str = "is_train") -> DataFrame:
    """M2 with exact quotas: of each group's n rows the ``round(test_share * n)`` with the smallest hash of ``keys`` are for testing,
    but at least ``least`` where the group has more rows than that (so R² has rows to score, T9).

    The threshold of each group is an order statistic of its hashes, found for all groups together by counting
    (:mod:`regiopanel.operators.quantiles`); no group is sorted or gathered. The split depends on the rows alone. Rows with equal hashes at
    the threshold (equal keys) are told apart by their place in the order of all columns.
    """
    group, keys = ([c] if isinstance(c, str) else list(c) for c in (group, keys))
    hashed = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in keys]), 12).cast("double")  # 52 bits: exact
    rows, _ = keyed(df, group)
    rows = materialize(rows.withColumn("__x", hashed), "quota-rows")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    quota = F.round(F.col("n") * F.lit(float(test_share)))
    quota = F.when(F.col("n") > least, F.greatest(quota, F.lit(least))).otherwise(quota).cast("long")
    sizes = materialize(sizes.select("g", quota.alias("quota")), "quota-sizes")
    found = order_statistics(rows.select("g", F.col("__x").alias("x")), sizes.where("quota > 0").select("g", (F.col("quota") - 1).alias("rank")))
    found = materialize(found.select("g", F.col("value").alias("__cut"), (F.col("rest") + 1).alias("__take")), "quota-cuts")
    joined = rows.join(found, "g", "left")
    clear = joined.where(F.col("__cut").isNull() | (F.col("__x") != F.col("__cut"))).withColumn(
        out, F.col("__cut").isNull() | (F.col("__x") > F.col("__cut")))
    # Of the rows at the threshold the first ones are for testing, until the quota is full.
    edge = with_positions(joined.where(F.col("__x") == F.col("__cut")), "g", name="__place")
    first = edge.groupBy("g").agg(F.min("__place").alias("__first"))
    edge = edge.join(first, "g").withColumn(out, F.col("__place") - F.col("__first") >= F.col("__take"))
    columns = [*[f"`{c}`" for c in df.columns], out]
    return clear.select(*columns).unionByName(edge.select(*columns))


def regression_metrics(preds: DataFrame, keys, actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    """M6 + M7: ``n, rmse, r2`` per group in ONE grouped aggregate over all groups.

    r2 = 1 - SSerr / SStot with SStot = n * var_pop(actual) (not through the origin). T9: with
    SStot = 0 it is NaN when SSerr = 0 too and -inf otherwise (a single test row), as the ML
    evaluator gives; the explicit branch also avoids a division error under ANSI mode.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    a, p = F.col(actual), F.col(predicted)
    err = (a - p) * (a - p)
    g = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err).alias("sse"),
        (F.var_pop(a) * F.count(a)).alias("sst"),
    )
    r2 = (F.when(F.col("sst") == 0,
                 F.when(F.col("sse") == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf"))))
          .otherwise(F.lit(1.0) - F.col("sse") / F.col("sst")))
    return g.select(*keys, "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), r2.alias("r2"))
