"""One regression forest per group.

Plan
----
1. Complete rows (label and features present) get a deterministic split flag (M2).
2. One grouped count sizes every group and its split (A5).
3. The forests of all eligible groups grow together, a level at a time (:mod:`regiopanel.operators.forest`): the number
   of jobs follows the depth of the trees, not the groups, and nothing but counters reaches the driver.
4. Metrics for all groups come from one grouped aggregate over the predictions (M6, M7).

``ForestParams(trainer="ml")`` fits Spark ML's ``VectorAssembler`` + ``RandomForestRegressor`` for each group instead, driven from a bounded
thread pool, for few groups whose forests should be Spark's own: the rows are written once, in a subfolder per group (named by
a hash of the keys, so any key value, the empty string too, is possible) and in one file for every ``ROWS_PER_FILE`` rows of the
group, so a fit reads only its own folder and the layout depends on the data alone (T8). Each group's test predictions are
written to its own folder of one predictions table. A group whose fit fails is reported in the gate.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, is_remote
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiopanel.operators import forest
from regiopanel.operators.evaluate import hash_split, regression_metrics
from regiopanel.session import materialize, scratch_path, small_frame


@dataclass(frozen=True)
class ForestParams:
    """Defaults are the reference's settings."""

    num_trees: int = 200
    max_depth: int = 8
    seed: int = 42
    min_rows: int = 10
    train_share: float = 0.8
    split: str = "hash"  # "hash": md5 buckets of the row keys (T8); "random": drawn by ``seed``
    trainer: str = "levels"  # "levels": all groups at once; "ml": a Spark ML fit for each group
    python_model: bool = False  # with "ml", True: fit a pyspark.ml Pipeline and keep its Python model object


#: Rows of a group in a file of the training table.
ROWS_PER_FILE = 1_000_000
#: Fits at a time at most: each holds driver memory. It doesn't change any result.
MAX_FITS = 32


@dataclass
class GroupForests:
    predictions: DataFrame  # keys..., order, actual, predicted (test rows of every fitted group)
    metrics: DataFrame      # keys..., n_train, n_test, rmse, r2 (one row per fitted group)
    gate: DataFrame         # keys..., n_rows, eligible, error (every group: fitted, skipped or failed)


def group_id(keys):
    """The folder name of a group: a hash of its keys that tells null from empty text."""
    return F.md5(F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in keys])))


def _score(estimator, assembler, train: DataFrame, test: DataFrame, params: ForestParams) -> DataFrame:
    """Test rows with ``__pred``. The fitted model stays in the JVM where that is possible: the Python wrapper
    wraps every tree through Py4J (about 14k calls for 200 trees), work on the driver that serialises
    concurrent fits. Without those handles (Spark Connect, other versions) the public path does the same."""
    if not params.python_model and not is_remote() and hasattr(estimator, "_fit_java") and hasattr(test, "_jdf"):
        java_model = estimator._fit_java(assembler.transform(train))
        return DataFrame(java_model.transform(assembler.transform(test)._jdf), test.sparkSession)
    from pyspark.ml import Pipeline

    return Pipeline(stages=[assembler, estimator]).fit(train).transform(test)


def _fit_one(rows: DataFrame, keys, features, label: str, order: str, params: ForestParams, out_path: str,
             split_counts: tuple[int, int]) -> tuple[int, int]:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    if params.split == "random":
        # the reference's randomSplit; reproducible because the group's files and their order are fixed
        ordered = rows.sortWithinPartitions(order, label, *features)
        train, test = ordered.randomSplit([params.train_share, 1.0 - params.train_share], seed=params.seed)
        n_train, n_test = train.count(), test.count()
    else:  # split sizes were counted for all groups in the gate aggregate
        train = rows.filter(F.col("is_train"))
        test = rows.filter(~F.col("is_train"))
        n_train, n_test = split_counts
    if n_train == 0 or n_test == 0:
        return n_train, n_test
    assembler = VectorAssembler(inputCols=list(features), outputCol="__features")
    estimator = RandomForestRegressor(featuresCol="__features", labelCol=label, predictionCol="__pred",
                                      numTrees=params.num_trees, maxDepth=params.max_depth, seed=params.seed)
    scored = _score(estimator, assembler, train, test, params)
    preds = scored.select(*keys, order, F.col(label).cast("double").alias("actual"), F.col("__pred").alias("predicted"))
    # One folder per group: concurrent writers must not share a job's temporary directory.
    preds.write.mode("overwrite").parquet(out_path)
    return n_train, n_test


def fit_group_forests(long_df: DataFrame, keys=("region", "pollutant"), label: str = "label",
                      features=("traffic", "year_feature"), order: str = "period",
                      params: ForestParams = ForestParams(), parallelism: int | None = None) -> GroupForests:
    """M5: fit and apply one forest per group of ``long_df`` (one label column, long layout).

    Rows need every key (a group is named by its keys), the label and the features. Groups without a row on one side of the split
    have no predictions and no rmse and r2. With ``trainer="ml"`` a fit that raises doesn't stop the
    others: its group has no metrics, and its message is in the gate.
    """
    if params.trainer not in ("levels", "ml"):
        raise ValueError("trainer must be 'levels' or 'ml'")
    spark = long_df.sparkSession
    keys = list(keys)
    features = list(features)
    complete = long_df.select(*keys, order, label, *features).na.drop(how="any", subset=[*keys, label, *features])
    if params.trainer == "levels" and params.split == "random":
        drawn = F.pmod(F.xxhash64(F.lit(params.seed), *keys, order, label, *features), F.lit(1_000_000))
        split = complete.withColumn("is_train", drawn < F.lit(int(round(params.train_share * 1_000_000))))
    else:
        split = hash_split(complete, [*keys, order], params.train_share)
    split = materialize(split.withColumn("__group", group_id(keys)), "group-split")

    sized = materialize(split.groupBy("__group", *keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("is_train"), F.lit(1))).alias("n_train")).withColumn(
        "eligible", F.col("n_rows") >= F.lit(params.min_rows)), "group-sizes")
    if params.trainer == "levels":
        return _all_groups(split, sized, keys, label, features, order, params)
    eligible = sized.filter("eligible").orderBy("__group").collect()

    table = scratch_path(spark, "group-rows")
    files = F.ceil(F.col("n_rows") / ROWS_PER_FILE)
    (split.join(sized.select("__group", "n_rows"), "__group")
     .withColumn("__file", F.pmod(F.xxhash64(order, label, *features), files)).drop("n_rows")
     .repartition("__group", "__file").sortWithinPartitions("__group", "__file", order, label, *features).drop("__file")
     .write.mode("overwrite").partitionBy("__group").parquet(table))
    schema = T.StructType([f for f in split.schema.fields if f.name != "__group"])

    out_path = scratch_path(spark, "group-predictions")
    # a fit alternates driver work (planning, tree bookkeeping) with short tasks, so twice the
    # cluster's task slots keeps the executors busy
    try:
        slots = spark.sparkContext.defaultParallelism
    except Exception:  # Spark Connect
        slots = os.cpu_count() or 4
    workers = parallelism or max(1, min(len(eligible), 2 * slots, MAX_FITS))

    def fit(group) -> tuple:
        try:
            rows = spark.read.schema(schema).parquet(f"{table}/__group={group['__group']}")
            counts = group["n_train"], group["n_rows"] - group["n_train"]
            return *_fit_one(rows, keys, features, label, order, params, f"{out_path}/{group['__group']}", counts), None
        except Exception as e:  # reported, not hidden: see the gate
            return None, None, f"{type(e).__name__}: {e}"[:500]

    with ThreadPoolExecutor(max_workers=workers) as pool:
        fitted = list(pool.map(inheritable_thread_target(spark)(fit), eligible))

    key_fields = [schema[k] for k in keys]
    done_schema = T.StructType(key_fields + [T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
                                             T.StructField("error", T.StringType())])
    done = small_frame(spark, [(*[g[k] for k in keys], *f) for g, f in zip(eligible, fitted)], done_schema)
    gate = sized.select(*keys, "n_rows", "eligible").join(done.select(*keys, "error"), keys, "left")
    pred_schema = T.StructType(key_fields + [schema[order], T.StructField("actual", T.DoubleType()),
                                             T.StructField("predicted", T.DoubleType())])
    folders = [f"{out_path}/{g['__group']}" for g, (n_train, n_test, error) in zip(eligible, fitted) if not error and n_train and n_test]
    predictions = spark.read.schema(pred_schema).parquet(*folders) if folders else small_frame(spark, [], pred_schema)
    metrics = (done.where("error is null").join(regression_metrics(predictions, keys).drop("n"), keys, "left")
               .select(*keys, "n_train", "n_test", "rmse", "r2"))
    return GroupForests(predictions=predictions, metrics=metrics, gate=gate)


def _all_groups(split: DataFrame, sized: DataFrame, keys, label: str, features, order: str, params: ForestParams) -> GroupForests:
    fitted = sized.where("eligible and n_train > 0 and n_train < n_rows").select("__group")
    inner = [f"__x{i}" for i in range(len(features))]  # names that no column of the caller has
    rows = split.join(fitted, "__group").select(
        F.col("__group").alias("group"), "is_train", F.col(label).cast("double").alias("__label"), F.col(order).alias("__order"),
        *[F.col(f"`{f}`").cast("double").alias(x) for f, x in zip(features, inner)])
    scored, _ = forest.fit_predict(rows, "__label", inner, params.num_trees, params.max_depth, params.seed, keep=["__order"])
    named = sized.select(F.col("__group").alias("group"), *keys)
    predictions = materialize(scored.join(named, "group").select(*keys, F.col("__order").alias(order), "actual", "predicted"), "group-predictions")
    counts = sized.where("eligible").select(*keys, "n_train", (F.col("n_rows") - F.col("n_train")).alias("n_test"))
    metrics = counts.join(regression_metrics(predictions, keys).drop("n"), keys, "left").select(*keys, "n_train", "n_test", "rmse", "r2")
    gate = sized.select(*keys, "n_rows", "eligible", F.lit(None).cast("string").alias("error"))
    return GroupForests(predictions=predictions, metrics=metrics, gate=gate)


def predictions_long(pred_frames) -> DataFrame:
    """Per-model prediction frames (label column renamed to ``actual``) in one long frame."""
    from regiopanel.sources.collection import ragged_union

    return ragged_union(pred_frames)
