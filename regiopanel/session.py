"""Session helpers: shared scratch location and local defaults for tests and the bench."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, is_remote


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is visible to every executor. Only when it
    is unset in local mode (tests, the bench) do we create one ourselves and register it with the
    context, so ``DataFrame.checkpoint()`` and our written scratch tables land in the same place;
    unset on a cluster is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context handle, the server's setting is all there is
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        if configured:
            sc.setCheckpointDir(configured)
            return sc.getCheckpointDir() or configured
    if configured:
        return configured
    master = spark.conf.get("spark.master", None)
    if master is None or not re.match(r"local(\[|$)", master):  # unknown (Spark Connect) is not local
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                           "(a machine-local temporary folder is not visible to the executors)")
    local = tempfile.mkdtemp(prefix="regiopanel-ckpt-", dir="/tmp")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    if sc is not None:
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir() or local
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint root for an intermediate written table.

    Frames are lazy, so a table must outlive the call that wrote it; :func:`clear_scratch` removes all of
    this application's when its results have been taken.
    """
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        app = spark.conf.get("spark.app.id", "connect")
    return f"{checkpoint_root(spark).rstrip('/')}/regiopanel-scratch/{app}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by the file system of its path."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # Spark Connect: no JVM handle, so ask a reader
        try:
            spark.read.format("binaryFile").load(path).limit(0).collect()
            return True
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(conf).exists(where))


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables that this application has written under the checkpoint root."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(conf).delete(path, True)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "regiopanel") -> SparkSession:
    """A local session with the settings the tests and the bench use (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REGIOPANEL_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def unique_suffix() -> str:
    return uuid.uuid4().hex[:8]


#: Files of an intermediate table at most: so many for each core of a cluster of fixed size, or one for so many bytes that its plan reads.
FILES_PER_CORE, BYTES_PER_FILE = 4, 32 << 20


def _few_files(df):
    """``df`` in no more partitions than the cluster and its input call for: each would be a file of its own, and small ones cost more
    than they hold. Partitions are only put together, not shuffled, and large inputs keep all of theirs. With dynamic allocation the
    size isn't known, so nothing changes."""
    spark = df.sparkSession
    if is_remote() or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    cores = spark.sparkContext.defaultParallelism
    return df.coalesce(min((1 << 31) - 1, max(1, FILES_PER_CORE * cores, size // BYTES_PER_FILE)))


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the checkpoint root and return a scan of it.

    Cuts the lineage like ``checkpoint()`` but in a single job (a reliable checkpoint computes its
    plan twice unless the frame is cached first); the files live in the shared folder, so a lost
    executor does not take the data with it.
    """
    path = scratch_path(df.sparkSession, name)
    _few_files(df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_frame(spark, rows, schema):
    """A DataFrame of a few driver-side rows (a summary, a lookup dict) built entirely in the JVM.

    ``createDataFrame(list)`` ships pickled rows that Python workers must decode; this expresses
    the rows as literals (``inline`` of an array of structs over a one-row range) instead.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not rows:
        typed = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        return spark.range(1).select(*typed).filter(F.lit(False))
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
               for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
