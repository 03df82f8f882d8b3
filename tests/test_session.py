"""Scratch location rules: the session's spark.checkpoint.dir, a local fallback only in local mode."""

import pytest
from pyspark.sql import functions as F

from regiopanel.session import checkpoint_root, clear_scratch, materialize, scratch_path


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _NoContextSession:
    """A session without a context handle (as with Spark Connect)."""

    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):
        raise RuntimeError("no context")


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError, match="shared folder"):
        checkpoint_root(_NoContextSession({"spark.master": "spark://cluster:7077"}))


def test_configured_checkpoint_dir_is_used():
    s = _NoContextSession({"spark.master": "yarn", "spark.checkpoint.dir": "s3a://bucket/ckpt"})
    assert checkpoint_root(s) == "s3a://bucket/ckpt"
    assert scratch_path(s, "t").startswith("s3a://bucket/ckpt/regiopanel-scratch/connect/t-")


@pytest.mark.parametrize("values", [{}, {"spark.master": "local-cluster[2,1,1024]"}])
def test_unknown_master_is_not_local(values):
    with pytest.raises(RuntimeError, match="shared folder"):
        checkpoint_root(_NoContextSession(values))


def test_scratch_is_removed_on_request(spark):
    import os

    df = materialize(spark.range(5), "gone")
    path = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    assert df.count() == 5 and os.listdir(path)
    clear_scratch(spark)
    assert not os.path.exists(path)


def test_local_fallback_is_registered(spark):
    root = checkpoint_root(spark)
    assert root and spark.sparkContext.getCheckpointDir()


def test_intermediate_tables_have_few_files_unless_their_input_is_large(spark, tmp_dir, monkeypatch):
    from regiopanel import session

    monkeypatch.setattr(session, "FILES_PER_CORE", 1)
    df = spark.range(0, 1000, 1, 50).repartition(40)
    files = lambda t: t.select(F.input_file_name().alias("f")).distinct().count()
    few = materialize(df, "few")
    assert few.count() == 1000 and files(few) <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "BYTES_PER_FILE", 100)
    assert files(materialize(df, "many")) == 40
