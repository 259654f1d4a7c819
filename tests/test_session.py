from types import SimpleNamespace

import pytest

from noctiluca.session import BATCH_SETTING, bounded_batches, cut, ensure_checkpoint_dir, shared_folder, spread


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(10, numPartitions=1), spark.range(10, numPartitions=3 * cores)
    assert spread(few).rdd.getNumPartitions() == cores and spread(few).count() == 10
    assert spread(many) is many
    grouped = few.groupBy("id").count()
    assert spread(grouped) is grouped


def test_checkpoint_folder_stays(spark):
    ensure_checkpoint_dir(spark)
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert cut(spark.range(3)).count() == 3
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == at


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        sparkContext = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
        conf = SimpleNamespace(get=lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Cluster)


def test_shared_folders_differ(spark):
    assert shared_folder(spark, "a") != shared_folder(spark, "a")


def test_batches_are_bounded(spark):
    bounded_batches(spark)
    assert int(spark.conf.get(BATCH_SETTING)) <= 32 << 20
    spark.conf.set(BATCH_SETTING, "1000")
    bounded_batches(spark)
    assert spark.conf.get(BATCH_SETTING) == "1000"
    spark.conf.unset(BATCH_SETTING)
