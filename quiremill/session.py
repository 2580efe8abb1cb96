"""Session helpers shared by every operator: tables, checkpoints, parallelism."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Broadcasts made by hand stay under this many serialized bytes.
BROADCAST_LIMIT = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers that see this file system find the library, wherever the driver was started."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's shared folder if it names one, else a local one.

    Only a local master gets a machine-local folder; on a cluster the folder must come
    from spark.checkpoint.dir.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quiremill-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it from there: lineage ends, lost executors don't matter."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """As many partitions as the session shuffles into, none put together again: for Python stages whose work isn't told by their input's size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition an input that has fewer partitions than half the cores; larger inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores:
        return df.repartition(cores, *keys)
    return df
