"""Settings read from the session: the shared folder and the bounds for what is sent to every task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows a table may have to be broadcast or collected; beyond it every operator has a shuffled way.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset and the master is local
    (tests, one machine) a folder is made and set as the checkpoint folder; on a cluster that is an error, since a folder
    of one machine would hold a part of the rows only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="catalens-", dir=os.environ.get("CATALENS_TMP")))
        where = spark.sparkContext.getCheckpointDir()
    return where


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage that survives lost executors. The folder is
    deleted when the driver ends."""
    to = run_dir(df.sparkSession, name)
    df.write.parquet(to)
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for per-row work in Python on inputs of a few
    files: one large Parquet row group is one task otherwise. Inputs with enough partitions aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
