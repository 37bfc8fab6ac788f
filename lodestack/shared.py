"""Tables in the shared folder: what is written there survives lost executors and cuts lineage.

The folder is the one that spark.checkpoint.dir names. Where that is unset a temporary folder of this machine is
set, but only for a local master: on a cluster each executor would write to its own disk, so that raises.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Masters whose executors are the driver itself: "local" and "local[...]", not "local-cluster".
LOCAL = ("local", "local[")


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != LOCAL[0] and not master.startswith(LOCAL[1]):
            raise RuntimeError(f"spark.checkpoint.dir is unset and {master} does not share this machine's folders")
        base = "file://" + tempfile.mkdtemp(prefix="lodestack-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again; deleted at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestack_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of written() tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodestack_path", None)
        if path:
            fs, p = filesystem(df.sparkSession, path)
            fs.delete(p, True)


#: Bytes below which a table is not worth dealing out, and above which its files give enough tasks.
SPREAD = (1 << 20, 1 << 30)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt out over all cores, where its files give fewer tasks than there are cores and its size is within SPREAD.

    A file of one row group is one task, however many splits it has. Plans that are more than a scan, and larger or smaller tables, stay as they are.
    """
    plan = df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if not SPREAD[0] <= size <= SPREAD[1] or "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


#: Rows and bytes of an Arrow batch handed to Python.
ARROW_ROWS, ARROW_BYTES = 400, 8 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to ours where they are higher; they stay, since plans take them when they run."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
