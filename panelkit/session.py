"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "panelkit", master: str | None = None) -> SparkSession.Builder:
    """A session builder with the settings the operators expect.

    AQE coalesces the shuffle partitions, so the initial number may be
    generous on a cluster; it is left to the caller.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return b.master(master) if master else b


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC instants everywhere; pin the session to that."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location is read from ``spark.checkpoint.dir``.  Where the session names
    none, a local session uses a temporary folder; a cluster session is refused,
    because executors could not see a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="panelkit-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system drop a scratch folder when the driver's JVM shuts down."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    For results that several branches of a plan use: the branches prune
    different columns, so Spark would otherwise scan the raw input once per
    branch.  The written table also cuts the lineage, survives lost executors
    and prunes columns and row groups.  It goes when the driver's JVM ends.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fanned_out(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition rows for work that is heavy in CPU but light in bytes.

    An explicit partition count keeps AQE from merging such rows into one task
    because they are few.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)
