"""Session defaults and the one helper that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lodestar") -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver found it. Once per context."""
    context = spark.sparkContext
    if getattr(context, "_lodestar_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lodestar-ship-"), "lodestar.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    context._lodestar_shipped = True


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A
    temporary folder is chosen only for a local master, where driver and
    executors share one disk.
    """
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_base(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors can reach."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master == "local" or context.master.startswith("local["):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written below the checkpoint folder and read again.

    For loops of many rounds: a checkpointed table keeps the planner's estimate
    of its size, which joins multiply in every round; a written one has the size of its files.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The most that ``spread`` may shuffle, whatever the cluster.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, key: str) -> DataFrame:
    """Put a small table that comes in fewer partitions than there are cores on all of them.

    A file of one row group is one task, however many cores wait. Only a table
    of at most ``SPREAD_BYTES`` (the planner's size, as on disk) is moved.
    """
    context = df.sparkSession.sparkContext
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    few = size <= SPREAD_BYTES and df.rdd.getNumPartitions() < context.defaultParallelism
    return df.repartition(context.defaultParallelism, key) if few else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
