"""Session helpers: configuration, reliable materialisation, shared scratch paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tablelens") -> SparkSession:
    """Session for tests and the local bench. A cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def is_local(master: str) -> bool:
    """Driver and executors are one process (``local``, ``local[8]``, but not ``local-cluster[...]``)."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set in local mode; on a cluster, whose machines would
    each see a folder of their own, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablelens-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read on from there.

    Used where a later pass must see exactly the same rows, also after executors are lost, and to cut
    the lineage of loops. Later passes read only the columns they need.
    """
    path = scratch_path(df.sparkSession, "part")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a plain table scan over all cores, where the files alone give fewer partitions.

    For work that is heavy per row. A large table has more splits than cores and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
