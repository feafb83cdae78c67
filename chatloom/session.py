"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "chatloom") -> SparkSession:
    """Session for tests and the benchmark. On a cluster the caller brings its own."""
    master = f"local[{cpus}]"
    parallelism = (os.cpu_count() or 8) if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs more than building most expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; a cluster without it is an error,
    since a machine-local folder would lose staged rows together with an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="chatloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_staged: list[tuple[SparkSession, str]] = []


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is gone when the program ends."""
    folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    _staged.append((spark, folder))
    return f"{folder}/{name}"


@atexit.register
def drop_staged() -> None:
    """Delete what this program has staged; results that still read it must have been written before."""
    while _staged:
        spark, folder = _staged.pop()
        if spark.sparkContext._jsc is not None:  # else the session was stopped, and its files are left to the cluster
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, computes an expensive input once when a plan needs it twice, and gives the optimizer the
    real size in bytes.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
