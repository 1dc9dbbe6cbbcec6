"""Session helpers. A cluster brings its own session; the builder here serves tests and bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session with the settings the checks assume."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WRENCHLAKE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master, where that is unset, may use a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="wrenchlake-")
    return _LOCAL_DIRS[app]


_MADE: list[str] = []


def new_shared_folder(spark: SparkSession) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/wrenchlake-stage/{uuid.uuid4().hex}"
    # Other threads add theirs.
    _MADE.append(path)
    return path


def folders_made() -> list[str]:
    """All paths that new_shared_folder has given out in this process, in order."""
    return list(_MADE)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, on whichever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame) -> DataFrame:
    """Write a step of an iterative job to the shared folder and read it back.

    This cuts the lineage, survives lost executors, runs the step once, and gives the next
    step the true size of its input, which a checkpoint would not.
    """
    path = new_shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
