"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "scanloom") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """What runs inside runs with these settings of the session; afterwards they are as they were."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster a
    missing setting is an error, because a driver-local folder would not be shared.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="scanloom-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/scanloom/{purpose}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """The path as the file system of a machine names it; only folders that all machines have mounted have one."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"{path} is not in a mounted folder")
    return "/" + rest.lstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives executor loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
