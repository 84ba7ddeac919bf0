"""Session building and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators count on; everything else is left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_CLEANED: set[str] = set()


def build_session(app: str = "gleanery", **conf: str) -> SparkSession:
    """A session with DEFAULTS and ``conf`` (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local session (tests) gets one of its own; a
    cluster is refused, since executors would write where the driver cannot read."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gleanery-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
        atexit.register(__import__("shutil").rmtree, folder, ignore_errors=True)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the cluster delete the shuffle files of finished steps, which it does once the driver has dropped their plans."""
    gc.collect()
    for _ in range(2):  # what the listeners still hold is gone a moment later
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gleanery/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all staged tables of this application; results that still read them must be written before."""
    remove(spark, _run_dir(spark))


def _clean_at_exit(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # the session has ended before
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for what one run keeps; it is deleted when the application ends."""
    if spark.sparkContext.applicationId not in _CLEANED:
        _CLEANED.add(spark.sparkContext.applicationId)
        atexit.register(_clean_at_exit, spark)
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", free: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors.

    The returned frame has the attribute ``staged_path``; ``unstage`` deletes it when it is no longer needed. With ``free`` the
    step's shuffle files are deleted at once, which takes half a second: loops over small tables go without, and so does a local
    session, which has no executors' disks to spare.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if free and not spark.sparkContext.master.startswith("local"):
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete the tables behind frames returned by ``stage``."""
    for df in frames:
        if path := getattr(df, "staged_path", None):
            remove(df.sparkSession, path)
