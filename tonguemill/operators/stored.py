"""The shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _REPO not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_REPO, have) if p)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent and the session is local, a folder of this
    machine will do; on a cluster its absence is an error, since a machine-local
    folder would lose data with an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tonguemill-")
        return _LOCAL[app]
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


#: The folders of sessions that run on this machine only, as tests do.
_LOCAL: dict[str, str] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and no
    longer dependent on the executors that computed it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def session_of(df: DataFrame) -> SparkSession:
    return ready(df.sparkSession)


def kept(df: DataFrame, what: str) -> DataFrame:
    """:func:`written`, or on the executors' disks where no folder is shared."""
    try:
        return written(df, what)
    except ValueError:
        return df.persist(StorageLevel.DISK_ONLY)
