"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset and all executors run inside this process (tests), a
    temporary folder is used; on a cluster the setting is required, because a
    machine-local folder would lose its rows with the machine.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/leafmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The copy survives lost executors, is never recomputed, and gives the
    planner true sizes.  It is owned by the caller's job folder, which the
    cluster cleans like any checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/leafmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
