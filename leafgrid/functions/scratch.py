"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """Folder under spark.checkpoint.dir; only a session within one process gets one of its own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafgrid-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found}/leafgrid"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back; its size is then known to the optimiser."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``keep`` that no later step reads."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
