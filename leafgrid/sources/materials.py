"""Material files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materials import latest, parse_materials, strict


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file, folders below included; bad files carry their problem."""
    bodies = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return parse_materials(bodies.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def load_library(spark: SparkSession, path: str) -> DataFrame:
    """Strict library of a folder: of equal names the last path wins."""
    return latest(strict(read_materials(spark, path)), "path")
