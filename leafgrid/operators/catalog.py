"""Image catalogues: metadata, selection, incremental ingest, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expressions import base_name, path_name, path_stem, path_suffix


def with_names(samples: DataFrame) -> DataFrame:
    """Columns name, stem and suffix of the image path."""
    named = samples.withColumn("name", path_name(F.col("image")))
    return named.withColumn("stem", path_stem(F.col("name"))).withColumn("suffix", path_suffix(F.col("name")))


def metadata(samples: DataFrame, dataset: str, version: str, sensor: str = "RGB", annotations: str = "TreePolygons") -> DataFrame:
    """One record for each sample."""
    return with_names(samples).select(
        "idx", F.lit(dataset).alias("dataset"), F.lit(version).alias("version"), F.col("name").alias("image"), "stem", "suffix",
        F.lit(False).alias("synthetic"), F.lit(sensor).alias("sensor"), F.lit(annotations).alias("annotations"),
    )


def images_only(samples: DataFrame) -> DataFrame:
    """Supported suffixes, in any case."""
    return with_names(samples).where(F.lower("suffix").isin(".png", ".jpg", ".jpeg", ".tif", ".tiff"))


def cleaned(samples: DataFrame) -> DataFrame:
    """Column base: the stem without its tags."""
    return with_names(samples).withColumn("base", base_name(F.col("stem")))


def collisions(samples: DataFrame) -> DataFrame:
    """Base names that several different names share, and would overwrite each other."""
    return cleaned(samples).groupBy("base").agg(F.countDistinct("name").alias("n_names")).where("n_names > 1")


def first_samples(samples: DataFrame, limit: int = 100) -> DataFrame:
    """The first by index, fewer if there are fewer."""
    return samples.orderBy("idx").limit(limit)


def to_ingest(samples: DataFrame, present: DataFrame) -> DataFrame:
    """First sample of each file name that the destination does not hold yet."""
    first = Window.partitionBy("name").orderBy("idx")
    new = with_names(samples).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return new.join(present.select("name").distinct(), "name", "left_anti")


def ingested(spark: SparkSession, destination: str, schema: StructType) -> DataFrame:
    """What a destination holds: the samples' columns, their name, stem and suffix, and the batch that brought them."""
    held = ", ".join(["name string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "stem string", "suffix string", "batch int"])
    folder = spark._jvm.org.apache.hadoop.fs.Path(destination)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], held)
    return spark.read.schema(held).parquet(destination)


def append_new(samples: DataFrame, destination: str, batch: int) -> None:
    """Append the first sample of each name that no other batch of the destination holds.

    Each batch has its own folder and overwrites it: a batch that is run again leaves what it left before, and a later one
    over the same samples adds nothing. The names in the destination are the manifest; nothing else has to be kept in step.
    """
    held = ingested(samples.sparkSession, destination, samples.schema)
    new = to_ingest(samples, held.where(F.col("batch") != batch))
    new.select("name", *samples.columns, "stem", "suffix").write.mode("overwrite").parquet(f"{destination}/batch={batch}")


def reconcile(rgb: DataFrame, polygons: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each stem of any table and whether each holds it."""
    side = lambda d, n: d.select("stem").distinct().withColumn(n, F.lit(True))
    joined = side(rgb, "has_rgb").join(side(polygons, "has_polygons"), "stem", "full_outer").join(side(records, "has_metadata"), "stem", "full_outer")
    return joined.select("stem", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_rgb", "has_polygons", "has_metadata")])


def verification(reconciled: DataFrame) -> DataFrame:
    """Counts and mismatch flags."""
    counts = reconciled.agg(*[F.count_if(f"has_{n}").alias(f"n_{n}") for n in ("rgb", "polygons", "metadata")])
    return counts.withColumn("polygons_mismatch", F.col("n_rgb") != F.col("n_polygons")).withColumn("metadata_mismatch", F.col("n_rgb") != F.col("n_metadata"))


def quarantine(decoded: DataFrame, ok: str = "ok") -> tuple[DataFrame, DataFrame]:
    """Rows that decoded, and rows that did not."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return decoded.where(good), decoded.where(~good)


def success_ratio(decoded: DataFrame, ok: str = "ok") -> DataFrame:
    return decoded.agg(F.count_if(F.coalesce(F.col(ok), F.lit(False))).alias("n_ok"), F.count("*").alias("n"))
