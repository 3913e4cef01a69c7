"""Whole jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import above, mask255, ndvi
from ..functions.scratch import keep
from ..operators import audit, catalog, objects
from ..operators.bands import batch_nir, derive_bands
from ..operators.morphology import vegetation_mask
from ..sources.files import list_files
from ..sources.pixels import explode_pixels, read_images, scan_report
from ..sources.sinks import write_metadata, write_polygons


def image_job(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A folder of image files to its pixel table (name, x, y, r, g, b), written once, and a report with one row for each file.

    Broken files stop nothing: the report finds them as listed files without pixels, on names alone.
    """
    pixels = keep(explode_pixels(read_images(spark, path), ["name"]), "pixels")
    return pixels, scan_report(list_files(spark, path), pixels)


def batch_index(pixels: DataFrame) -> DataFrame:
    """Batch path, no shuffle: unclipped NDVI on its own NIR."""
    return batch_nir(pixels).withColumn("ndvi", ndvi(F.col("red"), F.col("nir"), clipped=False))


def batch_statistics(pixels: DataFrame) -> DataFrame:
    return audit.statistics(batch_index(pixels), "ndvi")


def batch_canopy(pixels: DataFrame) -> DataFrame:
    """255 where unclipped NDVI is over 0.35 and green over red."""
    return batch_index(pixels).withColumn("mask", mask255(above(F.col("ndvi"), 0.35) & (F.col("g") > F.col("r"))))


def index_table(pixels: DataFrame) -> DataFrame:
    """Derived bands under the names that the indices read."""
    return derive_bands(pixels).select("image_id", "x", "y", F.col("Blue").alias("blue"), F.col("Green").alias("green"), F.col("Red").alias("red"), F.col("RedEdge").alias("red_edge"), F.col("NIR").alias("nir"))


def labelled_runs(pixels: DataFrame, width: int) -> DataFrame:
    """Objects of the vegetation mask, as labelled runs."""
    return objects.components(objects.runs(vegetation_mask(pixels)), width)


def dataset_job(samples: DataFrame, present: DataFrame, folder: str, dataset: str, version: str, limit: int = 100) -> DataFrame:
    """Select, ingest, write polygons and metadata, and report the verification."""
    spark = samples.sparkSession
    chosen = catalog.with_names(catalog.first_samples(samples, limit))
    new = catalog.to_ingest(chosen.select("idx", "image"), present)
    records = catalog.metadata(chosen.select("idx", "image"), dataset, version)
    new.select("idx", "image", "name", "stem").write.mode("overwrite").parquet(f"{folder}/rgb")
    write_polygons(chosen.dropDuplicates(["stem"]).select("stem", F.array(F.col("idx")).alias("polygons")), f"{folder}/polygons")
    write_metadata(records, f"{folder}/metadata")
    rgb = spark.read.parquet(f"{folder}/rgb").select("stem").unionByName(present.select("stem"))
    polygons = spark.read.schema("polygons array<bigint>, stem string").json(f"{folder}/polygons")
    return catalog.verification(catalog.reconcile(rgb, polygons, spark.read.schema(records.schema).json(f"{folder}/metadata")))
