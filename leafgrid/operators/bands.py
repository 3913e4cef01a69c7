"""Bands derived from RGB pixel tables (image_id, x, y, r, g, b).

Whatever needs an image's extrema or its neighbourhood is a window inside the image; ``by_image`` shuffles once and
every later window reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clip, normal_noise, quantise, safe_div

BANDS = ("Blue", "Green", "Red", "RedEdge", "NIR")


def whole_image():
    return Window.partitionBy("image_id")


def along_x():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_y():
    return Window.partitionBy("image_id", "x").orderBy("y")


def by_image(pixels: DataFrame) -> DataFrame:
    """The one shuffle of the pixel pipeline."""
    return pixels.repartition("image_id")


def normalise(pixels: DataFrame, clipped: bool = True) -> DataFrame:
    """Columns rn, gn, bn: divided by 255 if the largest value of the whole image is over 1."""
    peak = F.max(F.greatest("r", "g", "b")).over(whole_image())
    scaled = pixels.withColumn("_peak", peak)
    unit = lambda c: F.when(F.col("_peak") > 1, F.col(c) / F.lit(255.0)).otherwise(F.col(c).cast("double"))
    return scaled.withColumns({c + "n": clip(unit(c), 0, 1) if clipped else unit(c) for c in "rgb"}).drop("_peak")


def stretch(pixels: DataFrame, name: str) -> DataFrame:
    """Min-max of a column within each image; a constant image is 0 everywhere."""
    low = pixels.withColumn("_low", F.min(name).over(whole_image())).withColumn("_peak", F.max(name).over(whole_image()))
    return low.withColumn(name, safe_div(F.col(name) - F.col("_low"), F.col("_peak") - F.col("_low") + F.lit(1e-6))).drop("_low", "_peak")


def excess_green(pixels: DataFrame) -> DataFrame:
    """Column exg over rn, gn, bn, stretched within the image."""
    return stretch(pixels.withColumn("exg", F.col("gn") * 2 - F.col("rn") - F.col("bn")), "exg")


def _smooth(value: str, order: Window) -> Column:
    here = F.col(value)
    l1, l2, r1, r2 = F.lag(value, 1).over(order), F.lag(value, 2).over(order), F.lead(value, 1).over(order), F.lead(value, 2).over(order)
    left1, right1 = F.coalesce(l1, r1, here), F.coalesce(r1, l1, here)
    left2 = F.coalesce(l2, F.when(l1.isNull(), r2), here)
    right2 = F.coalesce(r2, F.when(r1.isNull(), l2), here)
    return (left2 + left1 * 4 + here * 6 + right1 * 4 + right2) / F.lit(16.0)


def gaussian(pixels: DataFrame, name: str) -> DataFrame:
    """5 x 5 binomial smoothing, one axis after the other, the border mirrored without repeating the edge."""
    return pixels.withColumn(name, _smooth(name, along_x())).withColumn(name, _smooth(name, along_y()))


def vegetation_probability(pixels: DataFrame) -> DataFrame:
    """Column veg: smoothed and stretched excess green."""
    return stretch(gaussian(excess_green(pixels).withColumnRenamed("exg", "veg"), "veg"), "veg")


def visible_bands(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"Blue": clip(F.col("bn") * 0.85, 0, 1), "Green": clip(F.col("gn") * 0.95, 0, 1), "Red": clip(F.col("rn") * 0.90, 0, 1)})


def red_edge_band(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("RedEdge", clip(F.col("rn") * 0.45 + F.col("gn") * 0.45 + F.col("veg") * 0.10, 0, 1))


def nir_band(pixels: DataFrame) -> DataFrame:
    base = F.col("rn") * 0.25 + F.col("gn") * 0.55 + F.col("veg") * 0.20 + F.col("veg") * 0.25
    return pixels.withColumn("NIR", clip(base * (F.lit(0.75) + F.col("veg") * 0.25), 0, 1))


def derive_bands(pixels: DataFrame) -> DataFrame:
    """The five bands of an RGB pixel table."""
    return by_image(pixels).transform(normalise).transform(vegetation_probability).transform(visible_bands).transform(red_edge_band).transform(nir_band)


def batch_nir(pixels: DataFrame) -> DataFrame:
    """Columns red and nir of the batch path, which always divides by 255."""
    unit = lambda c: F.col(c) / F.lit(255.0)
    return pixels.withColumns({"red": unit("r"), "green": unit("g"), "nir": clip(unit("g") * 1.6 - unit("r") * 0.4 + F.lit(0.1), 0, 1)})


def add_noise(pixels: DataFrame, name: str, std: float = 0.01, seed: int = 42) -> DataFrame:
    """Gaussian noise, clipped; no noise leaves the column as it is."""
    if std <= 0:
        return pixels
    return pixels.withColumn(name, clip(F.col(name) + normal_noise(seed, "image_id", "x", "y") * F.lit(std), 0, 1))


def quantised(pixels: DataFrame, names: tuple[str, ...], levels: int = 255) -> DataFrame:
    return pixels.withColumns({n: quantise(F.col(n), levels) for n in names})


def long_bands(pixels: DataFrame, names: tuple[str, ...] = BANDS) -> DataFrame:
    """(image_id, x, y, band, value)."""
    return pixels.select("image_id", "x", "y", *names).unpivot(["image_id", "x", "y"], list(names), "band", "value")
