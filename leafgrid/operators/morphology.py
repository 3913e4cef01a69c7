"""Masks: thresholds, erosion, dilation, opening, closing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import above, mask255
from ..functions.scratch import keep
from .bands import along_x, along_y, by_image, excess_green, normalise


def _sweep(pixels: DataFrame, name: str, k: int, pick) -> DataFrame:
    low, high = -(k // 2), k - 1 - k // 2
    across = pixels.withColumn(name, pick(name).over(along_x().rangeBetween(low, high)))
    return across.withColumn(name, pick(name).over(along_y().rangeBetween(low, high)))


def erode(pixels: DataFrame, name: str = "mask", k: int = 5) -> DataFrame:
    """Least value of the k x k neighbourhood; what lies outside the image is ignored."""
    return _sweep(pixels, name, k, F.min)


def dilate(pixels: DataFrame, name: str = "mask", k: int = 5) -> DataFrame:
    return _sweep(pixels, name, k, F.max)


def opening(pixels: DataFrame, name: str = "mask", k: int = 5) -> DataFrame:
    return dilate(erode(pixels, name, k), name, k)


def closing(pixels: DataFrame, name: str = "mask", k: int = 5) -> DataFrame:
    return erode(dilate(pixels, name, k), name, k)


def threshold_mask(pixels: DataFrame, name: str, threshold: float) -> DataFrame:
    return pixels.withColumn("mask", mask255(above(F.col(name), threshold)))


def raw_vegetation_mask(pixels: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Excess green over the threshold, before clean-up."""
    return by_image(pixels).transform(lambda d: normalise(d, clipped=False)).transform(excess_green).transform(lambda d: threshold_mask(d, "exg", threshold))


#: Columns of a line that one word holds; with REACH more on either side they fill 64 bits.
WORD, REACH = 32, 16


def pack_lines(mask: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Pixels of a 0/255 mask as bits: keys, y, word (of WORD columns), ``held`` (pixels there are) and ``on`` (foreground).

    A hash aggregate below the keys: pixels that already lie together by the keys are neither shuffled nor sorted.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod(x, {WORD}) as int))")
    word = F.floor(F.col("x") / WORD).cast("int").alias("word")
    return mask.groupBy(*keys, "y", word).agg(F.bit_or(bit).alias("held"), F.bit_or(F.when(F.col("mask") > 0, bit).otherwise(F.lit(0).cast("bigint"))).alias("on"))


def unpack_lines(lines: DataFrame) -> DataFrame:
    """Back to one row for each pixel, with x and mask in place of word, held and on."""
    rest = [c for c in lines.columns if c not in ("word", "held", "on")]
    spread = lines.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).where("(shiftrightunsigned(held, _i) & 1L) = 1")
    return spread.select(*rest, (F.col("word") * WORD + F.col("_i")).alias("x"), F.expr("if((shiftrightunsigned(on, _i) & 1L) = 1, 255, 0)").alias("mask"))


def _sweep_lines(lines: DataFrame, keys: tuple[str, ...], k: int, erosion: bool) -> DataFrame:
    """One erosion or dilation of packed lines: across by shifts of words, down by a window over lines of words."""
    low, high, full = -(k // 2), k - 1 - k // 2, (1 << WORD) - 1
    fold, pick, empty = (" & ", F.bit_and, full) if erosion else (" | ", F.bit_or, 0)
    seen = F.expr(f"on | ({full}L & ~held)") if erosion else F.col("on")  # what is not there decides nothing
    words = Window.partitionBy(*keys, "y").orderBy("word")
    beside = lambda d: F.coalesce(F.max("_seen").over(words.rangeBetween(d, d)), F.lit(empty).cast("bigint"))
    wide = f"(shiftrightunsigned(_before, {WORD - REACH}) | shiftleft(_seen, {REACH}) | shiftleft(_after, {REACH + WORD}))"
    across = fold.join(f"shiftrightunsigned({wide}, {REACH + d})" for d in range(low, high + 1))
    made = lines.withColumn("_seen", seen).withColumns({"_before": beside(-1), "_after": beside(1)}).withColumn("on", F.expr(f"({across}) & held"))
    down = Window.partitionBy(*keys, "word").orderBy("y").rangeBetween(low, high)
    return made.withColumn("_seen", seen).withColumn("on", pick("_seen").over(down).bitwiseAND(F.col("held"))).drop("_seen", "_before", "_after")


def clean(mask: DataFrame, k: int = 5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Opening, then closing, of a 0/255 mask that lies together by the keys: keys, x, y, mask.

    Windows sort words of lines and not pixels, so a task holds a small part of the mask's rows at a time.
    """
    if k // 2 > REACH:
        named = mask.select(F.struct(*keys).alias("image_id"), "x", "y", "mask")
        return closing(opening(named, k=k), k=k).select("image_id.*", "x", "y", "mask")
    lines = pack_lines(mask, keys)
    for erosion in (True, False, False, True):
        lines = _sweep_lines(lines, keys, k, erosion)
    return unpack_lines(lines).select(*keys, "x", "y", "mask")


def vegetation_mask(pixels: DataFrame, threshold: float = 0.25, k: int = 5) -> DataFrame:
    """Cleaned mask of whole images: image_id, x, y, mask."""
    return clean(raw_vegetation_mask(pixels, threshold), k)


def tiled(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """Cut large images: keys tile_x, tile_y and ``core``; pixels within ``halo`` of a tile are copied into it.

    A stencil of radius r needs a halo of r; opening and closing with k need 4 * (k // 2) in all. Filter on core after.
    """
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    spread = pixels.withColumn("tile_x", F.explode(reach("x"))).withColumn("tile_y", F.explode(reach("y"))).where("tile_x >= 0 and tile_y >= 0")
    core = (F.floor(F.col("x") / size) == F.col("tile_x")) & (F.floor(F.col("y") / size) == F.col("tile_y"))
    return spread.withColumn("core", core)


#: Bytes of a broadcast row of extrema: key, peak and two numbers, and its place in the hash map.
EXTREMA_ROW = 100


def with_extrema(pixels: DataFrame, ends: DataFrame) -> DataFrame:
    """Pixels beside their image's row of a written table ``ends``; which of the two a join holds is stated.

    Pixels that were exploded look as small as their source to Spark, which would send all of them through the driver. The
    extrema are broadcast where their counted rows are within Spark's threshold. Else both are dealt by image and a task
    hashes the extrema of its images; pixels are not sorted, and adaptive execution splits a hot image.
    """
    most = ends.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return pixels.join(ends.hint("broadcast" if ends.count() * EXTREMA_ROW <= most else "shuffle_hash"), "image_id")


def scaled_green(pixels: DataFrame) -> DataFrame:
    """Column exg, excess green stretched within the image, without a window: the extrema come from one aggregate.

    It is written out and joined by ``with_extrema``.
    """
    of = lambda unit: unit("g") * 2 - unit("r") - unit("b")
    scales = {"byte": of(lambda c: F.col(c) / F.lit(255.0)), "plain": of(lambda c: F.col(c).cast("double"))}
    ends = pixels.groupBy("image_id").agg(F.max(F.greatest("r", "g", "b")).alias("peak"), *[f(v).alias(f"{n}_{k}") for k, v in scales.items() for n, f in (("low", F.min), ("top", F.max))])
    pick = lambda byte, plain: F.when(F.col("peak") > 1, byte).otherwise(plain)
    ends = keep(ends.select("image_id", "peak", *[pick(F.col(f"{n}_byte"), F.col(f"{n}_plain")).alias(n) for n in ("low", "top")]), "extrema")
    green = with_extrema(pixels, ends).withColumn("exg", pick(scales["byte"], scales["plain"]))
    return green.withColumn("exg", (F.col("exg") - F.col("low")) / (F.col("top") - F.col("low") + F.lit(1e-6)))


def tiled_vegetation_mask(pixels: DataFrame, size: int, threshold: float = 0.25, k: int = 5) -> DataFrame:
    """Same mask for images too large for one task: extrema first, then windows inside tiles with a halo."""
    cut = threshold_mask(scaled_green(pixels), "exg", threshold).select("image_id", "x", "y", "mask").transform(lambda d: tiled(d, size, 4 * (k // 2)))
    keys = ("image_id", "tile_x", "tile_y")
    made = clean(cut.drop("core").repartition(*keys), k, keys)
    core = (F.floor(F.col("x") / size) == F.col("tile_x")) & (F.floor(F.col("y") / size) == F.col("tile_y"))
    return made.where(core).select("image_id", "x", "y", "mask")


def vegetation_mask_by_lines(pixels: DataFrame, threshold: float = 0.25, k: int = 5) -> DataFrame:
    """Same mask for images too large for one task, without tiles: a task holds single lines and columns.

    Opening and closing are an erosion, two dilations and an erosion. The dilations merge into one of twice the reach, and
    as each step may take its two axes in either order, lines and columns alternate three times only: no pixel is copied.
    """
    low, high = -(k // 2), k - 1 - k // 2
    made = threshold_mask(scaled_green(pixels), "exg", threshold).select("image_id", "x", "y", "mask")
    made = made.repartition("image_id", "y")  # pixels that a join has dealt by image would stay so
    steps = [(along_x, F.min, 1), (along_y, F.min, 1), (along_y, F.max, 2), (along_x, F.max, 2), (along_x, F.min, 1), (along_y, F.min, 1)]
    for along, pick, reach in steps:
        made = made.withColumn("mask", pick("mask").over(along().rangeBetween(reach * low, reach * high)))
    return made
