"""Column expressions shared by the operators. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def safe_div(num: Column, den: Column) -> Column:
    """IEEE division: n/0 is signed infinity and 0/0 is NaN, where ANSI mode would raise."""
    zero = F.when(F.isnan(num) | (num == 0), F.lit(NAN)).otherwise(F.signum(num) * F.lit(INF))
    return F.when(den == 0, zero).otherwise(F.try_divide(num, den))


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NaN stays NaN."""
    return F.when(F.isnan(value), value).otherwise(F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def above(value: Column, threshold: float) -> Column:
    """Strictly greater; false for NaN, which Spark would order above all numbers."""
    return ~F.isnan(value) & (value > F.lit(float(threshold)))


def mask255(condition: Column) -> Column:
    return F.when(condition, 255).otherwise(0)


def quantise(value: Column, levels: int = 255) -> Column:
    """Truncate ``levels`` times a value in [0, 1]; NaN becomes 0 and the rest is clipped first."""
    return (F.lit(float(levels)) * clip(F.nanvl(value, F.lit(0.0)), 0, 1)).cast("int")


def ndvi(red: Column, nir: Column, epsilon: float = 1e-8, clipped: bool = True) -> Column:
    value = safe_div(nir - red, nir + red + F.lit(epsilon))
    return clip(value, -1, 1) if clipped else value


def gndvi(green: Column, nir: Column, epsilon: float = 1e-8) -> Column:
    return clip(safe_div(nir - green, nir + green + F.lit(epsilon)), -1, 1)


def savi(red: Column, nir: Column, soil: float = 0.5) -> Column:
    return clip(safe_div(nir - red, nir + red + F.lit(soil)) * F.lit(1 + soil), -1, 1)


def msavi(red: Column, nir: Column) -> Column:
    """Real for red >= 0; a negative radicand gives NaN."""
    twice = nir * 2 + 1
    return clip((twice - F.sqrt(twice * twice - (nir - red) * 8)) / 2, -1, 1)


def evi(blue: Column, red: Column, nir: Column, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, canopy: float = 1.0) -> Column:
    return clip(safe_div((nir - red) * F.lit(gain), nir + red * F.lit(c1) - blue * F.lit(c2) + F.lit(canopy)), -1, 1)


#: The five indices over columns blue, green, red and nir.
INDICES: dict[str, Callable[[], Column]] = {
    "ndvi": lambda: ndvi(F.col("red"), F.col("nir")),
    "gndvi": lambda: gndvi(F.col("green"), F.col("nir")),
    "savi": lambda: savi(F.col("red"), F.col("nir")),
    "msavi": lambda: msavi(F.col("red"), F.col("nir")),
    "evi": lambda: evi(F.col("blue"), F.col("red"), F.col("nir")),
}


def index_unit(value: Column) -> Column:
    """[-1, 1] to [0, 1]."""
    return (value + 1) / 2


def index_code(value: Column) -> Column:
    """[-1, 1] to 0..255."""
    return quantise(index_unit(value))


def preview(value: Column) -> Column:
    """Stretch of [-0.2, 1] to [0, 1]; NaN counts as 0."""
    return clip((F.nanvl(value, F.lit(0.0)) + F.lit(0.2)) / F.lit(1.2), 0, 1)


def hashed_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts' text, the same in every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def normal_noise(seed: int, *keys: str) -> Column:
    """Standard normal value that depends on the keys alone, so that retries and repartitioning repeat it (Box-Muller)."""
    unit = lambda k: hashed_unit(*map(F.col, keys), F.lit(seed), F.lit(k))
    return F.sqrt(F.log(unit(1)) * -2) * F.cos(unit(2) * F.lit(6.283185307179586))


def path_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_suffix(name: Column) -> Column:
    return F.regexp_extract(name, r".(\.[^.]+)$", 1)


def path_stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(path_suffix(name)))


def base_name(stem: Column, tags: tuple[str, ...] = ("_NDVI", "_NIR", "_canopy")) -> Column:
    """Remove every occurrence of each tag, in order."""
    for tag in tags:
        stem = F.replace(stem, F.lit(tag))
    return stem
