"""Vegetation indices over tables with blue, green, red and nir columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import INDICES, clip, index_code, quantise


def with_indices(table: DataFrame, names: Iterable[str] = tuple(INDICES)) -> DataFrame:
    """Add the named indices; bands that no named index reads are pruned at the scan."""
    return table.withColumns({n: INDICES[n]() for n in names})


def long_indices(table: DataFrame, keys: list[str], names: Iterable[str] = tuple(INDICES)) -> DataFrame:
    names = list(names)
    return with_indices(table, names).select(*keys, *names).unpivot(keys, names, "index", "value")


def palette_from_stops(spark, stops: list[tuple[int, int, int, int]]) -> DataFrame:
    """256 rows (code, pr, pg, pb), linear between stops (code, r, g, b), by truncation."""
    pieces = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("c0", "r0", "g0", "b0", "c1", "r1", "g1", "b1"), (*a, *b), strict=True)]) for a, b in zip(stops, stops[1:], strict=False)])
    codes = spark.range(256).select(F.col("id").cast("int").alias("code"), F.inline(pieces))
    inside = codes.where("code >= c0 and (code < c1 or (code = 255 and c1 = 255))")
    mix = lambda n: F.expr(f"cast({n}0 + ({n}1 - {n}0) * (code - c0) / (c1 - c0) as int)").alias("p" + n)
    return inside.select("code", mix("r"), mix("g"), mix("b"))


# Breakpoints of the Jet map by channel, as places and levels from 0 to 1.
JET = {
    "r": ((0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)),
    "g": ((0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)),
    "b": ((0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)),
}
# Coefficients of the published fifth-degree fit of the Turbo map, constant term first.
TURBO = {
    "r": (0.13572138, 4.6153926, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    "g": (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    "b": (0.1066733, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
}


def _palette(spark, level) -> DataFrame:
    place = F.col("code") / F.lit(255.0)
    codes = spark.range(256).select(F.col("id").cast("int").alias("code"))
    return codes.select("code", *[quantise(level(c, place)).alias(f"p{c}") for c in "rgb"])


def jet_palette(spark) -> DataFrame:
    """256 rows of the Jet map, linear between breakpoints, by truncation."""

    def level(c: str, place: Column) -> Column:
        stops = JET[c]
        found = F.lit(stops[-1][1])
        for (a, u), (b, v) in reversed(list(zip(stops, stops[1:], strict=False))):
            found = F.when(place <= b, F.lit(u) + F.lit(v - u) * (place - a) / F.lit(b - a)).otherwise(found)
        return found

    return _palette(spark, level)


def turbo_palette(spark) -> DataFrame:
    """256 rows of the Turbo map by its published polynomial fit: near its table, but up to some 32 of 255 off at the ends."""

    def level(c: str, place: Column) -> Column:
        found = F.lit(0.0)
        for factor in reversed(TURBO[c]):
            found = found * place + F.lit(factor)
        return found

    return _palette(spark, level)


def fraction_code(value: Column) -> Column:
    """Row of a palette for a value from 0 to 1: 256 equal steps."""
    return F.least(F.floor(clip(F.nanvl(value, F.lit(0.0)), 0, 1) * 256), F.lit(255)).cast("int")


def colourise(table: DataFrame, name: str, palette: DataFrame) -> DataFrame:
    """Look the 0..255 code of an index up in a palette of 256 rows."""
    return table.withColumn("code", index_code(F.col(name))).join(F.broadcast(palette), "code")
