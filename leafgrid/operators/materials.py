"""Libraries of spectral materials: name, version, category, reflectance map and four scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

SCALARS = ("chlorophyll", "water_content", "lai", "stress")
FIELDS = ("name", "category", "reflectance", *SCALARS)
SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("reflectance", T.MapType(T.StringType(), T.DoubleType())), *[T.StructField(s, T.DoubleType()) for s in SCALARS]]
)


def parse_materials(bodies: DataFrame) -> DataFrame:
    """(path, body) to materials with ``problem``: not an object, an unknown key, or no name or category; else null."""
    keys = F.json_object_keys("body")
    m = F.from_json("body", SCHEMA)
    parsed = bodies.withColumn("_keys", keys).withColumn("_m", m)
    problem = (
        F.when(F.col("_keys").isNull(), "not an object")
        .when(F.size(F.array_except("_keys", F.array(*map(F.lit, FIELDS)))) > 0, "unknown key")
        .when(F.col("_m.name").isNull() | F.col("_m.category").isNull(), "missing name or category")
    )
    scalars = [F.coalesce(F.col(f"_m.{s}"), F.lit(0.0)).alias(s) for s in SCALARS]
    return parsed.select("path", "_m.name", "_m.category", F.coalesce("_m.reflectance", F.create_map().cast("map<string,double>")).alias("reflectance"), *scalars, problem.alias("problem"))


def to_json(materials: DataFrame) -> DataFrame:
    """Column body: one JSON object for each material."""
    return materials.withColumn("body", F.to_json(F.struct(*FIELDS)))


def strict(parsed: DataFrame) -> DataFrame:
    """Fail the job at the first problem."""
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("problem"))).cast("string")).otherwise(F.col("name"))
    return parsed.withColumn("name", checked).drop("problem")


def latest(materials: DataFrame, by: str = "version") -> DataFrame:
    """The last material of each name."""
    columns = [c for c in materials.columns if c != "name"]
    newest = materials.groupBy("name").agg(F.max_by(F.struct(*columns), by).alias("_m"))
    return newest.select("name", *[F.col(f"_m.{c}").alias(c) for c in columns]).select(materials.columns)


def merged(first: DataFrame, second: DataFrame, by: str = "version") -> DataFrame:
    """Union of two libraries, overwritten by name."""
    return latest(first.unionByName(second), by)


def reflectance(band: str, column: str = "reflectance") -> Column:
    return F.coalesce(F.try_element_at(F.col(column), F.lit(band)), F.lit(0.0))


def with_reflectance(materials: DataFrame, band: str, value: Column) -> DataFrame:
    """Set or overwrite one band."""
    rest = F.map_filter("reflectance", lambda k, v: k != F.lit(band))
    return materials.withColumn("reflectance", F.map_concat(rest, F.create_map(F.lit(band), value.cast("double"))))


def bands(column: str = "reflectance") -> Column:
    return F.array_sort(F.map_keys(column))


def violations(materials: DataFrame) -> DataFrame:
    """One row for each band below 0 or above 1; NaN passes."""
    long = materials.select("name", "version", F.explode("reflectance").alias("band", "value"))
    return long.where(~F.isnan("value") & ((F.col("value") < 0) | (F.col("value") > 1)))


def pair(first: DataFrame, second: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (a, b) of two libraries for an explicit list of names (name_a, name_b, ...)."""
    a = first.select(F.struct(*FIELDS).alias("a"), F.col("name").alias("name_a"))
    b = second.select(F.struct(*FIELDS).alias("b"), F.col("name").alias("name_b"))
    return pairs.join(a, "name_a").join(b, "name_b")


def mixed(pairs: DataFrame) -> DataFrame:
    """Linear blend of a and b by column alpha over a's bands; alpha outside [0, 1] fails."""
    alpha = F.when(F.col("alpha").between(0.0, 1.0), F.col("alpha")).otherwise(F.raise_error(F.lit("alpha outside [0, 1]")).cast("double"))
    w = pairs.withColumn("_w", alpha)
    blend = lambda x, y: x * (F.lit(1.0) - F.col("_w")) + y * F.col("_w")
    return w.select(
        "alpha",
        F.concat_ws("_", "a.name", "b.name").alias("name"),
        F.col("a.category").alias("category"),
        F.transform_values("a.reflectance", lambda k, v: blend(v, F.coalesce(F.try_element_at(F.col("b.reflectance"), k), F.lit(0.0)))).alias("reflectance"),
        *[blend(F.col(f"a.{s}"), F.col(f"b.{s}")).alias(s) for s in SCALARS],
    )


def of_category(materials: DataFrame, category: str) -> DataFrame:
    return materials.where(F.col("category") == category)


def summary(materials: DataFrame) -> DataFrame:
    return materials.groupBy("category").agg(F.count("*").alias("n_materials"))


def names(materials: DataFrame) -> DataFrame:
    return materials.select("name").distinct().orderBy("name")


def categories(materials: DataFrame) -> DataFrame:
    return materials.select("category").distinct()


def looked_up(materials: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose name is asked for; every key with ``found``, so that a missing one can be reported."""
    return keys.join(materials.select("name", F.lit(True).alias("_found")).distinct(), "name", "left").select("name", F.coalesce("_found", F.lit(False)).alias("found"))


def without(materials: DataFrame, keys: DataFrame) -> DataFrame:
    return materials.join(keys, "name", "left_anti")


def random_pick(materials: DataFrame, seed: int) -> DataFrame:
    """One material of each category, the same for the same seed."""
    order = Window.partitionBy("category").orderBy(F.md5(F.concat_ws(":", "name", F.lit(seed)).cast("binary")), "name")
    return materials.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def get(materials: DataFrame, name: str) -> Row:
    """The material of that name; a missing one is an error."""
    found = materials.where(F.col("name") == name).first()
    if found is None:
        raise KeyError(f"no material is named {name!r}")
    return found


def random_of(materials: DataFrame, category: str, seed: int) -> Row:
    """One material of a category, the same for the same seed; an empty category is an error."""
    found = random_pick(of_category(materials, category), seed).first()
    if found is None:
        raise ValueError(f"category {category!r} holds no material")
    return found
