"""Connected objects of a mask, their statistics, outlines and polygon labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import label_runs
from ..functions.geometry import rings as ring_rows
from ..functions.scratch import discard, keep
from .bands import along_x, along_y


def runs(mask: DataFrame) -> DataFrame:
    """Foreground runs of each scan line: image_id, y, x0, x1."""
    on = mask.where("mask > 0").withColumn("_island", F.col("x") - F.row_number().over(along_x()))
    return on.groupBy("image_id", "y", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_island")


def run_edges(run: DataFrame) -> DataFrame:
    """Pairs of 8-connected runs on consecutive lines: image_id, y, x0 and below_x0 (the run on line y + 1)."""
    a = run.select("image_id", F.col("y"), F.col("x0"), F.col("x1"), (F.col("y") + 1).alias("below_y"))
    b = run.select("image_id", F.col("y").alias("below_y"), F.col("x0").alias("below_x0"), F.col("x1").alias("below_x1"))
    meet = (F.col("below_x0") <= F.col("x1") + 1) & (F.col("below_x1") >= F.col("x0") - 1)
    return a.join(b.hint("merge"), ["image_id", "below_y"]).where(meet).select("image_id", "y", "x0", "below_x0")


def _with_labels(runs_of: pa.Table, width: int) -> pa.Table:
    columns = [np.asarray(runs_of.column(c)) for c in ("y", "x0", "x1")]
    return runs_of.append_column("label", pa.array(label_runs(*columns, width), pa.int64()))


def components(run: DataFrame, width: int) -> DataFrame:
    """Label the runs of each image: one shuffle on the image, work on runs and not on pixels."""
    schema = "image_id bigint, y int, x0 int, x1 int, label bigint"
    return run.select("image_id", "y", "x0", "x1").groupBy("image_id").applyInArrow(lambda t: _with_labels(t, width), schema)


def tile_components(run: DataFrame, width: int, size: int) -> DataFrame:
    """Runs cut at the borders of square tiles and labelled within their tile, which is all that a task holds.

    image_id, y, x0, x1 of the piece; run_x0, run_x1 of its run; label, the smallest y * width + x of the object's part.
    """
    reach = F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))
    cut = run.select("image_id", "y", F.col("x0").alias("run_x0"), F.col("x1").alias("run_x1"), F.explode(reach).alias("tile_x"))
    ends = {"x0": F.greatest("run_x0", F.col("tile_x") * size).cast("int"), "x1": F.least("run_x1", (F.col("tile_x") + 1) * size - 1).cast("int")}
    pieces = cut.withColumns(ends).withColumn("tile_y", F.floor(F.col("y") / size))
    schema = "image_id bigint, y int, x0 int, x1 int, run_x0 int, run_x1 int, label bigint"
    names = ["image_id", "y", "x0", "x1", "run_x0", "run_x1"]
    return pieces.groupBy("image_id", "tile_x", "tile_y").applyInArrow(lambda t: _with_labels(t.select(names), width), schema)


def border_edges(pieces: DataFrame, size: int) -> DataFrame:
    """Pairs of labels of one image that touch across a tile border: image_id, u, v.

    Only pixels on the last line or column of a tile, and those on the first of the next, take part; they meet on whole
    pixel keys, so no line with many runs is a hot key.
    """
    edge_row = (F.col("y") % size).isin(0, size - 1)
    whole, ends = F.sequence("x0", "x1"), F.array_distinct(F.array("x0", "x1"))
    cells = pieces.select("image_id", "label", "y", F.explode(F.when(edge_row, whole).otherwise(ends)).alias("x"))
    cells = cells.where((F.col("x") % size).isin(0, size - 1) | edge_row)
    side = F.array(F.lit(-1), F.lit(0), F.lit(1))
    last = lambda c: F.col(c) % size == size - 1
    down = cells.where(last("y")).select("image_id", F.col("label").alias("u"), F.explode(F.transform(side, lambda d: F.col("x") + d)).alias("x"), (F.col("y") + 1).alias("y"))
    right = cells.where(last("x")).select("image_id", F.col("label").alias("u"), (F.col("x") + 1).alias("x"), F.explode(F.transform(side, lambda d: F.col("y") + d)).alias("y"))
    left = cells.where(F.col("x") % size == 0).select("image_id", F.col("label").alias("u"), (F.col("x") - 1).alias("x"), F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y"))
    met = down.unionByName(right).unionByName(left).join(cells.select("image_id", "x", "y", F.col("label").alias("v")), ["image_id", "x", "y"])
    return met.where("u <> v").select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def star_roots(edges: DataFrame) -> DataFrame:
    """The least label that each label is connected with: image_id, label, root.

    Alternating large and small stars (Kiveris et al., 2014): a node hands its larger neighbours, then its smaller ones, to
    the least of them, until every edge ends in a root. Each round is written to the shared folder and the one before it
    removed; a round costs one minimum for each node and one join of that minimum with the edges.
    """
    keys, pairs = ["image_id", "u"], keep(edges, "stars")
    while True:
        both = pairs.unionByName(pairs.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys).agg(F.least(F.col("u"), F.min("v")).alias("least"))
        large = both.join(least, keys).where("v > u").select("image_id", F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = keep(large, "stars")
        least = large.groupBy(*keys).agg(F.min("v").alias("least"))
        handed = large.join(least, keys)
        small = handed.select("image_id", F.col("v").alias("u"), F.col("least").alias("v")).unionByName(handed.select("image_id", "u", F.col("least").alias("v")))
        new = keep(small.where("u <> v").distinct(), "stars")
        discard(pairs, large)
        pairs = new
        hung = pairs.join(pairs.select("image_id", F.col("u").alias("v")), ["image_id", "v"], "left_semi").select(*keys)
        split = pairs.groupBy(*keys).count().where("count > 1").select(*keys)
        if not hung.unionByName(split).take(1):  # every label hangs on one root
            return pairs.select("image_id", F.col("u").alias("label"), F.col("v").alias("root"))


def components_by_joins(run: DataFrame, width: int, size: int = 1024) -> DataFrame:
    """The same labels for images too large for one task, in two levels.

    Tiles of ``size`` are labelled each on its own, by union-find on their runs; then only labels that touch at tile borders
    go through joins, which contract them to stars. The runs are written once.
    """
    pieces = keep(tile_components(run, width, size), "pieces")
    roots = star_roots(border_edges(pieces, size))
    first = pieces.where("x0 = run_x0").join(roots, ["image_id", "label"], "left")
    return first.select("image_id", "y", "x0", F.col("run_x1").alias("x1"), F.coalesce("root", "label").alias("label"))


def object_statistics(labelled: DataFrame) -> DataFrame:
    """Area, bounding box and centroid of each object, weighted over its runs."""
    n = (F.col("x1") - F.col("x0") + 1).cast("bigint")
    return (
        labelled.groupBy("image_id", "label")
        .agg(
            F.sum(n).alias("area"), F.min("x0").alias("x_min"), F.min("y").alias("y_min"), F.max("x1").alias("_mx"), F.max("y").alias("_my"),
            F.sum(n * (F.col("x0") + F.col("x1"))).alias("_sx"), F.sum(n * F.col("y")).alias("_sy"),
        )
        .select(
            "image_id", "label", "area", "x_min", "y_min", (F.col("_mx") - F.col("x_min") + 1).alias("w"), (F.col("_my") - F.col("y_min") + 1).alias("h"),
            (F.col("_sx") / 2 / F.col("area")).alias("cx"), (F.col("_sy") / F.col("area")).alias("cy"),
        )
    )


def at_least(objects: DataFrame, min_area: int = 500) -> DataFrame:
    return objects.where(F.col("area") >= min_area)


def filtered_mask(mask: DataFrame, labelled: DataFrame, kept: DataFrame) -> DataFrame:
    """255 only on objects of ``kept``; the runs turn back into pixels.

    Spark sizes an exploded table by its source, so the joins are merges by hint; else it would broadcast all pixels.
    """
    on = labelled.join(kept.select("image_id", "label").hint("merge"), ["image_id", "label"], "left_semi").select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(255).alias("_on"))
    return mask.select("image_id", "x", "y").join(on.hint("merge"), ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("_on", F.lit(0)).alias("mask"))


def object_counts(images: DataFrame, labelled: DataFrame) -> DataFrame:
    """Objects of each image, none included."""
    n = labelled.groupBy("image_id").agg(F.countDistinct("label").alias("n_objects"))
    return images.select("image_id").distinct().join(n, "image_id", "left").select("image_id", F.coalesce("n_objects", F.lit(0)).alias("n_objects"))


def box_outline(pixels: DataFrame, objects: DataFrame) -> DataFrame:
    """Pixels on the one-pixel outline of detection boxes, from (x, y) to (x + w, y + h) inclusive.

    Each box makes its own outline, so pixels and boxes meet on whole pixel keys, by a merge: Spark sizes an exploded table
    by its source and would broadcast the pixels.
    """
    box = objects.select("image_id", "label", "x_min", "y_min", (F.col("x_min") + F.col("w")).alias("ex"), (F.col("y_min") + F.col("h")).alias("ey"))
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    row = lambda y: F.transform(F.sequence("x_min", "ex"), lambda x: cell(x, F.col(y)))
    side = lambda x: F.transform(F.sequence("y_min", "ey"), lambda y: cell(F.col(x), y))
    outline = box.select("image_id", "label", F.inline(F.array_distinct(F.concat(row("y_min"), row("ey"), side("x_min"), side("ex")))))
    return pixels.select("image_id", "x", "y").join(outline.hint("merge"), ["image_id", "x", "y"]).select("image_id", "label", "x", "y")


def boundary(mask: DataFrame) -> DataFrame:
    """Foreground pixels with a background or missing neighbour on one of four sides."""
    sides = [F.lag("mask").over(along_x()), F.lead("mask").over(along_x()), F.lag("mask").over(along_y()), F.lead("mask").over(along_y())]
    flagged = mask.withColumns({f"_s{k}": s for k, s in enumerate(sides)})
    open_side = F.least(*[F.coalesce(f"_s{k}", F.lit(0)) for k in range(4)]) == 0
    return flagged.where((F.col("mask") > 0) & open_side).select("image_id", "x", "y")


def contours(labelled: DataFrame) -> DataFrame:
    """Ordered outer ring of each object, holes ignored: image_id, label, seq, x, y."""
    return labelled.groupBy("image_id", "label").applyInPandas(lambda f: ring_rows(f, None), "image_id bigint, label bigint, seq int, x int, y int")


def simplified_contours(labelled: DataFrame, epsilon_factor: float = 0.003) -> DataFrame:
    """Rings simplified with a tolerance of ``epsilon_factor`` times their length."""
    return labelled.groupBy("image_id", "label").applyInPandas(lambda f: ring_rows(f, epsilon_factor), "image_id bigint, label bigint, seq int, x int, y int")


def perimeter(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Length of closed rings given as vertices in order of seq."""
    order = Window.partitionBy(*keys).orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = [F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) - F.col(c) for c in ("x", "y")]
    sides = rings.withColumn("_dx", step[0]).withColumn("_dy", step[1])
    return sides.groupBy(*keys).agg(F.sum(F.sqrt((F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).cast("double"))).alias("perimeter"))


def rings_as_arrays(rings: DataFrame, keys: list[str], min_points: int = 10) -> DataFrame:
    """One array of points for each ring with at least ``min_points``."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return rings.groupBy(*keys).agg(points.alias("points")).where(F.size("points") >= min_points)


def normalised_points(rings: DataFrame, width: int, height: int) -> DataFrame:
    """Column values: x / width and y / height in turn."""
    return rings.withColumn("values", F.flatten(F.transform("points", lambda p: F.array(p["x"] / F.lit(float(width)), p["y"] / F.lit(float(height))))))


def label_lines(rings: DataFrame, class_id: int = 0) -> DataFrame:
    """Column line: the class and every value with six decimals."""
    return rings.withColumn("line", F.concat_ws(" ", F.lit(str(class_id)), F.transform("values", lambda v: F.format_string("%.6f", v))))


def polygon_labels(labelled: DataFrame, width: int, height: int, class_id: int = 0, min_points: int = 10, epsilon_factor: float = 0.003) -> DataFrame:
    """Contours, simplified, kept from ``min_points`` on, normalised and written as lines."""
    keys = ["image_id", "label"]
    return simplified_contours(labelled, epsilon_factor).transform(lambda d: rings_as_arrays(d, keys, min_points)).transform(lambda d: normalised_points(d, width, height)).transform(lambda d: label_lines(d, class_id))
