"""Tables of the library's shapes derived from the given tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = HEIGHT = 48


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame, key: str) -> DataFrame:
    """Rows that each become many: dealt by their key over all shuffle partitions, since a small file is one task's.

    The number is stated, else Spark would join the partitions again by the few bytes of the rows.
    """
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectances without geometry, from lineitem."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS image_id", "l_orderkey", "l_linenumber", "(l_partkey % 101) / 100D AS blue", "l_tax * 12.5D AS green", "l_discount * 10D AS red", "l_quantity / 50D AS nir"
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 48 x 48 RGB image for each supplier: three discs and inverted pixels."""
    grid = spread(read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").selectExpr("s_suppkey AS i", "explode(sequence(0, 47)) AS x").selectExpr("i", "x", "explode(sequence(0, 47)) AS y")
    disc = " OR ".join(f"(x-(8+(i*17+{k}*13)%32))*(x-(8+(i*17+{k}*13)%32))+(y-(8+(i*29+{k}*19)%32))*(y-(8+(i*29+{k}*19)%32)) <= 9+(i*7+{k}*11)%40" for k in (1, 2, 3))
    on = grid.selectExpr("i", "x", "y", f"(({disc}) <> ((x*31+y*17+i*7) % 97 = 0)) AS on")
    return on.selectExpr(
        "i AS image_id", "x", "y",
        "cast(if(on, 40+(x*3+y*5+i)%20, 120+(x*3+y*5+i)%20) as int) AS r",
        "cast(if(on, 160+(x*7+y+i)%20, 100+(x*7+y+i)%20) as int) AS g",
        "cast(if(on, 40+(x+y*11+i)%20, 80+(x+y*11+i)%20) as int) AS b",
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles with values out of range, from embeddings."""
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", "label", "embedding", "posexplode(embedding) AS (pos, v)").selectExpr(
        "image_id", "label", "pos % 8 AS x", "cast(pos div 8 as int) AS y", "cast(v as double) AS red", "cast(embedding[(pos + 1) % 64] as double) AS nir"
    )


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_name AS name", "p_partkey AS version", "p_type AS category",
        "map_filter(map('Red', p_size/50D, 'Green', (p_partkey%113)/100D, 'NIR', IF(p_partkey%3=0, NULL, (p_partkey%90)/100D)), (k,v) -> v IS NOT NULL) AS reflectance",
        "(p_partkey%7)/10D AS chlorophyll", "(p_partkey%11)/10D AS water_content", "(p_partkey%5)*1D AS lai", "(p_partkey%3)/10D AS stress",
    )


def image_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS idx",
        "concat('/raw/f', o_custkey % 13, '/img', o_orderkey % 400, CASE o_custkey % 4 WHEN 0 THEN '_NDVI' WHEN 1 THEN '_NIR' WHEN 2 THEN '_canopy' ELSE '' END, "
        "CASE o_orderkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.tif' WHEN 3 THEN '.jpeg' ELSE '.txt' END) AS image",
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band tables of as many sensors as there are suppliers, two to five bands each."""
    bands = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS i", "explode(sequence(1, cast(2 + s_suppkey % 4 as int))) AS k")
    return bands.selectExpr("concat('sensor', i) AS sensor", "concat('B', k) AS band", "400D + (i * 37 + k * 61) % 500 AS center", "10D + k AS bandwidth")


RING = ((10, 0), (9, 5), (5, 9), (0, 10), (-5, 9), (-9, 5), (-10, 0), (-9, -5), (-5, -9), (0, -10), (5, -9), (9, -5))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of 8 to 12 vertices, one for each supplier."""
    ring = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(RING)])
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.inline(ring))
    return rows.where("seq < 8 + image_id % 5").selectExpr("image_id", "seq", "cast(24 + image_id % 7 + dx as int) AS x", "cast(24 + image_id % 11 + dy as int) AS y")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded one-channel images, 8 x 8, from embeddings: origin, height, width, nChannels, data."""
    byte = "lpad(hex(cast(floor((cast(v as double) + 1) * 100) as int)), 2, '0')"
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", "8 AS height", "8 AS width", "1 AS nChannels", f"unhex(concat_ws('', transform(embedding, v -> {byte}))) AS data")


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 x 8 pixels from embeddings, to be written as files: grey, RGB and RGBA in turn; ``fault`` tells which to spoil."""
    at = "least(greatest(cast(floor((cast(embedding[i] as double) + 1) * 100) as int), 0), 255)"
    pixel = f"CASE vec_id % 3 WHEN 0 THEN array({at}) WHEN 1 THEN array({at}, 255 - {at}, ({at} + i) % 256) ELSE array({at}, 255 - {at}, ({at} + i) % 256, 200) END"
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS image_id", "concat('img', vec_id, CASE vec_id % 2 WHEN 0 THEN '.png' ELSE '.PNG' END) AS name", "8 AS height", "8 AS width", "CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS channels",
        f"flatten(transform(sequence(0, 63), i -> {pixel})) AS values", "CASE WHEN vec_id % 7 = 3 THEN 'cut' WHEN vec_id % 11 = 5 THEN 'text' WHEN vec_id % 13 = 4 THEN 'head' END AS fault",
    )


_DISC = " OR ".join(f"(x-(8+(i*17+{k}*13)%32))*(x-(8+(i*17+{k}*13)%32))+(y-(8+(i*29+{k}*19)%32))*(y-(8+(i*29+{k}*19)%32)) <= 9+(i*7+{k}*11)%40" for k in (1, 2, 3))

SQL = {
    "samples": "samples AS (SELECT l_suppkey AS image_id, l_orderkey, l_linenumber, (l_partkey % 101) / CAST(100 AS DOUBLE) AS blue, l_tax * CAST(12.5 AS DOUBLE) AS green, l_discount * CAST(10 AS DOUBLE) AS red, l_quantity / CAST(50 AS DOUBLE) AS nir FROM lineitem)",
    "pixels": f"""grid AS (SELECT s_suppkey AS i, CAST(a.range AS INTEGER) AS x, CAST(b.range AS INTEGER) AS y FROM supplier, range(48) a, range(48) b),
lit AS (SELECT i, x, y, (({_DISC}) <> ((x*31+y*17+i*7) % 97 = 0)) AS veg FROM grid),
pixels AS (SELECT i AS image_id, x, y, CAST(CASE WHEN veg THEN 40+(x*3+y*5+i)%20 ELSE 120+(x*3+y*5+i)%20 END AS INTEGER) AS r,
CAST(CASE WHEN veg THEN 160+(x*7+y+i)%20 ELSE 100+(x*7+y+i)%20 END AS INTEGER) AS g, CAST(CASE WHEN veg THEN 40+(x+y*11+i)%20 ELSE 80+(x+y*11+i)%20 END AS INTEGER) AS b FROM lit)""",
    "tiles": "tiles AS (SELECT vec_id AS image_id, label, CAST((p-1) % 8 AS INTEGER) AS x, CAST((p-1) // 8 AS INTEGER) AS y, CAST(embedding[p] AS DOUBLE) AS red, CAST(embedding[p % 64 + 1] AS DOUBLE) AS nir FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, 64)) AS p FROM embeddings))",
    "image_files": """raw_px AS (SELECT vec_id AS image_id, CAST((p - 1) % 8 AS INTEGER) AS x, CAST((p - 1) // 8 AS INTEGER) AS y, p - 1 AS i, least(greatest(CAST(floor((CAST(embedding[p] AS DOUBLE) + 1) * 100) AS INTEGER), 0), 255) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS p FROM embeddings)),
file_px AS (SELECT image_id, x, y, v AS r, CASE WHEN image_id % 3 = 0 THEN v ELSE 255 - v END AS g, CAST(CASE WHEN image_id % 3 = 0 THEN v ELSE (v + i) % 256 END AS INTEGER) AS b FROM raw_px),
image_files AS (SELECT vec_id AS image_id, 'img' || vec_id || CASE vec_id % 2 WHEN 0 THEN '.png' ELSE '.PNG' END AS name, CASE WHEN vec_id % 7 = 3 THEN 'cut' WHEN vec_id % 11 = 5 THEN 'text' WHEN vec_id % 13 = 4 THEN 'head' END AS fault FROM embeddings)""",
    "materials": """materials AS (SELECT p_name AS name, p_partkey AS version, p_type AS category, p_size / CAST(50 AS DOUBLE) AS red, (p_partkey % 113) / CAST(100 AS DOUBLE) AS green,
CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 90) / CAST(100 AS DOUBLE) END AS nir, (p_partkey % 7) / CAST(10 AS DOUBLE) AS chlorophyll, (p_partkey % 11) / CAST(10 AS DOUBLE) AS water_content,
(p_partkey % 5) * CAST(1 AS DOUBLE) AS lai, (p_partkey % 3) / CAST(10 AS DOUBLE) AS stress FROM part),
latest AS (SELECT * FROM materials QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1)""",
    "image_samples": """image_samples AS (SELECT o_orderkey AS idx, concat('/raw/f', o_custkey % 13, '/img', o_orderkey % 400, CASE o_custkey % 4 WHEN 0 THEN '_NDVI' WHEN 1 THEN '_NIR' WHEN 2 THEN '_canopy' ELSE '' END,
CASE o_orderkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.tif' WHEN 3 THEN '.jpeg' ELSE '.txt' END) AS image FROM orders),
named0 AS (SELECT *, regexp_extract(image, '([^/]*)$', 1) AS name FROM image_samples), named1 AS (SELECT *, regexp_extract(name, '.(\\.[^.]+)$', 1) AS suffix FROM named0),
named AS (SELECT *, left(name, length(name) - length(suffix)) AS stem FROM named1)""",
    "sensors": "sensors AS (SELECT 'sensor' || i AS sensor, 'B' || k AS band, CAST(400 AS DOUBLE) + (i * 37 + k * 61) % 500 AS center, CAST(10 AS DOUBLE) + k AS bandwidth FROM (SELECT s_suppkey AS i, unnest(range(1, 3 + s_suppkey % 4)) AS k FROM supplier))",
    "polygons": "ring AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(RING)) + ") t(seq, dx, dy)), polygons AS (SELECT s_suppkey AS image_id, seq, CAST(24 + s_suppkey % 7 + dx AS INTEGER) AS x, CAST(24 + s_suppkey % 11 + dy AS INTEGER) AS y FROM supplier, ring WHERE seq < 8 + s_suppkey % 5)",
}


def _clip(v: str, low: str = "0", high: str = "1") -> str:
    return f"CASE WHEN isnan({v}) THEN {v} ELSE least(greatest({v}, CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE)) END"


def _smooth(value: str, part: str, order: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY {order})"
    l1, l2, r1, r2 = f"lag({value}, 1) {w}", f"lag({value}, 2) {w}", f"lead({value}, 1) {w}", f"lead({value}, 2) {w}"
    left1, right1 = f"coalesce({l1}, {r1}, {value})", f"coalesce({r1}, {l1}, {value})"
    left2 = f"coalesce({l2}, CASE WHEN {l1} IS NULL THEN {r2} END, {value})"
    right2 = f"coalesce({r2}, CASE WHEN {r1} IS NULL THEN {l2} END, {value})"
    return f"({left2} + {left1} * 4 + {value} * 6 + {right1} * 4 + {right2}) / CAST(16 AS DOUBLE)"


def _sweep(source: str, name: str, pick: str) -> str:
    """Two CTEs that erode (min) or dilate (max) column mask of ``source`` into table ``name``."""
    return (
        f"{name}_h AS (SELECT image_id, x, y, {pick}(mask) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mask FROM {source}), "
        f"{name} AS (SELECT image_id, x, y, {pick}(mask) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mask FROM {name}_h)"
    )


_UNIT = "CASE WHEN peak > 1 THEN {c} / CAST(255 AS DOUBLE) ELSE CAST({c} AS DOUBLE) END"
SQL |= {
    "units": SQL["pixels"] + ", peaks AS (SELECT *, max(greatest(r, g, b)) OVER (PARTITION BY image_id) AS peak FROM pixels), units AS (SELECT image_id, x, y, r, g, b, " + ", ".join(_UNIT.format(c=c) + f" AS {c}n" for c in "rgb") + " FROM peaks)",
}
SQL["exg"] = SQL["units"] + ", e0 AS (SELECT *, gn * 2 - rn - bn AS e FROM units), e1 AS (SELECT *, min(e) OVER (PARTITION BY image_id) AS lo, max(e) OVER (PARTITION BY image_id) AS hi FROM e0), exg AS (SELECT image_id, x, y, rn, gn, bn, (e - lo) / (hi - lo + CAST(1e-6 AS DOUBLE)) AS exg FROM e1)"
SQL["blur"] = SQL["exg"] + f", b0 AS (SELECT *, {_smooth('exg', 'image_id, y', 'x')} AS h FROM exg), blur AS (SELECT * EXCLUDE (h), {_smooth('h', 'image_id, x', 'y')} AS blur FROM b0)"
SQL["veg"] = SQL["blur"] + ", v0 AS (SELECT *, min(blur) OVER (PARTITION BY image_id) AS lo, max(blur) OVER (PARTITION BY image_id) AS hi FROM blur), veg AS (SELECT image_id, x, y, rn, gn, bn, (blur - lo) / (hi - lo + CAST(1e-6 AS DOUBLE)) AS veg FROM v0)"
_D = "CAST({} AS DOUBLE)".format
SQL["bands"] = (
    SQL["veg"]
    + ", bands AS (SELECT image_id, x, y, "
    + f"{_clip('bn * ' + _D(0.85))} AS blue, {_clip('gn * ' + _D(0.95))} AS green, {_clip('rn * ' + _D(0.90))} AS red, "
    + f"{_clip(f'(rn * {_D(0.45)} + gn * {_D(0.45)} + veg * {_D(0.10)})')} AS red_edge, "
    + f"{_clip(f'((rn * {_D(0.25)} + gn * {_D(0.55)} + veg * {_D(0.20)} + veg * {_D(0.25)}) * ({_D(0.75)} + veg * {_D(0.25)}))')} AS nir FROM veg)"
)
SQL["raw_mask"] = SQL["exg"] + ", raw_mask AS (SELECT image_id, x, y, CASE WHEN NOT isnan(exg) AND exg > CAST(0.25 AS DOUBLE) THEN 255 ELSE 0 END AS mask FROM exg)"
SQL["opened"] = SQL["raw_mask"] + ", " + _sweep("raw_mask", "er1", "min") + ", " + _sweep("er1", "opened", "max")
SQL["closed"] = SQL["opened"] + ", " + _sweep("opened", "di2", "max") + ", " + _sweep("di2", "closed", "min")
SQL["runs"] = SQL["closed"] + ", isl AS (SELECT image_id, x, y, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM closed WHERE mask > 0), runs AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM isl GROUP BY image_id, y, k)"
SQL["edges"] = SQL["runs"] + ", edges AS (SELECT a.image_id, a.y, a.x0, b.x0 AS below_x0 FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.y = a.y + 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1)"
SQL["labelled"] = (
    SQL["edges"]
    + ", nodes AS (SELECT *, y * 48 + x0 AS node FROM runs), ways AS (SELECT image_id, y * 48 + x0 AS a, (y + 1) * 48 + below_x0 AS b FROM edges UNION ALL SELECT image_id, (y + 1) * 48 + below_x0, y * 48 + x0 FROM edges), "
    + "reach(image_id, node, got) AS (SELECT image_id, node, node FROM nodes UNION SELECT r.image_id, r.node, w.b FROM reach r JOIN ways w ON r.image_id = w.image_id AND r.got = w.a), "
    + "least_of AS (SELECT image_id, node, min(got) AS label FROM reach GROUP BY image_id, node), labelled AS (SELECT n.image_id, n.y, n.x0, n.x1, CAST(l.label AS BIGINT) AS label FROM nodes n JOIN least_of l ON n.image_id = l.image_id AND n.node = l.node)"
)
SQL["objects"] = (
    SQL["labelled"]
    + ", objects AS (SELECT image_id, label, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area, min(x0) AS x_min, min(y) AS y_min, max(x1) - min(x0) + 1 AS w, max(y) - min(y) + 1 AS h, "
    + "sum((x1 - x0 + 1) * (x0 + x1)) / CAST(2 AS DOUBLE) / sum(x1 - x0 + 1) AS cx, sum((x1 - x0 + 1) * y) / CAST(sum(x1 - x0 + 1) AS DOUBLE) AS cy FROM labelled GROUP BY image_id, label)"
)
# Outer rings by crack following: a crack is a side of a pixel that faces the outside of its object (0 up, 1 right, 2 down,
# 3 left). At its end the walk goes on to the pixel across the corner, else to the one ahead, else around the same pixel.
SQL["rings"] = (
    SQL["labelled"]
    + ", px AS (SELECT image_id, label, CAST(unnest(range(x0, x1 + 1)) AS INTEGER) AS x, y FROM labelled), "
    + "frame AS (SELECT image_id, label, min(x) - 1 AS xa, max(x) + 1 AS xb, min(y) - 1 AS ya, max(y) + 1 AS yb FROM px GROUP BY image_id, label), "
    + "grid2 AS (SELECT image_id, label, CAST(x AS INTEGER) AS x, CAST(unnest(range(ya, yb + 1)) AS INTEGER) AS y FROM (SELECT *, unnest(range(xa, xb + 1)) AS x FROM frame)), "
    + "bg AS (SELECT * FROM grid2 ANTI JOIN px USING (image_id, label, x, y)), "
    + "outside(image_id, label, x, y) AS (SELECT image_id, label, CAST(xa AS INTEGER), CAST(ya AS INTEGER) FROM frame UNION SELECT b.image_id, b.label, b.x, b.y FROM outside o JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) ON true JOIN bg b ON b.image_id = o.image_id AND b.label = o.label AND b.x = o.x + dx AND b.y = o.y + dy), "
    + "turns AS (SELECT * FROM (VALUES (0, 0, -1, 1, 0), (1, 1, 0, 0, 1), (2, 0, 1, -1, 0), (3, -1, 0, 0, -1)) t(s, ox, oy, tx, ty)), "
    + "cracks AS (SELECT p.image_id, p.label, p.x, p.y, s, tx, ty, p.x + ox + tx AS dx, p.y + oy + ty AS dy FROM px p, turns t JOIN outside o ON o.image_id = p.image_id AND o.label = p.label AND o.x = p.x + ox AND o.y = p.y + oy), "
    + "moves AS (SELECT c.image_id, c.label, c.x, c.y, c.s, coalesce(d.x, a.x, c.x) AS nx, coalesce(d.y, a.y, c.y) AS ny, CASE WHEN d.x IS NOT NULL THEN (c.s + 3) % 4 WHEN a.x IS NOT NULL THEN c.s ELSE (c.s + 1) % 4 END AS ns "
    + "FROM cracks c LEFT JOIN px d ON d.image_id = c.image_id AND d.label = c.label AND d.x = c.dx AND d.y = c.dy LEFT JOIN px a ON a.image_id = c.image_id AND a.label = c.label AND a.x = c.x + c.tx AND a.y = c.y + c.ty), "
    + "start AS (SELECT image_id, label, CAST(label % 48 AS INTEGER) AS x, CAST(label // 48 AS INTEGER) AS y FROM frame), "
    + "walk(image_id, label, k, x, y, s) AS (SELECT image_id, label, 0, x, y, 0 FROM start UNION ALL SELECT m.image_id, m.label, k + 1, m.nx, m.ny, m.ns FROM walk w JOIN moves m ON m.image_id = w.image_id AND m.label = w.label AND m.x = w.x AND m.y = w.y AND m.s = w.s "
    + "JOIN start t ON t.image_id = w.image_id AND t.label = w.label WHERE NOT (m.nx = t.x AND m.ny = t.y AND m.ns = 0)), "
    + "steps AS (SELECT w.image_id, w.label, k, w.x, w.y, nx <> w.x OR ny <> w.y AS moved FROM walk w JOIN moves m USING (image_id, label, x, y, s)), "
    + "rings AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id, label ORDER BY k) - 1 AS INTEGER) AS seq, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT *, bool_or(moved) OVER (PARTITION BY image_id, label) AS any_move FROM steps) WHERE moved OR (NOT any_move AND k = 0))"
)
# Closed simplification: the vertex farthest from the first splits the ring, then each part splits at its farthest vertex
# while that deviates by more than the tolerance. Deviations of one part compare as integers.
SQL["simple"] = (
    SQL["rings"]
    + ", lap AS (SELECT *, count(*) OVER w AS n, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy FROM rings WINDOW w AS (PARTITION BY image_id, label), o AS (PARTITION BY image_id, label ORDER BY seq)), "
    + "whole AS (SELECT image_id, label, any_value(n) AS n, CAST(0.003 AS DOUBLE) * sum(sqrt(CAST((nx - x) * (nx - x) + (ny - y) * (ny - y) AS DOUBLE))) AS tolerance, first(seq ORDER BY (x - fx) * (x - fx) + (y - fy) * (y - fy) DESC, seq) AS far FROM lap GROUP BY image_id, label), "
    + "loop AS (SELECT image_id, label, seq AS i, x, y FROM rings UNION ALL SELECT image_id, label, n, fx, fy FROM lap WHERE seq = 0), "
    + "part(image_id, label, a, b) AS (SELECT image_id, label, 0, CAST(far AS BIGINT) FROM whole WHERE n > 2 UNION ALL SELECT image_id, label, far, n FROM whole WHERE n > 2 UNION ALL "
    + "SELECT image_id, label, unnest([a, k]), unnest([k, b]) FROM (SELECT image_id, label, a, b, first(i ORDER BY off DESC, i) AS k, max(off) / CASE WHEN any_value(long2) = 0 THEN CAST(1 AS DOUBLE) ELSE sqrt(CAST(any_value(long2) AS DOUBLE)) END AS most FROM ("
    + "SELECT p.image_id, p.label, p.a, p.b, r.i, (v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y) AS long2, CASE WHEN v.x = u.x AND v.y = u.y THEN sqrt(CAST((r.x - u.x) * (r.x - u.x) + (r.y - u.y) * (r.y - u.y) AS DOUBLE)) ELSE CAST(abs((v.x - u.x) * (r.y - u.y) - (v.y - u.y) * (r.x - u.x)) AS DOUBLE) END AS off "
    + "FROM part p JOIN loop u ON u.image_id = p.image_id AND u.label = p.label AND u.i = p.a JOIN loop v ON v.image_id = p.image_id AND v.label = p.label AND v.i = p.b JOIN loop r ON r.image_id = p.image_id AND r.label = p.label AND r.i > p.a AND r.i < p.b) GROUP BY image_id, label, a, b) "
    + "JOIN (SELECT image_id, label, tolerance FROM whole) USING (image_id, label) WHERE most > tolerance), "
    + "held AS (SELECT DISTINCT image_id, label, a AS seq FROM part UNION SELECT image_id, label, seq FROM rings JOIN whole USING (image_id, label) WHERE n < 3), "
    + "simple AS (SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id, label ORDER BY seq) - 1 AS INTEGER) AS seq, x, y FROM rings JOIN held USING (image_id, label, seq))"
)


def with_(name: str, recursive: bool = False) -> str:
    """WITH clause that defines the table ``name``."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + SQL[name] + " "
