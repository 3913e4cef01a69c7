"""Closed forms, invariants and edge cases of the operators."""

import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.functions import expressions as X
from leafgrid.functions.geometry import RunCells, ring_length, simplify, trace
from leafgrid.operators import audit, bands, catalog, indices, materials, morphology, objects, sensors, tiles
from leafgrid.plans import jobs
from leafgrid.sources import materials as material_files
from leafgrid.sources import pixels as images
from leafgrid.sources import sinks
from leafgrid.sources import files
from leafgrid.streaming.ingest import ingest, ingest_images

NAN = float("nan")


def pixel_table(spark, rows):
    return spark.createDataFrame(rows, "image_id bigint, x int, y int, r int, g int, b int")


def mask_table(spark, grid, image=1):
    return spark.createDataFrame([(image, x, y, 255 if v else 0) for y, row in enumerate(grid) for x, v in enumerate(row)], "image_id bigint, x int, y int, mask int")


def grid_of(df):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), int)
    for r in rows:
        out[r["y"], r["x"]] = r["mask"] > 0
    return out


def test_indices_closed_forms(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0, 1.0), (2, 0.2, 0.0, 0.0, 0.5), (3, 1.0, 0.0, 0.0, 0.5), (4, 0.1, 0.1, 0.1, NAN)]
    got = {r["k"]: r for r in indices.with_indices(spark.createDataFrame(rows, "k int, blue double, green double, red double, nir double")).collect()}
    for name in X.INDICES:
        assert got[0][name] == 0 and math.isnan(got[4][name])
    assert got[1]["ndvi"] == 0 and got[1]["evi"] == 0
    assert got[2]["evi"] == 1.0  # a zero denominator, then the clip
    assert round(got[3]["evi"], 6) == -0.208333


def test_nan_never_passes_a_threshold(spark):
    df = spark.createDataFrame([(NAN,), (0.3,), (0.25,)], "v double")
    assert [r[0] for r in df.select(X.above(F.col("v"), 0.25)).collect()] == [False, True, False]
    assert [r[0] for r in df.select(X.quantise(F.col("v"))).collect()] == [0, 76, 63]


def test_statistics_propagate_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, NAN), (2, 1.0)], "image_id int, v double")
    got = {r["image_id"]: r for r in audit.statistics(df, "v").collect()}
    assert (got[1]["minimum"], got[1]["maximum"], got[1]["mean"], got[1]["std"]) == (1, 3, 2, 1)
    assert math.isnan(got[2]["minimum"]) and math.isnan(got[2]["std"])


def test_normalise_depends_on_the_whole_image(spark):
    df = pixel_table(spark, [(1, 0, 0, 1, 0, 1), (2, 0, 0, 1, 0, 255), (2, 1, 0, 1, 1, 1)])
    got = {(r["image_id"], r["x"]): r["rn"] for r in bands.normalise(df).collect()}
    assert got[1, 0] == 1 and got[2, 0] == got[2, 1] == 1 / 255


@pytest.mark.parametrize("width,height", [(1, 1), (5, 1), (1, 4), (2, 2), (7, 6)])
def test_gaussian_matches_mirror_padding(spark, width, height):
    rng = np.random.default_rng(width * 10 + height)
    image = rng.random((height, width))
    df = spark.createDataFrame([(1, x, y, float(image[y, x])) for y in range(height) for x in range(width)], "image_id bigint, x int, y int, v double")
    got = np.zeros_like(image)
    for r in bands.gaussian(df, "v").collect():
        got[r["y"], r["x"]] = r["v"]

    def mirrored(i, n):
        while not 0 <= i < n:
            i = 0 if n == 1 else -i if i < 0 else 2 * (n - 1) - i
        return i

    k = np.array([1, 4, 6, 4, 1]) / 16
    across = np.array([[sum(k[d + 2] * image[y, mirrored(x + d, width)] for d in range(-2, 3)) for x in range(width)] for y in range(height)])
    want = np.array([[sum(k[d + 2] * across[mirrored(y + d, height), x] for d in range(-2, 3)) for x in range(width)] for y in range(height)])
    assert np.allclose(got, want)


def test_constant_image_is_background(spark):
    df = pixel_table(spark, [(1, x, y, 10, 200, 10) for x in range(6) for y in range(6)])
    assert morphology.vegetation_mask(df).agg(F.sum("mask")).first()[0] == 0


def test_morphology_order_and_idempotence(spark):
    rng = np.random.default_rng(1)
    df = mask_table(spark, rng.random((14, 17)) < 0.6)
    raw, opened, closed = grid_of(df), grid_of(morphology.opening(df, k=3)), grid_of(morphology.closing(df, k=3))
    assert (opened <= raw).all() and (raw <= closed).all()
    assert (grid_of(morphology.opening(morphology.opening(df, k=3), k=3)) == opened).all()
    assert (grid_of(morphology.closing(morphology.closing(df, k=3), k=3)) == closed).all()


def test_mask_is_the_same_for_any_partitioning_and_tiling(spark):
    rng = random.Random(3)
    df = pixel_table(spark, [(i, x, y, rng.randrange(60), rng.choice([20, 220]), rng.randrange(60)) for i in (1, 2) for x in range(30) for y in range(21)])
    want = sorted(map(tuple, morphology.vegetation_mask(df, k=3).select("image_id", "x", "y", "mask").collect()))
    assert sorted(map(tuple, morphology.vegetation_mask(df.repartition(7), k=3).select("image_id", "x", "y", "mask").collect())) == want
    assert sorted(map(tuple, morphology.tiled_vegetation_mask(df, size=8, k=3).collect())) == want
    for k in (2, 3, 4, 5):
        want = sorted(map(tuple, morphology.vegetation_mask(df, k=k).select("image_id", "x", "y", "mask").collect()))
        assert sorted(map(tuple, morphology.vegetation_mask_by_lines(df, k=k).collect())) == want


def flood(grid):
    todo, parts = {(x, y) for y, row in enumerate(grid) for x, v in enumerate(row) if v}, []
    while todo:
        stack, part = [todo.pop()], set()
        while stack:
            x, y = stack.pop()
            part.add((x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if (x + dx, y + dy) in todo:
                        todo.remove((x + dx, y + dy))
                        stack.append((x + dx, y + dy))
        parts.append(part)
    return parts


@pytest.mark.parametrize("density", [0.2, 0.45, 0.7])
def test_components_match_flood_fill(spark, density):
    grid = np.random.default_rng(int(density * 100)).random((18, 23)) < density
    run = objects.runs(mask_table(spark, grid))
    want = sorted((min(y * 23 + x for x, y in part), len(part)) for part in flood(grid))
    for labelled in (objects.components(run, 23), objects.components_by_joins(run, 23)):
        stats = objects.object_statistics(labelled).collect()
        assert sorted((r["label"], r["area"]) for r in stats) == want
    assert sum(r["area"] for r in stats) == grid.sum()


SPIRAL = ["##########", ".........#", "########.#", "#......#.#", "#.####.#.#", "#.#..#.#.#", "#.#.##.#.#", "#.#....#.#", "#.######.#", "#........#", "##########"]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64])
def test_components_by_tiles(spark, size):
    """A spiral through all tiles, diagonal contacts across corners, noise: as in one piece."""
    rng = np.random.default_rng(size)
    grids = [[[c == "#" for c in row] for row in SPIRAL], np.indices((9, 9)).sum(0) % 2 == 0, rng.random((17, 13)) < 0.45]
    mask = mask_table(spark, grids[0], 1).unionByName(mask_table(spark, grids[1], 2)).unionByName(mask_table(spark, grids[2], 3))
    run = objects.runs(mask)
    rows = lambda df: sorted(map(tuple, df.select("image_id", "y", "x0", "x1", "label").collect()))
    assert rows(objects.components_by_joins(run, 20, size)) == rows(objects.components(run, 20))
    assert objects.components_by_joins(run.limit(0), 20, size).count() == 0


def test_joins_of_components_hold_border_labels_only(spark):
    """Objects inside a tile never reach the joins."""
    grid = np.zeros((40, 40), bool)
    grid[2:8, 2:8] = grid[12:18, 13:17] = True
    grid[5:35, 30:32] = True
    edges = objects.border_edges(objects.tile_components(objects.runs(mask_table(spark, grid)), 40, 10), 10)
    assert {(r["u"], r["v"]) for r in edges.collect()} == {(430, 230), (830, 430), (1230, 830)}


def test_rings_on_runs_match_pixel_sets():
    rng = np.random.default_rng(11)
    for grid in [rng.random((14, 15)) < 0.55 for _ in range(20)]:
        for part in flood(grid):
            rows = sorted((y, x) for x, y in part)
            starts = [k for k, (y, x) in enumerate(rows) if k == 0 or rows[k - 1] != (y, x - 1)]
            ends = [*[k - 1 for k in starts[1:]], len(rows) - 1]
            cells = RunCells(np.array([rows[k][0] for k in starts]), np.array([rows[k][1] for k in starts]), np.array([rows[k][1] for k in ends]))
            assert trace(cells) == trace(part)


def test_ring_of_a_large_disc():
    """A disc of 4,000 pixels across has twelve million pixels and 4,001 runs; the ring is traced on the runs."""
    y = np.arange(-2000, 2001)
    half = np.floor(np.sqrt(2000**2 - y.astype(float) ** 2)).astype(int)
    cells = RunCells(y + 2000, 2000 - half, 2000 + half)
    ring = trace(cells)
    assert sum(len(starts) for starts, _ in cells.lines.values()) == 4001
    assert len(ring) == len(set(ring)) and all((x - 2000) ** 2 + (v - 2000) ** 2 <= 2000**2 < (abs(x - 2000) + 1) ** 2 + (abs(v - 2000) + 1) ** 2 for x, v in ring)
    assert 11_000 < len(ring) < 12_000


def test_object_counts_keep_empty_images(spark):
    run = objects.runs(mask_table(spark, [[1, 0, 1]]).unionByName(mask_table(spark, [[0, 0]], 2)))
    got = dict(objects.object_counts(spark.createDataFrame([(1,), (2,)], "image_id bigint"), objects.components(run, 48)).collect())
    assert got == {1: 2, 2: 0}


def test_contours_and_simplification(spark):
    square = [[int(1 <= x <= 20 and 1 <= y <= 20) for x in range(24)] for y in range(24)]
    labelled = objects.components(objects.runs(mask_table(spark, square)), 24)
    ring = objects.contours(labelled).collect()
    assert len(ring) == 76
    corners = {(r["x"], r["y"]) for r in objects.simplified_contours(labelled).collect()}
    assert corners == {(1, 1), (20, 1), (20, 20), (1, 20)}
    assert objects.perimeter(objects.simplified_contours(labelled), ["image_id", "label"]).first()["perimeter"] == 76
    assert objects.polygon_labels(labelled, 24, 24, min_points=4).first()["line"].startswith("0 0.041667 0.041667 ")
    assert objects.polygon_labels(labelled, 24, 24).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_trace_visits_the_outline(seed):
    grid = np.random.default_rng(seed).random((9, 11)) < 0.55
    for part in flood(grid):
        ring = trace(part)
        assert set(ring) <= part
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        shape = np.array(ring, float)
        short = simplify(shape, 0.5)
        assert {tuple(p) for p in short} <= {tuple(p) for p in shape}
        assert ring_length(short) <= ring_length(shape) + 1e-9


def test_noise_is_a_function_of_the_pixel(spark):
    df = spark.createDataFrame([(i, x, y, 0.5) for i in (1, 2) for x in range(40) for y in range(40)], "image_id bigint, x int, y int, v double")
    one = sorted(map(tuple, bands.add_noise(df, "v", 0.01, 7).collect()))
    assert one == sorted(map(tuple, bands.add_noise(df.repartition(5), "v", 0.01, 7).collect()))
    values = np.array([r[3] for r in one])
    assert abs(values.mean() - 0.5) < 1e-3 and abs(values.std() - 0.01) < 1e-3
    assert bands.add_noise(df, "v", 0.0) is df


def test_material_files(spark, tmp_path):
    good = {"name": "leaf", "category": "plant", "reflectance": {"Red": 0.1, "NIR": 0.6}, "lai": 2.0}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"category": "crop"}, indent=2))
    library = material_files.load_library(spark, str(tmp_path)).collect()
    assert [(r["name"], r["category"], r["stress"]) for r in library] == [("leaf", "crop", 0.0)]
    (tmp_path / "c.json").write_text(json.dumps(good | {"colour": 1}))
    (tmp_path / "d.json").write_text(json.dumps({"name": "x"}))
    problems = {r["problem"] for r in material_files.read_materials(spark, str(tmp_path)).collect()}
    assert problems == {None, "unknown key", "missing name or category"}
    with pytest.raises(Exception, match="unknown key|missing name"):
        material_files.load_library(spark, str(tmp_path)).collect()


def test_mixing_rejects_alpha(spark):
    m = spark.createDataFrame([("a", "c", {"Red": 0.2}, 1.0, 0.0, 0.0, 0.0), ("b", "d", {"NIR": 1.0}, 0.0, 0.0, 0.0, 0.0)], "name string, category string, reflectance map<string,double>, chlorophyll double, water_content double, lai double, stress double")
    pairs = materials.pair(m, m, spark.createDataFrame([("a", "b")], "name_a string, name_b string"))
    row = materials.mixed(pairs.withColumn("alpha", F.lit(0.5))).first()
    assert (row["name"], row["category"], row["reflectance"], row["chlorophyll"]) == ("a_b", "c", {"Red": 0.1}, 0.5)
    with pytest.raises(Exception, match="alpha outside"):
        materials.mixed(pairs.withColumn("alpha", F.lit(1.5))).collect()


def png(path, rows):
    """A small RGB file written by hand."""
    height, width = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files_become_pixels(spark, tmp_path):
    png(tmp_path / "one.png", [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (250, 251, 252)]])
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_text("no")
    found = images.read_images(spark, str(tmp_path))
    good, bad = catalog.quarantine(found)
    assert bad.count() == 1 and tuple(catalog.success_ratio(found).first()) == (1, 2)
    got = sorted(tuple(r)[1:] for r in images.explode_pixels(good, ["origin"]).collect())
    assert got == [(0, 0, 1, 2, 3), (0, 1, 7, 8, 9), (1, 0, 4, 5, 6), (1, 1, 250, 251, 252)]


def test_ingest_adds_each_row_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(10).write.parquet(source)
    for _ in range(2):
        ingest(spark, source, "id bigint", sink, state, key="id")
    spark.range(5, 15).write.mode("append").parquet(source)
    ingest(spark, source, "id bigint", sink, state, key="id")
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(15))


def test_retried_batch_repeats_no_rows(spark, tmp_path):
    """The state of the last commit is lost after its rows were written, so the batch runs once more."""
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(10).write.parquet(source)
    ingest(spark, source, "id bigint", sink, state)
    for left in (tmp_path / "state" / "commits").iterdir():
        left.unlink()
    ingest(spark, source, "id bigint", sink, state)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(10))


def test_sink_folders(spark, tmp_path):
    sinks.write_polygons(spark.createDataFrame([("a", [1]), ("b", [2])], "stem string, polygons array<int>"), str(tmp_path / "p"), folders=True)
    assert {p.name for p in (tmp_path / "p").glob("stem=*")} == {"stem=a", "stem=b"}


def test_empty_sample_source_fails(spark, tmp_path):
    spark.createDataFrame([], "idx bigint, image string").write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="no samples"):
        images.read_samples(spark, str(tmp_path / "s"))


def test_fixture_anchors(spark):
    """Figures of the batch path on the spatial fixture."""
    from leafgrid.plans import fixtures as fx

    px = fx.pixels(spark, "/root/testdata/sf0.01")
    sums = px.agg(F.count("*"), F.sum("r"), F.sum("g"), F.sum("b")).first()
    assert tuple(sums) == (230400, 27554560, 26940480, 19479680)
    mean = jobs.batch_index(px).agg(F.round(F.avg("nir"), 6), F.round(F.avg("ndvi"), 6), F.count_if(F.expr("ndvi > 0.35 and g > r"))).first()
    assert tuple(mean) == (0.635445, 0.144149, 28528)


def test_pixel_pipeline_shuffles_once(spark):
    px = pixel_table(spark, [(1, x, y, 1, 2, 3) for x in range(3) for y in range(3)])
    plan = morphology.vegetation_mask(px)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_palettes(spark):
    """Anchors of the maps as they are published, not derived from the library's constants."""
    jet = {r["code"]: (r["pr"], r["pg"], r["pb"]) for r in indices.jet_palette(spark).collect()}
    assert len(jet) == 256 and jet[0] == (0, 0, 127) and jet[255] == (127, 0, 0) and jet[128] == (125, 255, 121)
    turbo = {r["code"]: (r["pr"], r["pg"], r["pb"]) for r in indices.turbo_palette(spark).collect()}
    assert len(turbo) == 256
    for code, want in ((0, (48, 18, 59)), (128, (164, 252, 60)), (255, (122, 4, 3))):
        assert max(abs(a - b) for a, b in zip(turbo[code], want, strict=True)) <= 35  # a fit, loose at its ends
    codes = spark.createDataFrame([(NAN,), (0.0,), (0.5,), (1.0,), (2.0,)], "v double").select(indices.fraction_code(F.col("v")))
    assert [r[0] for r in codes.collect()] == [0, 0, 128, 255, 255]


def test_box_outline_makes_its_own_cells(spark):
    """A one-pixel box, a box cut by the image's edge, and no plan that meets whole images with boxes."""
    px = spark.createDataFrame([(1, x, y) for x in range(6) for y in range(5)], "image_id bigint, x int, y int")
    boxes = spark.createDataFrame([(1, 7, 1, 1, 1, 1), (1, 9, 3, 2, 4, 4)], "image_id bigint, label bigint, x_min int, y_min int, w int, h int")
    got = sorted(map(tuple, objects.box_outline(px, boxes).select("label", "x", "y").collect()))
    want = [(l, x, y) for l, x0, y0, w, h in ((7, 1, 1, 1, 1), (9, 3, 2, 4, 4)) for x in range(6) for y in range(5) if x0 <= x <= x0 + w and y0 <= y <= y0 + h and (x in (x0, x0 + w) or y in (y0, y0 + h))]
    assert got == sorted(want)


def test_mask_by_lines_alternates_three_times(spark):
    px = pixel_table(spark, [(1, x, y, 1, 2, 3) for x in range(3) for y in range(3)])
    plan = morphology.vegetation_mask_by_lines(px)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == 4 and "Generate" not in plan


def test_tiled_mask_shuffles_pixels_only_into_tiles(spark):
    px = pixel_table(spark, [(1, x, y, 1, 2, 3) for x in range(3) for y in range(3)])
    plan = morphology.tiled_vegetation_mask(px, size=2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_strict_lookups_fail_on_what_is_missing(spark):
    table = spark.createDataFrame([("oak", "wood"), ("fir", "wood")], "name string, category string")
    assert materials.get(table, "oak")["category"] == "wood"
    assert materials.random_of(table, "wood", 3) == materials.random_of(table, "wood", 3)
    with pytest.raises(KeyError):
        materials.get(table, "elm")
    with pytest.raises(ValueError):
        materials.random_of(table, "stone", 3)


def picture(spark, name, height, width, channels, seed=0):
    values = np.random.default_rng(seed).integers(0, 256, height * width * channels)
    return spark.createDataFrame([(name, height, width, channels, values.tolist())], "name string, height int, width int, channels int, values array<int>"), values.reshape(height, width, channels)


@pytest.mark.parametrize("height,width,channels", [(1, 1, 1), (3, 5, 3), (7, 2, 4), (300, 290, 3)])
def test_image_files_round_trip(spark, tmp_path, height, width, channels):
    made, values = picture(spark, "p.png", height, width, channels)
    assert files.write_files(files.png_bodies(made), str(tmp_path)) == 1
    got = images.explode_pixels(images.read_images(spark, str(tmp_path)), ["name"]).toPandas().sort_values(["y", "x"])
    assert len(got) == height * width and set(got["name"]) == {"p.png"}
    for k, c in enumerate("rgb"):
        assert (got[c].to_numpy().reshape(height, width) == values[:, :, min(k, channels - 1) if channels > 1 else 0]).all()


def test_broken_files_stop_nothing(spark, tmp_path):
    for k in range(6):
        files.write_files(files.png_bodies(picture(spark, f"good{k}.PnG", 4, 4, 3, k)[0]), str(tmp_path))
    body = (tmp_path / "good0.PnG").read_bytes()
    for k, bad in enumerate([body[:20], body[: len(body) // 2], b"text", body[:-40] + b"x" * 28]):
        (tmp_path / f"bad{k}.png").write_bytes(bad)
    (tmp_path / "notes.txt").write_text("not asked for")
    pixels, report = jobs.image_job(spark, str(tmp_path))
    got = {r["name"]: (r["ok"], r["n_pixels"]) for r in report.collect()}
    assert got == {f"good{k}.PnG": (True, 16) for k in range(6)} | {f"bad{k}.png": (False, 0) for k in range(4)}
    assert pixels.count() == 96 and catalog.success_ratio(report).first()["n_ok"] == 6


def test_image_stream_keeps_dead_letters(spark, tmp_path):
    source, sink, dead, state = (str(tmp_path / n) for n in ("in", "out", "dead", "state"))
    for k in range(5):
        files.write_files(files.png_bodies(picture(spark, f"a{k}.png", 2, 3, 1, k)[0]), source)
    (tmp_path / "in" / "b.png").write_bytes(b"broken")
    seen = ingest_images(spark, source, sink, dead, state, max_files=2)
    assert len(seen) == 3 and sum(n for _, n in seen) == 6
    assert ingest_images(spark, source, sink, dead, state, max_files=2) == []
    files.write_files(files.png_bodies(picture(spark, "c.png", 2, 3, 1)[0]), source)
    only = lambda d: d.where("x = 0")
    assert ingest_images(spark, source, sink, dead, state, only) == [(3, 1)]
    got = spark.read.parquet(sink).groupBy("name").count()
    assert dict(map(tuple, got.collect())) == {f"a{k}.png": 6 for k in range(5)} | {"c.png": 2}
    assert [tuple(r) for r in spark.read.parquet(dead).select("name", "length").collect()] == [("b.png", 6)]


@pytest.mark.parametrize("size", [3, 8, 100])
def test_tiled_bands_equal_those_of_whole_images(spark, size):
    """Images smaller than a halo, not a multiple of the tile, on either scale, and a constant one."""
    rng = np.random.default_rng(size)
    rows = [(1, x, y, *map(int, rng.integers(0, 256, 3))) for x in range(13) for y in range(10)]
    rows += [(2, x, y, *map(int, rng.integers(0, 2, 3))) for x in range(9) for y in range(9)]
    rows += [(3, 0, 0, 5, 90, 7), (4, 0, 0, 9, 9, 9), (4, 1, 0, 9, 9, 9)]
    px = pixel_table(spark, rows)
    table = lambda df: {tuple(r)[:3]: tuple(r)[3:] for r in df.select("image_id", "x", "y", *bands.BANDS).collect()}
    want, got = table(bands.derive_bands(px)), table(tiles.tiled_bands(px, size))
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], rtol=0, atol=1e-12) for k in want)


def test_append_is_idempotent(spark, tmp_path):
    samples = spark.createDataFrame([(2, "/a/x.png"), (1, "/b/x.png"), (3, "/a/y.png")], "idx bigint, image string")
    folder = str(tmp_path / "made")
    rows = lambda: sorted(map(tuple, catalog.ingested(spark, folder, samples.schema).select("name", "idx", "batch").collect()))
    assert rows() == []
    catalog.append_new(samples.where("idx < 3"), folder, 0)
    catalog.append_new(samples, folder, 1)
    want = [("x.png", 1, 0), ("y.png", 3, 1)]
    assert rows() == want
    for batch in (1, 0, 2):
        catalog.append_new(samples.where("idx < 3") if batch == 0 else samples, folder, batch)
        assert rows() == want


def test_bands_of_sensors(spark):
    table = sensors.sensor_bands(spark)
    assert sensors.band(table, "drone", "NIR")["center"] == 842.0
    for sensor, name in (("drone", "SWIR"), ("other", "NIR")):
        with pytest.raises(KeyError):
            sensors.band(table, sensor, name)
    asked = spark.createDataFrame([("drone", "Red"), ("drone", "red")], "sensor string, band string")
    assert dict(sensors.has_band(table, asked).select("band", "found").collect()) == {"Red": True, "red": False}


def test_hashed_noise_is_normal_and_repeats(spark):
    df = spark.range(20_000).withColumn("v", X.normal_noise(7, "id"))
    mean, std, far = df.agg(F.avg("v"), F.stddev("v"), F.avg((F.abs("v") > 1.96).cast("double"))).first()
    assert abs(mean) < 0.03 and abs(std - 1) < 0.03 and abs(far - 0.05) < 0.01
    assert sorted(df.repartition(7).collect()) == sorted(df.collect())
