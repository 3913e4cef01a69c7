"""Plans and edge cases that the findings of the fourth round are about."""

from threading import Barrier

import numpy as np
import pytest

from leafgrid.functions.png import png
from leafgrid.operators import bands, morphology, tiles
from leafgrid.streaming.ingest import COMPACTING, ingest_images

BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exploded(spark):
    """Three images of 20 x 13 pixels, one of them on the scale to 1, which to Spark look like the 24 bytes they come from."""
    grid = spark.range(3).withColumnRenamed("id", "image_id").selectExpr("image_id", "explode(sequence(0, 19)) AS x").selectExpr("image_id", "x", "explode(sequence(0, 12)) AS y")
    value = lambda k: f"cast(if(image_id = 2, (x * {k} + y) % 2, (x * x * {k} + y * 31 + image_id * 7) % 256) as int)"
    return grid.selectExpr("image_id", "x", "y", f"{value(3)} AS r", f"{value(7)} AS g", f"{value(11)} AS b")


@pytest.fixture(params=["10m", "299", "-1"])
def threshold(spark, request):
    """Room for the extrema, for one row of three too few, and for nothing."""
    before = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, request.param)
    yield request.param
    spark.conf.set(BROADCAST, before)


def holds_extrema(plan, threshold):
    """The right side of the join, the extrema, is the one held: by all tasks or by those that its images are dealt to."""
    join, other = ("BroadcastHashJoin", "ShuffledHashJoin") if threshold == "10m" else ("ShuffledHashJoin", "Broadcast")
    found = [line for line in plan.splitlines() if join in line]
    return found and all("BuildRight" in line for line in found) and other not in plan


def rows(df, *names):
    return {tuple(r)[:3]: tuple(round(v, 12) for v in tuple(r)[3:]) for r in df.select("image_id", "x", "y", *names).collect()}


def test_tiled_vegetation_holds_extrema_not_pixels(spark, threshold, monkeypatch):
    """the first of two joins sent all pixels through the driver, as they looked smaller than their extrema."""
    plans, keep = [], tiles.keep
    monkeypatch.setattr(tiles, "keep", lambda df, label: (plans.append((label, plan_of(df))), keep(df, label))[1])
    made = tiles.tiled_vegetation(exploded(spark), 8)
    plans = [p for label, p in plans if label == "smooth"] + [plan_of(made)]
    assert len(plans) == 2 and all(holds_extrema(p, threshold) for p in plans)
    want = bands.vegetation_probability(bands.normalise(bands.by_image(exploded(spark))))
    assert made.count() == 3 * 20 * 13 and rows(made, "veg") == rows(want, "veg")


def test_tiled_bands_hold_extrema_not_pixels(spark, threshold, monkeypatch):
    """the same first join, on the way to the bands."""
    plans, keep = [], tiles.keep
    monkeypatch.setattr(tiles, "keep", lambda df, label: (plans.append((label, plan_of(df))), keep(df, label))[1])
    made = tiles.tiled_bands(exploded(spark), 8)
    plans = [p for label, p in plans if label == "smooth"] + [plan_of(made)]
    assert len(plans) == 2 and all(holds_extrema(p, threshold) for p in plans)
    assert rows(made, *bands.BANDS) == rows(bands.derive_bands(exploded(spark)), *bands.BANDS)


def test_mask_by_lines_holds_extrema_not_pixels(spark, threshold):
    """pixels were broadcast; where extrema are dealt by image instead, lines and columns still go to tasks of their own."""
    made = morphology.vegetation_mask_by_lines(exploded(spark))
    plan = plan_of(made)
    assert holds_extrema(plan, threshold)
    assert plan.count("Exchange hashpartitioning(image_id") == (4 if threshold == "10m" else 6)
    assert rows(made, "mask") == rows(morphology.vegetation_mask(exploded(spark)), "mask")


def test_tiled_mask_holds_extrema_not_pixels(spark, threshold):
    """the same join; its broadcast failed in the driver."""
    made = morphology.tiled_vegetation_mask(exploded(spark), 8)
    assert holds_extrema(plan_of(made), threshold)
    assert rows(made, "mask") == rows(morphology.vegetation_mask(exploded(spark)), "mask")


def images_into(folder, names):
    """One grey pixel each; every sixth file is broken."""
    folder.mkdir(exist_ok=True)
    for k in names:
        (folder / f"a{k}.png").write_bytes(png(1, 1, 1, np.array([k])) if k % 6 else b"broken")


def told(spark, made):
    """Names of the sink and of the dead letters, and the notes that are left."""
    names = lambda part: sorted(r["name"] for r in spark.read.parquet(f"{made}/{part}").select("name").collect())
    return names("sink"), names("dead"), list((made / "state" / "arrived").glob("*.json"))


def expected(n):
    return tuple(sorted(f"a{k}.png" for k in range(n) if (k % 6 > 0) == good) for good in (True, False)) + ([],)


def test_batches_are_decoded_together(spark, tmp_path):
    """a batch waited for the one before it. The source's list of files is not written anew every ten batches."""
    images_into(tmp_path / "in", range(12))
    meet, before = Barrier(2, timeout=60), spark.conf.get(COMPACTING)
    seen = ingest_images(spark, str(tmp_path / "in"), f"{tmp_path}/sink", f"{tmp_path}/dead", f"{tmp_path}/state", lambda d: (meet.wait(), d)[1], max_files=1)
    assert sorted(seen) == [(k, 1) for k in range(12)] and told(spark, tmp_path) == expected(12)
    logs = [p.name for p in (tmp_path / "state" / "sources" / "0").iterdir()]
    assert "11" in logs and not any(n.endswith(".compact") for n in logs) and spark.conf.get(COMPACTING) == before


def test_small_images_of_a_batch_share_tasks(spark, tmp_path):
    """few small files were dealt over all cores, each of which wrote a file of the sink."""
    images_into(tmp_path / "in", range(70))
    assert ingest_images(spark, str(tmp_path / "in"), f"{tmp_path}/sink", f"{tmp_path}/dead", f"{tmp_path}/state", max_files=70) == [(0, 70)]
    assert len(list((tmp_path / "sink" / "batch=0").glob("*.parquet"))) <= 3 and told(spark, tmp_path) == expected(70)


def test_batch_that_failed_is_taken_up_again(spark, tmp_path):
    """the stream has gone on when a batch fails; the next call does what was noted and not ended, once."""
    images_into(tmp_path / "in", range(5))
    calls = []

    def failing(d):
        calls.append(1)
        if len(calls) == 2:
            raise ValueError("no luck")
        return d

    run = lambda process=None: ingest_images(spark, str(tmp_path / "in"), f"{tmp_path}/sink", f"{tmp_path}/dead", f"{tmp_path}/state", process, max_files=1)
    with pytest.raises(Exception, match="no luck"):
        run(failing)
    assert told(spark, tmp_path)[2]
    images_into(tmp_path / "in", range(5, 8))
    run()
    assert told(spark, tmp_path) == expected(8) and run() == []
