"""Tables bucketed by tile, geometry stored for a grid, and bands that meet without a shuffle."""

import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.operators import align, atlas, composite
from skyloom.plans import catalog
from skyloom.plans.settings import SETTINGS
from skyloom.sources import grids, store, tiles

DATA = "/root/testdata/sf0.001"
GRIDS = "grid_id int, height int, width int, gt array<double>, proj struct<sat_height:double,semi_major:double,semi_minor:double,lon_origin:double>"
CO_LOCATED = "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.fixture
def settings(spark):
    have = spark.conf.get(CO_LOCATED)
    spark.conf.set(CO_LOCATED, SETTINGS[CO_LOCATED])
    with store.dropped(spark):
        yield
    spark.conf.set(CO_LOCATED, have)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def two_grids(spark):
    proj = tuple(grids.PROJ[k] for k in ("sat_height", "semi_major", "semi_minor", "lon_origin"))
    return spark.createDataFrame([(1, 20, 30, [-0.16, 0.32 / 30, 0.0, 0.16, 0.0, -0.32 / 20], proj), (2, 5, 4, [-0.02, 0.01, 0.0, 0.02, 0.0, -0.01], proj)], GRIDS)


def test_bands_meet_where_they_lie(spark, settings):
    wide = align.to_wide(catalog.stored(spark, DATA), [11, 13, 14], tiles.PLACE)
    text = plan(wide)
    assert "Exchange" not in text
    scan = next(line for line in wide._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [" in scan and "band" in scan.split("PartitionFilters")[1]
    with_geometry = tiles.joined(align.to_wide(catalog.stored(spark, DATA), [1, 2, 3], (*tiles.PLACE, "cell")), catalog.stored_geometry(spark))
    assert "Exchange" not in plan(with_geometry) and "ShuffledHashJoin" in plan(with_geometry)


def test_stored_geometry_gives_the_same_light(spark, settings):
    cells = two_grids(spark).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    hours = spark.createDataFrame([("a", "2024-06-01 15:00:00"), ("b", "2023-12-21 21:30:00"), ("c", "2024-02-29 04:00:00")], "scene_id string, t string").select("scene_id", F.to_timestamp("t").alias("start_ts"))
    rows = cells.join(atlas.sun(hours)).withColumns({c: F.lit(v) for c, v in (("b", 0.3), ("r", 0.4), ("n", 0.5))})
    gt = F.col("gt")
    plain = G.view_angles(G.sun_angles(G.navigate(rows.withColumns({"x_rad": G.scan_angle(F.col("x"), gt[0], gt[1]), "y_rad": G.scan_angle(F.col("y"), gt[3], gt[5])}))))
    plain = plain.withColumn("raa", G.relative_azimuth(F.col("saa"), F.col("vaa"))).withColumns({c: G.sun_normalise(F.col(c), F.col("sza")) for c in "brn"})
    plain = G.rayleigh_bands(plain, {"b": 0.47, "r": 0.64})
    geometry = tiles.write(atlas.geometry(two_grids(spark), 7), store.fresh(spark), 4)
    light = atlas.daylight(tiles.joined(tiles.placed(rows, 7), geometry))
    key = lambda r: (r.grid_id, r.scene_id, r.y, r.x)
    want, got = {key(r): r for r in plain.collect()}, {key(r): r for r in light.collect()}
    assert want.keys() == got.keys() and len(want) == 3 * 620
    assert any(r.lat is None for r in got.values()) and any(r.sza is not None and r.sza > 90 for r in want.values())
    for k, w in want.items():
        g = got[k]
        assert (w.lat is None) == (g.lat is None)
        if w.lat is not None:
            # the hour angle's base is some 50,000 radians, so its sums are good to 1e-11
            assert g.sun_up == pytest.approx(math.cos(math.radians(w.sza)), abs=1e-10)
        assert [g.b, g.r, g.n] == pytest.approx([w.b, w.r, w.n], abs=1e-9)


def test_tables_are_read_again_by_path(spark, settings):
    rows = [(1, y, x, "s", float(y * 300 + x)) for y in (0, 63, 64, 200) for x in (0, 64, 299)] + [(2, 0, 0, "t", None), (None, 1, 1, "u", 1.0), (3, None, 1, "v", 2.0)]
    df = tiles.placed(spark.createDataFrame(rows, "grid_id int, y int, x int, scene_id string, value double").withColumn("band", F.lit(7)))
    path = store.fresh(spark)
    tiles.write(df, path, 4, parts=("band",), order=("scene_id",))
    again = tiles.read(spark, path, "grid_id short, y int, x int, scene_id string, value double, tile int, cell short, band int", 4, parts=("band",))
    key = lambda r: (str(r.grid_id), str(r.y), r.x)
    assert sorted(again.select(df.columns).collect(), key=key) == sorted(df.collect(), key=key)
    assert df.where("y = 63 and x = 64").select("tile", "cell").first() == (1, 63 * 64)
    assert df.where("y = 64 and x = 0").select("tile", "cell").first() == (32768, 0)
    with pytest.raises(ValueError):
        tiles.placed(df, 182)
    assert tiles.buckets_for(0) == 8 and tiles.buckets_for(100 * tiles.BUCKET_BYTES + 1) == 101


def test_empty_tables_and_pixels_without_geometry(spark, settings):
    empty = tiles.write(atlas.geometry(two_grids(spark).where("false"), 7), store.fresh(spark), 4)
    rows = tiles.placed(spark.createDataFrame([(1, 3, 3, "s", 0.2, 0.3, 0.4)], "grid_id int, y int, x int, scene_id string, c01 double, c02 double, c03 double"), 7)
    facts = spark.createDataFrame([("s", 0.1, 0.9, 0.5, 0.5)], "scene_id string, sun_sd double, sun_cd double, sin_ha double, cos_ha double")
    image = composite.truecolor(tiles.joined(rows, empty).join(facts, "scene_id"), light=atlas.daylight).collect()
    assert [(r.r, r.g, r.b) for r in image] == [(0, 0, 0)]
    none = tiles.write(rows.where("false"), store.fresh(spark), 4)
    assert none.count() == 0 and tiles.joined(none, empty).count() == 0
