"""Plans and large-scale forms: scans and exchanges of products, levels of a pyramid, tables by key."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import align, atmosphere, measure, palette
from skyloom.plans import catalog
from skyloom.sources import store

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("name", ["p9_gray", "p7_daynite", "d7_equalise_rgb", "d8_clahe"])
def test_two_scans_of_a_written_frame(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert text.count("FileScan") <= 2 and text.count("Exchange ") <= 6 and "NestedLoop" not in text


def test_no_nested_loop_in_look_ups(spark):
    for name in ("c6_h3_continuous_colours", "f4_table_from_spectra"):
        assert "NestedLoop" not in plan(catalog.QUERIES[name](spark, DATA))


def test_table_reader_broadcasts_nothing(spark):
    """Values are exploded from small files; a choice by file size would build them whole in the driver."""
    text = plan(catalog.QUERIES["f3_table_reader"](spark, DATA))
    assert "Broadcast" not in text and "SortMergeJoin" in text


@pytest.mark.parametrize("name", ["c9_nearest_pixel", "g8_bounding_box", "g9_clip_native"])
def test_points_are_not_broadcast_to_their_pixels(spark, name):
    """Samples of clips are exploded from small files; a choice by file size would broadcast them all."""
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert re.search(r"SortMergeJoin \[[^\]]*plat", text) and not re.search(r"BroadcastHashJoin \[[^\]]*plat", text)


def test_lines_of_windows_are_dealt_apart(spark):
    text = plan(catalog.QUERIES["g9_clip_native"](spark, DATA))
    assert re.search(r"hashpartitioning\(key#\d+, scene_id#\d+, y#\d+, 8\), REPARTITION_BY_NUM", text)


def test_pyramid_is_one_shuffle(spark):
    h, w, levels = 21, 13, 3
    v = np.random.default_rng(5).integers(0, 256, (h, w))
    df = spark.createDataFrame([("s", y, x, int(v[y, x])) for y in range(h) for x in range(w)], "scene_id string, y int, x int, v int")
    out = align.pyramid(df, h, w, levels, ("v",))
    assert plan(out).count("Exchange ") == 1
    got = {(r.level, r.y, r.x): r.v for r in out.collect()}
    want, now = {}, v
    for k in range(levels + 1):
        want |= {(k, y, x): int(now[y, x]) for y in range(now.shape[0]) for x in range(now.shape[1])}
        a, b = now.shape[0] // 2, now.shape[1] // 2
        now = np.floor(now[: 2 * a, : 2 * b].reshape(a, 2, b, 2).mean((1, 3)) + 0.5).astype(int)
    assert got == want
    assert {r.level for r in align.pyramid(df, h, w, 0, ("v",)).collect()} == {0}
    with pytest.raises(ValueError):
        align.pyramid(df, h, w, 4, ("v",))
    assert align.pyramid(df.where("false"), h, w, 2, ("v",)).count() == 0


def test_colours_of_many_tables(spark):
    pairs = "key string, lo double, hi double, r0 int, g0 int, b0 int, r1 int, g1 int, b1 int"
    tables = spark.createDataFrame([("a", 10.0, 20.0, 0, 0, 0, 100, 50, 20), ("a", 0.0, 10.0, 200, 0, 0, 100, 0, 0), ("a", 30.0, 40.0, 9, 9, 9, 19, 9, 9), ("b", 5.0, 6.0, 1, 2, 3, 1, 2, 3)], pairs)
    values = [("a", -1.0), ("a", 0.0), ("a", 5.0), ("a", 10.0), ("a", 15.0), ("a", 25.0), ("a", 40.0), ("a", 41.0), ("a", None), ("b", 5.5), ("b", 4.0), ("c", 1.0)]
    df = spark.createDataFrame(values, "key string, value double")
    got = {(r.key, r.value): (r.r, r.g, r.b) for r in palette.colour_of(df, tables, (7, 7, 7), (8, 8, 8), table="key").collect()}
    want = [(7, 7, 7), (200, 0, 0), (150, 0, 0), (0, 0, 0), (50, 25, 10), (0, 0, 0), (19, 9, 9), (8, 8, 8), (0, 0, 0), (1, 2, 3), (7, 7, 7), (0, 0, 0)]
    assert got == dict(zip(values, want, strict=True))
    none = palette.colour_of(df.drop("key"), tables.drop("key").where("false"), (7, 7, 7))
    assert {(r.r, r.g, r.b) for r in none.collect()} == {(0, 0, 0)}


def test_spectra_at_and_beyond_their_ends(spark):
    rows = [(w, 0, 0, 0, 10.0 * w) for w in (3.0, 1.0, 2.0)]
    spectra = spark.createDataFrame(rows, "wavelength double, i_s int, i_v int, i_a int, value double")
    targets = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 2.25), (4, 3.0), (5, 9.0)], "channel int, wavelength double")
    got = {r.channel: r.value for r in atmosphere.from_spectra(spectra, targets).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 22.5, 4: 30.0, 5: 30.0}
    assert atmosphere.from_spectra(spectra, targets.where("false")).count() == 0


def test_written_frames_are_dropped(spark):
    with store.dropped(spark) as made:
        df = store.written(spark.range(10).withColumn("v", F.lit(1)))
        assert df.count() == 10 and len(made) == 1 and os.path.isdir(made[0][0])
    assert not os.path.exists(made[0][0])
    pixels = spark.createDataFrame([("s", y, 0) for y in range(70)] + [("t", 1, 0), ("u", 1, 0)], "scene_id string, y int, x int")
    facts = spark.createDataFrame([("s", 5), ("t", 6)], "scene_id string, k int")
    assert store.with_facts(pixels, facts).groupBy("k").count().orderBy("k").collect() == [(5, 70), (6, 1)]


def test_exact_percentile_of_doubles(spark):
    rng = np.random.default_rng(8)
    a = {"s": np.concatenate([rng.lognormal(0, 9, 3000), np.full(500, 2.5)]), "t": rng.integers(0, 256, 700).astype(float), "u": np.array([4.0]), "w": np.full(40, 3.0)}
    rows = [(k, 0, x, float(v)) for k, values in a.items() for x, v in enumerate(values)] + [("m", 0, 0, None)]
    df = spark.createDataFrame(rows, "scene_id string, y int, x int, v double")
    got = {r.scene_id: r for r in measure.diff_stats(df, df.withColumn("v", F.col("v") * 0)).collect()}
    for k, values in a.items():
        assert got[k].p99 == pytest.approx(np.quantile(values, 0.99), rel=1e-12) and got[k].mae == pytest.approx(values.mean())
    assert got["m"].p99 is None
    ranks = spark.createDataFrame([("s", r) for r in (0, 1749, 3499, 3500)], "scene_id string, rank bigint")
    found = {r.rank: r.value for r in measure.values_at(df.select("scene_id", F.col("v").alias("value")), ranks).collect()}
    assert found == {r: float(np.sort(a["s"])[r]) for r in (0, 1749, 3499)}
    assert measure.diff_stats(df.where("false"), df).count() == 0
