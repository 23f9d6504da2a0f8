"""Scalar restatements, invariants and edge cases of the raster operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geometry as G
from skyloom.functions import pixelwise as P
from skyloom.operators import algebra, align, composite, enhance, names, palette, products, spatial
from skyloom.sources import grids


def image(spark, values, name="v", scene="s"):
    rows = [(scene, y, x, v) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"scene_id string, y int, x int, {name} {'int' if isinstance(values[0][0], int) else 'double'}")


def array(df, name, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r.y, r.x] = r[name]
    return out


def test_band_expressions():
    e = algebra.parse("-0.5*C13 + c2 - 3 + 2")
    assert e.terms == ((-0.5, 13), (1.0, 2)) and e.bias == -1.0 and e.bands == [13, 2]
    assert algebra.required_bands("C13-C15;C2;C13") == [2, 13, 15]
    for bad in ("", "5", "C17", "C1 C2", "C1*2", "(C1)", "C1/C2", "+".join(["C1"] * 11)):
        with pytest.raises(ValueError):
            algebra.parse(bad)
    with pytest.raises(ValueError):
        algebra.parse_rgb("C1;C2")


def test_missing_pixels(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (1.0, 0.0)], "a double, b double")
    got = [tuple(r) for r in df.select(*[P.combine(F.col("a"), F.col("b"), op) for op in ("add", "sub", "mul", "div")]).collect()]
    assert got == [(None,) * 4, (None,) * 4, (1.0, 1.0, 0.0, None)]
    low, high = F.lit(0.0), F.lit(2.0)
    got = df.select(P.quantise_gray(F.col("a"), low, high, missing=9), P.quantise_channel(F.col("a"), 0, 2), P.validity(F.col("a")), P.stretch(F.col("a")), P.gamma(F.col("a"), 2.0, low, high)).collect()
    assert tuple(got[1]) == (9, 0, 0, None, None)
    sentinel = spark.createDataFrame([(1e32,), (float("nan"),), (float("-inf"),), (float("inf"),), (3.0,)], "v double")
    assert [r[0] for r in sentinel.select(grids.missing_as_null(F.col("v"))).collect()] == [None] * 4 + [3.0]


def test_gamma_one_is_identity(spark):
    df = spark.createDataFrame([(0.3,)], "v double")
    assert df.select(P.gamma(F.col("v"), 1.0, F.lit(0.0), F.lit(1.0))).first()[0] == 0.3


def test_planck_and_zero(spark):
    df = spark.createDataFrame([(50.0,), (0.0,), (-1.0,), (None,)], "v double")
    c = [F.lit(x) for x in (10000.0, 1300.0, 0.5, 0.99)]
    got = [r[0] for r in df.select(P.planck(F.col("v"), *c)).collect()]
    assert got[0] == pytest.approx((1300 / math.log(10000 / 50 + 1) - 0.5) / 0.99) and got[1:] == [0.0, 0.0, None]


def test_clahe_and_equalise_against_numpy(spark):
    rng = np.random.default_rng(3)
    h, w, ty, tx, limit = 27, 22, 3, 4, 3.0
    v = rng.integers(0, 60, (h, w))
    df = image(spark, v.tolist())
    th, tw = h // ty, w // tx
    top = max(1, int(limit * th * tw / 256))
    maps = np.zeros((ty, tx, 256))
    for a in range(ty):
        for b in range(tx):
            tile = v[a * th : (h if a == ty - 1 else (a + 1) * th), b * tw : (w if b == tx - 1 else (b + 1) * tw)]
            hist = np.bincount(tile.ravel(), minlength=256)
            excess = int(np.maximum(hist - top, 0).sum())
            hist = np.minimum(hist, top) + excess // 256
            hist[: excess % 256] += 1
            maps[a, b] = np.floor(np.cumsum(hist) * (255.0 / tile.size) + 0.5)
    want = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            a, b = min(max(int(fy), 0), ty - 2), min(max(int(fx), 0), tx - 2)
            dy, dx = min(max(fy - a, 0), 1), min(max(fx - b, 0), 1)
            m = maps[a : a + 2, b : b + 2, v[y, x]]
            want[y, x] = math.floor((m[0, 0] * (1 - dx) + m[0, 1] * dx) * (1 - dy) + (m[1, 0] * (1 - dx) + m[1, 1] * dx) * dy + 0.5)
    assert (array(enhance.clahe(df, "v", h, w, ty, tx, limit), "v", h, w) == want).all()
    cdf = np.cumsum(np.bincount(v.ravel(), minlength=256))
    assert (array(enhance.equalise(df, ("v",)), "v", h, w) == np.floor(255 * cdf / v.size)[v]).all()


def test_box_mean_is_contagious_and_keeps_constants(spark):
    v = [[5.0] * 7 for _ in range(5)]
    v[0][0] = None
    df = image(spark, v, "value").withColumn("band", F.lit(1))
    assert {(r.y, r.x): r.value for r in align.box_mean(df, 2, 5, 7).collect()} == {(y, x): (None if (y, x) == (0, 0) else 5.0) for y in range(2) for x in range(3)}


def test_enlarge_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.random((4, 5))
    df = image(spark, v.tolist(), "c")
    got = array(align.enlarge(df, df.select("scene_id").distinct(), 3, 4, 5, ["c"]), "c", 12, 15)
    for y in range(12):
        for x in range(15):
            fy, fx = y * 3 / 11, x * 4 / 14
            a, b, c, d = math.floor(fy), math.floor(fx), math.ceil(fy), math.ceil(fx)
            p, q = fy - a, fx - b
            assert got[y, x] == pytest.approx(v[a, b] * (1 - p) * (1 - q) + v[a, d] * (1 - p) * q + v[c, b] * p * (1 - q) + v[c, d] * p * q)


def test_navigation_round_trip(spark):
    """Scan angles to coordinates and back to the same source position."""
    proj = F.struct(*[F.lit(v).alias(k) for k, v in grids.PROJ.items()])
    df = spark.createDataFrame([("s", y, x) for y in range(4, 28, 4) for x in range(4, 28, 4)], "scene_id string, y int, x int")
    df = G.navigate(df.withColumns({"x_rad": G.scan_angle(F.col("x"), F.lit(grids.X0), F.lit(grids.DX)), "y_rad": G.scan_angle(F.col("y"), F.lit(grids.Y0), F.lit(grids.DY)), "proj": proj}))
    gt = F.array(*[F.lit(v) for v in (grids.X0, grids.DX, 0.0, grids.Y0, 0.0, grids.DY)])
    seen = df.where("lat is not null")
    assert seen.count() == 35  # one corner is off the disk
    cell = seen.select(F.concat_ws(",", "y", "x").alias("scene_id"), (F.col("lat") + 0.5).alias("lat_max"), (F.col("lat") - 0.5).alias("lat_min"), (F.col("lon") - 0.5).alias("lon_min"), (F.col("lon") + 0.5).alias("lon_max"), F.lit(1).alias("out_h"), F.lit(1).alias("out_w"), "proj", gt.alias("gt"))
    for r in spatial.source_positions(cell).collect():
        y, x = map(int, r.scene_id.split(","))
        assert r.row == pytest.approx(y + 0.5, abs=1e-6) and r.col == pytest.approx(x + 0.5, abs=1e-6)


def test_sun_at_noon(spark):
    """Zenith near the latitude at an equinox noon; night on the other side."""
    df = spark.sql("select 's' scene_id, timestamp'2024-03-20 12:07:00' start_ts").join(spark.createDataFrame([(0.0, 0.0), (50.0, 0.0), (0.0, 180.0), (None, None)], "lat double, lon double"))
    got = [r.sza for r in G.sun_angles(G.ephemeris(df)).orderBy(F.col("lon").asc_nulls_last(), "lat").collect()]
    assert abs(got[0]) < 0.6 and abs(got[1] - 50) < 0.6 and abs(got[2] - 180) < 0.6 and got[3] is None


def test_view_angle_at_nadir(spark):
    proj = F.struct(*[F.lit(v).alias(k) for k, v in grids.PROJ.items()])
    df = spark.createDataFrame([(0.0, -75.0), (0.0, -20.0), (None, None)], "lat double, lon double").withColumn("proj", proj)
    got = [r.vza for r in G.view_angles(df).collect()]
    assert got[0] == pytest.approx(0, abs=1e-6) and 55 < got[1] < 65 and got[2] is None


def test_blend_ends(spark):
    df = spark.createDataFrame([(10, 200, 0), (10, 200, 255), (10, 200, 128)], "a int, b int, m int")
    assert [r[0] for r in df.select(P.blend(F.col("a"), F.col("b"), F.col("m"))).collect()] == [200, 10, 104]


def test_bilinear_and_nearest_agree_on_constants(spark):
    df = image(spark, [[7] * 32 for _ in range(32)], "r")
    proj = F.struct(*[F.lit(v).alias(k) for k, v in grids.PROJ.items()])
    gt = F.array(*[F.lit(v) for v in (grids.X0, grids.DX, 0.0, grids.Y0, 0.0, grids.DY)])
    ext = df.select("scene_id").distinct().select("scene_id", F.lit(-30.0).alias("lat_min"), F.lit(30.0).alias("lat_max"), F.lit(-200.0).alias("lon_min"), F.lit(-50.0).alias("lon_max"), proj.alias("proj"), gt.alias("gt"))
    plan = spatial.plan(ext, F.lit(500.0))
    a = {(r.y, r.x): r.r for r in spatial.reproject_nearest(df, plan, 32, 32, ["r"]).collect()}
    b = {(r.y, r.x): r.r for r in spatial.reproject_bilinear(df, plan, 32, 32, ["r"]).collect()}
    assert a == b and set(a.values()) == {0, 7}
    counts = spatial.counters(plan, 32, 32).first()
    assert counts.valid == sum(v == 7 for v in a.values()) and counts.off_horizon > 0


def test_names(spark):
    rows = [("OR_ABI-L1b-RadC-M3C07_G17_s20242201301171_e_c.nc",), ("x_GOES-16_CMIPM2.nc",), ("nothing",)]
    got = names.parse_names(spark.createDataFrame(rows, "name string")).collect()
    assert (got[0].satellite, got[0].sector, got[0].level, got[0].scan_mode, got[0].channel, got[0].token) == ("G17", "conus", "L1b", "M3", "C07", "s2024220130")
    assert (got[1].satellite, got[1].sector, got[1].stamp) == ("G16", "m2", None) and (got[2].satellite, got[2].variable, got[2].channel) == ("unknown", None, "C00")
    out = names.expand_template("{SAT}-{YYYY}{MM}{DD}{hh}{mm}{ss}-{CH}-{OPS}", spark.createDataFrame(rows, "name string").transform(names.parse_names)).collect()
    assert out[0].output == "G17-20240807130117-C07-{OPS}" and out[2].output == "{SAT}-{YYYY}{MM}{DD}{hh}{mm}{ss}-{CH}-{OPS}"
    empty = names.parse_names(spark.createDataFrame([], "name string"))
    assert names.siblings(empty, empty, [1, 2]).count() == 0


def test_palette_meta_of_discrete_lines(spark):
    lines = ["# UNIT = phase", *[f"{k} 10 20 30 ; name" for k in range(6)], "B 0 0 0", "F 1 1 1", "N 2 2 2"]
    df = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)], "file string, n int, line string")
    meta = palette.palette_meta(palette.parse_lines(df)).first()
    assert (meta.discrete, meta.n_entries, meta.vmin, meta.vmax, meta.unit) == (True, 6, 1.0, 5.0, "phase")


def test_sinks(spark, tmp_path):
    df = image(spark, [[1, 2], [3, 4]]).unionByName(image(spark, [[5]], scene="t"))
    products.write_image(df, str(tmp_path / "image"))
    back = spark.read.parquet(str(tmp_path / "image"))
    assert back.count() == 5 and sorted(p.name for p in (tmp_path / "image").glob("scene_id=*")) == ["scene_id=s", "scene_id=t"]
    products.write_sidecar(spark.createDataFrame([("s", None)], "scene_id string, crs string"), str(tmp_path / "meta"))
    assert spark.read.text(str(tmp_path / "meta")).first()[0] == '{"scene_id":"s"}'
    clips = tmp_path / "clips.csv"
    clips.write_text("clave,region,a,b,c,d\nmx,Mexico,-120,33,-85,13\nbad,Bad,x,1,2,3\n")
    got = {r.key: r.usable for r in names.list_clips(names.load_clips(spark, str(clips))).collect()}
    assert got == {"mx": True, "bad": False}


def test_recipes_name_their_bands(spark):
    for name, recipe in composite.RECIPES.items():
        assert recipe.bands and all(1 <= b <= 16 for b in recipe.bands), name
    plan = align.to_wide(spark.createDataFrame([], grids.PIXELS), [13, 15])._jdf.queryExecution().optimizedPlan().toString()
    assert "band" in plan and "IN (13,15)" in plan.replace(" ", "").replace("IN(", "IN (") or "13" in plan


def test_gray_product_with_everything(spark):
    rng = np.random.default_rng(5)
    px = spark.createDataFrame([("s", 13, y, x, float(v)) for (y, x), v in np.ndenumerate(rng.random((16, 16)))], grids.PIXELS)
    out = products.gray(px, "C13", invert=True, gamma=2.0, histogram=True, clahe=(2, 2, 4.0, 16, 16))
    values = [r.v for r in out.collect()]
    assert len(values) == 256 and min(values) >= 0 and max(values) <= 255
    assert products.gray(spark.createDataFrame([], grids.PIXELS), "C13").count() == 0


def brute_nearest(points, nav):
    """{(pid, scene_id): (y, x)} over every pixel."""
    out = {}
    for pid, plat, plon in points:
        if plat is None or plon is None:
            continue
        for scene, pixels in nav.items():
            s, y, x, lat, lon = pixels
            d = np.abs(lon - plon)
            d = np.where(d > 180, 360 - d, d)
            k = np.lexsort((x, y, (lat - plat) * (lat - plat) + d * d))[0]
            out[pid, scene] = int(y[k]), int(x[k])
    return out


def arrays(nav):
    scenes = {}
    for r in nav.where("lat is not null").select("scene_id", "y", "x", "lat", "lon").collect():
        scenes.setdefault(r.scene_id, []).append(tuple(r))
    return {s: tuple(np.array(c) for c in zip(*rows, strict=True)) for s, rows in scenes.items()}


def test_nearest_pixel_of_many_points(spark):
    rng = np.random.default_rng(3)
    nav = [(f"s{s}", int(k // 40), int(k % 40), float(lat), float(lon)) for s in range(2) for k, (lat, lon) in enumerate(zip(rng.uniform(-3, 30, 1600).round(1), (rng.uniform(165, 200, 1600).round(1) + 180) % 360 - 180, strict=True))] + [("s0", 99, 99, None, None)]
    points = [(f"p{i}", float(rng.uniform(-80, 80).__round__(1)), float(rng.uniform(-180, 180).__round__(1))) for i in range(250)] + [("p0b", 5.0, 180.0), ("p0b", 80.0, 10.0), ("none", None, 1.0)]
    df = spark.createDataFrame(nav, "scene_id string, y int, x int, lat double, lon double")
    got = spatial.nearest_pixel(spark.createDataFrame(points, "pid string, plat double, plon double"), df).collect()
    want = brute_nearest([p for p in points if p != ("p0b", 80.0, 10.0)], arrays(df))
    assert len(got) == len(want) and {(r.pid, r.scene_id): (r.y, r.x) for r in got} == want


def test_nearest_pixel_of_even_distances_is_that_of_the_sql(spark):
    """Pixels in columns 15 and 16 mirror each other about 75 degrees west, where some of the suppliers' 3,240 places lie."""
    import duckdb

    from skyloom.functions import geometry as G
    from skyloom.plans import catalog
    from skyloom.sources import grids

    pts = "pts AS (SELECT CAST(k AS VARCHAR) AS pid, k % 81 - 40.0::DOUBLE AS plat, -k % 120 - 15.0::DOUBLE AS plon FROM range(1, 3241) t(k))"
    grid = "WITH w AS (SELECT 's0' AS scene_id, CAST(k // 32 AS INT) AS y, CAST(k % 32 AS INT) AS x FROM range(0, 1024) t(k))"
    rest = catalog.ORACLE["c9_nearest_pixel"].partition(f"{catalog._POINTS}, ")[2]
    want = {r[0]: r[2:] for r in duckdb.execute(f"{grid}, {catalog.NAV}, {pts}, {rest}").fetchall()}
    proj = F.struct(*[F.lit(v).alias(k) for k, v in grids.PROJ.items()])
    at = spark.range(1024).selectExpr("'s0' as scene_id", "cast(id div 32 as int) as y", "cast(id % 32 as int) as x")
    at = at.select("*", G.scan_angle(F.col("x"), F.lit(grids.X0), F.lit(grids.DX)).alias("x_rad"), G.scan_angle(F.col("y"), F.lit(grids.Y0), F.lit(grids.DY)).alias("y_rad"), proj.alias("proj"))
    places = spark.range(1, 3241).selectExpr("cast(id as string) as pid", "id % 81 - 40D as plat", "-id % 120 - 15D as plon")
    got = {r.pid: (r.y, r.x) for r in spatial.nearest_pixel(places, G.navigate(at)).collect()}
    assert len(got) == 3240 and got == want


def test_all_points_and_clips(spark):
    from skyloom.plans import catalog

    sf = "/root/testdata/sf0.01"  # 100 suppliers
    nav = arrays(catalog.navigated(spark, sf))
    points = [(r.pid, r.plat, r.plon) for r in catalog.places(spark, sf).collect()]
    got = {(r.pid, r.scene_id): (r.y, r.x) for r in catalog.QUERIES["c9_nearest_pixel"](spark, sf).collect()}
    assert len(got) == len(points) * len(nav) and got == brute_nearest(points, nav)
    clips = [r for r in catalog.clips(spark, sf).collect() if r.ul_y is not None]
    edges = [((c.key, s, e), p, q) for c in clips for s in range(21) for e, (p, q) in enumerate([(c.ul_y, c.ul_x + s / 20 * (c.lr_x - c.ul_x)), (c.lr_y, c.ul_x + s / 20 * (c.lr_x - c.ul_x)), (c.lr_y + s / 20 * (c.ul_y - c.lr_y), c.ul_x), (c.lr_y + s / 20 * (c.ul_y - c.lr_y), c.lr_x)])]
    hits = {}
    for (pid, scene), at in brute_nearest(edges, nav).items():
        hits.setdefault((pid[0], scene), []).append(at)
    want = {k: (min(y for y, _ in v), min(x for _, x in v), max(y for y, _ in v) - min(y for y, _ in v) + 1, max(x for _, x in v) - min(x for _, x in v) + 1) for k, v in hits.items()}
    assert {(r.key, r.scene_id): (r.y0, r.x0, r.height, r.width) for r in catalog.QUERIES["g8_bounding_box"](spark, sf).collect()} == want
    cells = {(r.scene_id, r.y, r.x) for r in catalog.every(spark, sf).collect()}
    windows = sorted((k, s, y, x) for (k, s), (y0, x0, h, w) in want.items() for y in range(h) for x in range(w) if (s, y + y0, x + x0) in cells)
    assert sorted((r.key, r.scene_id, r.y, r.x) for r in catalog.QUERIES["g9_clip_native"](spark, sf).collect()) == windows


def test_equal_rectangles_share_a_search_and_keys_may_repeat(spark, monkeypatch):
    rng = np.random.default_rng(12)
    nav = [("s0", int(k // 30), int(k % 30), float(lat), float(lon)) for k, (lat, lon) in enumerate(zip(rng.uniform(-40, 40, 900), rng.uniform(-130, -20, 900), strict=True))]
    df = spark.createDataFrame(nav, "scene_id string, y int, x int, lat double, lon double")
    one, two = (-100.0, 20.0, -80.0, 0.0), (-60.0, 10.0, -30.0, -20.0)
    rows = [*[(f"k{i}", *one) for i in range(50)], ("d", *one), ("d", *two), ("d", *two), (None, *two), ("", *one), ("bad", 1.0, None, 2.0, 3.0)]
    asked, search = [], spatial.nearest_pixel
    monkeypatch.setattr(spatial, "nearest_pixel", lambda points, nav: asked.append(points.count()) or search(points, nav))
    got = {r.key: (r.y0, r.x0, r.height, r.width) for r in spatial.bounding_box(spark.createDataFrame(rows, "key string, ul_x double, ul_y double, lr_x double, lr_y double"), df).collect()}
    assert asked == [4 * 84]  # once for each of the two, and two for the key that has both
    want = {}
    for key in dict.fromkeys(r[0] for r in rows if r[0] != "bad"):
        hits = []
        for s in range(21):
            for e in range(4):
                at = []
                for ul_x, ul_y, lr_x, lr_y in (r[1:] for r in rows if r[0] == key):
                    lon, lat = ul_x + s / 20 * (lr_x - ul_x), lr_y + s / 20 * (ul_y - lr_y)
                    p, q = ((ul_y, lon), (lr_y, lon), (lat, ul_x), (lat, lr_x))[e]
                    at.append(min(((la - p) * (la - p) + (lo - q) * (lo - q), y, x) for _, y, x, la, lo in nav))
                hits.append(min(at)[1:])
        ys, xs = [y for y, _ in hits], [x for _, x in hits]
        want[key] = (min(ys), min(xs), max(ys) - min(ys) + 1, max(xs) - min(xs) + 1)
    assert got == want


def test_phase_palette(spark):
    """Five phases: a discrete file with a missing colour, first value 1, last value 5, six colours."""
    lines = ["# UNIT = phase", "0 0/0/255 ; clear", "1 10/20/30 ; a", "2 40/50/60 ; b", "3 70/80/90 ; c", "5 100/110/120 ; d", "N 1 2 3"]
    entries = palette.parse_lines(spark.createDataFrame([("p", n, x) for n, x in enumerate(lines)], "file string, n int, line string"))
    (meta,) = palette.index_meta(entries).collect()
    assert (meta.vmin, meta.vmax, meta["size"], meta.missing_at, meta.foreground_at) == (1.0, 5.0, 6, 5, None)
    assert [(r.idx, r.r) for r in palette.index_palette(entries).orderBy("idx").collect()] == [(0, 0), (1, 10), (2, 40), (3, 70), (4, 100), (5, 1)]


def test_palettes_without_colours_or_range(spark):
    lines = [("one", 0, "1 2/3/4"), ("none", 0, "N 1 2 3"), ("flat", 0, "5 1 2 3 5 4 5 6"), ("flat", 1, "F 7 8 9"), ("gap", 0, "0 0 0 0 1 100 100 100"), ("gap", 1, "2 200 200 200 3 50 50 50"), ("gap", 2, "B 9 9 9")]
    got = {}
    for r in palette.index_palette(palette.parse_lines(spark.createDataFrame(lines, "file string, n int, line string"))).collect():
        got.setdefault(r.file, {})[r.idx] = r.r
    assert set(got) == {"flat", "gap"} and len(got["flat"]) == 256 and got["flat"][0] == 0 and got["flat"][1] == got["flat"][254] == 7
    assert got["gap"][0] == 0 and got["gap"][128] == 0 and got["gap"][255] == 50 and got["gap"][170] == 200


def test_clip_by_key(spark, tmp_path):
    (tmp_path / "clips.csv").write_text("clave,region,a,b,c,d\na,first,1,2,3,4\nb,,5,6,7,8\na,second,9,9,9,9\nc,r,x,1.5e1abc\n\n")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("clave",), ("z",)], "key string")
    got = {r.key: tuple(r)[1:] for r in names.find_clips(names.clip_lines(spark, str(tmp_path)), keys).collect()}
    assert got["a"] == (True, "first", 1.0, 2.0, 3.0, 4.0) and got["b"] == (True, "5", 6.0, 7.0, 8.0, 0.0) and got["c"] == (True, "r", 0.0, 15.0, 0.0, 0.0)
    assert got["clave"][0] is got["z"][0] is False


def test_written_scene_is_cut_in_strips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(products, "STRIP", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is one task
    image = spark.range(1024).selectExpr("'s0' as scene_id", "cast(id div 32 as int) as y", "cast(id % 32 as int) as x", "cast(id % 256 as int) as v")
    products.write_image(image, str(tmp_path / "image"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "image").glob("scene_id=s0/*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "image")).count() == 1024


def test_night_colours_equal_a_plain_search(spark):
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 200, 257):
        lows = np.sort(rng.uniform(180, 300, n))
        table = spark.createDataFrame([(i, float(x), i / 256, 0.0, 0.0, 1.0) for i, x in enumerate(lows)], "idx int, lo double, r double, g double, b double, a double")
        values = [None, 100.0, 400.0, *map(float, rng.uniform(170, 310, 40)), *map(float, lows[:3])]
        pixels = spark.createDataFrame([("s", 0, k, v) for k, v in enumerate(values)], "scene_id string, y int, x int, value double")
        got = {r.x: r.r for r in palette.by_threshold(pixels, table).collect()}
        for k, v in enumerate(values):
            at = -1 if v is None else int((lows <= v).sum()) - 1
            at = at if 0 <= at <= 254 else 254
            assert got[k] == (0 if v is None or at >= n else int(at / 256 * 255)), (n, v)
