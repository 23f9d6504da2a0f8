"""Names, tags, sidecars, stored palettes and tables by hand-made rows."""

import json

from pyspark.sql import functions as F

from skyloom.operators import names, palette, products
from skyloom.sources import grids


def test_six_digits(spark):
    want = {0.0: "0", 1e-7: "1e-07", 1e6: "1e+06", 123456.5: "123456", 123457.5: "123458", 999999.5: "1e+06", 250.0: "250", 1.5: "1.5", -2.5e-5: "-2.5e-05", 0.0001: "0.0001", 1e20: "1e+20", 3.14159265: "3.14159", float("inf"): "inf", -float("inf"): "-inf"}
    df = spark.createDataFrame([(v,) for v in [*want, float("nan"), None]], "v double").select("v", names.six_digits(F.col("v")).alias("t"))
    got = [r.t for r in df.collect()]
    assert got == [("%.6g" % v) for v in want] + ["nan", None] and got[:-2] == list(want.values())


def test_names_without_a_command(spark):
    cols = "satellite string, sector string, start_ts timestamp, command string, mode string, band_name string, invert boolean, rayleigh boolean, histogram boolean, clahe boolean, gamma double, clip boolean, stretch boolean, geo boolean"
    plain = (False, False, False, False, 1.0, False, False, False)
    rows = [("G16", "fd", None, "rgb", "ash", "C13", *plain), (None, "unknown", None, None, None, "C02", *plain), ("G18", "", None, "rgb", "truecolor", "C01", *plain), ("unknown", None, None, "", None, None, *plain)]
    got = [r.name for r in names.automatic_name(spark.createDataFrame(rows, cols), ".png").collect()]
    assert got == ["sky_G16_fd_NA_ash.png", "sky_GXX_NA_output_C02.png", "sky_G18_NA_rgb.png", "sky_GXX_NA_output.png"]


def test_template_satellites(spark):
    rows = [(f"OR_ABI-L1b-RadF-M6C01{s}_s20240010000000_e1.nc",) for s in ("_G16", "_G21", "_Gx1", "-GOES18", "_G1")]
    df = names.parse_names(spark.createDataFrame(rows, "name string"))
    assert [r.output for r in names.expand_template("{SAT}{PROD}", df).collect()] == ["G16", "G21", "GXX", "GXX", "GXX"]


def test_only_the_first_line_is_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("clave,region,ul_x,ul_y,lr_x,lr_y\nenclave,e,1,2,3,4\nkey,k,1,x,3,4\nmx,m,1,2,3,4\n,none,1,2,3,4\n")
    (tmp_path / "b.csv").write_text("mx,m,1,2,3,4\nclave,c,5,6,7,8\n")
    assert {(r.key, r.usable) for r in names.list_clips(names.load_clips(spark, str(tmp_path / "a.csv"))).collect()} == {("enclave", True), ("key", False), ("mx", True)}
    assert {r.key for r in names.load_clips(spark, str(tmp_path / "b.csv")).collect()} == {"mx", "clave"}


def test_sidecar_leaves_out_what_is_not_there(spark):
    df = spark.createDataFrame([("G16", None, None), (None, 1.5, [1.0, 2.0, 3.0, 4.0])], "satellite string, gamma double, bounds array<double>")
    docs = [json.loads(r.d) for r in df.select(names.sidecar(df, ("gamma",)).alias("d")).collect()]
    assert docs[0] == {"tool": "skyloom", "version": "3", "satellite": "G16"}
    assert docs[1] == {"tool": "skyloom", "version": "3", "bounds": [1.0, 2.0, 3.0, 4.0], "geometry": {"projection": "", "bbox": [1.0, 2.0, 3.0, 4.0]}, "enhancements": {"gamma": 1.5}}


def test_channels_of_codes(spark):
    stats = spark.createDataFrame([("s", 0, "Phase", True, 0.0, 5.0), ("s", 13, "CMI", False, 200.0, 300.0), ("s", 2, "CMI", False, 0.0, 1.0)], "scene_id string, band int, variable string, categorical boolean, vmin double, vmax double")
    (row,) = names.channel_metadata(stats).collect()
    assert [(c.name, c.quantity, c.unit) for c in row.channels] == [("Phase", "raw_counts", None), ("C02", "reflectance", "unitless"), ("C13", "brightness_temperature", "K")]


def test_stored_palettes(spark):
    for n, size in ((1, 2), (2, 2), (3, 4), (5, 16), (16, 16), (17, 256), (256, 256)):
        colours = spark.createDataFrame([(i, i, 2 * i % 256, 7) for i in range(n)], "idx int, r int, g int, b int")
        got = products.stored_palette(colours).orderBy("idx").collect()
        assert [r.idx for r in got] == list(range(size)) and all(r.r == min(r.idx, n - 1) for r in got)
    image = spark.createDataFrame([("s", 0, 0, 1, 255), ("s", 0, 1, 1, 0), ("s", 1, 0, 3, 255)], "scene_id string, y int, x int, v int, a int")
    colours = spark.createDataFrame([(i, i, i, i) for i in range(3)], "idx int, r int, g int, b int")
    assert [(r.idx, r.r, r.a) for r in products.stored_palette(colours, image).orderBy("idx").collect()] == [(0, 0, 255), (1, 1, 0), (2, 2, 255), (3, 2, 255)]


def test_unit_is_one_word(spark):
    (row,) = palette.parse_lines(spark.createDataFrame([("f", 0, "# UNIT =  K kelvin")], "file string, n int, line string")).collect()
    assert row.unit == "K"


def test_stored_bands_prune_the_scan(spark, tmp_path):
    rows = [(f"s{s}", b, 0, 0, float(b)) for s in range(2) for b in (1, 2, 13)]
    spark.createDataFrame(rows, grids.PIXELS).write.partitionBy("scene_id", "band").parquet(str(tmp_path / "p"))
    df = grids.read_pixels(spark, str(tmp_path / "p"), [13])
    assert sorted((r.scene_id, r.value) for r in df.collect()) == [("s0", 13.0), ("s1", 13.0)]
    assert "PartitionFilters: [band" in df._jdf.queryExecution().executedPlan().toString() or "band#" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
