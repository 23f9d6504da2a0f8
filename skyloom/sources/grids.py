"""Raster tables: schemas, readers of stored ones, and pixels that the star-schema tables stand for.

Long pixels are (scene_id, band, y, x, value); a missing pixel is NULL.  Stored pixel tables are
partitioned by scene and band, so the bands of a recipe prune the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 32
FILL = -1
#: Scan geometry of the derived grid, in radians: first edge and step of each axis.
X0, DX, Y0, DY = -0.16, 0.01, 0.16, -0.01
PROJ = {"sat_height": 35786023.0, "semi_major": 6378137.0, "semi_minor": 6356752.31414, "lon_origin": -75.0}

PIXELS = T.StructType(
    [T.StructField("scene_id", T.StringType()), T.StructField("band", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("value", T.DoubleType())]
)
CLIPS = "key string, region string, ul_x double, ul_y double, lr_x double, lr_y double"


def read_pixels(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """A stored pixel table; naming the bands prunes the partitions of the others."""
    df = spark.read.schema(PIXELS).parquet(path)
    return df if bands is None else df.where(F.col("band").isin(bands))


def missing_as_null(value):
    """NULL for what the sentinel conventions call missing: at least 1e30, NaN or infinite."""
    return F.when((value >= 1e30) | F.isnan(value) | (value == float("-inf")), None).otherwise(value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, bands: list[int] | None = None, side: int = SIDE) -> DataFrame:
    """Packed counts (scene_id, band, y, x, raw) that lineitem stands for; FILL marks missing ones."""
    li = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 2).cast("string")).alias("scene_id"),
        (F.col("l_partkey") % 16 + 1).cast("int").alias("band"),
        F.expr(f"cast((l_orderkey % {side * side}) div {side} as int)").alias("y"),
        (F.col("l_orderkey") % side).cast("int").alias("x"),
        (F.col("l_partkey") * 37 + F.col("l_quantity").cast("long") * 53).alias("v"),
    )
    if bands is not None:
        li = li.where(F.col("band").isin(bands))
    v = (F.sum("v") % 4095).cast("int")
    return li.groupBy("scene_id", "band", "y", "x").agg(F.when(v >= 4000, F.lit(FILL)).otherwise(v).alias("raw"))


def band_attributes(raw_pixels: DataFrame) -> DataFrame:
    """(scene_id, band, calibration, geometry): one row for each band of each scene."""
    warm = F.col("band") >= 7
    proj = F.struct(*[F.lit(v).alias(k) for k, v in PROJ.items()])
    return raw_pixels.select("scene_id", "band").distinct().select(
        "scene_id",
        "band",
        F.when(warm, F.lit(0.035)).otherwise(F.lit(1.0) / 4000).alias("scale"),
        F.when(warm, F.lit(180.0)).otherwise(F.lit(0.0)).alias("offset"),
        F.lit(FILL).alias("fill"),
        F.when(F.col("band") <= 3, F.lit(1.0)).otherwise(F.lit(2.0)).alias("resolution_km"),
        (F.lit(0.001) + F.col("band") * 0.0001).alias("kappa0"),
        (F.lit(10000.0) + F.col("band") * 100).alias("fk1"),
        (F.lit(1000.0) + F.col("band") * 10).alias("fk2"),
        F.lit(0.2).alias("bc1"),
        F.lit(0.999).alias("bc2"),
        F.array(*[F.lit(v) for v in (X0, DX, 0.0, Y0, 0.0, DY)]).alias("gt"),
        proj.alias("proj"),
    )


def scene_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, start_ts): a daylight and an evening scene, placed by the event stream."""
    key = F.col("user_id") % 2
    return (
        table(spark, sf_dir, "events")
        .groupBy(key.alias("k"))
        .agg(F.date_trunc("second", F.min("ts")).alias("t"))
        .select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("scene_id"), F.timestamp_seconds(F.unix_timestamp("t") + 3600 * (13 + 9 * F.col("k"))).alias("start_ts"))
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name) of scene files that orders stand for: several products, satellites and sectors."""
    k = F.col("o_orderkey")
    stamp = F.concat(F.date_format("o_orderdate", "yyyyDDD"), F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.lpad((k % 599).cast("string"), 3, "0"))
    kind = F.element_at(F.array(*map(F.lit, ("L2-CMIPC-M6C#", "L1b-RadF-M3C#", "L2-ACHAF-M6", "L2-ACTPC-M6", "L2-CMIPM1-M6C#", "L1b-RadM2-M4C#", "L2-LSTF-M3", "L2-XYZC-"))), (k % 8 + 1).cast("int"))
    sat = F.element_at(F.array(*map(F.lit, ("_G16", "_G17", "_G18", "_G19", "-GOES18"))), (k % 5 + 1).cast("int"))
    tail = F.when(k % 11 == 0, F.lit("_nostamp")).otherwise(F.concat(F.lit("_s"), stamp, F.lit("_e1_c2")))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("OR_ABI-"), F.replace(kind, F.lit("#"), F.lpad((k % 16 + 1).cast("string"), 2, "0")), sat, tail, F.lit(".nc")).alias("name"))
