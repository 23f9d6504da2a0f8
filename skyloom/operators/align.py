"""Bands side by side: conditional aggregation, resampling by integer factors, band choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("scene_id", "y", "x")


def band_column(band: int) -> str:
    return f"c{band:02d}"


def to_wide(pixels: DataFrame, bands: list[int], place: tuple[str, ...] = ()) -> DataFrame:
    """One row per pixel with c01..c16 of the wanted bands only: one shuffle, combined map-side; none where
    the table is bucketed by the columns of ``place``, which then stay on the rows."""
    wanted = pixels.where(F.col("band").isin(bands))
    return wanted.groupBy(*place, *KEYS).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(band_column(b)) for b in bands])


def reference_band(scenes: DataFrame, bands: list[int], full_res: bool = False) -> DataFrame:
    """(scene_id, band): the coarsest of the bands, or the finest; the first listed wins ties."""
    place = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band"))
    sign = F.col("resolution_km") if full_res else -F.col("resolution_km")
    return scenes.where(F.col("band").isin(bands)).groupBy("scene_id").agg(F.min_by("band", F.struct(sign, place)).alias("band"))


def decimate(pixels: DataFrame, factor: int) -> DataFrame:
    """Every factor-th row and column."""
    return pixels.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0)).withColumns({"y": F.expr(f"y div {factor}"), "x": F.expr(f"x div {factor}")})


def _whole_blocks(pixels: DataFrame, factor: int, height: int, width: int) -> DataFrame:
    return pixels.where((F.col("y") < factor * (height // factor)) & (F.col("x") < factor * (width // factor))).withColumns({"y": F.expr(f"cast(y div {factor} as int)"), "x": F.expr(f"cast(x div {factor} as int)")})


def box_mean(pixels: DataFrame, factor: int, height: int, width: int) -> DataFrame:
    """Mean of factor x factor blocks; a block with a missing pixel is missing; the rest is dropped."""
    whole = F.count("value") == factor * factor
    return _whole_blocks(pixels, factor, height, width).groupBy("scene_id", "band", "y", "x").agg(F.when(whole, F.avg("value")).alias("value"))


def box_mean_image(image: DataFrame, factor: int, height: int, width: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The same for 8-bit channels, rounded half up."""
    if factor > min(height, width):
        raise ValueError("the shrunken image would be empty")
    return _whole_blocks(image, factor, height, width).groupBy(*KEYS).agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in channels])


def pyramid(image: DataFrame, height: int, width: int, levels: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The image and its halvings with a level column; each level halves the rounded one before it.

    One shuffle whatever the levels: pixels are dealt by their quad-tree tile of the last level, within
    which every halving is a grouping of neighbours.  A tile's list has less than 4/3 of its 4^levels pixels.
    """
    if levels and 2**levels > min(height, width):
        raise ValueError("the shrunken image would be empty")
    tile = ["scene_id", "_ty", "_tx"]
    pixel = lambda level: F.struct("y", "x", *channels, F.lit(level).alias("level"))
    now = image.select(F.expr(f"cast(y div {2**levels} as int)").alias("_ty"), F.expr(f"cast(x div {2**levels} as int)").alias("_tx"), *KEYS, *channels)
    now = now.repartition(*tile).withColumn("_below", F.array(pixel(0)))
    for k in range(1, levels + 1):
        up = now.groupBy(*tile, F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(
            *[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in channels], F.flatten(F.collect_list("_below")).alias("_below")
        )
        # blocks beyond the last whole one pass on what they hold, but have no pixel of this level
        inside = (F.col("y") < height // 2**k) & (F.col("x") < width // 2**k)
        now = up.withColumn("_below", F.when(inside, F.concat("_below", F.array(pixel(k)))).otherwise(F.col("_below")))
    return now.select("scene_id", F.explode("_below").alias("p")).select("scene_id", "p.*")


def _corners(position: str, target: int, source: int) -> list[tuple[Column, Column]]:
    """(neighbour, weight) pairs of the corner-aligned position on one axis."""
    at = F.col(position) * F.lit((source - 1) / (target - 1))
    low = F.floor(at)
    return [(low.cast("int"), 1 - (at - low)), (F.ceil(at).cast("int"), at - low)]


def gather(targets: DataFrame, source: DataFrame, values: list[str]) -> DataFrame:
    """Weighted sums: targets(scene_id, y, x, sources: array of sy, sx, w) of source(scene_id, y, x, values).

    A missing or absent source with weight makes the sum missing.
    """
    flat = targets.select(*KEYS, F.explode("sources").alias("s")).select(*KEYS, F.col("s.sy").alias("sy"), F.col("s.sx").alias("sx"), F.col("s.w").alias("w"))
    return weighted(flat, source, values)


def weighted(flat: DataFrame, source: DataFrame, values: list[str]) -> DataFrame:
    """The same for targets with one row a source: (scene_id, y, x, sy, sx, w)."""
    flat = flat.where("w > 0")
    have = source.select("scene_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *values)
    joined = flat.join(have, ["scene_id", "sy", "sx"], "left")
    whole = [F.when(F.count(v) == F.count(F.lit(1)), F.sum(F.col("w") * F.col(v))).alias(v) for v in values]
    return joined.groupBy(*KEYS).agg(*whole)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to all tasks before each is exploded into many; a fixed number, so that they stay apart."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def grid(scenes: DataFrame, height: int, width: int) -> DataFrame:
    """Every (scene_id, y, x) of a height x width grid."""
    rows = scenes.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return spread(rows, "scene_id", "y").select("scene_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def enlarge(source: DataFrame, scenes: DataFrame, factor: int, height: int, width: int, values: list[str], as_bytes: bool = False) -> DataFrame:
    """Corner-aligned bilinear enlargement by a factor; 8-bit values are rounded half up."""
    h, w = height * factor, width * factor
    ys, xs = _corners("y", h, height), _corners("x", w, width)
    sources = F.array(*[F.struct(sy.alias("sy"), sx.alias("sx"), (wy * wx).alias("w")) for sy, wy in ys for sx, wx in xs])
    out = gather(grid(scenes, h, w).withColumn("sources", sources), source, values)
    return out.select(*KEYS, *[F.floor(F.col(v) + 0.5).cast("int").alias(v) for v in values]) if as_bytes else out
