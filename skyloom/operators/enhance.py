"""Contrast: ratio sharpening, histogram equalisation and its tiled, limited form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store

BINS = 256


def block_mean(wide: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the mean of each pixel's 2 x 2 block, missing ones left out."""
    w = Window.partitionBy("scene_id", F.expr("y div 2"), F.expr("x div 2"))
    return wide.withColumn(out, F.avg(value).over(w))


def sharpen_ratio(wide: DataFrame, value: str, out: str = "ratio") -> DataFrame:
    """Adds value over its block mean, within [0.5, 1.5]; 1 where that is not a positive number."""
    wide = block_mean(wide, value, "_mean")
    ratio = F.col(value) / F.when(F.col("_mean") != 0, F.col("_mean"))
    return wide.withColumn(out, F.when(ratio.isNull() | (ratio < 0), F.lit(1.0)).otherwise(F.least(F.greatest(ratio, F.lit(0.5)), F.lit(1.5)))).drop("_mean")


def _dense(counts: DataFrame, keys: tuple[str, ...], level: str) -> DataFrame:
    """(keys, hist): the counts (keys, level, n) of each group as an array of BINS numbers; combined map-side."""
    found = F.map_from_entries(F.collect_list(F.struct(level, "n")))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    return counts.groupBy(*keys).agg(found.alias("_found")).select(*keys, F.transform(bins, lambda k: F.coalesce(F.try_element_at("_found", k), F.lit(0).cast("long"))).alias("hist"))


def _running(hist: Column, last: Callable[[Column], Column]) -> Column:
    """``last`` of the running sums of an array of whole numbers."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(last(acc["sum"] + n).cast("int"))).alias("out"))
    return F.aggregate(hist, start, step, lambda acc: acc["out"])


def _sum(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, n: a + n)


def equalise(image: DataFrame, channels: tuple[str, ...], level: Column | str = "v") -> DataFrame:
    """Histogram equalisation: the transfer of ``level`` (an 8-bit column) applied to every channel.

    All pixels count.  The image is written once and read twice; the transfer of a scene is one array.
    """
    image = store.written(image)
    counts = image.groupBy("scene_id", (level if isinstance(level, Column) else F.col(level)).alias("_level")).agg(F.count(F.lit(1)).alias("n"))
    tables = _dense(counts, ("scene_id",), "_level").withColumn("_n", _sum(F.col("hist")))
    tables = tables.select("scene_id", _running(F.col("hist"), lambda s: F.floor(F.lit(255.0) * s / F.col("_n"))).alias("_to"))
    out = store.with_facts(image, tables)
    return out.withColumns({c: F.element_at("_to", F.col(c) + 1) for c in channels}).select(*image.columns)


def _transfer_arrays(image: DataFrame, value: str, height: int, width: int, tiles_y: int, tiles_x: int, limit: float) -> DataFrame:
    """(scene_id, ty, tx, to): the transfer of each tile as an array, after clipping its histogram."""
    th, tw = height // tiles_y, width // tiles_x
    top = max(1, int(limit * th * tw / BINS))
    ty, tx = F.least(F.expr(f"cast(y div {th} as int)"), F.lit(tiles_y - 1)), F.least(F.expr(f"cast(x div {tw} as int)"), F.lit(tiles_x - 1))
    counts = image.groupBy("scene_id", ty.alias("ty"), tx.alias("tx"), F.col(value).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    keys = ("scene_id", "ty", "tx")
    table = _dense(counts, keys, "level")
    excess = F.aggregate("hist", F.lit(0).cast("long"), lambda a, n: a + F.greatest(n - top, F.lit(0)))
    table = table.withColumns({"_n": _sum(F.col("hist")), "_excess": excess})
    # an equal part of what is cut off goes to every level, the rest to the lowest ones
    part, rest = F.expr(f"_excess div {BINS}"), F.col("_excess") % BINS
    clipped = F.transform("hist", lambda n, k: F.least(n, F.lit(top)) + part + F.when(k < rest, 1).otherwise(0))
    return table.withColumn("hist", clipped).select(*keys, _running(F.col("hist"), lambda s: F.floor(s * (F.lit(255.0) / F.col("_n")) + 0.5)).alias("to"))


def tile_transfers(image: DataFrame, value: str, height: int, width: int, tiles_y: int, tiles_x: int, limit: float) -> DataFrame:
    """(scene_id, ty, tx, level, to): transfer of each tile after clipping its histogram."""
    return _transfer_arrays(image, value, height, width, tiles_y, tiles_x, limit).select("scene_id", "ty", "tx", F.posexplode("to").alias("level", "to"))


def clahe(image: DataFrame, value: str, height: int, width: int, tiles_y: int = 4, tiles_x: int = 4, limit: float = 4.0) -> DataFrame:
    """Equalisation per tile with a clipped histogram, bilinear between the four tiles around a pixel.

    The image is written once and read twice."""
    image = store.written(image)
    th, tw = height // tiles_y, width // tiles_x
    table = tile_transfers(image, value, height, width, tiles_y, tiles_x, limit)
    fy, fx = F.col("y") / F.lit(float(th)) - 0.5, F.col("x") / F.lit(float(tw)) - 0.5
    inside = lambda f, n: F.least(F.greatest(f.cast("int"), F.lit(0)), F.lit(n - 2))
    out = image.withColumns({"_fy": fy, "_fx": fx}).withColumns({"_ty": inside(F.col("_fy"), tiles_y), "_tx": inside(F.col("_fx"), tiles_x)})
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    out = out.withColumns({"_dy": clamp(F.col("_fy") - F.col("_ty")), "_dx": clamp(F.col("_fx") - F.col("_tx"))})
    # one row of four transfers per cell and level, so that a pixel joins once
    spread = table.select("scene_id", "level", "to", "ty", "tx", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)])).alias("d"))
    cells = spread.groupBy("scene_id", (F.col("ty") - F.col("d.dy")).alias("_ty"), (F.col("tx") - F.col("d.dx")).alias("_tx"), F.col("level").alias(value)).agg(
        *[F.max(F.when((F.col("d.dy") == dy) & (F.col("d.dx") == dx), F.col("to"))).alias(f"_{dy}{dx}") for dy in (0, 1) for dx in (0, 1)]
    )
    out = out.join(cells, ["scene_id", "_ty", "_tx", value], "left")
    c = F.col
    top = c("_00") * (1 - c("_dx")) + c("_01") * c("_dx")
    low = c("_10") * (1 - c("_dx")) + c("_11") * c("_dx")
    return out.withColumn(value, F.floor(top * (1 - c("_dy")) + low * c("_dy") + 0.5).cast("int")).select(*image.columns)
