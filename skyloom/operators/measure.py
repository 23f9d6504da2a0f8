"""Grid statistics and image comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store

RANK_BINS = 4096  # parts that each pass of values_at divides a range into


def grid_stats(pixels: DataFrame, *keys: str) -> DataFrame:
    """Valid minimum, maximum and count of each grid; missing pixels are left out."""
    return pixels.groupBy(*keys).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.count("value").alias("n_valid"), F.count(F.lit(1)).alias("n"))


def diff_count(a: DataFrame, b: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), fuzz: float = 0.02, allowed: float = 0.01) -> DataFrame:
    """Per scene: pixels that differ beyond the fuzz in any channel or stand in one image only, and the verdict."""
    left = a.select("scene_id", "y", "x", F.struct(*channels).alias("p"))
    right = b.select("scene_id", "y", "x", F.struct(*channels).alias("q"))
    beyond = F.lit(False)
    for c in channels:
        beyond = beyond | (F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) > fuzz * 255)
    bad = F.coalesce(beyond, F.lit(True)) | F.col("p").isNull() | F.col("q").isNull()
    size = lambda side, axis: F.max(F.when(F.col(side).isNotNull(), F.col(axis)))
    out = left.join(right, ["scene_id", "y", "x"], "full_outer").groupBy("scene_id").agg(
        F.count_if(bad).alias("n_differ"), F.count(F.lit(1)).alias("n"), (size("p", "y").eqNullSafe(size("q", "y")) & size("p", "x").eqNullSafe(size("q", "x"))).alias("same_size")
    )
    return out.withColumn("passed", F.col("same_size") & (F.col("n_differ") <= allowed * F.col("n")))


def values_at(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(scene_id, rank, value): the values(scene_id, value) at ranks(scene_id, rank), counted from 0 in rising order.

    Exact without sorting or holding a scene: each pass counts the values around a rank in RANK_BINS equal
    parts of their range and goes on with the part that holds it, until that is one value: one pass for
    bytes, about five for doubles, as a pass takes off twelve bits.  Missing values (NULL, NaN, infinite)
    have no rank; a rank beyond the last gives no row.
    """
    inf, scene = F.lit(float("inf")), Window.partitionBy("scene_id", "rank")
    counts = values.where((F.col("value") < inf) & (F.col("value") > -inf)).groupBy("scene_id", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = store.written(counts)
    ends = counts.groupBy("scene_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("all"))
    at = ranks.join(ends, "scene_id").where("rank >= 0 and rank < all").select("scene_id", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"))
    at = store.written(at)
    while not at.where("lo < hi").isEmpty():
        open_, done = at.where("lo < hi"), at.where("lo >= hi")
        # a scene's values are dealt to tasks by salt, each with its own copy of the scene's few ranges
        salted = counts.withColumn("_salt", F.pmod(F.hash("value"), F.lit(store.SALTS)))
        copies = open_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(store.SALTS - 1))))
        near = salted.join(copies, ["scene_id", "_salt"]).where("value between lo and hi")
        part = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANK_BINS), F.lit(RANK_BINS - 1))
        parts = near.groupBy("scene_id", "rank", "before", part.alias("part")).agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.col("before") + F.sum("n").over(scene.orderBy("part"))
        found = parts.withColumn("upto", upto).where("upto > rank and upto - n <= rank").select("scene_id", "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("before"))
        at = store.written(done.unionByName(found))
    return at.select("scene_id", "rank", F.col("lo").alias("value"))


def diff_stats(a: DataFrame, b: DataFrame, channel: str = "v", mask: str | None = None) -> DataFrame:
    """Per scene: mean absolute and root mean square difference, shares within 10 and 25, 99th percentile, means, bias.

    The percentile is exact, between the two ranks around it; the compared pixels are written once.
    """
    left = a if mask is None else a.where(F.col(mask) > 250)
    joined = left.select("scene_id", "y", "x", F.col(channel).alias("p")).join(b.select("scene_id", "y", "x", F.col(channel).alias("q")), ["scene_id", "y", "x"])
    joined = store.written(joined.select("scene_id", "p", "q"))
    d = F.col("p") - F.col("q")
    share = lambda k: F.avg(F.when(F.abs(d) <= k, 1.0).otherwise(0.0))
    stats = joined.groupBy("scene_id").agg(
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), share(10).alias("within_10"), share(25).alias("within_25"),
        F.avg("p").alias("mean_a"), F.avg("q").alias("mean_b"), F.avg(d).alias("bias"),
    )
    values = joined.select("scene_id", F.abs(d).cast("double").alias("value"))
    place = values.where(F.col("value") < float("inf")).groupBy("scene_id").agg(((F.count(F.lit(1)) - 1) * 0.99).alias("place"))
    ranks = place.select("scene_id", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    found = values_at(values, ranks).join(place, "scene_id")
    # two neighbours weigh 1 - distance each, a whole place 1
    p99 = found.groupBy("scene_id").agg(F.sum(F.col("value") * (1 - F.abs(F.col("place") - F.col("rank")))).alias("p99"))
    return stats.join(p99, "scene_id", "left").select("scene_id", "mae", "rmse", "within_10", "within_25", "p99", "mean_a", "mean_b", "bias")


def nonblank(image: DataFrame, channel: str = "v") -> DataFrame:
    """Per scene: whether the image varies at all, and the values in its corners."""
    corners = image.groupBy("scene_id").agg(F.stddev_pop(channel).alias("sd"), F.min_by(channel, F.struct("y", "x")).alias("first"), F.max_by(channel, F.struct("y", "x")).alias("last"))
    return corners.select("scene_id", (F.col("sd") > 0).alias("varies"), "first", "last")
