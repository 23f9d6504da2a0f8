"""Crop, nearest pixel, bounding box, reprojection to latitude and longitude, georeference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import KEYS, spread, weighted

RAD = math.pi / 180
HEIGHT = 35786023.0  # fixed value: usual height of a geostationary satellite in metres
HALF_DISK = 0.151872  # fixed value: half the full-disk field of view in radians
LIMITS = (10, 10_000)
CORNERS = ("ul_x", "ul_y", "lr_x", "lr_y")
EDGE_SAMPLES = 20
LEAF = 0.0439453125  # fixed value: degrees of the smallest cells of pixels, 180 / FINER ** (LEVELS - 1)
FINER, LEVELS = 8, 5  # a cell of the next level is FINER times as wide
SALTS = 32  # parts of the points, each with its own copy of the scenes' largest cells


def crop(pixels: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """The window moved to the origin; what lies outside the grid is simply not there."""
    inside = F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)
    return pixels.where(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def crop_image(image: DataFrame, y0: int, x0: int, height: int, width: int, full_height: int, full_width: int) -> DataFrame:
    """The same for 8-bit images, where a window beyond the image is an error."""
    if y0 < 0 or x0 < 0 or y0 + height > full_height or x0 + width > full_width:
        raise ValueError("the window exceeds the image")
    return crop(image, y0, x0, height, width)


def _gap(lo: str, hi: str, at: str) -> tuple[Column, Column]:
    """Least and greatest distance in latitude of ``at`` from values between lo and hi."""
    lo, hi, at = F.col(lo), F.col(hi), F.col(at)
    return F.greatest(lo - at, at - hi, F.lit(0.0)), F.greatest(F.abs(lo - at), F.abs(hi - at))


def _wrapped(lon: Column, plon: Column) -> Column:
    d = F.abs(lon - plon)
    return F.when(d > 180, 360 - d).otherwise(d)


def _bounds() -> tuple[Column, Column]:
    """Least and greatest squared degrees from a point to what a cell's box (lat0, lat1, lon0, lon1) can hold."""
    south, north = _gap("lat0", "lat1", "plat")
    plon, lo, hi = F.col("plon"), F.col("lon0"), F.col("lon1")
    a, b = _wrapped(lo, plon), _wrapped(hi, plon)
    inside = plon.between(lo, hi) | (plon + 360).between(lo, hi) | (plon - 360).between(lo, hi)
    opposite = (plon + 180).between(lo, hi) | (plon - 180).between(lo, hi)
    west, east = F.when(inside, 0.0).otherwise(F.least(a, b)), F.when(opposite, 180.0).otherwise(F.greatest(a, b))
    return south * south + west * west, north * north + east * east


def _nearer(pairs: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """The cells (i, j) that can hold the pixel nearest to a point: none farther than another cell is for certain."""
    least, most = _bounds()
    keys = ["plat", "plon", "scene_id"]
    limit = F.min("most").over(Window.partitionBy(*keys))
    boxes = pairs.join(cells, on).select(*keys, "i", "j", least.alias("least"), most.alias("most"))
    return boxes.withColumn("limit", limit).where("least <= limit").select(*keys, "i", "j")


def _boxes(pixels: DataFrame) -> list[DataFrame]:
    """Bounds (lat0, lat1, lon0, lon1) of the pixels in each cell (scene_id, i, j), its parent being (pi, pj), by level."""
    out = [pixels.groupBy("scene_id", "i", "j").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))]
    for _ in range(1, LEVELS):
        up = out[-1].withColumns({"i": F.floor(F.col("i") / FINER).cast("int"), "j": F.floor(F.col("j") / FINER).cast("int")})
        out.append(up.groupBy("scene_id", "i", "j").agg(F.min("lat0").alias("lat0"), F.max("lat1").alias("lat1"), F.min("lon0").alias("lon0"), F.max("lon1").alias("lon1")))
    return [df.withColumns({"pi": F.floor(F.col("i") / FINER).cast("int"), "pj": F.floor(F.col("j") / FINER).cast("int")}) for df in out]


def nearest_pixel(points: DataFrame, nav: DataFrame) -> DataFrame:
    """(pid, scene_id, y, x) of the pixel nearest to each point, by squared degrees; ties to the first.

    points(pid, plat, plon) may be many, and scenes large.  A place descends a pyramid of cells of each scene: it is
    held against the few cells as wide as half the globe, and those that can be nearest are joined, by
    equality, with the cells in them, level by level down to cells of a few pixels and to these.  Of each
    level a few cells stay, so rows grow with places x scenes, not with the pixels.  A point without
    coordinates, or a scene without a navigated pixel, gives no row.
    """
    small = lambda c: F.floor(F.col(c) / LEAF).cast("int")
    # as a generated column a position is computed once a pixel and its filter stays here; else both
    # would be pushed through the grouping that made the pixels, into each row of the source
    seen = nav.select(*KEYS, F.explode(F.array(F.struct("lat", "lon"))).alias("p")).select(*KEYS, "p.lat", "p.lon")
    pixels = seen.where("lat is not null and lon is not null").select(*KEYS, "lat", "lon", small("lat").alias("i"), small("lon").alias("j"))
    *finer, widest = _boxes(pixels)
    places = points.where("plat is not null and plon is not null").select(F.col("plat").cast("double").alias("plat"), F.col("plon").cast("double").alias("plon"))
    pairs = places.distinct().withColumn("salt", F.pmod(F.hash("plat", "plon"), F.lit(SALTS)))
    around = _nearer(pairs, widest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["salt"])
    for boxes in reversed(finer):
        around = _nearer(around.select("plat", "plon", "scene_id", F.col("i").alias("pi"), F.col("j").alias("pj")), boxes, ["scene_id", "pi", "pj"])
    dlon = _wrapped(F.col("lon"), F.col("plon"))
    d = (F.col("lat") - F.col("plat")) * (F.col("lat") - F.col("plat")) + dlon * dlon
    found = around.join(pixels, ["scene_id", "i", "j"]).groupBy("plat", "plon", "scene_id").agg(F.min(F.struct(d.alias("d"), "y", "x")).alias("m"))
    named = points.select("pid", F.col("plat").cast("double").alias("plat"), F.col("plon").cast("double").alias("plon"))
    # points may be exploded, so far more than the size of their files tells: both sides are dealt by place
    near = named.join(found.hint("shuffle_merge"), ["plat", "plon"]).groupBy("pid", "scene_id").agg(F.min("m").alias("m"))
    return near.select("pid", "scene_id", F.col("m.y").alias("y"), F.col("m.x").alias("x"))


def edge_points(clips: DataFrame) -> DataFrame:
    """(pid, key, plat, plon): samples on the four edges of each clip(key, ul_x, ul_y, lr_x, lr_y) with all corners."""
    clips = clips.where("ul_x is not null and ul_y is not null and lr_x is not null and lr_y is not null")
    t = F.col("s") / F.lit(float(EDGE_SAMPLES))
    lon, lat = F.col("ul_x") + t * (F.col("lr_x") - F.col("ul_x")), F.col("lr_y") + t * (F.col("ul_y") - F.col("lr_y"))
    edges = F.array(F.struct(F.col("ul_y").alias("plat"), lon.alias("plon")), F.struct(F.col("lr_y").alias("plat"), lon.alias("plon")), F.struct(lat.alias("plat"), F.col("ul_x").alias("plon")), F.struct(lat.alias("plat"), F.col("lr_x").alias("plon")))
    flat = clips.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(EDGE_SAMPLES)))).select("key", "s", F.posexplode(edges).alias("edge", "e"))
    return flat.select(F.concat_ws("/", "key", F.col("s").cast("string"), F.col("edge").cast("string")).alias("pid"), "key", F.col("e.plat").alias("plat"), F.col("e.plon").alias("plon"))


def bounding_box(clips: DataFrame, nav: DataFrame) -> DataFrame:
    """(key, scene_id, y0, x0, height, width) of each clip on the native grid; at least four hits.

    Keys with the same rectangle share one search.  A key with several has its own, in which each sample is
    the nearest pixel to any of them.
    """
    rects = clips.where(" and ".join(f"{c} is not null" for c in CORNERS)).select("key", *CORNERS).distinct()
    several = F.count(F.lit(1)).over(Window.partitionBy("key")) > 1
    shape = F.when(several, F.concat_ws("/", F.lit("="), "key")).otherwise(F.concat_ws("/", *[F.col(c).cast("string") for c in CORNERS]))
    shapes = rects.withColumn("shape", shape)
    samples = edge_points(shapes.select(F.col("shape").alias("key"), *CORNERS).distinct())
    hits = nearest_pixel(samples.select(F.struct("key", "pid").alias("pid"), "plat", "plon"), nav).withColumn("shape", F.col("pid.key"))
    found = hits.groupBy("shape", "scene_id").agg(F.count(F.lit(1)).alias("hits"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    box = shapes.select("key", "shape").distinct().join(found.where("hits >= 4").hint("shuffle_merge"), "shape")
    return box.select("key", "scene_id", "y0", "x0", (F.col("y1") - F.col("y0") + 1).alias("height"), (F.col("x1") - F.col("x0") + 1).alias("width"))


def clip_native(pixels: DataFrame, nav: DataFrame, clips: DataFrame) -> DataFrame:
    """Pixels in the bounding box of each clip, moved to its origin, with the clip's key."""
    lines = bounding_box(clips, nav).withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("height") - 1)))
    rows = spread(lines, "key", "scene_id", "y")  # before the join makes a line's pixels of it
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("width"))
    return pixels.join(rows, ["scene_id", "y"]).where(inside).withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).drop("y0", "x0", "height", "width")


def plan(extent: DataFrame, resolution_km: Column, clip: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Target grid of each scene: extent(scene_id, lat_min, lat_max, lon_min, lon_max, …) with the clip
    (ul_x, ul_y, lr_x, lr_y) taken out of it, cells of the native resolution, and their number."""
    c = F.col
    if clip is not None:
        ul_x, ul_y, lr_x, lr_y = map(F.lit, clip)
        extent = extent.withColumns({"lon_min": F.greatest(ul_x, "lon_min"), "lon_max": F.least(lr_x, "lon_max"), "lat_min": F.greatest(lr_y, "lat_min"), "lat_max": F.least(ul_y, "lat_max")})
    km = 111.132954 - 0.559822 * F.cos(2.0 * RAD * (c("lat_min") + c("lat_max")) / 2.0)
    cell = F.when(resolution_km > 0, resolution_km).otherwise(F.lit(1.0)) / km
    count = lambda a, b: F.least(F.greatest(F.floor((c(b) - c(a)) / c("cell") + 0.5), F.lit(LIMITS[0])), F.lit(LIMITS[1])).cast("int")
    out = extent.withColumn("cell", cell)
    return out.withColumns({"out_w": count("lon_min", "lon_max"), "out_h": count("lat_min", "lat_max")})


def safe_transform(gt: Column, width: Column, height: Column) -> Column:
    """The transform, or that of a full disk where its steps are no radians."""
    bad = (gt[1] == 0) | (gt[5] == 0) | (F.abs(gt[1]) > 1)
    full = F.array(F.lit(-HALF_DISK), 2 * HALF_DISK / width, F.lit(0.0), F.lit(HALF_DISK), F.lit(0.0), -2 * HALF_DISK / height)
    return F.when(bad, full).otherwise(gt)


def source_positions(planned: DataFrame) -> DataFrame:
    """(scene_id, y, x, col, row) of every target cell; col and row are NULL off the disk.

    planned: rows of ``plan`` with gt and proj.
    """
    c, p = F.col, lambda k: F.col("proj")[k]
    rows = planned.withColumn("y", F.explode(F.sequence(F.lit(0), c("out_h") - 1)))
    cells = spread(rows, "scene_id", "y").withColumn("x", F.explode(F.sequence(F.lit(0), c("out_w") - 1)))
    lat = c("lat_max") - (c("y") + 0.5) * ((c("lat_max") - c("lat_min")) / c("out_h"))
    lon = c("lon_min") + (c("x") + 0.5) * ((c("lon_max") - c("lon_min")) / c("out_w"))
    out = cells.withColumns({"_a2": p("semi_major") * p("semi_major"), "_b2": p("semi_minor") * p("semi_minor"), "_h": p("semi_major") + p("sat_height"), "_lat": lat * RAD, "_dl": lon * RAD - p("lon_origin") * RAD})
    out = out.withColumn("_pc", F.atan(c("_b2") / c("_a2") * F.tan("_lat")))
    out = out.withColumn("_rc", p("semi_minor") / F.sqrt(1.0 - (c("_a2") - c("_b2")) / c("_a2") * F.cos("_pc") * F.cos("_pc")))
    out = out.withColumns({"_sx": c("_h") - c("_rc") * F.cos("_pc") * F.cos("_dl"), "_sy": -c("_rc") * F.cos("_pc") * F.sin("_dl"), "_sz": c("_rc") * F.sin("_pc")})
    seen = c("_h") * (c("_h") - c("_sx")) >= c("_sy") * c("_sy") + c("_a2") / c("_b2") * c("_sz") * c("_sz")
    x_rad = F.asin(-c("_sy") / F.sqrt(c("_sx") * c("_sx") + c("_sy") * c("_sy") + c("_sz") * c("_sz")))
    y_rad = F.atan2(c("_sz"), c("_sx"))
    return out.select("scene_id", "y", "x", F.when(seen, (x_rad - c("gt")[0]) / c("gt")[1]).alias("col"), F.when(seen, (y_rad - c("gt")[3]) / c("gt")[5]).alias("row"))


def _inside(width: int, height: int) -> Column:
    return (F.col("col") >= 0) & (F.col("col") < width - 1) & (F.col("row") >= 0) & (F.col("row") < height - 1)


def reproject_nearest(image: DataFrame, planned: DataFrame, height: int, width: int, values: list[str], nodata: int = 0, pixel_centre: bool = False) -> DataFrame:
    """Each target cell's nearest source pixel, ``nodata`` off the disk and outside the grid."""
    half = 0.0 if pixel_centre else 0.5
    cells = source_positions(planned).select(*KEYS, F.when(_inside(width, height), F.floor(F.col("row") + half).cast("int")).alias("sy"), F.when(_inside(width, height), F.floor(F.col("col") + half).cast("int")).alias("sx"))
    have = image.select("scene_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *values)
    return cells.join(have, ["scene_id", "sy", "sx"], "left").select(*KEYS, *[F.coalesce(v, F.lit(nodata)).alias(v) for v in values])


def reproject_bilinear(image: DataFrame, planned: DataFrame, height: int, width: int, values: list[str], nodata: int = 0) -> DataFrame:
    """The same by the four pixels around each cell's source position, rounded half up, within 0..255."""
    at = source_positions(planned)
    # the corners are exploded as numbers, so that a cell's position is computed once for all four
    corners = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]))
    flat = at.where(_inside(width, height)).select(*KEYS, "row", "col", corners.alias("d"))
    dr, dc = F.col("row") - F.floor("row"), F.col("col") - F.floor("col")
    w = F.when(F.col("d.dy") == 1, dr).otherwise(1 - dr) * F.when(F.col("d.dx") == 1, dc).otherwise(1 - dc)
    flat = flat.select(*KEYS, (F.floor("row").cast("int") + F.col("d.dy")).alias("sy"), (F.floor("col").cast("int") + F.col("d.dx")).alias("sx"), w.alias("w"))
    sums = weighted(flat, image, values).select(*KEYS, *[F.when(F.col(v).isNotNull(), F.least(F.greatest(F.floor(F.col(v) + 0.5).cast("int"), F.lit(0)), F.lit(255))).alias(v) for v in values])
    return at.select(*KEYS).join(sums, list(KEYS), "left").select(*KEYS, *[F.coalesce(v, F.lit(nodata)).alias(v) for v in values])


def counters(planned: DataFrame, height: int, width: int) -> DataFrame:
    """Per scene: target cells that found a pixel, that are off the disk, and outside the grid."""
    inside, off = _inside(width, height), F.col("col").isNull()
    return source_positions(planned).groupBy("scene_id").agg(F.count_if(inside).alias("valid"), F.count_if(off).alias("off_horizon"), F.count_if(~off & ~inside).alias("out_of_bounds"))


def native_bounds(gt: Column, height_m: Column, y0: Column, x0: Column, height: Column, width: Column) -> Column:
    """Bounds in metres of a window of the native grid, y in rising order."""
    h = F.coalesce(height_m, F.lit(HEIGHT))
    ya, yb = (gt[3] + y0 * gt[5]) * h, (gt[3] + (y0 + height) * gt[5]) * h
    return F.struct(((gt[0] + x0 * gt[1]) * h).alias("x_min"), F.least(ya, yb).alias("y_min"), ((gt[0] + (x0 + width) * gt[1]) * h).alias("x_max"), F.greatest(ya, yb).alias("y_max"))


def output_transform(gt: Column, y0: int, x0: int, scale: int) -> Column:
    """The transform after a crop and an enlargement (scale above 0) or reduction (below)."""
    k = 1.0 if scale in (0, 1, -1) else (1.0 / scale if scale > 0 else float(-scale))
    return F.array(gt[0] + x0 * gt[1], gt[1] * k, F.lit(0.0), gt[3] + y0 * gt[5], F.lit(0.0), gt[5] * k)


def geographic_transform(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, height: Column, width: Column) -> Column:
    return F.array(lon_min, (lon_max - lon_min) / width, F.lit(0.0), lat_max, F.lit(0.0), -(lat_max - lat_min) / height)


def crs_label(satellite: Column, reprojected: Column) -> Column:
    return F.when(reprojected, "EPSG:4326").when(satellite.rlike("^G1[6-9]$"), F.concat(F.lit("goes"), F.substring(satellite, 2, 2))).otherwise("geostationary")


def proj_string(proj: Column) -> Column:
    return F.format_string("+proj=geos +h=%.1f +a=%.1f +b=%.5f +lon_0=%.1f +sweep=x", proj["sat_height"], proj["semi_major"], proj["semi_minor"], proj["lon_origin"])
