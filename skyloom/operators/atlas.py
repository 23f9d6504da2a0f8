"""Geometry that all scenes of a grid share, computed once, stored by tile and joined.

Navigation and view angles hang on the grid alone.  They are stored as sines and cosines, so that a scene's
sun needs one arc sine, one tangent and one sine a pixel instead of some thirty functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources import tiles

RAD = math.pi / 180
DUSK = math.cos(85 * RAD)  # least cosine of the sun zenith that bands are normalised at
#: Stored columns: place on earth and its sines and cosines; cosine of the view zenith; the view
#: direction's horizontal parts, to the east and to the north.
COLUMNS = ("lat", "lon", "sin_lat", "cos_lat", "sin_lon", "cos_lon", "view_up", "view_east", "view_north")


def geometry(grids: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """(grid_id, tile, cell, COLUMNS) of every pixel on the disk of grids(grid_id, height, width, gt, proj)."""
    rows = grids.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grid_id", "y")
    cells = rows.select("grid_id", "gt", "proj", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    gt = F.col("gt")
    seen = G.navigate(cells.withColumns({"x_rad": G.scan_angle(F.col("x"), gt[0], gt[1]), "y_rad": G.scan_angle(F.col("y"), gt[3], gt[5])}))
    # pixels on the disk as elements of a list: a filter on lat would be pushed below with all of its formula
    on_disk = F.filter(F.array(F.struct("lat", "lon")), lambda p: p["lat"].isNotNull())
    seen = G.view_angles(seen.select("grid_id", "proj", "y", "x", F.explode(on_disk).alias("p")).select("grid_id", "proj", "y", "x", "p.lat", "p.lon"))
    la, lo, vz, va = (F.col(c) * RAD for c in ("lat", "lon", "vza", "vaa"))
    made = {"sin_lat": F.sin(la), "cos_lat": F.cos(la), "sin_lon": F.sin(lo), "cos_lon": F.cos(lo), "view_up": F.cos(vz), "view_east": F.sin(vz) * F.sin(va), "view_north": F.sin(vz) * F.cos(va)}
    return tiles.placed(seen.withColumns(made), tile).select("grid_id", "tile", "cell", *COLUMNS)


def sun(scenes: DataFrame, time: str = "start_ts") -> DataFrame:
    """Adds the ephemeris and the sine and cosine of the hour angle's base to scene rows."""
    base = F.col("sun_ha") % (2 * math.pi)  # many turns: taken off as in geometry.sine_of_elevation
    return G.ephemeris(scenes, time).withColumns({"sin_ha": F.sin(base), "cos_ha": F.cos(base)})


def lit(df: DataFrame) -> DataFrame:
    """Adds sun_up, the cosine of the sun zenith with refraction and parallax, and scatter, the cosine of the
    scattering angle, to rows with COLUMNS and the columns of ``sun``; both NULL off the disk."""
    c = F.col
    out = df.withColumns({"_ch": c("cos_ha") * c("cos_lon") - c("sin_ha") * c("sin_lon"), "_sh": c("sin_ha") * c("cos_lon") + c("cos_ha") * c("sin_lon")})
    out = out.withColumns({"_se": c("sin_lat") * c("sun_sd") + c("cos_lat") * c("sun_cd") * c("_ch"), "_n": c("_ch") * c("sin_lat") - c("cos_lat") * c("sun_sd") / c("sun_cd")})
    out = out.withColumn("_ep", F.asin("_se") - 4.26e-5 * F.sqrt(1.0 - c("_se") * c("_se")))
    bend = F.when(c("_ep") > 0, 0.08422 / (273.0 * F.tan(c("_ep") + 0.003138 / (c("_ep") + 0.08919)))).otherwise(F.lit(0.0))
    out = out.withColumn("sun_up", F.sin(c("_ep") + bend))
    level = F.sqrt(c("_n") * c("_n") + c("_sh") * c("_sh"))
    along = F.when(level > 0, (c("_sh") * c("view_east") + c("_n") * c("view_north")) / level).otherwise(c("view_north"))
    return out.withColumn("scatter", F.sqrt(1.0 - c("sun_up") * c("sun_up")) * along - c("sun_up") * c("view_up")).drop("_ch", "_sh", "_se", "_n", "_ep")


def normalised(v: Column) -> Column:
    """As geometry.sun_normalise, by sun_up: v over it; 0 for missing pixels, night and twilight."""
    return F.when(v.isNotNull() & (F.col("sun_up") >= DUSK), v / F.when(F.col("sun_up") >= DUSK, F.col("sun_up"))).otherwise(F.lit(0.0))


def clear(df: DataFrame, wavelengths: dict[str, float]) -> DataFrame:
    """As geometry.rayleigh_bands, by sun_up, view_up and scatter of the row."""
    c = F.col
    good = F.coalesce((c("sun_up") >= 0.01) & (c("view_up") >= 0.01), F.lit(False))
    out = df.withColumns({"_ok": good, "_mm": c("sun_up") * c("view_up")})
    return out.withColumns({k: G.less_path(c(k), c("_ok"), c("_mm"), c("scatter"), w) for k, w in wavelengths.items()}).drop("_ok", "_mm")


def daylight(df: DataFrame) -> DataFrame:
    """The ``light`` of composite.truecolor for rows of stored geometry: b, r and n normalised, b and r cleared."""
    df = lit(df).withColumns({k: normalised(F.col(k)) for k in "brn"})
    return clear(df, {"b": 0.47, "r": 0.64})
