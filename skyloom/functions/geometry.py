"""Sun, satellite and navigation geometry as built-in expressions, in double precision.

Time-only quantities belong on the scene row; per-pixel expressions take them as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAD = math.pi / 180
#: WGS84 semi-major axis in metres and flattening.
WGS84 = (6378137.0, 1.0 / 298.257223563)


def scan_angle(position: Column, first_edge: Column, step: Column) -> Column:
    """Scan angle of a pixel's centre."""
    return first_edge + (position + F.lit(0.5)) * step


def navigate(df: DataFrame, wrap: bool = False) -> DataFrame:
    """Adds lat and lon to rows with x_rad, y_rad and proj; both NULL off the disk."""
    p = lambda c: F.col("proj")[c]
    out = df.withColumns({"_h": p("semi_major") + p("sat_height"), "_sx": F.sin("x_rad"), "_cx": F.cos("x_rad"), "_sy": F.sin("y_rad"), "_cy": F.cos("y_rad"), "_q": p("semi_major") * p("semi_major") / (p("semi_minor") * p("semi_minor"))})
    c = F.col
    out = out.withColumns({"_a": c("_sx") * c("_sx") + c("_cx") * c("_cx") * (c("_cy") * c("_cy") + c("_q") * c("_sy") * c("_sy")), "_b": -2.0 * c("_h") * c("_cx") * c("_cy")})
    out = out.withColumn("_disc", c("_b") * c("_b") - 4.0 * c("_a") * (c("_h") * c("_h") - p("semi_major") * p("semi_major")))
    out = out.withColumn("_rs", F.when(c("_disc") >= 0, (-c("_b") - F.sqrt(F.greatest(c("_disc"), F.lit(0.0)))) / (2.0 * c("_a"))))
    out = out.withColumns({"_px": c("_rs") * c("_cx") * c("_cy"), "_py": -c("_rs") * c("_sx")})
    # in this order of operations and with degrees(), every bit is that of the plain SQL: where two pixels are
    # equally far from a place but for rounding, the last bit decides which is nearest
    lat = F.degrees(F.atan2(c("_q") * c("_rs") * c("_cx") * c("_sy"), F.sqrt((c("_h") - c("_px")) * (c("_h") - c("_px")) + c("_rs") * c("_sx") * c("_rs") * c("_sx"))))
    lon = F.degrees(F.radians(p("lon_origin")) - F.atan2(c("_py"), c("_h") - c("_px")))
    if wrap:
        lon = F.pmod(lon + 180, F.lit(360.0)) - 180
    return out.withColumns({"lat": lat, "lon": lon}).drop(*[x for x in out.columns if x.startswith("_")])


def plain_grid(df: DataFrame, height: int, width: int, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Adds lat and lon to rows with y and x of a grid whose first and last rows and columns lie on the bounds."""
    down, right = F.col("y") / F.lit(float(height - 1)), F.col("x") / F.lit(float(width - 1))
    return df.withColumns({"lat": lat_max - down * (lat_max - lat_min), "lon": lon_min + right * (lon_max - lon_min)})


def ephemeris(df: DataFrame, time: str = "start_ts") -> DataFrame:
    """Adds sun_sd, sun_cd (sine and cosine of declination) and sun_ha (hour angle base) to scene rows."""
    t0 = F.col(time)
    year, month = F.year(t0), F.month(t0)
    early = month <= 2
    yt, mt = F.when(early, year - 1).otherwise(year), F.when(early, month + 12).otherwise(month)
    hours = F.hour(t0) + F.minute(t0) / F.lit(60.0) + F.floor(F.second(t0)) / F.lit(3600.0)
    days = (F.lit(365.25) * (yt - 2000)).cast("int") + (F.lit(30.6001) * (mt + 1)).cast("int") - (F.lit(0.01) * yt).cast("int") + F.dayofmonth(t0)
    c = F.col
    out = df.withColumn("_t", days + F.lit(0.0416667) * hours - 21958.0)
    out = out.withColumn("_te", c("_t") + 1.1574e-5 * (96.4 + 0.00158 * c("_t")))
    out = out.withColumns({"_s1": F.sin(0.0172019715 * c("_te")), "_c1": F.cos(0.0172019715 * c("_te"))})
    out = out.withColumns({"_s2": 2.0 * c("_s1") * c("_c1"), "_c2": (c("_c1") + c("_s1")) * (c("_c1") - c("_s1"))})
    out = out.withColumns({"_s3": c("_s2") * c("_c1") + c("_c2") * c("_s1"), "_c3": c("_c2") * c("_c1") - c("_s2") * c("_s1")})
    #: Amplitude, rate and phase of the periodic terms of the solar longitude.
    waves = ((1.27e-5, 1.49e-3, -2.337), (1.21e-5, 4.31e-3, 3.065), (2.33e-5, 1.076e-2, -1.533), (3.49e-5, 1.575e-2, -2.358), (2.67e-5, 2.152e-2, 0.074), (1.28e-5, 3.152e-2, 1.547), (3.14e-5, 2.1277e-1, -0.488))
    long = 1.7527901 + 1.7202792159e-2 * c("_te") + 3.33024e-2 * c("_s1") - 2.0582e-3 * c("_c1") + 3.512e-4 * c("_s2") - 4.07e-5 * c("_c2") + 5.2e-6 * c("_s3") - 9e-7 * c("_c3") - 8.23e-5 * c("_s1") * F.sin(2.92e-5 * c("_te"))
    for a, w, p in waves:
        long = long + a * F.sin(w * c("_te") + p)
    out = out.withColumns({"_long": long, "_nu": 9.282e-4 * c("_te") - 0.8})
    out = out.withColumn("_dl", 8.34e-5 * F.sin("_nu"))
    out = out.withColumns({"_lam": c("_long") + math.pi + c("_dl"), "_se": F.sin(4.089567e-1 - 6.19e-9 * c("_te") + 4.46e-5 * F.cos("_nu"))})
    ra = F.atan2(F.sin("_lam") * F.sqrt(1 - c("_se") * c("_se")), F.cos("_lam"))
    out = out.withColumn("_ra", F.when(ra < 0, ra + 2 * math.pi).otherwise(ra))
    out = out.withColumn("sun_sd", F.sin("_lam") * c("_se"))
    out = out.withColumns({"sun_cd": F.sqrt(1 - c("sun_sd") * c("sun_sd")), "sun_ha": 1.7528311 + 6.300388099 * c("_t") - c("_ra") + 0.92 * c("_dl")})
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def sine_of_elevation(df: DataFrame, out: str = "sin_elevation") -> DataFrame:
    """Adds the sine of the sun's elevation, without refraction, to rows with lat, lon and the ephemeris."""
    c = F.col
    turn = (c("sun_ha") + c("lon") * RAD + math.pi) % (2 * math.pi) - math.pi
    df = df.withColumns({"_h": F.when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn), "_sp": F.sin(c("lat") * RAD)})
    df = df.withColumn("_cp", F.sqrt(1 - c("_sp") * c("_sp")))
    return df.withColumn(out, c("_sp") * c("sun_sd") + c("_cp") * c("sun_cd") * F.cos("_h"))


def sun_angles(df: DataFrame) -> DataFrame:
    """Adds sza and saa in degrees, with refraction and parallax."""
    c = F.col
    df = sine_of_elevation(df, "_se0")
    df = df.withColumn("_ep", F.asin("_se0") - 4.26e-5 * F.sqrt(1.0 - c("_se0") * c("_se0")))
    bend = F.when(c("_ep") > 0, 0.08422 / (273.0 * F.tan(c("_ep") + 0.003138 / (c("_ep") + 0.08919)))).otherwise(F.lit(0.0))
    sza = (math.pi / 2 - c("_ep") - bend) / RAD
    saa = F.atan2(F.sin("_h"), F.cos("_h") * c("_sp") - c("sun_sd") * c("_cp") / c("sun_cd")) / RAD
    out = df.withColumns({"sza": F.when(c("lat").isNotNull(), sza), "saa": F.when(c("lat").isNotNull(), saa)})
    return out.drop("_se0", "_ep", "_h", "_sp", "_cp")


def view_angles(df: DataFrame) -> DataFrame:
    """Adds vza and vaa in degrees; vaa is the bearing of the line from satellite to pixel."""
    a, f = WGS84
    e2 = 2.0 * f - f * f
    c = F.col
    df = df.withColumns({"_la": c("lat") * RAD, "_lo": c("lon") * RAD, "_sl": F.col("proj")["lon_origin"] * RAD, "_r": F.lit(a) + F.col("proj")["sat_height"]})
    df = df.withColumn("_n", a / F.sqrt(1.0 - e2 * F.sin("_la") * F.sin("_la")))
    df = df.withColumns({"_x": c("_n") * F.cos("_la") * F.cos("_lo"), "_y": c("_n") * F.cos("_la") * F.sin("_lo"), "_z": c("_n") * (1.0 - e2) * F.sin("_la")})
    df = df.withColumns({"_dx": c("_x") - c("_r") * F.cos("_sl"), "_dy": c("_y") - c("_r") * F.sin("_sl"), "_dz": c("_z")})
    df = df.withColumns({"_d": F.sqrt(c("_dx") * c("_dx") + c("_dy") * c("_dy") + c("_dz") * c("_dz")), "_l": F.sqrt(c("_x") * c("_x") + c("_y") * c("_y") + c("_z") * c("_z"))})
    cosine = -(c("_dx") * c("_x") + c("_dy") * c("_y") + c("_dz") * c("_z")) / (c("_d") * c("_l"))
    east = (-c("_dx") * F.sin("_lo") + c("_dy") * F.cos("_lo")) / c("_d")
    north = (-c("_dx") * F.sin("_la") * F.cos("_lo") - c("_dy") * F.sin("_la") * F.sin("_lo") + c("_dz") * F.cos("_la")) / c("_d")
    out = df.withColumns({"vza": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / RAD, "vaa": F.atan2(east, north) / RAD})
    out = out.withColumns({k: F.when(c("lat").isNotNull(), c(k)) for k in ("vza", "vaa")})
    return out.drop("_la", "_lo", "_sl", "_r", "_n", "_x", "_y", "_z", "_dx", "_dy", "_dz", "_d", "_l")


def relative_azimuth(saa: Column, vaa: Column) -> Column:
    d = F.abs(saa - vaa)
    return F.when(d > 180, 360 - d).otherwise(d)


def sun_normalise(v: Column, sza: Column) -> Column:
    """v over the cosine of the sun zenith; 0 for missing pixels, night and twilight."""
    mu = F.cos(sza * RAD)
    return F.when(v.isNotNull() & (sza <= 85) & (mu > 0.087), v / F.when(mu > 0.087, mu)).otherwise(F.lit(0.0))


def rayleigh_tau(wavelength_um: float) -> float:
    """Optical depth of a standard atmosphere."""
    l2 = wavelength_um**2
    return 0.008569 / (l2 * l2) * (1 + 0.0113 / l2 + 0.00013 / (l2 * l2))


def rayleigh_analytic(v: Column, sza: Column, vza: Column, raa: Column, wavelength_um: float) -> Column:
    """v less single-scattering path reflectance; unchanged without geometry or near grazing angles."""
    ms, mv = F.cos(sza * RAD), F.cos(vza * RAD)
    scatter = -ms * mv + F.sin(sza * RAD) * F.sin(vza * RAD) * F.cos(raa * RAD)
    good = F.coalesce((ms >= 0.01) & (mv >= 0.01) & raa.isNotNull(), F.lit(False))
    return less_path(v, good, ms * mv, scatter, wavelength_um)


def less_path(v: Column, good: Column, cosines: Column, scatter: Column, wavelength_um: float) -> Column:
    """v less path reflectance by the product and the scattering cosine of both zeniths, where ``good``."""
    g = 0.0279 / (2.0 - 0.0279)
    a, b, c = 0.75 / (1 + 2 * g), 1 + 3 * g, 1 - g
    corrected = v - F.lit(rayleigh_tau(wavelength_um)) * (a * (b + c * scatter * scatter)) / (4.0 * F.when(good, cosines))
    return F.when(~good, v).otherwise(F.when(corrected < 0, F.lit(0.0001)).otherwise(corrected))


def rayleigh_bands(df: DataFrame, wavelengths: dict[str, float]) -> DataFrame:
    """``rayleigh_analytic`` of several columns of rows with sza, vza and raa: the geometry is computed once."""
    c = F.col
    out = df.withColumns({"_ms": F.cos(c("sza") * RAD), "_mv": F.cos(c("vza") * RAD), "_ss": F.sin(c("sza") * RAD) * F.sin(c("vza") * RAD) * F.cos(c("raa") * RAD)})
    out = out.withColumns({"_mm": c("_ms") * c("_mv"), "_ok": F.coalesce((c("_ms") >= 0.01) & (c("_mv") >= 0.01) & c("raa").isNotNull(), F.lit(False))})
    out = out.withColumn("_sc", c("_ss") - c("_mm"))
    return out.withColumns({k: less_path(c(k), c("_ok"), c("_mm"), c("_sc"), w) for k, w in wavelengths.items()}).drop("_ms", "_mv", "_ss", "_mm", "_ok", "_sc")
