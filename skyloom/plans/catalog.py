"""Registered queries of the raster engine and their DuckDB SQL.

Pixels come from lineitem, scene times from events, file names from orders (see sources.grids); the
SQL derives the same tables for itself and states each operator on its own.  Doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pixelwise as P
from ..operators import algebra, align, atlas, atmosphere, composite, enhance, measure, names, palette, products, spatial
from ..sources import grids, store, tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BANDS = list(range(1, 17))
KEYS = list(align.KEYS)


def query(name: str, sql: str = "") -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in columns]


# --- the derived tables, in Spark and in SQL

RAW = """WITH raw AS (SELECT 's' || CAST(l_suppkey % 2 AS VARCHAR) AS scene_id, CAST(l_partkey % 16 + 1 AS INT) AS band, CAST((l_orderkey % 1024) // 32 AS INT) AS y, CAST(l_orderkey % 32 AS INT) AS x,
 CASE WHEN sum(l_partkey * 37 + CAST(l_quantity AS BIGINT) * 53) % 4095 >= 4000 THEN -1 ELSE CAST(sum(l_partkey * 37 + CAST(l_quantity AS BIGINT) * 53) % 4095 AS INT) END AS raw
 FROM lineitem GROUP BY 1, 2, 3, 4)"""
PX = RAW + """, px AS (SELECT scene_id, band, y, x, CASE WHEN raw = -1 THEN NULL WHEN band >= 7 THEN raw * 0.035::DOUBLE + 180 ELSE raw * (1.0::DOUBLE / 4000) END AS value FROM raw)"""
WIDE = PX + ", w AS (SELECT scene_id, y, x, " + ", ".join(f"max(CASE WHEN band = {b} THEN value END) AS c{b:02d}" for b in BANDS) + " FROM px GROUP BY ALL)"
TIMES = """st AS (SELECT 's' || CAST(user_id % 2 AS VARCHAR) AS scene_id, date_trunc('second', min(ts)) + to_hours(CAST(13 + 9 * (user_id % 2) AS INT)) AS t FROM events GROUP BY user_id % 2)"""
NAV = """n0 AS (SELECT w.*, -0.16::DOUBLE + (x + 0.5::DOUBLE) * 0.01::DOUBLE AS xr, 0.16::DOUBLE - (y + 0.5::DOUBLE) * 0.01::DOUBLE AS yr, 42164160.0::DOUBLE AS h, 6378137.0::DOUBLE * 6378137.0::DOUBLE / (6356752.31414::DOUBLE * 6356752.31414::DOUBLE) AS q FROM w),
 n1 AS (SELECT *, sin(xr) * sin(xr) + cos(xr) * cos(xr) * (cos(yr) * cos(yr) + q * sin(yr) * sin(yr)) AS a, -2 * h * cos(xr) * cos(yr) AS b FROM n0),
 n2 AS (SELECT *, b * b - 4 * a * (h * h - 6378137.0::DOUBLE * 6378137.0::DOUBLE) AS disc FROM n1),
 n3 AS (SELECT *, CASE WHEN disc >= 0 THEN (-b - sqrt(greatest(disc, 0))) / (2 * a) END AS rs FROM n2),
 nav AS (SELECT *, degrees(atan2(q * rs * cos(xr) * sin(yr), sqrt((h - rs * cos(xr) * cos(yr)) * (h - rs * cos(xr) * cos(yr)) + rs * sin(xr) * rs * sin(xr)))) AS lat,
   degrees(radians(-75.0::DOUBLE) - atan2(-rs * sin(xr), h - rs * cos(xr) * cos(yr))) AS lon FROM n3)"""
EPH = TIMES + """, e0 AS (SELECT *, CASE WHEN month(t) <= 2 THEN year(t) - 1 ELSE year(t) END AS yt, CASE WHEN month(t) <= 2 THEN month(t) + 12 ELSE month(t) END AS mt,
   hour(t) + minute(t) / 60.0::DOUBLE + second(t) / 3600.0::DOUBLE AS ut FROM st),
 e1 AS (SELECT *, trunc(365.25::DOUBLE * (yt - 2000)) + trunc(30.6001::DOUBLE * (mt + 1)) - trunc(0.01::DOUBLE * yt) + day(t) + 0.0416667::DOUBLE * ut - 21958 AS d FROM e0),
 e2 AS (SELECT *, d + 1.1574e-5 * (96.4 + 0.00158 * d) AS te FROM e1),
 e3 AS (SELECT *, sin(0.0172019715 * te) AS s1, cos(0.0172019715 * te) AS c1, 9.282e-4 * te - 0.8 AS nu FROM e2),
 e4 AS (SELECT *, 1.7527901 + 1.7202792159e-2 * te + 3.33024e-2 * s1 - 2.0582e-3 * c1 + 3.512e-4 * (2 * s1 * c1) - 4.07e-5 * (c1 * c1 - s1 * s1)
   + 5.2e-6 * (2 * s1 * c1 * c1 + (c1 * c1 - s1 * s1) * s1) - 9e-7 * ((c1 * c1 - s1 * s1) * c1 - 2 * s1 * c1 * s1) - 8.23e-5 * s1 * sin(2.92e-5 * te)
   + 1.27e-5 * sin(1.49e-3 * te - 2.337) + 1.21e-5 * sin(4.31e-3 * te + 3.065) + 2.33e-5 * sin(1.076e-2 * te - 1.533) + 3.49e-5 * sin(1.575e-2 * te - 2.358)
   + 2.67e-5 * sin(2.152e-2 * te + 0.074) + 1.28e-5 * sin(3.152e-2 * te + 1.547) + 3.14e-5 * sin(2.1277e-1 * te - 0.488) + pi() + 8.34e-5 * sin(nu) AS lam,
   sin(4.089567e-1 - 6.19e-9 * te + 4.46e-5 * cos(nu)) AS se FROM e3),
 eph AS (SELECT scene_id, t, sin(lam) * se AS sd, sqrt(1 - sin(lam) * se * sin(lam) * se) AS cd,
   1.7528311 + 6.300388099 * d - (CASE WHEN atan2(sin(lam) * sqrt(1 - se * se), cos(lam)) < 0 THEN 2 * pi() ELSE 0 END + atan2(sin(lam) * sqrt(1 - se * se), cos(lam))) + 0.92 * 8.34e-5 * sin(nu) AS ha FROM e4)"""
SUN = NAV + ", " + EPH + """, s0 AS (SELECT nav.*, sd, cd, (ha + radians(lon) + pi()) % (2 * pi()) - pi() AS hh, sin(radians(lat)) AS sp FROM nav JOIN eph USING (scene_id)),
 s1 AS (SELECT * EXCLUDE (hh), CASE WHEN hh < -pi() THEN hh + 2 * pi() ELSE hh END AS hh, sqrt(1 - sp * sp) AS cp FROM s0),
 s2 AS (SELECT *, sp * sd + cp * cd * cos(hh) AS se0 FROM s1),
 s3 AS (SELECT *, asin(se0) - 4.26e-5 * sqrt(1 - se0 * se0) AS ep FROM s2),
 sun AS (SELECT *, degrees(pi() / 2 - ep - CASE WHEN ep > 0 THEN 0.08422 / (273 * tan(ep + 0.003138 / (ep + 0.08919))) ELSE 0 END) AS sza,
   degrees(atan2(sin(hh), cos(hh) * sp - sd * cp / cd)) AS saa FROM s3)"""
VIEW = SUN + """, v0 AS (SELECT *, radians(lat) AS la, radians(lon) AS lo, 2.0 / 298.257223563::DOUBLE - (1 / 298.257223563::DOUBLE) * (1 / 298.257223563::DOUBLE) AS e2 FROM sun),
 v1 AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(la) * sin(la)) AS nn FROM v0),
 v2 AS (SELECT *, nn * cos(la) * cos(lo) AS pxx, nn * cos(la) * sin(lo) AS pyy, nn * (1 - e2) * sin(la) AS pzz FROM v1),
 v3 AS (SELECT *, pxx - 42164160.0::DOUBLE * cos(radians(-75.0::DOUBLE)) AS dx, pyy - 42164160.0::DOUBLE * sin(radians(-75.0::DOUBLE)) AS dy FROM v2),
 v4 AS (SELECT *, sqrt(dx * dx + dy * dy + pzz * pzz) AS dd FROM v3),
 v5 AS (SELECT *, CASE WHEN lat IS NOT NULL THEN degrees(acos(greatest(-1, least(1, -(dx * pxx + dy * pyy + pzz * pzz) / (dd * sqrt(pxx * pxx + pyy * pyy + pzz * pzz)))))) END AS vza,
   degrees(atan2((-dx * sin(lo) + dy * cos(lo)) / dd, (-dx * sin(la) * cos(lo) - dy * sin(la) * sin(lo) + pzz * cos(la)) / dd)) AS vaa FROM v4),
 geo AS (SELECT *, CASE WHEN abs(saa - vaa) > 180 THEN 360 - abs(saa - vaa) ELSE abs(saa - vaa) END AS raa FROM v5)"""
NAMES = """WITH f AS (SELECT 'OR_ABI-' || replace(['L2-CMIPC-M6C#', 'L1b-RadF-M3C#', 'L2-ACHAF-M6', 'L2-ACTPC-M6', 'L2-CMIPM1-M6C#', 'L1b-RadM2-M4C#', 'L2-LSTF-M3', 'L2-XYZC-'][o_orderkey % 8 + 1], '#', lpad(CAST(o_orderkey % 16 + 1 AS VARCHAR), 2, '0'))
 || ['_G16', '_G17', '_G18', '_G19', '-GOES18'][o_orderkey % 5 + 1] || CASE WHEN o_orderkey % 11 = 0 THEN '_nostamp' ELSE '_s' || strftime(o_orderdate, '%Y%j') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 599 AS VARCHAR), 3, '0') || '_e1_c2' END || '.nc' AS name FROM orders)"""


def pixels(spark: SparkSession, sf: str, bands: list[int] | None = None) -> DataFrame:
    """Unpacked pixels: counts joined with their band's attributes (a row a band, broadcast)."""
    raw = grids.raw(spark, sf, bands)
    attrs = F.broadcast(grids.band_attributes(raw).select("scene_id", "band", "scale", "offset", "fill"))
    joined = raw.join(attrs, ["scene_id", "band"])
    return joined.select("scene_id", "band", "y", "x", P.unpack(F.col("raw"), F.col("scale"), F.col("offset"), F.col("fill")).alias("value"))


def wide(spark: SparkSession, sf: str, bands: list[int]) -> DataFrame:
    return align.to_wide(pixels(spark, sf, bands), bands)


def every(spark: SparkSession, sf: str) -> DataFrame:
    return wide(spark, sf, BANDS)


def navigated(spark: SparkSession, sf: str, bands: list[int] | None = None) -> DataFrame:
    """Wide rows with lat and lon; all cells that any band fills, so that grids agree."""
    df = every(spark, sf)
    df = df.select(*KEYS, *[align.band_column(b) for b in (bands or [13])])
    proj = F.struct(*[F.lit(v).alias(k) for k, v in grids.PROJ.items()])
    df = df.withColumns({"x_rad": G.scan_angle(F.col("x"), F.lit(grids.X0), F.lit(grids.DX)), "y_rad": G.scan_angle(F.col("y"), F.lit(grids.Y0), F.lit(grids.DY)), "proj": proj})
    return G.navigate(df)


def with_sun(spark: SparkSession, sf: str, bands: list[int] | None = None) -> DataFrame:
    scenes = F.broadcast(G.ephemeris(grids.scene_times(spark, sf)))  # one row a scene
    return navigated(spark, sf, bands).join(scenes, "scene_id")


def with_angles(spark: SparkSession, sf: str, bands: list[int] | None = None) -> DataFrame:
    df = G.view_angles(G.sun_angles(with_sun(spark, sf, bands)))
    return df.withColumn("raa", G.relative_azimuth(F.col("saa"), F.col("vaa")))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return names.parse_names(grids.file_names(spark, sf))


# --- catalog

_SAT = """CASE WHEN regexp_matches(regexp_extract(name, '^.*?(_G(?:16|17|18|19)?)', 1), '^_G1') THEN substr(regexp_extract(name, '^.*?(_G(?:16|17|18|19)?)', 1), 2)
 WHEN contains(name, 'G16') OR contains(name, 'GOES16') OR contains(name, 'GOES-16') THEN 'G16' WHEN contains(name, 'G18') OR contains(name, 'GOES18') OR contains(name, 'GOES-18') THEN 'G18'
 WHEN contains(name, 'G17') OR contains(name, 'GOES17') OR contains(name, 'GOES-17') THEN 'G17' WHEN contains(name, 'G19') OR contains(name, 'GOES19') OR contains(name, 'GOES-19') THEN 'G19' ELSE 'unknown' END"""
_SEC = """CASE WHEN contains(name, 'RadM1') OR contains(name, 'CMIPM1') THEN 'm1' WHEN contains(name, 'RadM2') OR contains(name, 'CMIPM2') THEN 'm2'
 WHEN contains(name, 'RadC-') OR contains(name, 'CMIPC-') THEN 'conus' WHEN contains(name, 'RadF-') OR contains(name, 'CMIPF-') THEN 'fd' ELSE 'unknown' END"""
_VAR = """CASE WHEN contains(name, 'L1b') THEN 'Rad' WHEN contains(name, 'CMIP') THEN 'CMI' WHEN contains(name, 'ACHA') THEN 'HT' WHEN contains(name, 'ACHT') THEN 'TEMP' WHEN contains(name, 'ACTP') THEN 'Phase'
 WHEN contains(name, 'CTP') THEN 'PRES' WHEN contains(name, 'LST') THEN 'LST' WHEN contains(name, 'SST') THEN 'SST' WHEN contains(name, 'AOD') THEN 'AOD' END"""
PARSED = NAMES + f""", p0 AS (SELECT name, {_SAT} AS satellite, {_SEC} AS sector, {_VAR} AS variable, nullif(regexp_extract(name, '_s(\\d{{13,14}})', 1), '') AS stamp FROM f),
 p AS (SELECT *, CASE WHEN variable IS NULL THEN NULL WHEN variable = 'Rad' THEN 'L1b' ELSE 'L2' END AS level, contains(name, 'CMIP') AS is_l2_image, 's' || substr(stamp, 1, 10) AS token,
   coalesce(nullif(regexp_extract(name, '-(M[0-9])C', 1), ''), 'M6') AS scan_mode, 'C' || coalesce(nullif(regexp_extract(name, 'M[36]C(\\d\\d)', 1), ''), '00') AS channel,
   CASE WHEN stamp IS NOT NULL THEN strptime(substr(stamp, 1, 11), '%Y%j%H%M') END AS start_ts FROM p0)"""


@query("a1_satellite", f"{NAMES} SELECT name, {_SAT} AS satellite FROM f")
def a1(spark, sf):
    return grids.file_names(spark, sf).select("name", names.satellite(F.col("name")).alias("satellite"))


@query("a2_sector", f"{NAMES} SELECT name, {_SEC} AS sector FROM f")
def a2(spark, sf):
    return grids.file_names(spark, sf).select("name", names.sector(F.col("name")).alias("sector"))


@query("a3_variable_level", f"{PARSED} SELECT name, variable, level FROM p")
def a3(spark, sf):
    return parsed(spark, sf).select("name", "variable", "level")


@query("a4_a5_a6_a8_name_fields", f"{PARSED} SELECT name, token, scan_mode, channel, is_l2_image, strftime(start_ts, '%Y-%m-%d %H:%M') AS started FROM p")
def a4(spark, sf):
    return parsed(spark, sf).select("name", "token", "scan_mode", "channel", "is_l2_image", F.date_format("start_ts", "yyyy-MM-dd HH:mm").alias("started"))


def _siblings_sql(keys: str) -> str:
    return f"""{PARSED}, k AS (SELECT *, CASE WHEN is_l2_image THEN 'L2-CMI' WHEN level = 'L1b' THEN 'L1b-Rad' END AS product FROM p WHERE stamp IS NOT NULL),
 g AS (SELECT product, {keys}, CAST(substr(channel, 2, 2) AS INT) AS band, max(name) AS path FROM k GROUP BY ALL),
 b AS (SELECT unnest([1, 9, 13]) AS band),
 j AS (SELECT DISTINCT k.name AS anchor, b.band, g.path FROM k CROSS JOIN b LEFT JOIN g ON k.product = g.product AND b.band = g.band AND {' AND '.join(f'k.{c.strip()} = g.{c.strip()}' for c in keys.split(','))} WHERE k.product IS NOT NULL)
 SELECT anchor, band, path, count(path) OVER (PARTITION BY anchor) = 3 AS complete FROM j"""


def _siblings(spark, sf, compat):
    cat = parsed(spark, sf)
    return names.siblings(cat, cat, [1, 9, 13], compat)


@query("a7_siblings", _siblings_sql("scan_mode, stamp, satellite, sector"))
def a7(spark, sf):
    return _siblings(spark, sf, False)


@query("a7_siblings_compat", _siblings_sql("scan_mode, token"))
def a7c(spark, sf):
    return _siblings(spark, sf, True)


CLIPS_SQL = """cl AS (SELECT 'k' || CAST(s_suppkey AS VARCHAR) AS key, s_name AS region, -130.0::DOUBLE + s_suppkey % 40 AS ul_x, CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE 40.0::DOUBLE - s_suppkey % 20 END AS ul_y,
 -110.0::DOUBLE + s_suppkey % 70 AS lr_x, -10.0::DOUBLE - s_suppkey % 15 AS lr_y FROM supplier)"""


def clips(spark, sf):
    k = F.col("s_suppkey")
    return grids.table(spark, sf, "supplier").select(
        F.concat(F.lit("k"), k.cast("string")).alias("key"), F.col("s_name").alias("region"), (F.lit(-130.0) + k % 40).alias("ul_x"), F.when(k % 7 != 3, F.lit(40.0) - k % 20).alias("ul_y"),
        (F.lit(-110.0) + k % 70).alias("lr_x"), (F.lit(-10.0) - k % 15).alias("lr_y"),
    )


@query("a9_a10_clip_list", f"WITH {CLIPS_SQL} SELECT *, ul_x IS NOT NULL AND ul_y IS NOT NULL AND lr_x IS NOT NULL AND lr_y IS NOT NULL AS usable FROM cl")
def a10(spark, sf):
    return names.list_clips(clips(spark, sf))


_CSV = """csv AS (SELECT CAST(s_suppkey AS BIGINT) AS n, 'k' || CAST(s_suppkey % 37 AS VARCHAR) AS key, CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE 'r' || CAST(s_suppkey AS VARCHAR) END AS region,
 s_suppkey % 40 - 130.5::DOUBLE AS a, 40.25::DOUBLE - s_suppkey % 20 AS b, CASE WHEN s_suppkey % 7 <> 3 THEN s_suppkey % 70 - 110.0::DOUBLE END AS c, -10.0::DOUBLE - s_suppkey % 15 AS d FROM supplier)"""


def clip_csv(spark, sf):
    """Lines of a clip file with a header that suppliers stand for; keys repeat, some fields are empty or no numbers."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    fields = [F.concat(F.lit("k"), text(k % 37)), F.when(k % 9 == 4, F.lit("")).otherwise(F.concat(F.lit("r"), text(k))), text(k % 40 - F.lit(130.5)), text(F.lit(40.25) - k % 20), F.when(k % 7 != 3, text(k % 70 - F.lit(110.0))).otherwise(F.lit("x")), text(F.lit(-10.0) - k % 15)]
    suppliers = grids.table(spark, sf, "supplier")
    head = suppliers.agg(F.lit(0).cast("long").alias("n"), F.lit("clave,region,ul_x,ul_y,lr_x,lr_y").alias("line"))
    return head.unionByName(suppliers.select(k.cast("long").alias("n"), F.concat_ws(",", *fields).alias("line")))


@query("a9_clip_by_key", f"""WITH {_CSV}, f AS (SELECT key, arg_min(struct_pack(n, region, a, b, c, d), n) AS v FROM csv GROUP BY key), q AS (SELECT DISTINCT 'k' || CAST(c_nationkey * 2 AS VARCHAR) AS key FROM customer)
 SELECT q.key, v IS NOT NULL AS found, CASE WHEN v.region IS NULL THEN printf('%.1f', v.a) ELSE v.region END AS region, CASE WHEN v.region IS NULL THEN v.b ELSE v.a END AS ul_x,
  CASE WHEN v.region IS NULL THEN coalesce(v.c, v.b - v.b) ELSE v.b END AS ul_y, CASE WHEN v.region IS NULL THEN v.d ELSE coalesce(v.c, v.b - v.b) END AS lr_x, CASE WHEN v.region IS NULL THEN v.d - v.d ELSE v.d END AS lr_y
 FROM q LEFT JOIN f USING (key)""")
def a9(spark, sf):
    keys = grids.table(spark, sf, "customer").select(F.concat(F.lit("k"), (F.col("c_nationkey") * 2).cast("string")).alias("key")).distinct()
    return names.find_clips(clip_csv(spark, sf), keys)


@query("a22_product_type", """WITH c AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'gray' WHEN 1 THEN 'pseudocolor' WHEN 2 THEN 'info' WHEN 3 THEN '' ELSE 'rgb' END AS command, CASE o_orderkey % 6 WHEN 0 THEN 'ash' WHEN 1 THEN 'truecolor' WHEN 2 THEN 'composite' WHEN 3 THEN '' WHEN 4 THEN 'night' END AS mode FROM orders)
 SELECT o_orderkey, CASE WHEN command = 'pseudocolor' THEN 'pseudo' WHEN command = '' THEN 'output' WHEN command <> 'rgb' THEN command WHEN mode IN ('ash', 'night') THEN mode ELSE 'rgb' END AS type FROM c""")
def a22_type(spark, sf):
    k = F.col("o_orderkey")
    command = F.when(k % 5 == 0, "gray").when(k % 5 == 1, "pseudocolor").when(k % 5 == 2, "info").when(k % 5 == 3, "").otherwise("rgb")
    mode = F.when(k % 6 == 0, "ash").when(k % 6 == 1, "truecolor").when(k % 6 == 2, "composite").when(k % 6 == 3, "").when(k % 6 == 4, "night")
    return grids.table(spark, sf, "orders").select("o_orderkey", names.product_type(command, mode).alias("type"))


_LINE = """lines AS (SELECT 'f' || CAST(p_partkey // 8 AS VARCHAR) AS file, CAST(p_partkey % 8 AS INT) AS n, CASE WHEN p_partkey % 8 = 0 THEN '# UNIT = K kelvin' WHEN p_partkey % 8 = 7 THEN 'N 1 2 ' || CAST(p_size AS VARCHAR)
 WHEN (p_partkey // 8) % 2 = 0 THEN CAST(p_partkey % 8 AS VARCHAR) || ' ' || CAST(p_partkey % 256 AS VARCHAR) || ' ' || CAST(p_size AS VARCHAR) || ' 9 ; label'
 ELSE CAST(p_partkey % 8 AS VARCHAR) || ' 10 20 ' || CAST(p_size AS VARCHAR) || ' ' || CAST(p_partkey % 8 + 1 AS VARCHAR) || ' 30 40 50' END AS line FROM part)"""


def colour_lines(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = lambda c: c.cast("string")
    line = (
        F.when(k % 8 == 0, "# UNIT = K kelvin").when(k % 8 == 7, F.concat(F.lit("N 1 2 "), size))
        .when(F.expr("(p_partkey div 8) % 2") == 0, F.concat(text(k % 8), F.lit(" "), text(k % 256), F.lit(" "), size, F.lit(" 9 ; label")))
        .otherwise(F.concat(text(k % 8), F.lit(" 10 20 "), size, F.lit(" "), text(k % 8 + 1), F.lit(" 30 40 50")))
    )
    return grids.table(spark, sf, "part").select(F.concat(F.lit("f"), F.expr("cast(p_partkey div 8 as string)")).alias("file"), (k % 8).cast("int").alias("n"), line.alias("line"))


@query("a11_palette_lines", f"""WITH {_LINE}, k AS (SELECT *, CASE WHEN line LIKE '#%' THEN 'unit' WHEN line LIKE 'N %' THEN 'N' WHEN line LIKE '%label' THEN 'discrete' ELSE 'continuous' END AS kind, string_split(line, ' ') AS p FROM lines)
 SELECT file, n, kind, CASE WHEN kind IN ('discrete', 'continuous') THEN CAST(p[1] AS DOUBLE) END AS lo, CASE WHEN kind = 'continuous' THEN CAST(p[5] AS DOUBLE) END AS hi,
  {', '.join(f"CASE WHEN kind <> 'unit' THEN CAST(p[{k}] AS INT) END AS {c}" for k, c in ((2, 'r'), (3, 'g'), (4, 'b')))}, {', '.join(f"CASE WHEN kind = 'continuous' THEN CAST(p[{k}] AS INT) END AS {c}" for k, c in ((6, 'r1'), (7, 'g1'), (8, 'b1')))},
  CASE WHEN kind = 'unit' THEN 'K' END AS unit FROM k""")
def a11(spark, sf):
    return palette.parse_lines(colour_lines(spark, sf))


@query("a11_h4_palette_meta", f"""WITH {_LINE}, c AS (SELECT file, n, line LIKE '%label' AS disc, CAST(split_part(line, ' ', 1) AS DOUBLE) AS lo, CASE WHEN line NOT LIKE '%label' THEN CAST(split_part(line, ' ', 5) AS DOUBLE) END AS hi FROM lines WHERE n BETWEEN 1 AND 6),
 v AS (SELECT *, CASE WHEN disc THEN coalesce(lead(lo) OVER (PARTITION BY file ORDER BY n), lo) ELSE lo END AS value FROM c),
 m AS (SELECT file, arg_max(disc, n) AS discrete, count(*) AS n_entries, arg_min(value, n) AS vmin, arg_max(coalesce(hi, value), n) AS vmax FROM v GROUP BY file)
 SELECT m.*, u.unit FROM m LEFT JOIN (SELECT file, 'K' AS unit FROM lines WHERE n = 0) u USING (file)""")
def a11m(spark, sf):
    return palette.palette_meta(palette.parse_lines(colour_lines(spark, sf)))


def palette_lines(spark, sf):
    """Lines of colour files with F, B and N that parts stand for."""
    k, f, size = F.col("p_partkey"), F.expr("p_partkey div 10"), F.col("p_size").cast("string")
    text = lambda c: c.cast("string")
    n = k % 10
    colour = F.when(f % 2 == 0, F.concat(text(n), F.lit(" "), text(k % 256), F.lit("/"), size, F.lit("/9 ; label"))).otherwise(F.concat(text(n), F.lit(" 10/20/"), size, F.lit(" "), text(n + 1), F.lit(" 30/40/50")))
    line = (
        F.when(n == 0, "# UNIT = K").when(n <= 6, colour).when((n == 7) & (f % 3 != 0), F.concat(F.lit("N 1 2 "), size))
        .when((n == 8) & (f % 4 < 2), F.concat(F.lit("F 200 100 "), size)).when((n == 9) & (f % 5 == 0), F.lit("B 5 6 7")).otherwise("#")
    )
    return grids.table(spark, sf, "part").select(F.concat(F.lit("q"), text(f)).alias("file"), n.cast("int").alias("n"), line.alias("line"))


_PALETTE = """pf AS (SELECT p_partkey // 10 AS f, CAST(max(CASE WHEN p_partkey % 10 = 7 AND (p_partkey // 10) % 3 <> 0 THEN p_size END) AS INT) AS nb, CAST(max(CASE WHEN p_partkey % 10 = 8 AND (p_partkey // 10) % 4 < 2 THEN p_size END) AS INT) AS fb,
   coalesce(bool_or(p_partkey % 10 = 9 AND (p_partkey // 10) % 5 = 0), false) AS hb FROM part GROUP BY 1 HAVING count(*) FILTER (p_partkey % 10 BETWEEN 1 AND 6) = 6),
 pm AS (SELECT *, CASE WHEN f % 2 = 0 THEN 6 ELSE 256 END AS samples, CAST(least(256, CASE WHEN f % 2 = 0 THEN 6 ELSE 256 END + (nb IS NOT NULL)::INT + (fb IS NOT NULL)::INT) AS INT) AS size FROM pf),
 pi AS (SELECT *, 1 + 6.0::DOUBLE * idx / 255 AS v FROM (SELECT *, unnest(range(0, size)) AS idx FROM pm)),
 pc AS (SELECT pi.*, CASE WHEN f % 2 = 0 THEN a.p_partkey % 256 ELSE trunc(10 + (v - floor(v)) * 20) END AS r0, CASE WHEN f % 2 = 0 THEN a.p_size ELSE trunc(20 + (v - floor(v)) * 20) END AS g0,
   CASE WHEN f % 2 = 0 THEN CASE WHEN a.p_partkey IS NOT NULL THEN 9 END ELSE trunc(a.p_size + (v - floor(v)) * (50 - a.p_size)) END AS b0 FROM pi LEFT JOIN part a ON a.p_partkey = f * 10 + CASE WHEN f % 2 = 0 THEN CASE WHEN idx < 6 THEN idx + 1 END ELSE CASE WHEN v < 7 THEN floor(v) END END),
 pal AS (SELECT 'q' || CAST(f AS VARCHAR) AS file, CAST(idx AS INT) AS idx,
   CAST(CASE WHEN fb IS NOT NULL AND idx = size - 2 THEN 200 WHEN nb IS NOT NULL AND idx = size - 1 THEN 1 WHEN f % 2 = 1 AND v = 7 THEN 30 ELSE coalesce(r0, CASE WHEN fb IS NOT NULL THEN 200 WHEN hb THEN 5 ELSE 0 END) END AS INT) AS r,
   CAST(CASE WHEN fb IS NOT NULL AND idx = size - 2 THEN 100 WHEN nb IS NOT NULL AND idx = size - 1 THEN 2 WHEN f % 2 = 1 AND v = 7 THEN 40 ELSE coalesce(g0, CASE WHEN fb IS NOT NULL THEN 100 WHEN hb THEN 6 ELSE 0 END) END AS INT) AS g,
   CAST(CASE WHEN fb IS NOT NULL AND idx = size - 2 THEN fb WHEN nb IS NOT NULL AND idx = size - 1 THEN nb WHEN f % 2 = 1 AND v = 7 THEN 50 ELSE coalesce(b0, CASE WHEN fb IS NOT NULL THEN fb WHEN hb THEN 7 ELSE 0 END) END AS INT) AS b FROM pc)"""


@query("h3_index_palette", f"WITH {_PALETTE} SELECT * FROM pal")
def h3(spark, sf):
    return palette.index_palette(palette.parse_lines(palette_lines(spark, sf)))


@query("h3_index_meta", f"WITH {_PALETTE} SELECT 'q' || CAST(f AS VARCHAR) AS file, f % 2 = 0 AS discrete, size, CASE WHEN fb IS NOT NULL THEN CAST(size - 2 AS INT) END AS foreground_at, CASE WHEN nb IS NOT NULL THEN CAST(size - 1 AS INT) END AS missing_at, 1.0::DOUBLE + (f % 2 = 0)::INT AS vmin, 7.0::DOUBLE - (f % 2 = 0)::INT AS vmax FROM pm")
def h3_meta(spark, sf):
    return palette.index_meta(palette.parse_lines(palette_lines(spark, sf))).select("file", "discrete", "size", "foreground_at", "missing_at", "vmin", "vmax")


@query("p10_h3_palette_file", f"{PX}, {_PALETTE}, gv AS (SELECT scene_id, y, x, max(value) AS value FROM px WHERE band = 13 GROUP BY ALL), gm AS (SELECT scene_id, min(value) AS lo, max(value) AS hi FROM gv GROUP BY 1), gi AS (SELECT scene_id, y, x, coalesce(CAST(trunc(255 * ((value - lo) / (hi - lo))) AS INT), 255) AS v FROM gv JOIN gm USING (scene_id)) SELECT scene_id, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM gi LEFT JOIN (SELECT * FROM pal WHERE file = 'q5') ON v = idx")
def p10_file(spark, sf):
    return products.pseudocolor_of_file(pixels(spark, sf, [13]), "C13", palette.parse_lines(palette_lines(spark, sf)), "q5")


@query("a12_scene_scan", f"{PX} SELECT scene_id, band, y, x, round(value, 6) AS value FROM px WHERE band IN (2, 13)")
def a12(spark, sf):
    return pixels(spark, sf, [2, 13]).select("scene_id", "band", "y", "x", *r6("value"))


@query("a13_a14_scene_attributes", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(p_size AS DOUBLE) / 2 END AS km, round(CAST(p_size AS DOUBLE) - 0.25, 6) AS x0, round(100 - CAST(p_size AS DOUBLE) + 0.5, 6) AS y0 FROM part""")
def a13(spark, sf):
    size = F.col("p_size").cast("double")
    text = F.when(F.col("p_size") % 3 == 0, F.lit("unknown")).otherwise(F.concat((size / 2).cast("string"), F.lit("km at nadir")))
    gt = names.axis_transform(size, F.lit(0.5), 100 - size, F.lit(-1.0))
    return grids.table(spark, sf, "part").select("p_partkey", names.resolution_km(text).alias("km"), F.round(gt[0], 6).alias("x0"), F.round(gt[3], 6).alias("y0"))


_DIGIT = "CAST(nullif(right(stamp, 1), '') AS INT)"


def digit():
    """The last digit of a scene's stamp, NULL without one: what the options of these queries hang on."""
    return F.right(F.col("stamp"), F.lit(1)).try_cast("int")


@query("a22_automatic_name", f"""{PARSED}, o AS (SELECT *, {_DIGIT} AS d FROM p), c AS (SELECT *, CASE d % 5 WHEN 0 THEN 'gray' WHEN 1 THEN 'pseudocolor' WHEN 2 THEN 'info' WHEN 3 THEN '' WHEN 4 THEN 'rgb' END AS command, ['ash', 'truecolor', 'composite', '', 'night', 'so2', NULL][d % 7 + 1] AS mode FROM o)
 SELECT name AS source, 'sky_' || CASE WHEN satellite = 'unknown' THEN 'GXX' ELSE satellite END || CASE WHEN sector <> 'unknown' THEN '_' || sector ELSE '' END || '_' || coalesce(strftime(start_ts, '%Y%j_%H%M'), 'NA') || '_'
 || CASE WHEN command IS NULL OR command = '' THEN 'output_' || channel WHEN command = 'rgb' THEN CASE WHEN mode IN ('ash', 'night', 'so2') THEN mode ELSE 'rgb' END WHEN command = 'pseudocolor' THEN 'pseudo_' || channel ELSE command || '_' || channel END
 || CASE WHEN d % 3 = 0 THEN '_inv__g1p5__geo' WHEN d % 3 = 1 THEN '' ELSE '_histo__clip' END || '.png' AS name FROM c""")
def a22(spark, sf):
    d = digit()
    one, none = F.coalesce(d % 3 == 0, F.lit(False)), F.coalesce(d % 3 == 1, F.lit(False))
    other = ~one & ~none
    command = F.when(d % 5 == 0, "gray").when(d % 5 == 1, "pseudocolor").when(d % 5 == 2, "info").when(d % 5 == 3, "").when(d % 5 == 4, "rgb")
    mode = F.when(d % 7 == 0, "ash").when(d % 7 == 1, "truecolor").when(d % 7 == 2, "composite").when(d % 7 == 3, "").when(d % 7 == 4, "night").when(d % 7 == 5, "so2")
    df = parsed(spark, sf).withColumns({"source": F.col("name"), "command": command, "mode": mode, "band_name": F.col("channel"), "invert": one, "rayleigh": F.lit(False), "histogram": other, "clahe": F.lit(False), "gamma": F.when(one, 1.5).otherwise(1.0), "clip": other, "stretch": F.lit(False), "geo": one})
    return names.automatic_name(df, ".png").select("source", "name")


@query("a23_name_template", f"""{PARSED}, g AS (SELECT *, split_part(substr(name, strpos(name, '_G') + 2), '_', 1) AS tail FROM p) SELECT name, CASE WHEN stamp IS NULL THEN '{{SAT}}_{{YYYY}}{{MM}}{{DD}}_{{JJJ}}_{{hh}}{{mm}}{{ss}}_{{CH}}_{{SECTOR}}_{{PROD}}_{{OPS}}'
 ELSE CASE WHEN contains(name, '_G') THEN 'G' || substr(tail, 1, 2) ELSE 'GXX' END || '_' || strftime(start_ts, '%Y%m%d_%j_%H%M') || substr(stamp, 12, 2) || '_' || channel || '_' || CASE WHEN sector = 'unknown' THEN '' ELSE sector END || '_' || CASE WHEN channel = 'C01' THEN '' ELSE 'L-' || channel END || '_{{OPS}}' END AS output FROM g""")
def a23(spark, sf):
    label = F.when(F.col("channel") != "C01", F.concat(F.lit("L-"), "channel"))
    return names.expand_template("{SAT}_{YYYY}{MM}{DD}_{JJJ}_{hh}{mm}{ss}_{CH}_{SECTOR}_{PROD}_{OPS}", parsed(spark, sf), label=label).select("name", "output")


@query("a10_clip_file", """WITH c AS (SELECT CASE WHEN s_suppkey % 11 = 3 THEN 'enclave' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 13 = 5 THEN 'key' WHEN s_suppkey % 17 = 6 THEN 'clave' ELSE 'k' || CAST(s_suppkey AS VARCHAR) END AS key, s_name AS region, s_suppkey % 40 - 130.5::DOUBLE AS ul_x,
 CASE WHEN s_suppkey % 7 <> 3 THEN 40.25::DOUBLE - s_suppkey % 20 END AS ul_y, s_suppkey % 70 - 110.0::DOUBLE AS lr_x, -10.0::DOUBLE - s_suppkey % 15 AS lr_y FROM supplier) SELECT *, ul_y IS NOT NULL AS usable FROM c""")
def a10_file(spark, sf):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    key = F.when(k % 11 == 3, F.concat(F.lit("enclave"), text(k))).when(k % 13 == 5, "key").when(k % 17 == 6, "clave").otherwise(F.concat(F.lit("k"), text(k)))
    fields = [key, F.col("s_name"), text(k % 40 - F.lit(130.5)), F.when(k % 7 != 3, text(F.lit(40.25) - k % 20)).otherwise("north"), text(k % 70 - F.lit(110.0)), text(F.lit(-10.0) - k % 15)]
    suppliers = grids.table(spark, sf, "supplier")
    head = suppliers.agg(F.lit(0).cast("long").alias("n"), F.lit("clave,region,ul_x,ul_y,lr_x,lr_y").alias("line"))
    return names.list_clips(names.clip_table(head.unionByName(suppliers.select(k.cast("long").alias("n"), F.concat_ws(",", *fields).alias("line")))))


@query("a24_a25_suffix_label", f"{NAMES} SELECT name, regexp_replace(name, '\\.nc$', '') || '_geo.tif' AS geo, split_part(name, '-', 1) AS short, CASE WHEN contains(name, '-') THEN substr(name, length(split_part(name, '-', 1)) + 2) ELSE name END AS long FROM f")
def a24(spark, sf):
    label = names.label_parts(F.replace(F.col("name"), F.lit("-"), F.lit(":")))
    long = F.when(F.col("name").contains("-"), F.substr(F.col("name"), F.length(label["short"]) + 2)).otherwise(F.col("name"))
    return grids.file_names(spark, sf).select("name", names.with_suffix(F.col("name"), extension=".tif").alias("geo"), label["short"].alias("short"), long.alias("long"))


# --- calibration and pixel arithmetic


@query("b1_unpack", f"{PX} SELECT scene_id, band, y, x, round(value, 6) AS value FROM px")
def b1(spark, sf):
    return pixels(spark, sf).select("scene_id", "band", "y", "x", *r6("value"))


@query("b2_b3_calibrate", f"""{RAW} SELECT scene_id, band, y, x, round(CASE WHEN raw = -1 THEN NULL WHEN band < 7 THEN raw * (0.001::DOUBLE + band * 0.0001::DOUBLE) WHEN raw = 0 THEN 0
 ELSE ((1000.0::DOUBLE + band * 10) / ln((10000.0::DOUBLE + band * 100) / raw + 1) - 0.2) / 0.999 END, 6) AS value FROM raw""")
def b2(spark, sf):
    raw = grids.raw(spark, sf)
    df = raw.join(F.broadcast(grids.band_attributes(raw)), ["scene_id", "band"])
    radiance = F.when(F.col("raw") != F.col("fill"), F.col("raw").cast("double"))
    return df.select("scene_id", "band", "y", "x", F.round(P.calibrate(radiance, *[F.col(c) for c in ("band", "kappa0", "fk1", "fk2", "bc1", "bc2")]), 6).alias("value"))


@query("b4_byte_codes", f"{RAW} SELECT scene_id, y, x, CASE WHEN raw % 7 <> 3 THEN CAST(raw % 7 AS INT) END AS code FROM raw WHERE band = 5")
def b4(spark, sf):
    return grids.raw(spark, sf, [5]).select(*KEYS, P.byte_code((F.col("raw") % 7).cast("int"), F.lit(3)).alias("code"))


@query("b5_grid_arithmetic", f"{WIDE} SELECT scene_id, y, x, round(c01 + c02, 6) AS added, round(c01 - c02, 6) AS less, round(c01 * c02, 12) AS times, round(CASE WHEN abs(c02) > 1e-9 THEN c01 / c02 END, 6) AS over FROM w")
def b5(spark, sf):
    a, b = F.col("c01"), F.col("c02")
    return every(spark, sf).select(*KEYS, *[F.round(P.combine(a, b, op), 12 if op == "mul" else 6).alias(n) for op, n in (("add", "added"), ("sub", "less"), ("mul", "times"), ("div", "over"))])


@query("b6_b7_b8_scalar_arithmetic", f"{WIDE} SELECT scene_id, y, x, round(273.15::DOUBLE - c08, 6) AS less, round(c08 / 4, 6) AS part, round(CASE WHEN abs(c01) > 1e-9 THEN 1 / c01 END, 6) AS inverse, round(-c08, 6) AS negative, 7.5::DOUBLE AS constant FROM w")
def b6(spark, sf):
    v = F.col("c08")
    return every(spark, sf).select(*KEYS, F.round(P.combine(F.lit(273.15), v, "sub"), 6).alias("less"), F.round(P.combine(v, F.lit(4.0), "div"), 6).alias("part"), F.round(P.combine(F.lit(1.0), F.col("c01"), "div"), 6).alias("inverse"), F.round(-v, 6).alias("negative"), F.lit(7.5).alias("constant"))


@query("b9_gamma", f"{PX}, m AS (SELECT scene_id, band, min(value) AS lo, max(value) AS hi FROM px GROUP BY ALL) SELECT scene_id, band, y, x, round(CASE WHEN value IS NULL THEN NULL WHEN hi - lo > 0 THEN pow(least(greatest((value - lo) / (hi - lo), 0), 1), 1 / 2.2::DOUBLE) ELSE value END, 6) AS value FROM px JOIN m USING (scene_id, band)")
def b9(spark, sf):
    px = pixels(spark, sf)
    stats = F.broadcast(measure.grid_stats(px, "scene_id", "band").select("scene_id", "band", "vmin", "vmax"))
    return px.join(stats, ["scene_id", "band"]).select("scene_id", "band", "y", "x", F.round(P.gamma(F.col("value"), 2.2, F.col("vmin"), F.col("vmax")), 6).alias("value"))


@query("b10_band_expression", f"{WIDE} SELECT scene_id, y, x, round(0.5 * c13 - 2 * c14 + c15 + 10, 6) AS value FROM w")
def b10(spark, sf):
    return algebra.band_expr(every(spark, sf), "0.5*C13 - 2*C14 + C15 + 10").select(*KEYS, *r6("value"))


@query("b10_b11_recipe_table", f"{WIDE} SELECT 'ash' AS recipe, scene_id, y, x, round(c15 - c13, 6) AS value FROM w WHERE scene_id || y || ',' || x IN (SELECT scene_id || y || ',' || x FROM px WHERE band IN (13, 15)) UNION ALL SELECT 'so2', scene_id, y, x, round(c09 - c10 + 5, 6) FROM w WHERE scene_id || y || ',' || x IN (SELECT scene_id || y || ',' || x FROM px WHERE band IN (9, 10))")
def b11(spark, sf):
    rows = []
    for name, text in (("ash", "C15-C13"), ("so2", "C09-C10+5")):
        e = algebra.parse(text)
        rows += [(name, b, k, e.bias, len(e.terms)) for k, b in e.terms]
    terms = spark.createDataFrame(rows, "recipe string, band int, coeff double, bias double, n_terms long")
    return algebra.recipes(pixels(spark, sf, algebra.required_bands("C15-C13;C09-C10")), terms).select("recipe", *KEYS, *r6("value"))


@query("b12_b15_gray_quantiser", f"{WIDE}, m AS (SELECT scene_id, min(c13) AS lo, max(c13) AS hi FROM w GROUP BY 1) SELECT scene_id, y, x, CASE WHEN c13 IS NULL THEN 0 ELSE CAST(trunc(255 * ((c13 - lo) / (hi - lo))) AS INT) END AS v, CASE WHEN c13 IS NULL THEN 7 ELSE CAST(trunc(255 * ((hi - c13) / (hi - lo))) AS INT) END AS inverted FROM w JOIN m USING (scene_id)")
def b12(spark, sf):
    df = every(spark, sf).withColumn("value", F.col("c13"))
    df = df.join(F.broadcast(measure.grid_stats(df, "scene_id")), "scene_id")
    v, lo, hi = F.col("c13"), F.col("vmin"), F.col("vmax")
    return df.select(*KEYS, P.quantise_gray(v, lo, hi).alias("v"), P.quantise_gray(v, lo, hi, invert=True, missing=7).alias("inverted"))


@query("b13_byte_quantiser", f"{RAW} SELECT scene_id, y, x, CAST(CASE WHEN raw % 5 = 4 THEN 0 ELSE ((raw % 300 - 150) % 256 + 256) % 256 END AS INT) AS v, CAST(CASE WHEN raw % 5 = 4 THEN 0 ELSE 255 - ((raw % 300 - 150) % 256 + 256) % 256 END AS INT) AS inverted FROM raw WHERE band = 6")
def b13(spark, sf):
    code = F.when(F.col("raw") % 5 != 4, F.col("raw") % 300 - 150)
    return grids.raw(spark, sf, [6]).select(*KEYS, P.quantise_byte(code).alias("v"), P.quantise_byte(code, invert=True).alias("inverted"))


def _q(v: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {v} IS NULL THEN 0 ELSE CAST(trunc(least(greatest(({v} - ({lo})) / ({hi} - ({lo}))::DOUBLE, 0), 1) * 255) AS INT) END"


@query("b14_rgb_quantiser", f"{WIDE} SELECT scene_id, y, x, {_q('c01', 0, 1)} AS r, {_q('c02', 0, 0.5)} AS g, {_q('c13', 200, 300)} AS b FROM w")
def b14(spark, sf):
    return composite.quantised(every(spark, sf), [(F.col("c01"), 0.0, 1.0), (F.col("c02"), 0.0, 0.5), (F.col("c13"), 200.0, 300.0)])


@query("b16_b17_alpha", f"{WIDE} SELECT scene_id, y, x, {_q('c02', 0, 1)} AS v, CAST(CASE WHEN c02 IS NULL THEN 0 ELSE 255 END AS INT) AS a FROM w")
def b16(spark, sf):
    return every(spark, sf).select(*KEYS, P.quantise_channel(F.col("c02"), 0.0, 1.0).alias("v"), P.validity(F.col("c02")).alias("a"))


_RGB = f"i AS (SELECT scene_id, y, x, {_q('c01', 0, 1)} AS r, {_q('c02', 0, 1)} AS g, {_q('c03', 0, 1)} AS b FROM w)"


def rgb_image(spark, sf):
    return composite.quantised(every(spark, sf), [(F.col(c), 0.0, 1.0) for c in ("c01", "c02", "c03")])


@query("b18_b19_luminance", f"{WIDE}, {_RGB}, l AS (SELECT *, least(255, CAST(floor(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE + 0.5) AS INT)) AS l0 FROM i) SELECT scene_id, y, x, l0, CAST(floor(least(r * least((255 - l0) / (l0 + 1e-6::DOUBLE), 4), 255) + 0.5) AS INT) AS r1 FROM l")
def b18(spark, sf):
    df = rgb_image(spark, sf).withColumn("l0", P.luminance(F.col("r"), F.col("g"), F.col("b")))
    return df.select(*KEYS, "l0", P.relight(F.col("r"), F.col("l0"), 255 - F.col("l0")).alias("r1"))


def _stretch_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= 0 THEN 0 WHEN {v} < 0.09804 THEN {v} * (0.35294::DOUBLE / 0.09804::DOUBLE) WHEN {v} < 0.21569 THEN 0.35294 + ({v} - 0.09804) * ((0.54902::DOUBLE - 0.35294::DOUBLE) / (0.21569::DOUBLE - 0.09804::DOUBLE)) WHEN {v} < 0.39216 THEN 0.54902 + ({v} - 0.21569) * ((0.68627::DOUBLE - 0.54902::DOUBLE) / (0.39216::DOUBLE - 0.21569::DOUBLE)) WHEN {v} < 1 THEN 0.68627 + ({v} - 0.39216) * ((1 - 0.68627::DOUBLE) / (1 - 0.39216::DOUBLE)) ELSE 1 END"


@query("b20_stretch", f"{WIDE} SELECT scene_id, y, x, round({_stretch_sql('c02')}, 6) AS value FROM w")
def b20(spark, sf):
    return every(spark, sf).select(*KEYS, F.round(P.stretch(F.col("c02")), 6).alias("value"))


@query("b21_synthetic_green", f"{WIDE} SELECT scene_id, y, x, round(c01 * 0.465 + c02 * 0.465 + c03 * 0.07, 9) AS g FROM w")
def b21(spark, sf):
    return every(spark, sf).select(*KEYS, F.round(P.synthetic_green(F.col("c01"), F.col("c02"), F.col("c03")), 9).alias("g"))


# --- geometry and atmosphere


@query("e1_e2_navigation", f"{WIDE}, {NAV} SELECT scene_id, y, x, round(lat, 6) AS lat, round(lon, 6) AS lon FROM nav")
def e2(spark, sf):
    return navigated(spark, sf).select(*KEYS, *r6("lat", "lon"))


@query("e3_plain_grid", f"{WIDE} SELECT scene_id, y, x, round(40 - y / 31.0::DOUBLE * 60, 6) AS lat, round(-120 + x / 31.0::DOUBLE * 80, 6) AS lon FROM w")
def e3(spark, sf):
    return G.plain_grid(every(spark, sf), grids.SIDE, grids.SIDE, -20.0, 40.0, -120.0, -40.0).select(*KEYS, *r6("lat", "lon"))


@query("e4_ephemeris", f"WITH {EPH} SELECT scene_id, round(sd, 6) AS sun_sd, round(cd, 6) AS sun_cd, round(ha, 6) AS sun_ha FROM eph")
def e4(spark, sf):
    return G.ephemeris(grids.scene_times(spark, sf)).select("scene_id", *r6("sun_sd", "sun_cd", "sun_ha"))


@query("e5_sun_angles", f"{WIDE}, {SUN} SELECT scene_id, y, x, round(sza, 5) AS sza, round(saa, 5) AS saa FROM sun")
def e5(spark, sf):
    return G.sun_angles(with_sun(spark, sf)).select(*KEYS, F.round("sza", 5).alias("sza"), F.round("saa", 5).alias("saa"))


@query("e6_sine_of_elevation", f"{WIDE}, {SUN} SELECT scene_id, y, x, round(se0, 6) AS sin_elevation FROM sun")
def e6(spark, sf):
    return G.sine_of_elevation(with_sun(spark, sf)).select(*KEYS, *r6("sin_elevation"))


@query("e7_e8_e10_view_angles", f"{WIDE}, {VIEW} SELECT scene_id, y, x, round(vza, 5) AS vza, round(vaa, 5) AS vaa, round(raa, 5) AS raa FROM geo")
def e7(spark, sf):
    return with_angles(spark, sf).select(*KEYS, *[F.round(c, 5).alias(c) for c in ("vza", "vaa", "raa")])


_NORM = "CASE WHEN {v} IS NOT NULL AND sza <= 85 AND cos(radians(sza)) > 0.087 THEN {v} / cos(radians(sza)) ELSE 0 END"


@query("f1_sun_normalise", f"{WIDE}, {SUN} SELECT scene_id, y, x, round({_NORM.format(v='c02')}, 6) AS value FROM sun")
def f1(spark, sf):
    return G.sun_angles(with_sun(spark, sf, [2])).select(*KEYS, F.round(G.sun_normalise(F.col("c02"), F.col("sza")), 6).alias("value"))


def _rayleigh_sql(v: str, wavelength: float) -> str:
    g = 0.0279 / (2.0 - 0.0279)
    tau, a, b, c = G.rayleigh_tau(wavelength), 0.75 / (1 + 2 * g), 1 + 3 * g, 1 - g
    scatter = "(-cos(radians(sza)) * cos(radians(vza)) + sin(radians(sza)) * sin(radians(vza)) * cos(radians(raa)))"
    out = f"({v} - {tau!r}::DOUBLE * ({a!r}::DOUBLE * ({b!r}::DOUBLE + {c!r}::DOUBLE * {scatter} * {scatter})) / (4 * cos(radians(sza)) * cos(radians(vza))))"
    return f"CASE WHEN NOT coalesce(cos(radians(sza)) >= 0.01 AND cos(radians(vza)) >= 0.01 AND raa IS NOT NULL, false) THEN {v} WHEN {out} < 0 THEN 0.0001 ELSE {out} END"


@query("f5_rayleigh_analytic", f"{WIDE}, {VIEW} SELECT scene_id, y, x, round({_rayleigh_sql('c01', 0.47)}, 6) AS value FROM geo")
def f5(spark, sf):
    angles = [F.col(c) for c in ("sza", "vza", "raa")]
    return with_angles(spark, sf, [1]).select(*KEYS, F.round(G.rayleigh_analytic(F.col("c01"), *angles, 0.47), 6).alias("value"))


#: Axes of the table that stands for path reflectance: first, last, step of secants and azimuth.
LUT_AXES = {"s": (1.0, 25.0, 1.0), "v": (1.0, 3.0, 0.25), "a": (0.0, 180.0, 30.0)}
_LUT_SQL = """lut AS (SELECT CAST(s AS INT) AS i_s, CAST(v AS INT) AS i_v, CAST(a AS INT) AS i_a, 0.02::DOUBLE + 0.002::DOUBLE * s + 0.01::DOUBLE * v + 0.0001::DOUBLE * ((s * v + a * a) % 17) AS value FROM range(0, 25) t(s), range(0, 9) u(v), range(0, 7) q(a))"""


def lut_table(spark, sf):
    n = {x: round((b - a) / d) + 1 for x, (a, b, d) in LUT_AXES.items()}
    i = spark.range(n["s"] * n["v"] * n["a"]).select(F.lit(1).alias("channel"), F.expr(f"cast(id div {n['v'] * n['a']} as int)").alias("i_s"), F.expr(f"cast((id div {n['a']}) % {n['v']} as int)").alias("i_v"), F.expr(f"cast(id % {n['a']} as int)").alias("i_a"))
    s, v, a = F.col("i_s"), F.col("i_v"), F.col("i_a")
    return i.withColumn("value", F.lit(0.02) + 0.002 * s + 0.01 * v + 0.0001 * ((s * v + a * a) % 17))


def _f2_sql() -> str:
    mixed = []
    for s in (0, 1):
        for v in (0, 1):
            for a in (0, 1):
                w = " * ".join((f"{x}f" if k else f"(1 - {x}f)") for x, k in zip("sva", (s, v, a)))
                mixed.append(f"(SELECT value FROM lut WHERE i_s = least(s0 + {s}, 24) AND i_v = least(v0 + {v}, 8) AND i_a = least(a0 + {a}, 6)) * {w}")
    return f"""{WIDE}, {VIEW}, {_LUT_SQL}, q0 AS (SELECT scene_id, y, x, c01, c02, sza, least(greatest(1 / cos(radians(least(greatest(sza, 0), 87.68))), 1), 25) - 1 AS sp_, (least(greatest(1 / cos(radians(least(greatest(vza, 0), 70.53))), 1), 3) - 1) / 0.25 AS vp_,
 least(greatest(180 - CASE WHEN abs(raa) > 180 THEN 360 - abs(raa) ELSE abs(raa) END, 0), 180) / 30 AS ap_ FROM geo),
 q1 AS (SELECT *, CAST(floor(round(sp_, 9)) AS INT) AS s0, CAST(floor(round(vp_, 9)) AS INT) AS v0, CAST(floor(round(ap_, 9)) AS INT) AS a0 FROM q0), q2 AS (SELECT *, sp_ - s0 AS sf, vp_ - v0 AS vf, ap_ - a0 AS af FROM q1),
 q3 AS (SELECT *, ({' + '.join(mixed)}) * CASE WHEN sza > 70 THEN greatest(1 - (sza - 70) / 18, 0) ELSE 1 END * CASE WHEN c02 >= 0.2 THEN greatest(1 - (c02 - 0.2) / 0.8, 0) ELSE 1 END AS r FROM q2)
 SELECT scene_id, y, x, round(CASE WHEN c01 IS NULL THEN NULL WHEN sza IS NULL OR sza < 0 OR sza > 88 THEN 0 ELSE greatest(c01 - r, 0) END, 6) AS value FROM q3"""


def _by_table(spark, sf):
    df = atmosphere.look_up(with_angles(spark, sf, [1, 2]), atmosphere.cells(lut_table(spark, sf)), 1, LUT_AXES)
    return df.withColumn("value", atmosphere.corrected(F.col("c01"), F.col("path"), F.col("sza"), F.col("c02")))


@query("f2_c3_rayleigh_table", _f2_sql())
def f2(spark, sf):
    return _by_table(spark, sf).select(*KEYS, *r6("value"))


@query("f4_table_from_spectra", f"{PX} SELECT CAST(k.channel AS INT) AS channel, y AS i_s, x AS i_v, CAST(CASE WHEN scene_id = 's0' THEN 0 ELSE 1 END AS INT) AS i_a, round(coalesce(CASE WHEN max(CASE WHEN band <= want THEN band END) IS NULL THEN arg_min(value, CASE WHEN band >= want THEN band END) WHEN min(CASE WHEN band >= want THEN band END) IS NULL OR max(CASE WHEN band <= want THEN band END) = min(CASE WHEN band >= want THEN band END) THEN arg_max(value, CASE WHEN band <= want THEN band END) ELSE arg_max(value, CASE WHEN band <= want THEN band END) + (want - max(CASE WHEN band <= want THEN band END)) / CAST(min(CASE WHEN band >= want THEN band END) - max(CASE WHEN band <= want THEN band END) AS DOUBLE) * (arg_min(value, CASE WHEN band >= want THEN band END) - arg_max(value, CASE WHEN band <= want THEN band END)) END, NULL), 9) AS value FROM px, (VALUES (1, 2.5::DOUBLE), (2, 4.25::DOUBLE), (3, 0.5::DOUBLE)) k(channel, want) WHERE value IS NOT NULL AND band <= 6 GROUP BY k.channel, want, scene_id, y, x")
def f4(spark, sf):
    px = pixels(spark, sf, [1, 2, 3, 4, 5, 6]).where("value is not null")
    spectra = px.select(F.col("band").cast("double").alias("wavelength"), F.col("y").alias("i_s"), F.col("x").alias("i_v"), F.when(F.col("scene_id") == "s0", 0).otherwise(1).alias("i_a"), "value")
    targets = spark.createDataFrame([(1, 2.5), (2, 4.25), (3, 0.5)], "channel int, wavelength double")
    return atmosphere.from_spectra(spectra, targets).select("channel", "i_s", "i_v", "i_a", F.round("value", 9).alias("value"))


@query("f6_correction_statistics", f"""{WIDE}, {VIEW}, q AS (SELECT scene_id, sza, c01 AS b, {_rayleigh_sql('c01', 0.47)} AS a FROM geo), d AS (SELECT *, b IS NOT NULL AND NOT (sza IS NULL OR sza < 0 OR sza > 88) AS day FROM q)
 SELECT scene_id, count(*) FILTER (b IS NOT NULL AND NOT day) AS n_night, count(*) FILTER (day AND a <= 0) AS n_clamped, count(*) FILTER (day) AS n_valid, round(avg(b) FILTER (day), 6) AS mean_before, round(avg(a) FILTER (day), 6) AS mean_after,
 round(max(b - a) FILTER (day), 6) AS max_correction, round(min(a) FILTER (a > 0), 6) AS low, round(max(a) FILTER (a > 0), 6) AS high FROM d GROUP BY 1""")
def f6(spark, sf):
    angles = [F.col(c) for c in ("sza", "vza", "raa")]
    df = with_angles(spark, sf, [1]).withColumn("after", G.rayleigh_analytic(F.col("c01"), *angles, 0.47))
    return atmosphere.statistics(df, "c01", "after").select("scene_id", "n_night", "n_clamped", "n_valid", *r6("mean_before", "mean_after", "max_correction", "low", "high"))


# --- composites and products


def _composite_sql(r: tuple, g: tuple, b: tuple, source: str = "w") -> str:
    return f"SELECT scene_id, y, x, {_q(*r)} AS r, {_q(*g)} AS g, {_q(*b)} AS b FROM {source}"


def _recipe(name: str, r: tuple, g: tuple, b: tuple) -> None:
    bands = composite.RECIPES[name].bands
    some = WIDE.replace("FROM px GROUP BY ALL)", f"FROM px WHERE band IN {bands} GROUP BY ALL)")
    QUERIES[{"ash": "p3_ash", "severestorm": "p4_severestorm", "airmass": "p5_airmass", "so2": "p6_so2"}[name]] = lambda spark, sf: products.rgb(pixels(spark, sf, list(bands)), name)
    ORACLE[{"ash": "p3_ash", "severestorm": "p4_severestorm", "airmass": "p5_airmass", "so2": "p6_so2"}[name]] = f"{some} {_composite_sql(r, g, b)}"


_recipe("ash", ("(c15 - c13)", -6.7, 2.6), ("(c14 - c11)", -6.0, 6.3), ("c13", 243.6, 302.4))
_recipe("severestorm", ("(c08 - c10)", -35, 5), ("(c07 - c13)", -5, 60), ("(c05 - c02)", -0.75, 0.25))
_recipe("airmass", ("(c08 - c10)", -26.2, 0.6), ("(c12 - c13)", -43.2, 6.7), ("(273.15 - c08)", 29.25, 64.65))
_recipe("so2", ("(c09 - c10)", -4, 2), ("(c13 - c11)", -4, 5), ("c13", 233, 300))

_GREEN = "(c01 * 0.465 + c02 * 0.465 + c03 * 0.07)"
_MEANS = "tm AS (SELECT *, avg(c02) OVER (PARTITION BY scene_id, y // 2, x // 2) AS m FROM w), tr AS (SELECT *, CASE WHEN c02 IS NULL OR m = 0 OR c02 / m < 0 THEN 1 ELSE least(greatest(c02 / m, 0.5), 1.5) END AS k FROM tm)"


@query("p1_truecolor_plain", f"{WIDE}, {_MEANS} SELECT scene_id, y, x, {_q('c02', 0, 1.1)} AS r, {_q(f'({_GREEN} * k)', 0, 1.1)} AS g, {_q('(c01 * k)', 0, 1.1)} AS b FROM tr")
def p1(spark, sf):
    return composite.truecolor(every(spark, sf), sharpen=True)


_DAY = f"day AS (SELECT *, {_rayleigh_sql('b0', 0.47)} AS bb, {_rayleigh_sql('r0', 0.64)} AS rr FROM (SELECT *, {_NORM.format(v='c01')} AS b0, {_NORM.format(v='c02')} AS r0, {_NORM.format(v='c03')} AS n0 FROM geo))"


@query("p1_truecolor_rayleigh", f"{WIDE}, {VIEW}, {_DAY} SELECT scene_id, y, x, {_q('(' + _stretch_sql('rr') + ')', 0, 1)} AS r, {_q('(' + _stretch_sql('(bb * 0.465 + rr * 0.465 + n0 * 0.07)') + ')', 0, 1)} AS g, {_q('(' + _stretch_sql('bb') + ')', 0, 1)} AS b FROM day")
def p1r(spark, sf):
    return composite.truecolor(with_angles(spark, sf, [1, 2, 3]), rayleigh=True, stretch=True)


TILE, BUCKETS = 8, 8  # of the stored tables of the derived grid


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of all bands as a stored table (grid_id, tile, cell, scene_id, y, x, value, band); both scenes share a grid."""
    rows = tiles.placed(pixels(spark, sf).withColumn("grid_id", F.lit(1)), TILE)
    return tiles.write(rows, store.fresh(spark), BUCKETS, parts=("band",), order=("scene_id", "y", "x"))


def stored_geometry(spark: SparkSession) -> DataFrame:
    gt, proj = F.array(*[F.lit(v) for v in (grids.X0, grids.DX, 0.0, grids.Y0, 0.0, grids.DY)]), F.struct(*[F.lit(v).alias(k) for k, v in grids.PROJ.items()])
    one = spark.range(1).select(F.lit(1).alias("grid_id"), F.lit(grids.SIDE).alias("height"), F.lit(grids.SIDE).alias("width"), gt.alias("gt"), proj.alias("proj"))
    return tiles.write(atlas.geometry(one, TILE), store.fresh(spark), BUCKETS)


@query("p1_truecolor_stored_geometry", ORACLE["p1_truecolor_rayleigh"])
def p1s(spark, sf):
    rows = align.to_wide(stored(spark, sf), BANDS, (*tiles.PLACE, "cell"))
    scenes = F.broadcast(atlas.sun(grids.scene_times(spark, sf)))  # one row a scene
    return composite.truecolor(tiles.joined(rows, stored_geometry(spark)).join(scenes, "scene_id"), stretch=True, light=atlas.daylight)


_TABLE = """tb AS (SELECT CAST(i AS INT) AS idx, 180.0::DOUBLE + i * 0.5 AS lo, (i % 256) / 255.0::DOUBLE AS r, (i * 7 % 256) / 255.0::DOUBLE AS g, (255 - i % 256) / 255.0::DOUBLE AS b, (i % 101) / 100.0::DOUBLE AS a FROM (SELECT DISTINCT (p_partkey % 257) AS i FROM part))"""


def night_table(spark, sf):
    """A threshold table by rule, with as many of its 257 entries as the part table has keys for."""
    i = (F.col("p_partkey") % 257).alias("i")
    part = lambda c: (c / F.lit(255.0))
    c = F.col("i")
    return grids.table(spark, sf, "part").select(i).distinct().select(c.cast("int").alias("idx"), (F.lit(180.0) + c * 0.5).alias("lo"), part(c % 256).alias("r"), part(c * 7 % 256).alias("g"), part(255 - c % 256).alias("b"), (c % 101 / F.lit(100.0)).alias("a"))


def lights(spark, sf):
    """A background that customers stand for, on the grid of every scene."""
    k = F.col("c_custkey")
    return grids.table(spark, sf, "customer").groupBy(F.concat(F.lit("s"), (k % 2).cast("string")).alias("scene_id"), F.expr("cast((c_custkey div 2) % 32 as int)").alias("y"), F.expr("cast((c_custkey div 64) % 32 as int)").alias("x")).agg(
        *[F.max((k * m % 256).cast("int")).alias(c) for c, m in (("r", 3), ("g", 5), ("b", 11))]
    )


_LIGHTS = "li AS (SELECT 's' || CAST(c_custkey % 2 AS VARCHAR) AS scene_id, CAST((c_custkey // 2) % 32 AS INT) AS y, CAST((c_custkey // 64) % 32 AS INT) AS x, max(c_custkey * 3 % 256) AS lr, max(c_custkey * 5 % 256) AS lg, max(c_custkey * 11 % 256) AS lb FROM customer GROUP BY ALL)"
_NIGHT = f"{_TABLE}, {_LIGHTS}, nq AS (SELECT w.*, CASE WHEN c13 IS NULL THEN NULL WHEN (SELECT count(*) FROM tb WHERE lo <= c13) BETWEEN 1 AND 255 THEN (SELECT count(*) FROM tb WHERE lo <= c13) - 1 ELSE 254 END AS t FROM w)"
_NIGHT_RGB = ", ".join(f"CAST(coalesce(CASE WHEN c13 > 263.15 AND li.lr IS NOT NULL THEN trunc(trunc(255 * tb.{c}) * tb.a + (1 - tb.a) * li.l{c}) ELSE trunc(255 * tb.{c}) END, 0) AS INT) AS {c}" for c in "rgb").replace("trunc(trunc(255 * tb.r) * tb.a", "trunc(trunc(255 * tb.r) * (1 - (1 - tb.a))").replace("trunc(trunc(255 * tb.g) * tb.a", "trunc(trunc(255 * tb.g) * (1 - (1 - tb.a))").replace("trunc(trunc(255 * tb.b) * tb.a", "trunc(trunc(255 * tb.b) * (1 - (1 - tb.a))")


@query("p2_c5_a15_night", f"{WIDE}, {_NIGHT} SELECT nq.scene_id, nq.y, nq.x, {_NIGHT_RGB} FROM nq LEFT JOIN tb ON nq.t = tb.idx LEFT JOIN li ON nq.scene_id = li.scene_id AND nq.y = li.y AND nq.x = li.x")
def p2(spark, sf):
    return composite.night(every(spark, sf), night_table(spark, sf), lights(spark, sf))


@query("a15_lights_by_width", """WITH px AS (SELECT DISTINCT 's' || CAST(c_custkey % 8 AS VARCHAR) AS scene_id, CAST((c_custkey // 8) % 32 AS INT) AS y, CAST((c_custkey // 256) % 32 AS INT) AS x FROM customer),
 ra AS (SELECT DISTINCT 's' || CAST(n_nationkey % 8 AS VARCHAR) AS scene_id, CASE n_nationkey % 4 WHEN 0 THEN 2500 WHEN 1 THEN 5424 WHEN 2 THEN 8987 ELSE 1000 END AS width FROM nation),
 li AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 2500 WHEN 1 THEN 5424 WHEN 2 THEN 8987 ELSE 1000 END AS width, CAST((p_partkey // 4) % 32 AS INT) AS y, CAST((p_partkey // 128) % 32 AS INT) AS x, CAST(max(p_partkey % 256) AS INT) AS r, CAST(max(p_size) AS INT) AS g, CAST(min(p_size) AS INT) AS b FROM part GROUP BY ALL)
 SELECT scene_id, y, x, r, g, b FROM px JOIN ra USING (scene_id) JOIN li USING (width, y, x) WHERE width <> 1000""")
def a15(spark, sf):
    k, n, p = F.col("c_custkey"), F.col("n_nationkey"), F.col("p_partkey")
    width = lambda c: F.when(c % 4 == 0, 2500).when(c % 4 == 1, 5424).when(c % 4 == 2, 8987).otherwise(1000)
    px = grids.table(spark, sf, "customer").select(F.concat(F.lit("s"), (k % 8).cast("string")).alias("scene_id"), F.expr("cast((c_custkey div 8) % 32 as int)").alias("y"), F.expr("cast((c_custkey div 256) % 32 as int)").alias("x")).distinct()
    rasters = grids.table(spark, sf, "nation").select(F.concat(F.lit("s"), (n % 8).cast("string")).alias("scene_id"), width(n).alias("width")).distinct()
    pictures = grids.table(spark, sf, "part").groupBy(width(p).alias("width"), F.expr("cast((p_partkey div 4) % 32 as int)").alias("y"), F.expr("cast((p_partkey div 128) % 32 as int)").alias("x")).agg(F.max((p % 256).cast("int")).alias("r"), F.max(F.col("p_size").cast("int")).alias("g"), F.min(F.col("p_size").cast("int")).alias("b"))
    return composite.lights_for(px, pictures, rasters)


_MASK = """mk AS (SELECT *, CASE WHEN coalesce(c13 < 200, false) THEN 1 WHEN se0 IS NULL OR se0 >= 0.25881904510252074 THEN 0 WHEN se0 < 0.08715574274765817 THEN 1 ELSE 1 - (se0 - 0.08715574274765817::DOUBLE) * (1 / (0.25881904510252074::DOUBLE - 0.08715574274765817::DOUBLE)) END AS wt FROM sun)"""


@query("c7_daynight_mask", f"{WIDE}, {SUN}, {_MASK} SELECT scene_id, y, x, CAST(trunc(255 * wt) AS INT) AS mask, wt < 0.5 AS is_day FROM mk")
def c7(spark, sf):
    return composite.daynight_mask(with_sun(spark, sf), 200.0).select(*KEYS, "mask", "is_day")


@query("d10_day_share", f"{WIDE}, {SUN}, {_MASK} SELECT scene_id, round(CASE WHEN count(*) FILTER (wt >= 0.5) = 0 THEN 100 ELSE 100.0::DOUBLE * count(*) FILTER (wt < 0.5) / count(*) END, 6) AS day_percent FROM mk GROUP BY 1")
def d10(spark, sf):
    return composite.day_share(composite.daynight_mask(with_sun(spark, sf), 200.0)).select("scene_id", *r6("day_percent"))


@query("p7_daynite")
def p7(spark, sf):
    return composite.daynite(with_angles(spark, sf, [1, 2, 3, 13]), night_table(spark, sf), lights(spark, sf))


@query("c8_mask_blend", f"{WIDE}, {_RGB} SELECT scene_id, y, x, CAST(trunc(b / 255.0::DOUBLE * r + (1 - b / 255.0::DOUBLE) * g) AS INT) AS v FROM i")
def c8(spark, sf):
    return rgb_image(spark, sf).select(*KEYS, P.blend(F.col("r"), F.col("g"), F.col("b")).alias("v"))


@query("p8_custom_rgb", f"{WIDE} {_composite_sql(('(c15 - c13)', -10, 10), ('(2 * c02 + 0.1)', 0, 2), ('c13', 0, 255))}")
def p8(spark, sf):
    return composite.custom(every(spark, sf), "C15-C13;2*C02+0.1;C13", [(-10.0, 10.0), (0.0, 2.0)])


_GRAY = "gm AS (SELECT scene_id, min(value) AS lo, max(value) AS hi FROM gv GROUP BY 1), gi AS (SELECT scene_id, y, x, coalesce(CAST(trunc(255 * pow((value - lo) / (hi - lo), 0.5)) AS INT), 0) AS v FROM gv JOIN gm USING (scene_id))"


@query("p9_gray", f"{PX}, gv AS (SELECT scene_id, y, x, max(value) AS value FROM px WHERE band = 2 GROUP BY ALL), {_GRAY}, gh AS (SELECT scene_id, v, sum(count(*)) OVER (PARTITION BY scene_id ORDER BY v) AS cum, sum(count(*)) OVER (PARTITION BY scene_id) AS n FROM gi GROUP BY scene_id, v) SELECT gi.scene_id, y, x, CAST(floor(255.0::DOUBLE * cum / n) AS INT) AS v FROM gi JOIN gh ON gi.scene_id = gh.scene_id AND gi.v = gh.v")
def p9(spark, sf):
    return products.gray(pixels(spark, sf, [2]), "C02", gamma=2.0, histogram=True)


_RAINBOW = """ri AS (SELECT DISTINCT CAST(p_partkey % 64 AS INT) AS i FROM part), rh AS (SELECT i, (1 - i / 63.0::DOUBLE) * 240 AS hue, CAST(floor((1 - abs(((1 - i / 63.0::DOUBLE) * 240 / 60) % 2 - 1)) * 255 + 0.5) AS INT) AS mid FROM ri),
 rb AS (SELECT i AS idx, CASE WHEN i = 63 THEN 0 WHEN hue < 60 THEN 255 WHEN hue < 120 THEN mid ELSE 0 END AS r, CASE WHEN i = 63 THEN 0 WHEN hue < 60 THEN mid WHEN hue < 180 THEN 255 ELSE mid END AS g, CASE WHEN i = 63 OR hue < 120 THEN 0 WHEN hue < 180 THEN mid ELSE 255 END AS b FROM rh)"""


def rainbow_table(spark, sf):
    i = grids.table(spark, sf, "part").select((F.col("p_partkey") % 64).cast("int").alias("i")).distinct()
    return palette.rainbow(i, F.lit(64)).select(F.col("i").alias("idx"), "r", "g", "b")


@query("h1_rainbow", f"WITH {_RAINBOW} SELECT * FROM rb")
def h1(spark, sf):
    return rainbow_table(spark, sf)


@query("h2_threshold_colours", f"WITH {_TABLE} SELECT idx, CAST(trunc(255 * r) AS INT) AS r, CAST(trunc(255 * g) AS INT) AS g, CAST(trunc(255 * b) AS INT) AS b FROM tb")
def h2(spark, sf):
    return palette.threshold_colours(night_table(spark, sf))


@query("p10_c4_pseudocolor", f"{PX}, gv AS (SELECT scene_id, y, x, max(value) AS value FROM px WHERE band = 13 GROUP BY ALL), gm AS (SELECT scene_id, min(value) AS lo, max(value) AS hi FROM gv GROUP BY 1), gi AS (SELECT scene_id, y, x, coalesce(CAST(trunc(100 * ((value - lo) / (hi - lo))) AS INT), 63) AS v FROM gv JOIN gm USING (scene_id)), {_RAINBOW} SELECT scene_id, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM gi LEFT JOIN rb ON gi.v = rb.idx")
def p10(spark, sf):
    return products.pseudocolor(pixels(spark, sf, [13]), "C13", rainbow_table(spark, sf), last=100, missing=63)


_PAIRS = "pr AS (SELECT 180.0::DOUBLE + 20 * k AS lo, 200.0::DOUBLE + 20 * k AS hi, k * 30 AS r0, 250 - k * 30 AS r1, k * 10 AS g0, 255 - k AS g1, 7 * k AS b0, 5 * k AS b1 FROM (SELECT DISTINCT CAST(p_partkey % 6 AS INT) AS k FROM part))"


@query("c6_h3_continuous_colours", f"{WIDE}, {_PAIRS} SELECT scene_id, y, x, " + ", ".join(f"CAST(CASE WHEN c13 < 180 THEN 9 WHEN c13 > 300 THEN 8 WHEN c13 = 300 THEN (SELECT arg_max({c}1, hi) FROM pr) ELSE coalesce(trunc({c}0 + (c13 - lo) / (hi - lo) * ({c}1 - {c}0)), 0) END AS INT) AS {c}" for c in "rgb") + " FROM w LEFT JOIN pr ON c13 >= lo AND c13 < hi")
def c6(spark, sf):
    k = F.col("k")
    pairs = grids.table(spark, sf, "part").select((F.col("p_partkey") % 6).cast("int").alias("k")).distinct().select((F.lit(180.0) + 20 * k).alias("lo"), (F.lit(200.0) + 20 * k).alias("hi"), (k * 30).alias("r0"), (250 - k * 30).alias("r1"), (k * 10).alias("g0"), (255 - k).alias("g1"), (7 * k).alias("b0"), (5 * k).alias("b1"))
    values = every(spark, sf).select(*KEYS, F.col("c13").alias("value"))
    return palette.colour_of(values, pairs, (9, 9, 9), (8, 8, 8)).select(*KEYS, "r", "g", "b")


# --- alignment, aggregation, enhancement


@query("c1_c2_band_alignment", f"{WIDE} SELECT scene_id, y, x, round(c11, 6) AS c11, round(c13, 6) AS c13, round(c14, 6) AS c14 FROM w WHERE scene_id || ' ' || y || ' ' || x IN (SELECT scene_id || ' ' || y || ' ' || x FROM px WHERE band IN (11, 13, 14))")
def c1(spark, sf):
    return wide(spark, sf, [11, 13, 14]).select(*KEYS, *r6("c11", "c13", "c14"))


@query("c1_c2_stored_bands", ORACLE["c1_c2_band_alignment"])
def c1s(spark, sf):
    return align.to_wide(stored(spark, sf), [11, 13, 14], tiles.PLACE).select(*KEYS, *r6("c11", "c13", "c14"))


@query("d1_grid_stats", f"{PX} SELECT scene_id, band, round(min(value), 6) AS vmin, round(max(value), 6) AS vmax, count(value) AS n_valid, count(*) AS n FROM px GROUP BY ALL")
def d1(spark, sf):
    return measure.grid_stats(pixels(spark, sf), "scene_id", "band").select("scene_id", "band", *r6("vmin", "vmax"), "n_valid", "n")


@query("d2_decimate", f"{PX} SELECT scene_id, band, CAST(y // 3 AS BIGINT) AS y, CAST(x // 3 AS BIGINT) AS x, round(value, 6) AS value FROM px WHERE y % 3 = 0 AND x % 3 = 0")
def d2(spark, sf):
    return align.decimate(pixels(spark, sf), 3).select("scene_id", "band", "y", "x", *r6("value"))


@query("d3_box_mean", f"{PX} SELECT scene_id, band, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, round(CASE WHEN count(value) = 9 THEN avg(value) END, 6) AS value FROM px WHERE y < 30 AND x < 30 GROUP BY scene_id, band, y // 3, x // 3")
def d3(spark, sf):
    return align.box_mean(pixels(spark, sf), 3, 32, 32).select("scene_id", "band", "y", "x", *r6("value"))


@query("d4_box_mean_image", f"{WIDE}, {_RGB} SELECT scene_id, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(g) + 0.5) AS INT) AS g, CAST(floor(avg(b) + 0.5) AS INT) AS b FROM i GROUP BY scene_id, y // 4, x // 4")
def d4(spark, sf):
    return align.box_mean_image(rgb_image(spark, sf), 4, 32, 32)


@query("a19_pyramid", f"{WIDE}, {_RGB}, l1 AS (SELECT scene_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(floor(avg(r) + 0.5) AS INT) AS r FROM i GROUP BY scene_id, y // 2, x // 2), l2 AS (SELECT scene_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(floor(avg(r) + 0.5) AS INT) AS r FROM l1 GROUP BY scene_id, y // 2, x // 2) SELECT scene_id, y, x, r, CAST(0 AS INT) AS level FROM i UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2")
def a19(spark, sf):
    return align.pyramid(rgb_image(spark, sf), 32, 32, 2, ("r",))


@query("d5_d6_sharpen", f"{WIDE}, {_MEANS} SELECT scene_id, y, x, round(m, 9) AS mean, round(k, 9) AS ratio FROM tr")
def d5(spark, sf):
    df = enhance.sharpen_ratio(every(spark, sf), "c02")
    return enhance.block_mean(df, "c02", "mean").select(*KEYS, F.round("mean", 9).alias("mean"), F.round("ratio", 9).alias("ratio"))


@query("d7_equalise_rgb", f"{WIDE}, {_RGB}, l AS (SELECT *, least(255, CAST(floor(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE + 0.5) AS INT)) AS lv FROM i), h AS (SELECT scene_id, k, (SELECT count(*) FROM l WHERE l.scene_id = s.scene_id AND lv <= k) * 255.0::DOUBLE / (SELECT count(*) FROM l WHERE l.scene_id = s.scene_id) AS t FROM (SELECT DISTINCT scene_id FROM l) s, range(0, 256) q(k)) SELECT l.scene_id, y, x, CAST(floor(hr.t) AS INT) AS r, CAST(floor(hg.t) AS INT) AS g, CAST(floor(hb.t) AS INT) AS b FROM l JOIN h hr ON hr.scene_id = l.scene_id AND hr.k = r JOIN h hg ON hg.scene_id = l.scene_id AND hg.k = g JOIN h hb ON hb.scene_id = l.scene_id AND hb.k = b")
def d7(spark, sf):
    df = rgb_image(spark, sf)
    return enhance.equalise(df, ("r", "g", "b"), P.luminance(F.col("r"), F.col("g"), F.col("b"))).select(*KEYS, "r", "g", "b")


_TILES = f"""{WIDE}, i AS (SELECT scene_id, y, x, {_q('c02', 0, 1)} AS v FROM w), tc AS (SELECT scene_id, least(y // 8, 3) AS ty, least(x // 8, 3) AS tx, v, count(*) AS n FROM i GROUP BY ALL),
 ta AS (SELECT t.scene_id, ty, tx, CAST(k AS INT) AS k FROM (SELECT DISTINCT scene_id, ty, tx FROM tc) t, range(0, 256) q(k)), tn AS (SELECT ta.*, coalesce(n, 0) AS n FROM ta LEFT JOIN tc ON ta.scene_id = tc.scene_id AND ta.ty = tc.ty AND ta.tx = tc.tx AND ta.k = tc.v),
 tx AS (SELECT *, sum(n) OVER t AS px, sum(greatest(n - 1, 0)) OVER t AS ex FROM tn WINDOW t AS (PARTITION BY scene_id, ty, tx)), tl AS (SELECT scene_id, ty, tx, k, px, least(n, 1) + ex // 256 + CASE WHEN k < ex % 256 THEN 1 ELSE 0 END AS n FROM tx),
 tt AS (SELECT scene_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, k AS level, CAST(floor(sum(n) OVER (PARTITION BY scene_id, ty, tx ORDER BY k) * (255.0::DOUBLE / px) + 0.5) AS INT) AS "to" FROM tl)"""


def band_image(spark, sf):
    return every(spark, sf).select(*KEYS, P.quantise_channel(F.col("c02"), 0.0, 1.0).alias("v"))


@query("d9_tile_transfers", f"{_TILES} SELECT * FROM tt")
def d9(spark, sf):
    return enhance.tile_transfers(band_image(spark, sf), "v", 32, 32, 4, 4, 4.0)


@query("d8_clahe", f"""{_TILES}, q0 AS (SELECT *, y / 8.0::DOUBLE - 0.5 AS fy, x / 8.0::DOUBLE - 0.5 AS fx FROM i), q1 AS (SELECT *, CAST(least(greatest(trunc(fy), 0), 2) AS INT) AS ty, CAST(least(greatest(trunc(fx), 0), 2) AS INT) AS tx FROM q0),
 q2 AS (SELECT *, least(greatest(fy - ty, 0), 1) AS dy, least(greatest(fx - tx, 0), 1) AS dx FROM q1) SELECT q2.scene_id, y, x, CAST(floor((a."to" * (1 - dx) + b."to" * dx) * (1 - dy) + (c."to" * (1 - dx) + d."to" * dx) * dy + 0.5) AS INT) AS v FROM q2
 JOIN tt a ON a.scene_id = q2.scene_id AND a.ty = q2.ty AND a.tx = q2.tx AND a.level = v JOIN tt b ON b.scene_id = q2.scene_id AND b.ty = q2.ty AND b.tx = q2.tx + 1 AND b.level = v
 JOIN tt c ON c.scene_id = q2.scene_id AND c.ty = q2.ty + 1 AND c.tx = q2.tx AND c.level = v JOIN tt d ON d.scene_id = q2.scene_id AND d.ty = q2.ty + 1 AND d.tx = q2.tx + 1 AND d.level = v""")
def d8(spark, sf):
    return enhance.clahe(band_image(spark, sf), "v", 32, 32, 4, 4, 4.0)


_PAIR = f"{WIDE}, a AS (SELECT scene_id, y, x, {_q('c01', 0, 1)} AS p FROM w), b AS (SELECT scene_id, y, x, {_q('c02', 0, 1)} AS q FROM w WHERE (y + x) % 17 <> 5)"


@query("d12_diff_count", f"{_PAIR} SELECT scene_id, count(*) FILTER (coalesce(abs(p - q) > 0.02::DOUBLE * 255, true)) AS n_differ, count(*) AS n, max(CASE WHEN p IS NOT NULL THEN y END) = max(CASE WHEN q IS NOT NULL THEN y END) AND max(CASE WHEN p IS NOT NULL THEN x END) = max(CASE WHEN q IS NOT NULL THEN x END) AS same_size, false AS passed FROM a FULL JOIN b USING (scene_id, y, x) GROUP BY 1")
def d12(spark, sf):
    df = every(spark, sf)
    a, b = (df.select(*KEYS, P.quantise_channel(F.col(c), 0.0, 1.0).alias("v")) for c in ("c01", "c02"))
    return measure.diff_count(a, b.where((F.col("y") + F.col("x")) % 17 != 5), ("v",))


@query("d13_diff_stats", f"{_PAIR} SELECT scene_id, round(avg(abs(p - q)), 6) AS mae, round(sqrt(avg((p - q) * (p - q))), 6) AS rmse, round(avg(CASE WHEN abs(p - q) <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_10, round(avg(CASE WHEN abs(p - q) <= 25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_25, round(quantile_cont(abs(p - q), 0.99), 6) AS p99, round(avg(p), 6) AS mean_a, round(avg(q), 6) AS mean_b, round(avg(p - q), 6) AS bias FROM a JOIN b USING (scene_id, y, x) GROUP BY 1")
def d13(spark, sf):
    df = every(spark, sf)
    a, b = (df.select(*KEYS, P.quantise_channel(F.col(c), 0.0, 1.0).alias("v")) for c in ("c01", "c02"))
    return measure.diff_stats(a, b.where((F.col("y") + F.col("x")) % 17 != 5)).select("scene_id", *r6("mae", "rmse", "within_10", "within_25", "p99", "mean_a", "mean_b", "bias"))


@query("d14_nonblank", f"{WIDE}, a AS (SELECT scene_id, y, x, {_q('c01', 0, 1)} AS v FROM w) SELECT scene_id, stddev_pop(v) > 0 AS varies, arg_min(v, y * 1000 + x) AS first, arg_max(v, y * 1000 + x) AS last FROM a GROUP BY 1")
def d14(spark, sf):
    return measure.nonblank(every(spark, sf).select(*KEYS, P.quantise_channel(F.col("c01"), 0.0, 1.0).alias("v")))


# --- space

_CROP = "WHERE y BETWEEN 5 AND 14 AND x BETWEEN 20 AND 31"


@query("g5_crop", f"{PX} SELECT scene_id, band, CAST(y - 5 AS INT) AS y, CAST(x - 20 AS INT) AS x, round(value, 6) AS value FROM px {_CROP}")
def g5(spark, sf):
    return spatial.crop(pixels(spark, sf), 5, 20, 10, 99).select("scene_id", "band", "y", "x", *r6("value"))


@query("g6_crop_image", f"{WIDE}, {_RGB} SELECT scene_id, CAST(y - 5 AS INT) AS y, CAST(x - 20 AS INT) AS x, r, g, b FROM i {_CROP}")
def g6(spark, sf):
    return spatial.crop_image(rgb_image(spark, sf), 5, 20, 10, 12, 32, 32)


_BIG = """sc AS (SELECT DISTINCT scene_id FROM w), gr AS (SELECT scene_id, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x, yy * (31 / 63.0::DOUBLE) AS fy, xx * (31 / 63.0::DOUBLE) AS fx FROM sc, range(0, 64) a(yy), range(0, 64) b(xx)),
 k AS (SELECT scene_id, y, x, unnest([floor(fy), floor(fy), ceil(fy), ceil(fy)]) AS sy, unnest([floor(fx), ceil(fx), floor(fx), ceil(fx)]) AS sx, unnest([(1 - (fy - floor(fy))) * (1 - (fx - floor(fx))), (1 - (fy - floor(fy))) * (fx - floor(fx)), (fy - floor(fy)) * (1 - (fx - floor(fx))), (fy - floor(fy)) * (fx - floor(fx))]) AS wt FROM gr)"""


@query("g3_enlarge", f"{WIDE}, {_BIG} SELECT k.scene_id, k.y, k.x, round(CASE WHEN count(c13) = count(*) THEN sum(wt * c13) END, 6) AS c13 FROM k LEFT JOIN w ON w.scene_id = k.scene_id AND w.y = sy AND w.x = sx WHERE wt > 0 GROUP BY k.scene_id, k.y, k.x")
def g3(spark, sf):
    df = every(spark, sf)
    return align.enlarge(df, df.select("scene_id").distinct(), 2, 32, 32, ["c13"]).select(*KEYS, *r6("c13"))


_POINTS = "pts AS (SELECT CAST(s_suppkey AS VARCHAR) AS pid, s_suppkey % 81 - 40.0::DOUBLE AS plat, -s_suppkey % 120 - 15.0::DOUBLE AS plon FROM supplier)"


@query("c9_nearest_pixel", f"{WIDE}, {NAV}, {_POINTS}, dd AS (SELECT pid, scene_id, y, x, (lat - plat) * (lat - plat) + pow(CASE WHEN abs(lon - plon) > 180 THEN 360 - abs(lon - plon) ELSE abs(lon - plon) END, 2) AS d2 FROM nav, pts WHERE lat IS NOT NULL) SELECT pid, scene_id, m.y AS y, m.x AS x FROM (SELECT pid, scene_id, min(struct_pack(d2, y, x)) AS m FROM dd GROUP BY ALL)")
def c9(spark, sf):
    return spatial.nearest_pixel(places(spark, sf), navigated(spark, sf))


def places(spark, sf):
    """A point for each supplier."""
    k = F.col("s_suppkey")
    return grids.table(spark, sf, "supplier").select("s_suppkey", k.cast("string").alias("pid"), (k % 81 - F.lit(40.0)).alias("plat"), (-k % 120 - F.lit(15.0)).alias("plon"))


_BOX = f"""{CLIPS_SQL}, c5 AS (SELECT * FROM cl WHERE ul_y IS NOT NULL), ep AS (SELECT key, s / 20.0::DOUBLE AS t, e, ul_x, ul_y, lr_x, lr_y FROM c5, range(0, 21) a(s), range(0, 4) b(e)),
 pt AS (SELECT key, t, e, CASE e WHEN 0 THEN ul_y WHEN 1 THEN lr_y ELSE lr_y + t * (ul_y - lr_y) END AS plat, CASE e WHEN 2 THEN ul_x WHEN 3 THEN lr_x ELSE ul_x + t * (lr_x - ul_x) END AS plon FROM ep),
 dd AS (SELECT key, t, e, scene_id, y, x, (lat - plat) * (lat - plat) + (CASE WHEN abs(lon - plon) > 180 THEN 360 - abs(lon - plon) ELSE abs(lon - plon) END) * (CASE WHEN abs(lon - plon) > 180 THEN 360 - abs(lon - plon) ELSE abs(lon - plon) END) AS d2 FROM nav, pt WHERE lat IS NOT NULL),
 nn AS (SELECT key, scene_id, m.y AS y, m.x AS x FROM (SELECT key, t, e, scene_id, min(struct_pack(d2, y, x)) AS m FROM dd GROUP BY ALL)),
 bx AS (SELECT key, scene_id, min(y) AS y0, min(x) AS x0, CAST(max(y) - min(y) + 1 AS INT) AS height, CAST(max(x) - min(x) + 1 AS INT) AS width FROM nn GROUP BY ALL)"""


@query("g8_bounding_box", f"{WIDE}, {NAV}, {_BOX} SELECT * FROM bx")
def g8(spark, sf):
    return spatial.bounding_box(clips(spark, sf), navigated(spark, sf))


@query("g9_clip_native", f"{WIDE}, {NAV}, {_BOX} SELECT bx.key, w.scene_id, CAST(w.y - y0 AS INT) AS y, CAST(w.x - x0 AS INT) AS x, round(c13, 6) AS c13 FROM w JOIN bx ON w.scene_id = bx.scene_id WHERE w.y BETWEEN y0 AND y0 + height - 1 AND w.x BETWEEN x0 AND x0 + width - 1")
def g9(spark, sf):
    return spatial.clip_native(every(spark, sf), navigated(spark, sf), clips(spark, sf)).select("key", *KEYS, *r6("c13"))


def extent(spark, sf):
    """Rows for ``spatial.plan`` of each scene: the whole disk's extent is clipped to the Americas."""
    bounds = navigated(spark, sf).groupBy("scene_id").agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
    proj = F.struct(*[F.lit(v).alias(k) for k, v in grids.PROJ.items()])
    gt = F.array(*[F.lit(v) for v in (grids.X0, grids.DX, 0.0, grids.Y0, 0.0, grids.DY)])
    return bounds.withColumns({"proj": proj, "gt": spatial.safe_transform(gt, F.lit(32.0), F.lit(32.0))})


def planned(spark, sf):
    return spatial.plan(extent(spark, sf), F.lit(300.0), (-110.0, 50.0, -20.0, -40.0))


_PLAN = f"""{WIDE}, {NAV}, ex AS (SELECT scene_id, greatest(-40, min(lat)) AS lat_min, least(50, max(lat)) AS lat_max, greatest(-110, min(lon)) AS lon_min, least(-20, max(lon)) AS lon_max FROM nav GROUP BY 1),
 pl AS (SELECT *, 300.0::DOUBLE / (111.132954 - 0.559822 * cos(2 * radians((lat_min + lat_max) / 2))) AS cell FROM ex), pp AS (SELECT *, CAST(least(greatest(floor((lon_max - lon_min) / cell + 0.5), 10), 10000) AS INT) AS out_w, CAST(least(greatest(floor((lat_max - lat_min) / cell + 0.5), 10), 10000) AS INT) AS out_h FROM pl)"""
_SOURCE = _PLAN + """, t0 AS (SELECT pp.*, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x, radians(lat_max - (yy + 0.5) * ((lat_max - lat_min) / out_h)) AS la, radians(lon_min + (xx + 0.5) * ((lon_max - lon_min) / out_w)) - radians(-75.0::DOUBLE) AS dl FROM pp, range(0, 200) a(yy), range(0, 200) b(xx) WHERE yy < out_h AND xx < out_w),
 t1 AS (SELECT *, 6378137.0::DOUBLE * 6378137.0::DOUBLE AS a2, 6356752.31414::DOUBLE * 6356752.31414::DOUBLE AS b2, 42164160.0::DOUBLE AS h FROM t0), t2 AS (SELECT *, atan(b2 / a2 * tan(la)) AS pc FROM t1), t3 AS (SELECT *, 6356752.31414::DOUBLE / sqrt(1 - (a2 - b2) / a2 * cos(pc) * cos(pc)) AS rc FROM t2),
 t4 AS (SELECT *, h - rc * cos(pc) * cos(dl) AS sx_, -rc * cos(pc) * sin(dl) AS sy_, rc * sin(pc) AS sz_ FROM t3),
 t5 AS (SELECT scene_id, y, x, CASE WHEN h * (h - sx_) >= sy_ * sy_ + a2 / b2 * sz_ * sz_ THEN (asin(-sy_ / sqrt(sx_ * sx_ + sy_ * sy_ + sz_ * sz_)) + 0.16) / 0.01 END AS col, CASE WHEN h * (h - sx_) >= sy_ * sy_ + a2 / b2 * sz_ * sz_ THEN (atan2(sz_, sx_) - 0.16) / -0.01 END AS "row" FROM t4),
 t6 AS (SELECT *, coalesce(col >= 0 AND col < 31 AND "row" >= 0 AND "row" < 31, false) AS inside FROM t5)"""


@query("g4_plan", f"{_PLAN} SELECT scene_id, round(cell, 6) AS cell, out_w, out_h FROM pp")
def g4(spark, sf):
    return planned(spark, sf).select("scene_id", *r6("cell"), "out_w", "out_h")


@query("g1_c11_g13_reproject_nearest", f"{_SOURCE}, {_RGB} SELECT t6.scene_id, t6.y, t6.x, coalesce(i.r, 0) AS r FROM t6 LEFT JOIN i ON inside AND i.scene_id = t6.scene_id AND i.y = CAST(floor(\"row\" + 0.5) AS INT) AND i.x = CAST(floor(col + 0.5) AS INT)")
def g1(spark, sf):
    return spatial.reproject_nearest(rgb_image(spark, sf).select(*KEYS, "r"), planned(spark, sf), 32, 32, ["r"])


@query("g2_reproject_bilinear", f"""{_SOURCE}, {_RGB}, k AS (SELECT scene_id, y, x, unnest([0, 0, 1, 1]) AS oy, unnest([0, 1, 0, 1]) AS ox, floor("row") AS r0, floor(col) AS c0, "row" - floor("row") AS dr, col - floor(col) AS dc FROM t6 WHERE inside),
 kw AS (SELECT *, CASE WHEN oy = 1 THEN dr ELSE 1 - dr END * CASE WHEN ox = 1 THEN dc ELSE 1 - dc END AS wt FROM k), s AS (SELECT kw.scene_id, kw.y, kw.x, {', '.join(f'CASE WHEN count(i.{c}) = count(*) THEN CAST(least(greatest(floor(sum(wt * i.{c}) + 0.5), 0), 255) AS INT) END AS {c}' for c in 'rgb')} FROM kw LEFT JOIN i ON i.scene_id = kw.scene_id AND i.y = r0 + oy AND i.x = c0 + ox WHERE wt > 0 GROUP BY ALL)
 SELECT t6.scene_id, t6.y, t6.x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM t6 LEFT JOIN s USING (scene_id, y, x)""")
def g2(spark, sf):
    return spatial.reproject_bilinear(rgb_image(spark, sf), planned(spark, sf), 32, 32, ["r", "g", "b"])


@query("d11_reprojection_counters", f"{_SOURCE} SELECT scene_id, count(*) FILTER (inside) AS valid, count(*) FILTER (col IS NULL) AS off_horizon, count(*) FILTER (col IS NOT NULL AND NOT inside) AS out_of_bounds FROM t6 GROUP BY 1")
def d11(spark, sf):
    return spatial.counters(planned(spark, sf), 32, 32)


@query("g10_g11_g12_georeference", f"""{_PLAN} SELECT scene_id, round((-0.16 + 3 * 0.01::DOUBLE) * 35786023, 3) AS x_min, round((0.16 - 12 * 0.01::DOUBLE) * 35786023, 3) AS y_min, round(-0.16 + 3 * 0.01::DOUBLE, 6) AS gt0, round(0.01 / 2.0::DOUBLE, 6) AS gt1, round((lon_max - lon_min) / out_w, 6) AS geo1,
 'goes16' AS crs, 'EPSG:4326' AS crs_geo, '+proj=geos +h=35786023.0 +a=6378137.0 +b=6356752.31414 +lon_0=-75.0 +sweep=x' AS proj FROM pp""")
def g10(spark, sf):
    df = planned(spark, sf)
    box = spatial.native_bounds(F.col("gt"), F.col("proj")["sat_height"], F.lit(2), F.lit(3), F.lit(10), F.lit(12))
    out, geo = spatial.output_transform(F.col("gt"), 2, 3, 2), spatial.geographic_transform(*[F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max", "out_h", "out_w")])
    return df.select(
        "scene_id", F.round(box["x_min"], 3).alias("x_min"), F.round(box["y_min"], 3).alias("y_min"), F.round(out[0], 6).alias("gt0"), F.round(out[1], 6).alias("gt1"), F.round(geo[1], 6).alias("geo1"),
        spatial.crs_label(F.lit("G16"), F.lit(False)).alias("crs"), spatial.crs_label(F.lit("G16"), F.lit(True)).alias("crs_geo"), spatial.proj_string(F.col("proj")).alias("proj"),
    )


# --- metadata and sinks


@query("s25_reference_band", f"{RAW}, s AS (SELECT DISTINCT scene_id, band, CASE WHEN band <= 3 THEN 1.0 ELSE 2.0 END AS km FROM raw WHERE band IN (2, 13, 5)) SELECT scene_id, arg_min(band, -km * 100 + list_position([2, 13, 5], band)) AS coarse, arg_min(band, km * 100 + list_position([2, 13, 5], band)) AS fine FROM s GROUP BY 1")
def s25(spark, sf):
    scenes = grids.band_attributes(grids.raw(spark, sf))
    coarse = align.reference_band(scenes, [2, 13, 5]).withColumnRenamed("band", "coarse")
    return coarse.join(align.reference_band(scenes, [2, 13, 5], True).withColumnRenamed("band", "fine"), "scene_id")


@query("a16_alpha_by_index", f"{WIDE}, i AS (SELECT scene_id, {_q('c02', 0, 1)} AS v, CASE WHEN c01 IS NULL THEN 0 ELSE 255 END AS a FROM w) SELECT scene_id, v, CAST(min(a) AS INT) AS a FROM i GROUP BY ALL")
def a16(spark, sf):
    return products.alpha_by_index(every(spark, sf).select(*KEYS, P.quantise_channel(F.col("c02"), 0.0, 1.0).alias("v"), P.validity(F.col("c01")).alias("a")))


@query("a16_stored_palette", f"""{WIDE}, i AS (SELECT scene_id, {_q('c02', 0, 1)} AS v, CASE WHEN c01 IS NULL THEN 0 ELSE 255 END AS a FROM w), {_RAINBOW}, z AS (SELECT max(idx) AS top FROM rb),
 e AS (SELECT CAST(unnest(range(0, CASE WHEN top < 2 THEN 2 WHEN top < 4 THEN 4 WHEN top < 16 THEN 16 ELSE 256 END)) AS INT) AS idx, top FROM z)
 SELECT s.scene_id, e.idx, r, g, b, CAST(coalesce(m.a, 255) AS INT) AS a FROM e JOIN rb ON rb.idx = least(e.idx, top) CROSS JOIN (SELECT DISTINCT scene_id FROM i) s LEFT JOIN (SELECT scene_id, v, min(a) AS a FROM i GROUP BY ALL) m ON m.scene_id = s.scene_id AND m.v = e.idx""")
def a16_palette(spark, sf):
    image = every(spark, sf).select(*KEYS, P.quantise_channel(F.col("c02"), 0.0, 1.0).alias("v"), P.validity(F.col("c01")).alias("a"))
    return products.stored_palette(rainbow_table(spark, sf), image)


_UNKNOWN = "CASE WHEN sector <> 'unknown' THEN sector END"


@query("a18_tags", f"""{PARSED} SELECT name, concat_ws(';', 'datetime=' || strftime(start_ts, '%Y:%m:%d %H:%M:%S'), 'product=' || variable, 'satellite=' || satellite, 'scan_time=' || strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ'), 'sector=' || {_UNKNOWN}, 'tool=skyloom') AS tags FROM p""")
def a18(spark, sf):
    df = parsed(spark, sf).withColumns({"band": F.lit(None).cast("int"), "product": F.col("variable")})
    return df.select("name", tag_text(df))


def tag_text(df):
    pairs = F.array_sort(F.map_entries(names.tags(df)))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags")


@query("a18_colormap_tags", f"""{PARSED}, o AS (SELECT *, {_DIGIT} AS d, CAST(substr(channel, 2, 2) AS INT) AS b FROM p),
 v AS (SELECT *, [NULL, 1e-7, 1e6, 123456.5, 250, -0.000123456, 0, 1.5, 999999.5, -2.5e-5][d + 1] AS lo, [1e20, 3, 0.1, 100000, NULL, 99.25, 65536, 1234567.0, 0.3, 17.25][d + 1]::DOUBLE + b AS hi, CASE WHEN d <> 7 THEN 2 + d * b END AS size, ['K', '', NULL][d % 3 + 1] AS units FROM o)
 SELECT name, concat_ws(';', CASE WHEN b BETWEEN 1 AND 16 THEN 'band=' || channel END, CASE WHEN size IS NOT NULL THEN 'colormap_max=' || printf('%.6g', hi) END, CASE WHEN size IS NOT NULL THEN 'colormap_min=' || printf('%.6g', lo::DOUBLE) END, 'colormap_size=' || size,
 CASE WHEN size IS NOT NULL THEN 'colormap_units=' || nullif(units, '') END, 'satellite=' || satellite, 'sector=' || {_UNKNOWN}, 'tool=skyloom') AS tags FROM v""")
def a18_colormap(spark, sf):
    d, b = digit(), F.substring("channel", 2, 2).cast("int")
    pick = lambda *values: F.try_element_at(F.array(*[F.lit(v).cast("double") for v in values]), d + 1)
    low = pick(None, 1e-7, 1e6, 123456.5, 250, -0.000123456, 0, 1.5, 999999.5, -2.5e-5)
    high = pick(1e20, 3, 0.1, 100000, None, 99.25, 65536, 1234567.0, 0.3, 17.25) + b
    units = F.when(d % 3 == 0, "K").when(d % 3 == 1, "")
    df = parsed(spark, sf).withColumns({"band": b, "product": F.lit(None).cast("string"), "start_ts": F.lit(None).cast("timestamp"), "colormap_min": low, "colormap_max": high, "colormap_size": F.when(d != 7, 2 + d * b), "colormap_units": units})
    return df.select("name", tag_text(df))


@query("a20_a21_sidecar", f"""{PX}, m AS (SELECT scene_id, band, min(value) AS lo, max(value) AS hi FROM px GROUP BY ALL)
 SELECT scene_id, string_agg('C' || lpad(CAST(band AS VARCHAR), 2, '0') || ' ' || CASE WHEN band >= 7 THEN 'brightness_temperature K' ELSE 'reflectance unitless' END, ';' ORDER BY band) AS channels, round(sum(lo), 6) AS lows, round(sum(hi), 6) AS highs FROM m GROUP BY 1""")
def a20(spark, sf):
    meta = names.channel_metadata(measure.grid_stats(pixels(spark, sf), "scene_id", "band"))
    docs = meta.select("scene_id", names.sidecar(meta).alias("json"))
    fact = "name: string, quantity: string, min: double, max: double, unit: string"
    back = docs.withColumn("c", F.from_json("json", f"channels array<struct<{fact}>>")["channels"])
    total = lambda part: F.round(F.aggregate(F.transform("c", lambda x: x[part]), F.lit(0.0), lambda a, b: a + b), 6)
    return back.select("scene_id", F.array_join(F.transform("c", lambda x: F.concat_ws(" ", x["name"], x["quantity"], x["unit"])), ";").alias("channels"), total("min").alias("lows"), total("max").alias("highs"))


@query("a20_sidecar_document", f"""{PARSED}, o AS (SELECT *, {_DIGIT} AS d, CAST(substr(channel, 2, 2) AS INT) AS band FROM p),
 q AS (SELECT *, CASE d % 4 WHEN 0 THEN 'gray' WHEN 1 THEN 'rgb' WHEN 2 THEN '' END AS command, CASE WHEN d % 3 = 0 THEN 'geostationary' END AS crs, CASE WHEN d % 2 = 0 THEN '[' || CAST(d - 10.5::DOUBLE AS VARCHAR) || ',5.25,' || CAST(d + 10.5::DOUBLE AS VARCHAR) || ',20.0]' END AS box,
   CASE WHEN band BETWEEN 1 AND 16 THEN channel ELSE variable END AS ch, concat_ws(',', CASE WHEN d IN (1, 2) THEN '"gamma":1.5' END, CASE WHEN d % 2 = 0 THEN '"invert":' || CAST(d = 4 AS VARCHAR) END, CASE WHEN d = 3 THEN '"mode":"ash"' END, CASE WHEN d < 6 THEN '"tiles":' || d END) AS extra FROM o)
 SELECT name, '{{"tool":"skyloom","version":"3","satellite":"' || satellite || '"' || coalesce(',"sector":"' || {_UNKNOWN} || '"', '') || coalesce(',"timestamp":"' || strftime(start_ts, '%Y-%m-%dT%H:%M:00Z') || '"', '') || coalesce(',"product":"' || variable || '"', '') || coalesce(',"command":"' || nullif(command, '') || '"', '')
 || coalesce(',"crs":"' || crs || '"', '') || coalesce(',"bounds":' || box || ',"geometry":{{"projection":"' || coalesce(crs, '') || '","bbox":' || box || '}}', '')
 || coalesce(',"channels":[{{"name":"' || ch || '","quantity":"' || CASE WHEN variable = 'Phase' THEN 'raw_counts' WHEN band >= 7 THEN 'brightness_temperature' ELSE 'reflectance' END || '","min":' || CAST(band / 2.0::DOUBLE AS VARCHAR) || ',"max":' || CAST(band + 0.25::DOUBLE AS VARCHAR)
   || CASE WHEN variable = 'Phase' THEN '' WHEN band >= 7 THEN ',"unit":"K"' ELSE ',"unit":"unitless"' END || '}}]', '') || CASE WHEN extra <> '' THEN ',"enhancements":{{' || extra || '}}' ELSE '' END || '}}' AS document FROM q""")
def a20_document(spark, sf):
    d, b = digit(), F.substring("channel", 2, 2).cast("int")
    command = F.when(d % 4 == 0, "gray").when(d % 4 == 1, "rgb").when(d % 4 == 2, "")
    fact = names.channel_fact(b, b / F.lit(2.0), b + F.lit(0.25), F.col("variable"), F.col("variable") == "Phase")
    df = parsed(spark, sf).withColumns({"product": F.col("variable"), "command": command, "crs": F.when(d % 3 == 0, "geostationary"), "bounds": F.when(d % 2 == 0, F.array(d - F.lit(10.5), F.lit(5.25), d + F.lit(10.5), F.lit(20.0))), "channels": F.filter(F.array(fact), lambda x: x["name"].isNotNull())})
    df = df.withColumns({"gamma": F.when(d.isin(1, 2), 1.5), "invert": F.when(d % 2 == 0, d == 4), "mode": F.when(d == 3, "ash"), "tiles": F.when(d < 6, d)})
    return df.select("name", names.sidecar(df, ("gamma", "invert", "mode", "tiles")).alias("document"))


@query("a17_georeferences", f"{WIDE}, {_RGB} SELECT scene_id, CAST(max(y) + 1 AS INT) AS height, CAST(max(x) + 1 AS INT) AS width, -0.16::DOUBLE AS gt0, 0.01::DOUBLE AS gt1, 0.0::DOUBLE AS gt2, 0.16::DOUBLE AS gt3, 0.0::DOUBLE AS gt4, -0.01::DOUBLE AS gt5, 'geostationary' AS crs, CAST(3 AS INT) AS channels, CAST(0 AS INT) AS nodata FROM i GROUP BY 1")
def a17(spark, sf):
    df = extent(spark, sf).select("scene_id", F.col("gt").alias("transform"), spatial.crs_label(F.lit("unknown"), F.lit(False)).alias("crs"))
    out = products.georeferences(rgb_image(spark, sf), df, 0)
    return out.select("scene_id", "height", "width", *[F.col("transform")[k].alias(f"gt{k}") for k in range(6)], "crs", "channels", "nodata")


@query("f3_table_check", f"{PX} SELECT band AS channel, count(*) AS n_values, count(*) = 2 * (SELECT count(DISTINCT y) * count(DISTINCT x) FROM px) AS complete FROM px GROUP BY 1")
def f3(spark, sf):
    px = pixels(spark, sf)
    lut = px.select(F.col("band").alias("channel"), F.col("y").alias("i_s"), F.col("x").alias("i_v"), "scene_id")
    top = px.agg(F.countDistinct("y").alias("s"), F.countDistinct("x").alias("v"), F.lit(2).alias("a"))
    axes = px.select(F.col("band").alias("channel")).distinct().join(F.broadcast(top)).select("channel", F.explode(F.array("s", "v", "a")).alias("n"))
    return atmosphere.table_is_complete(lut, axes)


_TABLES = """hd AS (SELECT CAST(p_partkey AS BIGINT) AS table_id, CAST(p_partkey % 5 AS INT) AS channel, p_partkey // 5 % 9 AS kind FROM part),
 va AS (SELECT table_id, place, CASE WHEN place = 5 AND kind = 6 THEN 'NaN'::DOUBLE ELSE table_id / 4.0::DOUBLE + place END AS value FROM (SELECT *, unnest(range(0, CASE kind WHEN 4 THEN 11 WHEN 5 THEN 13 ELSE 12 END)) AS place FROM hd))"""


@query("f3_table_reader", f"""WITH {_TABLES}, f AS (SELECT *, CASE WHEN channel NOT BETWEEN 1 AND 3 THEN 'channel' WHEN kind IN (1, 2, 3) THEN 'axes' WHEN kind IN (4, 5) THEN 'size' WHEN kind = 6 THEN 'value' WHEN kind = 7 THEN 'place' END AS fault FROM hd)
 SELECT table_id, channel, fault, CAST(NULL AS INT) AS i_s, CAST(NULL AS INT) AS i_v, CAST(NULL AS INT) AS i_a, CAST(NULL AS DOUBLE) AS value FROM f WHERE fault IS NOT NULL
 UNION ALL SELECT table_id, channel, fault, CAST(place // 6 AS INT), CAST(place // 2 % 3 AS INT), CAST(place % 2 AS INT), value FROM f JOIN va USING (table_id) WHERE fault IS NULL""")
def f3_reader(spark, sf):
    return atmosphere.read_table(*stored_tables(spark, sf)).select("table_id", "channel", "fault", "lut.*")


def stored_tables(spark, sf):
    """Tables that parts stand for, good ones and ones with each fault."""
    k = F.col("p_partkey").cast("long")
    rows = grids.table(spark, sf, "part").select(k.alias("table_id"), (k % 5).cast("int").alias("channel"), F.expr("p_partkey div 5 % 9").alias("kind"))
    kind = F.col("kind")
    headers = rows.select("table_id", "channel", F.when(kind == 1, 0).when(kind == 2, 1001).otherwise(2).alias("n_s"), F.lit(3).alias("n_v"), F.when(kind != 3, 2).alias("n_a"))
    values = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.when(kind == 4, 10).when(kind == 5, 12).otherwise(11))))
    value = F.when((F.col("place") == 5) & (kind == 6), F.lit(float("nan"))).otherwise(F.col("table_id") / F.lit(4.0) + F.col("place"))
    return headers, values.select("table_id", F.when((kind == 7) & (F.col("place") == 3), 4).otherwise(F.col("place")).alias("place"), value.alias("value"))


ORACLE["p7_daynite"] = f"""{WIDE}, {VIEW}, {_DAY}, dc AS (SELECT scene_id, y, x, {_q('(' + _stretch_sql('rr') + ')', 0, 1)} AS r, {_q('(' + _stretch_sql('(bb * 0.465 + rr * 0.465 + n0 * 0.07)') + ')', 0, 1)} AS g, {_q('(' + _stretch_sql('bb') + ')', 0, 1)} AS b FROM day),
 {_NIGHT}, nc AS (SELECT nq.scene_id, nq.y, nq.x, {_NIGHT_RGB} FROM nq LEFT JOIN tb ON nq.t = tb.idx LEFT JOIN li ON nq.scene_id = li.scene_id AND nq.y = li.y AND nq.x = li.x), {_MASK.replace('c13 < 200', 'c13 < 263.15')},
 sh AS (SELECT scene_id, CASE WHEN count(*) FILTER (wt >= 0.5) = 0 THEN 100 ELSE 100.0::DOUBLE * count(*) FILTER (wt < 0.5) / count(*) END AS share FROM mk GROUP BY 1)
 SELECT mk.scene_id, mk.y, mk.x, {', '.join(f'CASE WHEN 100 - share > 0.1 THEN CAST(trunc(trunc(255 * wt) / 255.0::DOUBLE * nc.{c} + (1 - trunc(255 * wt) / 255.0::DOUBLE) * dc.{c}) AS INT) ELSE dc.{c} END AS {c}' for c in 'rgb')}
 FROM mk JOIN dc USING (scene_id, y, x) JOIN nc USING (scene_id, y, x) JOIN sh USING (scene_id)"""
