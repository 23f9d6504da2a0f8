"""Facts in scene file names, sibling files, clips, output names, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.grids import CLIPS

#: Part of a file name and the variable that holds its data; the first that fits wins.
VARIABLES = (("L1b", "Rad"), ("CMIP", "CMI"), ("ACHA", "HT"), ("ACHT", "TEMP"), ("ACTP", "Phase"), ("CTP", "PRES"), ("LST", "LST"), ("SST", "SST"), ("AOD", "AOD"))
#: Order in which satellites are looked for without an underscore.
FALLBACK = (16, 18, 17, 19)
#: Sectors and the parts of a file name that tell them.
SECTORS = (("m1", ("RadM1", "CMIPM1")), ("m2", ("RadM2", "CMIPM2")), ("conus", ("RadC-", "CMIPC-")), ("fd", ("RadF-", "CMIPF-")))
VERSION = "3"
#: Operations in the order of an output name, with their keys.
OPERATIONS = (("invert", "inv"), ("rayleigh", "ray"), ("histogram", "histo"), ("clahe", "clahe"))


def satellite(name: Column) -> Column:
    after = F.regexp_extract(name, r"^.*?(_G(?:16|17|18|19)?)", 1)
    out = F.when(F.length(after) == 4, F.substring(after, 2, 3))
    for n in FALLBACK:
        out = out.when(name.contains(f"G{n}") | name.contains(f"GOES{n}") | name.contains(f"GOES-{n}"), f"G{n}")
    return out.otherwise("unknown")


def sector(name: Column) -> Column:
    out = None
    for label, parts in SECTORS:
        hit = name.contains(parts[0]) | name.contains(parts[1])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("unknown")


def variable(name: Column) -> Column:
    out = None
    for part, var in VARIABLES:
        out = F.when(name.contains(part), var) if out is None else out.when(name.contains(part), var)
    return out


def parse_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds the facts of a file name; NULL where the name does not tell."""
    n = F.col(name)
    out = files.withColumns({"satellite": satellite(n), "sector": sector(n), "variable": variable(n), "stamp": F.nullif(F.regexp_extract(n, r"_s(\d{13,14})", 1), F.lit(""))})
    day = F.try_to_timestamp(F.substring("stamp", 1, 11), F.lit("yyyyDDDHHmm"))
    return out.withColumns(
        {
            "level": F.when(F.col("variable").isNull(), None).when(F.col("variable") == "Rad", "L1b").otherwise("L2"),
            "is_l2_image": n.contains("CMIP"),
            "token": F.when(F.col("stamp").isNotNull(), F.concat(F.lit("s"), F.substring("stamp", 1, 10))),
            "scan_mode": F.coalesce(F.nullif(F.regexp_extract(n, r"-(M[0-9])C", 1), F.lit("")), F.lit("M6")),
            "channel": F.concat(F.lit("C"), F.coalesce(F.nullif(F.regexp_extract(n, r"M[36]C(\d\d)", 1), F.lit("")), F.lit("00"))),
            "start_ts": day,
        }
    )


def resolution_km(text: Column) -> Column:
    """Kilometres that an attribute starts with, 0 if it does not."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([0-9.]+)km", 1).try_cast("double"), F.lit(0.0))


def axis_transform(x_first: Column, x_step: Column, y_first: Column, y_step: Column) -> Column:
    """Transform from the centres of the first pixels and the signed steps."""
    return F.array(x_first - x_step / 2, x_step, F.lit(0.0), y_first - y_step / 2, F.lit(0.0), y_step)


def siblings(catalog: DataFrame, anchors: DataFrame, bands: list[int], compat: bool = False) -> DataFrame:
    """Files of the same scan as each anchor for the wanted bands: (anchor, band, path, complete).

    Both tables come from ``parse_names``.  compat matches to ten minutes whatever the satellite.
    """
    keys = ["product", "scan_mode", "token"] if compat else ["product", "scan_mode", "stamp", "satellite", "sector"]
    product = F.when(F.col("is_l2_image"), "L2-CMI").when(F.col("level") == "L1b", "L1b-Rad").alias("product")
    side = lambda df, *more: df.where("stamp is not null").select(product, *[k for k in keys if k != "product"], *more)
    left = side(anchors, F.col("name").alias("anchor")).where("product is not null").distinct()
    files = side(catalog, F.substring("channel", 2, 2).cast("int").alias("band"), F.col("name").alias("path")).where(F.col("band").isin(bands))
    files = files.groupBy(*keys, "band").agg(F.max("path").alias("path"))
    wanted = left.withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    out = wanted.join(files, [*keys, "band"], "left")
    complete = F.count("path").over(Window.partitionBy("anchor")) == len(bands)
    return out.select("anchor", "band", "path", complete.alias("complete"))


def without_header(lines: DataFrame) -> DataFrame:
    """lines (n, line) of a clip file less its first one, where that has the word clave."""
    top = lines.agg(F.min("n")).scalar()
    return lines.where(~(F.col("line").contains("clave") & (F.col("n") == top)))


def clip_table(lines: DataFrame) -> DataFrame:
    """Named boxes of the lines of a clip file: rows without a key go, bad numbers become NULL."""
    return without_header(lines).select(F.from_csv("line", CLIPS).alias("c")).select("c.*").where("key is not null")


def load_clips(spark: SparkSession, path: str) -> DataFrame:
    """Named boxes of a CSV file, with or without a header."""
    return clip_table(clip_lines(spark, path))


def clip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a CSV file of clips; n rises with the place in the file."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(place.alias("n"), F.col("value").alias("line"))


def find_clips(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, region, ul_x, ul_y, lr_x, lr_y) of each key: the first of the lines (n, line) that has it.

    A first line with the word clave is a header.  Empty fields are skipped; numbers that are missing
    or do not start with one are 0.  A key without a line has found false and NULL for the rest.
    """
    fields = F.filter(F.split(F.regexp_replace("line", r"[\r\n]+$", ""), ","), lambda x: x != "")
    text = lambda k: F.try_element_at("fields", F.lit(k))
    number = lambda k: F.coalesce(F.regexp_extract(text(k), r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    rows = without_header(lines).withColumn("fields", fields)
    clip = F.struct(text(2).alias("region"), *[number(k).alias(c) for k, c in ((3, "ul_x"), (4, "ul_y"), (5, "lr_x"), (6, "lr_y"))])
    first = rows.where(text(1).isNotNull()).groupBy(text(1).alias("key")).agg(F.min_by(clip, "n").alias("clip"))
    out = keys.select("key").join(first, "key", "left")
    return out.select("key", F.col("clip").isNotNull().alias("found"), *[F.col(f"clip.{c}").alias(c) for c in ("region", "ul_x", "ul_y", "lr_x", "lr_y")])


def list_clips(clips: DataFrame) -> DataFrame:
    return clips.withColumn("usable", F.expr("ul_x is not null and ul_y is not null and lr_x is not null and lr_y is not null")).orderBy("key")


def name_satellite(name: Column) -> Column:
    """The satellite in a template: the two digits after the first _G, GXX without them."""
    digits = F.regexp_extract(name, r"^.*?_G(.{0,2})", 1)
    return F.when(digits.rlike("^[0-9]{2}$"), F.concat(F.lit("G"), digits)).otherwise("GXX")


def expand_template(pattern: str, df: DataFrame, out: str = "output", label: Column | None = None) -> DataFrame:
    """Adds the pattern with its tokens replaced by a parsed name's facts; unchanged without a stamp.

    label: what {PROD} stands for, nothing where it is left out or NULL; an unknown sector is empty.
    """
    at = lambda fmt: F.date_format("start_ts", fmt)
    seconds = F.rpad(F.substring("stamp", 12, 2), 2, "0")
    tokens = {"{YYYY}": at("yyyy"), "{YY}": at("yy"), "{MM}": at("MM"), "{DD}": at("dd"), "{hh}": at("HH"), "{mm}": at("mm"), "{ss}": seconds, "{TS}": at("yyyyDDDHHmm"), "{JJJ}": at("DDD"), "{CH}": F.col("channel")}
    tokens |= {"{SAT}": name_satellite(F.col("name")), "{SECTOR}": F.when(F.col("sector") == "unknown", "").otherwise(F.coalesce("sector", F.lit(""))), "{PROD}": F.coalesce(F.lit("") if label is None else label, F.lit(""))}
    text = F.lit(pattern)
    for token, value in tokens.items():
        text = F.replace(text, F.lit(token), value)
    return df.withColumn(out, F.when(F.col("start_ts").isNull(), F.lit(pattern)).otherwise(text))


def operations(df: DataFrame) -> Column:
    """Operations of rows with invert, rayleigh, histogram, clahe, gamma, clip, stretch, geo, joined by two underscores."""
    parts = [F.when(F.col(key), label) for key, label in OPERATIONS]
    parts.append(F.when(F.abs(F.col("gamma") - 1) > 0.01, F.concat(F.lit("g"), F.replace(F.format_string("%.1f", "gamma"), F.lit("."), F.lit("p")))))
    parts += [F.when(F.col(key), label) for key, label in (("clip", "clip"), ("stretch", "str"), ("geo", "geo"))]
    return F.concat_ws("__", *parts)


def product_type(command: Column, mode: Column) -> Column:
    """The type in an automatic name: gray, pseudo, an RGB mode of its own or rgb, else the command; output without one."""
    own = mode.isNotNull() & ~mode.isin("", "truecolor", "composite")
    return F.when(command == "gray", "gray").when(command == "pseudocolor", "pseudo").when(command == "rgb", F.when(own, mode).otherwise("rgb")).otherwise(F.coalesce(F.nullif(command, F.lit("")), F.lit("output")))


def automatic_name(df: DataFrame, extension: str, prefix: str = "sky") -> DataFrame:
    """Adds name: prefix, satellite, sector, time, type, band and operations, those that there are.

    Rows have command and mode, from which the type follows; the names of RGB products have no band.
    """
    sat = F.when(F.col("satellite") == "unknown", "GXX").otherwise(F.coalesce("satellite", F.lit("GXX")))
    when = F.coalesce(F.date_format("start_ts", "yyyyDDD_HHmm"), F.lit("NA"))
    sec = F.when(F.col("sector") != "unknown", F.nullif("sector", F.lit("")))
    band = F.when(~F.col("command").eqNullSafe("rgb"), F.nullif("band_name", F.lit("")))
    ops = F.nullif(operations(df), F.lit(""))
    return df.withColumn("name", F.concat(F.concat_ws("_", F.lit(prefix), sat, sec, when, product_type(F.col("command"), F.col("mode")), band, ops), F.lit(extension)))


def with_suffix(name: Column, suffix: str = "_geo", extension: str | None = None) -> Column:
    """The suffix put before the extension, and the extension replaced where one is given."""
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    return F.concat(stem, F.lit(suffix), F.lit(extension) if extension else F.substr(name, F.length(stem) + 1))


def label_parts(label: Column) -> Column:
    """short:Long as a struct; without a colon both are the label."""
    short = F.substring_index(label, ":", 1)
    return F.struct(short.alias("short"), F.when(label.contains(":"), F.substring(label, F.length(short) + 2, F.length(label))).otherwise(label).alias("long"))


def quantity(band: Column, categorical: Column | None = None) -> Column:
    """Quantity and unit of a channel; counts of a categorical one have no unit."""
    known = lambda q, u: F.struct(F.lit(q).alias("quantity"), F.lit(u).alias("unit"))
    counts = F.struct(F.lit("raw_counts").alias("quantity"), F.lit(None).cast("string").alias("unit"))
    plain = F.when(band >= 7, known("brightness_temperature", "K")).otherwise(known("reflectance", "unitless"))
    return plain if categorical is None else F.when(categorical, counts).otherwise(plain)


def channel_fact(band: Column, low: Column, high: Column, variable: Column | None = None, categorical: Column | None = None) -> Column:
    """Facts of a channel; one without a band number from 1 to 16 is named by its variable."""
    name = F.when(band.between(1, 16), F.format_string("C%02d", band))
    what = quantity(band, categorical)
    return F.struct((name if variable is None else name.otherwise(variable)).alias("name"), what["quantity"].alias("quantity"), low.alias("min"), high.alias("max"), what["unit"].alias("unit"))


def channel_metadata(stats: DataFrame) -> DataFrame:
    """(scene_id, channels): an array of facts per scene from grid statistics per band, by band.

    stats may have variable and categorical, for channels without a band or of codes.
    """
    more = {k: F.col(k) for k in ("variable", "categorical") if k in stats.columns}
    fact = channel_fact(F.col("band"), F.col("vmin"), F.col("vmax"), **more)
    ordered = F.array_sort(F.collect_list(F.struct("band", fact.alias("fact"))))
    return stats.groupBy("scene_id").agg(F.transform(ordered, lambda c: c["fact"]).alias("channels"))


def six_digits(v: Column) -> Column:
    """A number with six significant digits and no trailing zeros, in powers of ten below 1e-4 and from 1e6 on.

    Between these, a tie of the number's shortest decimal form goes to the even digit.
    """
    v = v.cast("double")
    text = F.format_string("%.5e", v)
    power = F.regexp_extract(text, "e([-+][0-9]+)$", 1).try_cast("int")
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.lit(None).cast("string")
    for k in range(-4, 6):
        plain = F.when(power == k, trimmed(F.bround(v.try_cast("decimal(38,24)"), 5 - k).cast("string"))).otherwise(plain)
    large = F.concat(trimmed(F.regexp_extract(text, "^([^e]*)e", 1)), F.regexp_extract(text, "(e.*)$", 1))
    odd = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.when(v.isNull(), None).when(F.isnan(v) | (F.abs(v) == float("inf")), odd).otherwise(F.coalesce(plain, large))


def tags(df: DataFrame, tool: str = "skyloom") -> Column:
    """Tags of rows with satellite, sector, band, start_ts, product; those without a value are left out.

    An unknown sector is left out.  Rows with colormap_size (and colormap_min, colormap_max,
    colormap_units) get the tags of their colours where that is not NULL.
    """
    pairs = {
        "tool": F.lit(tool), "satellite": F.col("satellite"), "sector": F.when(F.col("sector") != "unknown", F.nullif("sector", F.lit(""))), "band": F.when(F.col("band").between(1, 16), F.format_string("C%02d", "band")),
        "scan_time": F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "datetime": F.date_format("start_ts", "yyyy:MM:dd HH:mm:ss"), "product": F.col("product"),
    }
    if "colormap_size" in df.columns:
        coloured = {"min": six_digits(F.col("colormap_min")), "max": six_digits(F.col("colormap_max")), "size": F.col("colormap_size").cast("string"), "units": F.nullif("colormap_units", F.lit(""))}
        pairs |= {f"colormap_{k}": F.when(F.col("colormap_size").isNotNull(), v) for k, v in coloured.items()}
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def sidecar(df: DataFrame, enhancements: tuple[str, ...] = (), tool: str = "skyloom") -> Column:
    """JSON document of a row: tool, version, satellite, sector, timestamp, product, command, crs, bounds,
    geometry, channels and enhancements (the named columns, each with its own type).

    Columns that a row does not have, and parts that are NULL or empty, are left out; bounds make a
    geometry, whose projection is the crs or empty.
    """
    column = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    text = lambda c: F.nullif(column(c), F.lit(""))
    bounds = column("bounds", "array<double>")
    geometry = F.when(bounds.isNotNull(), F.struct(F.coalesce(text("crs"), F.lit("")).alias("projection"), bounds.alias("bbox")))
    parts = {"tool": F.lit(tool), "version": F.lit(VERSION), "satellite": text("satellite"), "sector": F.when(text("sector") != "unknown", text("sector")), "timestamp": F.date_format(column("start_ts", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    parts |= {"product": text("product"), "command": text("command"), "crs": text("crs"), "bounds": bounds, "geometry": geometry}
    if "channels" in df.columns:
        parts["channels"] = F.when(F.size("channels") > 0, F.col("channels"))
    if enhancements:
        parts["enhancements"] = F.when(F.coalesce(*[F.col(c).cast("string") for c in enhancements]).isNotNull(), F.struct(*enhancements))
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))
