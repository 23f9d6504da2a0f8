"""Colour tables: rainbow, files of colour lines, thresholds, and index images in colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_THRESHOLD = 254
MOST_ENTRIES = 511  # fixed value: colours of a file that count
WARM_LIMIT = 263.15  # fixed value: warmest cloud in kelvin; warmer pixels show the background


def rainbow(df: DataFrame, n: Column) -> DataFrame:
    """Adds r, g, b to rows (i): hues from blue to red over n entries, the last black."""
    hue = (1 - F.col("i") / (n - 1).cast("double")) * 240.0
    mid = F.floor((1 - F.abs((hue / 60) % 2 - 1)) * 255 + 0.5).cast("int")
    last = F.col("i") == n - 1
    low, high = F.lit(0), F.lit(255)
    pick = lambda a, b, c, d: F.when(last, low).when(hue < 60, a).when(hue < 120, b).when(hue < 180, c).otherwise(d)
    return df.withColumns({"r": pick(high, mid, low, low), "g": pick(mid, high, high, mid), "b": pick(low, low, mid, high)})


def threshold_colours(table: DataFrame) -> DataFrame:
    """(idx, r, g, b) in 0..255 of a table with parts of one, truncated."""
    return table.select("idx", *[(F.col(c) * 255).cast("int").alias(c) for c in ("r", "g", "b")])


def to_rgb(image: DataFrame, palette: DataFrame) -> DataFrame:
    """An index image in colour; indices outside the palette are black.  A palette has 256 rows at most."""
    joined = image.join(F.broadcast(palette.select(F.col("idx").alias("v"), "r", "g", "b")), "v", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("r", "g", "b")})


def at_most(rising: Column, value: Column, bits: int = 9) -> Column:
    """How many numbers of a rising array of less than 2^bits are at most the value, by a halving search."""
    halves = F.array(*[F.lit(1 << k) for k in range(bits - 1, -1, -1)])
    return F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.try_element_at(rising, at + step) <= value, at + step).otherwise(at))


def by_threshold(pixels: DataFrame, table: DataFrame, lights: DataFrame | None = None) -> DataFrame:
    """Night colours: the entry t with lo(t) <= value < lo(t+1); below all and above the last it is entry 254.

    table(idx, lo, r, g, b, a) has 257 rows at most, lo rising with idx; it is read as one array; missing pixels are
    black; where lights(scene_id, y, x, r, g, b) is given, warm pixels show it through.
    """
    lows = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lo"))), lambda s: s["lo"]).alias("lows")).scalar()
    value = F.col("value")
    pixels = pixels.withColumn("_lows", lows)
    at = at_most(F.col("_lows"), value) - 1
    inside = (at >= 0) & (at <= LAST_THRESHOLD)
    out = pixels.withColumn("idx", F.when(value.isNull(), None).when(inside, at).otherwise(F.lit(LAST_THRESHOLD))).drop("_lows")
    colours = F.broadcast(table.select("idx", *[F.col(c).alias(f"p_{c}") for c in "rgba"]))
    out = out.join(colours, "idx", "left")
    whole = {c: F.coalesce((F.col(f"p_{c}") * 255).cast("int"), F.lit(0)) for c in "rgb"}
    if lights is None:
        out = out.withColumns(whole)
    else:
        back = lights.select("scene_id", "y", "x", *[F.col(c).alias(f"l_{c}") for c in "rgb"])
        w = 1 - F.col("p_a")
        through = (value > WARM_LIMIT) & F.col("l_r").isNotNull()
        out = out.join(back, ["scene_id", "y", "x"], "left").withColumns({c: F.when(through, (whole[c] * (1 - w) + w * F.col(f"l_{c}")).cast("int")).otherwise(whole[c]) for c in "rgb"}).drop("l_r", "l_g", "l_b")
    return out.drop("p_r", "p_g", "p_b", "p_a", "idx")


def colour_of(values: DataFrame, pairs: DataFrame, background: tuple[int, int, int] | None = None, foreground: tuple[int, int, int] | None = None, table: str | None = None) -> DataFrame:
    """Colour of each value in a continuous table of pairs(lo, hi, r0, g0, b0, r1, g1, b1) that don't overlap.

    Below all pairs: the background; above: the foreground; both black if not given, as are gaps and
    missing values.  With ``table``, a column of both sides, each value is looked up in its own table of
    pairs and a value whose table does not exist is black.  A table has MOST_ENTRIES pairs at most and is
    one sorted array, searched by halving.
    """
    numbers = [F.col(c).cast("double").alias(c) for c in ("lo", "hi", "r0", "g0", "b0", "r1", "g1", "b1")]
    array = F.array_sort(F.collect_list(F.struct(*numbers))).alias("_pairs")
    if table is None:
        df = values.withColumn("_pairs", pairs.agg(array).scalar())
    else:
        df = values.join(pairs.groupBy(table).agg(array), table, "left")
    value = F.col("value")
    df = df.withColumn("_lows", F.transform("_pairs", lambda p: p["lo"]))
    df = df.withColumn("_at", at_most(F.col("_lows"), value))
    df = df.withColumns({"_p": F.when(F.col("_at") > 0, F.try_element_at("_pairs", F.greatest("_at", F.lit(1)))), "_end": F.try_element_at("_pairs", F.lit(-1)), "_start": F.try_element_at("_lows", F.lit(1))})
    t = (value - F.col("_p.lo")) / (F.col("_p.hi") - F.col("_p.lo"))
    out = {}
    for k, c in enumerate("rgb"):
        low, high = F.col(f"_p.{c}0"), F.col(f"_p.{c}1")
        between = F.when(value < F.col("_p.hi"), (low + t * (high - low)).cast("int"))
        below, above = (F.lit(x[k] if x else 0) for x in (background, foreground))
        out[c] = F.when(value < F.col("_start"), below).when(value > F.col("_end.hi"), above).when(value == F.col("_end.hi"), F.col(f"_end.{c}1").cast("int")).otherwise(F.coalesce(between, F.lit(0)))
    return df.select(*values.columns, *[out[c].cast("int").alias(c) for c in "rgb"])


def parse_lines(lines: DataFrame) -> DataFrame:
    """Colour-table lines (file, n, line) as entries (file, n, kind, lo, hi, r, g, b, r1, g1, b1, unit).

    kind: continuous (eight numbers), discrete (four numbers), B, F, N or unit (one word).  Numbers may
    also be joined by slashes, an extension.
    """
    line = F.trim("line")
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    fields = F.split(F.trim(F.regexp_replace(line, ";.*$", "")), r"[\s/]+")
    kind = (
        F.when(line.rlike(r"^#\s*UNIT\s*="), "unit")
        .when(line.rlike("^#") | (line == ""), None)
        .when(line.rlike(r"^[BFN]\s"), F.substring(line, 1, 1))
        .when((F.size(fields) >= 8) & line.rlike(f"^{number}"), "continuous")
        .when((F.size(fields) >= 4) & line.rlike(f"^{number}"), "discrete")
    )
    at = lambda k: F.try_element_at(fields, F.lit(k)).try_cast("double")
    out = lines.select("file", "n", kind.alias("kind"), F.nullif(F.regexp_extract(line, r"=\s*(\S+)", 1), F.lit("")).alias("unit"), *[at(k).alias(f"f{k}") for k in range(1, 9)]).where("kind is not null")
    c = F.col
    whole = lambda a: c(a).cast("int")
    return out.select(
        "file", "n", "kind",
        F.when(c("kind").isin("continuous", "discrete"), c("f1")).alias("lo"), F.when(c("kind") == "continuous", c("f5")).alias("hi"),
        whole("f2").alias("r"), whole("f3").alias("g"), whole("f4").alias("b"),
        F.when(c("kind") == "continuous", whole("f6")).alias("r1"), F.when(c("kind") == "continuous", whole("f7")).alias("g1"), F.when(c("kind") == "continuous", whole("f8")).alias("b1"),
        F.when(c("kind") == "unit", c("unit")).alias("unit"),
    )


def palette_meta(entries: DataFrame) -> DataFrame:
    """(file, discrete, n_entries, vmin, vmax, unit): facts of each file.

    The last colour line tells a discrete from a continuous file; a discrete line's value is also
    the end of the entry before it, so the first entry's value is the second line's.
    """
    colour = F.col("kind").isin("continuous", "discrete")
    w = Window.partitionBy("file").orderBy("n")
    later = F.lead("lo").over(w)
    colours = entries.where(colour).withColumn("value", F.when(F.col("kind") == "discrete", F.coalesce(later, F.col("lo"))).otherwise(F.col("lo")))
    facts = colours.groupBy("file").agg(
        (F.max_by("kind", "n") == "discrete").alias("discrete"), F.count(F.lit(1)).alias("n_entries"), F.min_by("value", "n").alias("vmin"), F.max_by(F.coalesce("hi", "value"), "n").alias("vmax")
    )
    units = entries.where("kind = 'unit'").groupBy("file").agg(F.max_by("unit", "n").alias("unit"))
    return facts.join(units, "file", "left")


def index_meta(entries: DataFrame) -> DataFrame:
    """(file, discrete, samples, size, foreground_at, missing_at, vmin, vmax, …) of each file's index palette.

    samples: the entries of a discrete file, 256 of a continuous one.  size adds an entry for F and one
    for N, 256 at most; F has the last but one place and N the last.  A file with fewer than two
    colours has no palette.
    """
    listed = _listed(entries)
    facts = listed.groupBy("file").agg((F.max_by("kind", "i") == "discrete").alias("discrete"), F.count(F.lit(1)).alias("n_entries"), F.min_by("value", "i").alias("vmin"), F.max_by("value", "i").alias("vmax"), F.max_by(F.struct("r", "g", "b"), "i").alias("end"))
    special = entries.where(F.col("kind").isin("B", "F", "N")).groupBy("file").agg(*[F.max_by(F.when(F.col("kind") == k, F.struct("r", "g", "b")), F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in "BFN"])
    out = facts.where("n_entries >= 2").join(special, "file", "left")
    out = out.withColumn("samples", F.when(F.col("discrete"), F.col("n_entries")).otherwise(F.lit(256)).cast("int"))
    out = out.withColumn("size", F.least(F.lit(256), F.col("samples") + F.col("F").isNotNull().cast("int") + F.col("N").isNotNull().cast("int")))
    return out.withColumns({"foreground_at": F.when(F.col("F").isNotNull(), F.col("size") - 2), "missing_at": F.when(F.col("N").isNotNull(), F.col("size") - 1)})


def _listed(entries: DataFrame) -> DataFrame:
    """(file, i, kind, value, r, g, b): a file's colours one by one; a continuous line has two, and a
    discrete line's value is also the end of the colour before it."""
    c = F.col
    one = F.struct(c("lo").alias("value"), "r", "g", "b")
    two = F.struct(c("hi").alias("value"), c("r1").alias("r"), c("g1").alias("g"), c("b1").alias("b"))
    flat = entries.where(c("kind").isin("continuous", "discrete")).select("file", "n", "kind", "lo", F.posexplode(F.when(c("kind") == "continuous", F.array(one, two)).otherwise(F.array(one))).alias("k", "e"))
    w = Window.partitionBy("file").orderBy("n", "k")
    later = F.lead(F.when(c("kind") == "discrete", c("lo"))).over(w)
    return flat.select("file", (F.row_number().over(w) - 1).alias("i"), "kind", F.coalesce(later, c("e.value")).alias("value"), "e.r", "e.g", "e.b").where(c("i") < MOST_ENTRIES)


def index_palette(entries: DataFrame) -> DataFrame:
    """(file, idx, r, g, b): the index palette of each file, for ``to_rgb``.

    A discrete file's colours keep their order; a continuous one is sampled at 256 even steps from its
    first to its last value.  F and N take their places after that; places without a colour show F,
    else B, else black.
    """
    c = F.col
    rows = index_meta(entries).withColumn("idx", F.explode(F.sequence(F.lit(0), c("size") - 1)))
    rows = rows.withColumn("value", F.when(~c("discrete") & (c("vmax") > c("vmin")), c("vmin") + (c("vmax") - c("vmin")) * c("idx") / 255.0))
    listed = _listed(entries)
    halves = [listed.where(c("i") % 2 == k).select("file", F.floor(c("i") / 2).alias("k"), c("value").alias(f"v{k}"), F.struct("r", "g", "b").alias(f"c{k}")) for k in (0, 1)]
    pairs = halves[0].join(halves[1], ["file", "k"])
    found = rows.select("file", "idx", "value").join(pairs, "file").where("value >= v0 and value < v1").groupBy("file", "idx").agg(F.min_by(F.struct("v0", "v1", "c0", "c1"), "k").alias("pair"))
    plain = listed.select("file", c("i").alias("idx"), F.struct("r", "g", "b").alias("own"))
    out = rows.join(found, ["file", "idx"], "left").join(plain, ["file", "idx"], "left")
    t = (c("value") - c("pair.v0")) / (c("pair.v1") - c("pair.v0"))
    empty = F.struct(*[F.lit(0).alias(x) for x in "rgb"])
    mixed = F.struct(*[(c(f"pair.c0.{x}") + t * (c(f"pair.c1.{x}") - c(f"pair.c0.{x}"))).cast("int").alias(x) for x in "rgb"])
    sample = F.when(c("discrete"), F.when(c("idx") < c("samples"), c("own"))).when(c("value") == c("vmax"), c("end")).when(c("pair").isNotNull(), mixed).when((c("vmax") > c("vmin")) | (c("idx") == 0), empty)
    colour = F.when(c("idx") == c("foreground_at"), c("F")).when(c("idx") == c("missing_at"), c("N")).otherwise(F.coalesce(sample, c("F"), c("B"), empty))
    return out.withColumn("colour", colour).select("file", "idx", *[c(f"colour.{x}").alias(x) for x in "rgb"])
