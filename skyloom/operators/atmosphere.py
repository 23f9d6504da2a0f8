"""Rayleigh correction by table, its table's preparation, and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import RAD
from . import palette

#: Largest sun and view zenith of the table, start and end of the taper, cloud reflectance.
SUN_MAX, VIEW_MAX, TAPER, NIGHT, CLOUD = 87.68, 70.53, 70.0, 88.0, 0.20
AXES = ("s", "v", "a")
#: Channels that there are tables for, and the most points of an axis.
CHANNELS, MOST_POINTS = (1, 2, 3), 1000
SPECTRUM_BITS = 20  # a spectrum has less than 2^20 wavelengths


def cells(lut: DataFrame) -> DataFrame:
    """One row per cell of lut(channel, i_s, i_v, i_a, value) with its eight corners c000..c111.

    Cells at the upper ends repeat their last corner.
    """
    top = lut.groupBy("channel").agg(*[F.max(f"i_{x}").alias(f"n_{x}") for x in AXES])
    offsets = [(s, v, a) for s in (0, 1) for v in (0, 1) for a in (0, 1)]
    # each value is a corner of up to eight cells; at the top of an axis it is both corners
    flat = lut.join(F.broadcast(top), "channel").withColumn("d", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(v).alias("v"), F.lit(a).alias("a")) for s, v, a in offsets])))
    own = flat.select("channel", *[(F.col(f"i_{x}") - F.col(f"d.{x}")).alias(f"{x}0") for x in AXES], "d", "value").where("s0 >= 0 and v0 >= 0 and a0 >= 0")
    edge = flat.where(" or ".join(f"(d.{x} = 1 and i_{x} = n_{x})" for x in AXES))
    for x in AXES:
        at_top = (F.col(f"d.{x}") == 1) & (F.col(f"i_{x}") == F.col(f"n_{x}"))
        edge = edge.withColumn(f"{x}0", F.explode(F.when(at_top, F.array(F.col(f"i_{x}") - 1, F.col(f"i_{x}"))).otherwise(F.array(F.col(f"i_{x}") - F.col(f"d.{x}")))))
    edge = edge.where("s0 >= 0 and v0 >= 0 and a0 >= 0").select("channel", "s0", "v0", "a0", "d", "value")
    both = own.unionByName(edge).distinct()
    pick = lambda s, v, a: F.max(F.when((F.col("d.s") == s) & (F.col("d.v") == v) & (F.col("d.a") == a), F.col("value"))).alias(f"c{s}{v}{a}")
    return both.groupBy("channel", "s0", "v0", "a0").agg(*[pick(*o) for o in offsets])


def table_is_complete(lut: DataFrame, axes: DataFrame) -> DataFrame:
    """(channel, n_values, complete): whether the table has every cell of its axes(channel, axis, n)."""
    size = axes.groupBy("channel").agg(F.product("n").cast("long").alias("wanted"))
    have = lut.groupBy("channel").agg(F.count(F.lit(1)).alias("n_values"))
    return have.join(size, "channel", "left").select("channel", "n_values", F.coalesce(F.col("n_values") == F.col("wanted"), F.lit(False)).alias("complete"))


def read_table(headers: DataFrame, values: DataFrame) -> DataFrame:
    """Stored tables with what is wrong with each: (table_id, channel, fault, lut).

    headers(table_id, channel, n_s, n_v, n_a, and the axes' ends and steps) and values(table_id, place,
    value), place counting from 0 with the azimuth running fastest.  fault is NULL or the first of: no channel
    from 1 to 3, an axis without 1 to 1,000 points, too few or many values, a value that is missing or not
    finite, one that stands twice.  lut: the cells (i_s, i_v, i_a, value) of a good table's values, one row
    a value; a bad table has one row with NULL.
    """
    c = F.col
    finite = c("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    facts = values.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("good"), F.count_distinct("place").alias("places"), F.min("place").alias("first"), F.max("place").alias("last"))
    size = c("n_s").cast("long") * c("n_v") * c("n_a")
    sound = F.lit(True)
    for x in AXES:
        sound = sound & F.coalesce(c(f"n_{x}").between(1, MOST_POINTS), F.lit(False))
    fault = (
        F.when(~F.coalesce(c("channel").isin(*CHANNELS), F.lit(False)), "channel").when(~sound, "axes").when(F.coalesce("n", F.lit(0)) != size, "size")
        .when(c("good") != c("n"), "value").when((c("places") != c("n")) | (c("first") != 0) | (c("last") != size - 1), "place")
    )
    # values are exploded, so far more than the size of their files tells: neither side is ever broadcast
    checked = headers.join(facts.hint("shuffle_merge"), "table_id", "left").withColumn("fault", fault)
    bad = checked.where("fault is not null").select("table_id", "channel", "fault", F.lit(None).cast("struct<i_s: int, i_v: int, i_a: int, value: double>").alias("lut"))
    good = checked.where("fault is null").select("table_id", "channel", "fault", "n_v", "n_a").join(values.hint("shuffle_merge"), "table_id")
    cell = F.struct(F.expr("cast(place div (n_v * n_a) as int)").alias("i_s"), F.expr("cast(place div n_a % n_v as int)").alias("i_v"), F.expr("cast(place % n_a as int)").alias("i_a"), c("value").cast("double").alias("value"))
    return bad.unionByName(good.select("table_id", "channel", "fault", cell.alias("lut")))


def look_up(df: DataFrame, cell_table: DataFrame, channel: int, axes: dict[str, tuple[float, float, float]], out: str = "path") -> DataFrame:
    """Adds the table's trilinear value at (sec sza, sec vza, 180 - raa) to rows with sza, vza, raa.

    axes: (first, last, step) of s, v and a.  The cell table has a bounded number of rows (thousands
    per channel) and is broadcast.
    """
    c = F.col
    sun, view = F.least(F.greatest("sza", F.lit(0.0)), F.lit(SUN_MAX)), F.least(F.greatest("vza", F.lit(0.0)), F.lit(VIEW_MAX))
    turn = F.abs("raa")
    turn = 180.0 - F.when(turn > 180, 360 - turn).otherwise(turn)
    raw = {"s": 1 / F.cos(sun * RAD), "v": 1 / F.cos(view * RAD), "a": turn}
    df = df.withColumns({f"_{x}": (F.least(F.greatest(raw[x], F.lit(axes[x][0])), F.lit(axes[x][1])) - axes[x][0]) / axes[x][2] for x in AXES})
    # rounding first keeps the upper end of an axis from falling between two cells
    df = df.withColumns({f"{x}0": F.floor(F.round(c(f"_{x}"), 9)).cast("int") for x in AXES})
    df = df.withColumns({f"_{x}": c(f"_{x}") - c(f"{x}0") for x in AXES})
    keyed = F.broadcast(cell_table.where(c("channel") == channel).drop("channel"))
    df = df.join(keyed, ["s0", "v0", "a0"], "left")
    mix = lambda p, q, t: p * (1 - t) + q * t
    by_a = {(s, v): mix(c(f"c{s}{v}0"), c(f"c{s}{v}1"), c("_a")) for s in (0, 1) for v in (0, 1)}
    by_v = {s: mix(by_a[s, 0], by_a[s, 1], c("_v")) for s in (0, 1)}
    return df.withColumn(out, mix(by_v[0], by_v[1], c("_s"))).drop("s0", "v0", "a0", "_s", "_v", "_a", *[f"c{s}{v}{a}" for s in (0, 1) for v in (0, 1) for a in (0, 1)])


def corrected(v: Column, path: Column, sza: Column, red: Column | None = None) -> Column:
    """v less the table's path reflectance: tapered towards night, relaxed over bright clouds, at least 0.

    0 at night and without geometry; a missing pixel stays missing.
    """
    r = path * F.when(sza > TAPER, F.greatest(1 - (sza - TAPER) / (NIGHT - TAPER), F.lit(0.0))).otherwise(1.0)
    if red is not None:
        r = r * F.when(red >= CLOUD, F.greatest(1 - (red - CLOUD) / 0.80, F.lit(0.0))).otherwise(1.0)
    night = sza.isNull() | (sza < 0) | (sza > NIGHT)
    return F.when(v.isNull(), None).when(night, F.lit(0.0)).otherwise(F.greatest(v - r, F.lit(0.0)))


def statistics(df: DataFrame, before: str, after: str, sza: str = "sza") -> DataFrame:
    """Per scene: pixels at night, clamped and valid, means before and after, largest correction, range above 0."""
    b, a = F.col(before), F.col(after)
    night = F.col(sza).isNull() | (F.col(sza) < 0) | (F.col(sza) > NIGHT)
    day = b.isNotNull() & ~night
    return df.groupBy("scene_id").agg(
        F.count_if(b.isNotNull() & night).alias("n_night"), F.count_if(day & (a <= 0)).alias("n_clamped"), F.count_if(day).alias("n_valid"),
        F.avg(F.when(day, b)).alias("mean_before"), F.avg(F.when(day, a)).alias("mean_after"), F.max(F.when(day, b - a)).alias("max_correction"),
        F.min(F.when(a > 0, a)).alias("low"), F.max(F.when(a > 0, a)).alias("high"),
    )


def from_spectra(spectra: DataFrame, targets: DataFrame) -> DataFrame:
    """lut(channel, i_s, i_v, i_a, value) of spectra(wavelength, i_s, i_a, i_v, value) at targets(channel, wavelength).

    Linear between the wavelengths around the target, the end value beyond them.
    """
    node = ["i_s", "i_v", "i_a"]
    # a node's spectrum is one sorted array of points, searched by halving for each of the few targets
    lines = spectra.groupBy(*node).agg(F.array_sort(F.collect_list(F.struct(F.col("wavelength").cast("double").alias("w"), F.col("value").alias("v")))).alias("_points"))
    wanted = targets.agg(F.collect_list(F.struct("channel", F.col("wavelength").cast("double").alias("want")))).scalar()
    at = lines.select(*node, "_points", F.explode(wanted).alias("_t")).select(*node, "_points", "_t.*")
    n = palette.at_most(F.transform("_points", lambda p: p["w"]), F.col("want"), SPECTRUM_BITS)
    ends = at.withColumn("_n", n).withColumns({"_lo": F.when(F.col("_n") > 0, F.try_element_at("_points", F.greatest("_n", F.lit(1)))), "_hi": F.try_element_at("_points", F.col("_n") + 1)})
    w0, v0, w1, v1 = (F.col(c) for c in ("_lo.w", "_lo.v", "_hi.w", "_hi.v"))
    between = v0 + (F.col("want") - w0) / (w1 - w0) * (v1 - v0)
    value = F.when(w0.isNull(), v1).when(w1.isNull() | (w0 == F.col("want")), v0).otherwise(between)
    return ends.select("channel", *node, value.alias("value"))
