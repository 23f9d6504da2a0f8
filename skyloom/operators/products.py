"""Whole products from pixels to image rows, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixelwise as P
from ..sources import store
from . import algebra, composite, enhance, measure, palette
from .align import KEYS, to_wide


STRIP = 256  # rows of a scene that one task writes


def gray(pixels: DataFrame, expression: str, invert: bool = False, gamma: float = 1.0, minmax: tuple[float, float] | None = None, histogram: bool = False, clahe: tuple[int, int, float, int, int] | None = None, last: int = 255, missing: int = 0, alpha: bool = False) -> DataFrame:
    """8-bit view of a band or band expression: gamma, quantiser, histogram, tiled histogram, in that order.

    Without minmax the range is the valid one of each scene.  clahe: tiles_y, tiles_x, limit and the
    image's height and width.  What is read twice (values for their range, images for histograms) is written once.
    """
    wide = to_wide(pixels, algebra.required_bands(expression))
    values = algebra.band_expr(wide, expression).select(*KEYS, "value")
    if minmax is None:
        values = store.written(values)  # read for the range and for the image
        spread = measure.grid_stats(values, "scene_id").select("scene_id", F.col("vmin").alias("low"), F.col("vmax").alias("high"))
        values = store.with_facts(values, spread)
    else:
        values = values.withColumns({"low": F.lit(float(minmax[0])), "high": F.lit(float(minmax[1]))})
    low, high, v = F.col("low"), F.col("high"), F.col("value")
    if gamma > 0 and abs(gamma - 1) >= 1e-6:
        spread = F.coalesce(high - low, F.lit(0.0)) > 0
        values = values.withColumn("value", P.gamma(v, gamma, low, high)).withColumns({"low": F.when(spread, 0.0).otherwise(low), "high": F.when(spread, 1.0).otherwise(high)})
    image = values.select(*KEYS, P.quantise_gray(v, low, high, invert, last, missing).alias("v"), *([P.validity(v).alias("a")] if alpha else []))
    if histogram:
        image = enhance.equalise(image, ("v",))
    if clahe is not None:
        tiles_y, tiles_x, limit, height, width = clahe
        image = enhance.clahe(image, "v", height, width, tiles_y, tiles_x, limit)
    return image


def pseudocolor(pixels: DataFrame, expression: str, colours: DataFrame, **options) -> DataFrame:
    """A gray view in the colours of a palette (idx, r, g, b); never equalised."""
    image = gray(pixels, expression, **{k: v for k, v in options.items() if k not in ("histogram", "clahe", "alpha")})
    return palette.to_rgb(image, colours).select(*KEYS, "r", "g", "b")


def pseudocolor_of_file(pixels: DataFrame, expression: str, entries: DataFrame, file: str, **options) -> DataFrame:
    """The same in the index palette of one file of parsed colour lines: missing pixels show its N."""
    some = entries.where(F.col("file") == file)
    meta = palette.index_meta(some).select("size", "missing_at").first()  # one row of two numbers
    if meta is None:
        raise ValueError(f"{file} has no palette")
    places = {} if meta.missing_at is None else {"last": meta["size"] - 1, "missing": meta.missing_at}
    return pseudocolor(pixels, expression, palette.index_palette(some), **places, **options)


def rgb(pixels: DataFrame, recipe: str, **options) -> DataFrame:
    """A difference recipe by name, from long pixels."""
    found = composite.RECIPES[recipe]
    return found.compose(to_wide(pixels, list(found.bands)), **options)


def alpha_by_index(image: DataFrame) -> DataFrame:
    """(scene_id, v, a): least alpha of each palette index that occurs."""
    return image.groupBy("scene_id", "v").agg(F.min("a").alias("a"))


def stored_palette(colours: DataFrame, image: DataFrame | None = None) -> DataFrame:
    """(idx, r, g, b) of a palette (idx, r, g, b) as it is stored: padded to 2, 4, 16 or 256 entries with the
    last colour.  With an image (scene_id, v, a) a palette for each scene, with the least alpha of each
    index as a, 255 where an index does not occur."""
    padded = F.element_at(F.filter(F.array(*map(F.lit, (2, 4, 16, 256))), lambda k: k > F.col("top")), 1)
    top = colours.agg(F.max("idx").alias("top")).where("top < 256")
    entries = top.select("top", F.explode(F.sequence(F.lit(0), padded - 1)).alias("idx")).withColumn("from", F.least("idx", "top"))
    full = entries.join(colours.select(F.col("idx").alias("from"), "r", "g", "b"), "from").select("idx", "r", "g", "b")
    if image is None:
        return full
    scenes = image.select("scene_id").distinct().select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"))
    seen = alpha_by_index(image).select("scene_id", F.col("v").alias("idx"), "a")
    return scenes.join(full, "idx").join(seen, ["scene_id", "idx"], "left").select("scene_id", "idx", "r", "g", "b", F.coalesce("a", F.lit(255)).alias("a"))


def write_image(image: DataFrame, path: str) -> None:
    """Image rows as Parquet, a folder for each scene and in it a file for each strip of rows."""
    strip = F.expr(f"y div {STRIP}")
    image.repartition("scene_id", strip).sortWithinPartitions(*KEYS).write.partitionBy("scene_id").parquet(path)


def write_sidecar(metadata: DataFrame, path: str) -> None:
    """One JSON document for each row; NULL parts are left out."""
    metadata.write.json(path)


def georeferences(image: DataFrame, transforms: DataFrame, nodata: int | None = None) -> DataFrame:
    """One row per scene for a georeferenced image: transforms(scene_id, transform, crs) with the size,
    the number of channels and the nodata value."""
    channels = [c for c in image.columns if c not in KEYS]
    size = image.groupBy("scene_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return size.join(transforms, "scene_id", "left").withColumns({"channels": F.lit(len(channels)), "nodata": F.lit(nodata).cast("int")})


def write_georeferenced(image: DataFrame, transforms: DataFrame, path: str, nodata: int | None = None) -> None:
    """The image and its georeference side by side."""
    write_image(image, f"{path}/image")
    georeferences(image, transforms, nodata).write.parquet(f"{path}/georef")
