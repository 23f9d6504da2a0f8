"""Stored tables bucketed by tile of their grid, so that bands, geometry and images meet without a shuffle.

A grid is a raster with one navigation: its grid_id, a smallint, stands for satellite, sector and resolution,
and many scenes share it.  All tables here are bucketed by (grid_id, tile), a tile being TILE x TILE pixels;
a pixel's place in its tile is its cell.  The three have eight bytes, so that a hash join packs them into
one number; two tables with the same number of buckets are joined, and a table is grouped by anything that holds these two
columns, where their files lie.  A bucket has the tile of every scene, so the number of buckets is chosen
by bytes (see ``buckets_for``).  Joins on more columns than the bucketing has need
spark.sql.requireAllClusterKeysForCoPartition off, as in plans.settings; with it on the results are the
same and the plan shuffles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

PLACE = ("grid_id", "tile")
TILE = 64
BUCKET_BYTES = 256 << 20  # of stored pixels in a bucket


def buckets_for(stored_bytes: int, least: int = 8) -> int:
    """Buckets of at most BUCKET_BYTES for a table of the given size, tiles being dealt evenly."""
    return max(least, -(-stored_bytes // BUCKET_BYTES))


def tile_of(y: Column, x: Column, tile: int = TILE) -> Column:
    """Number of the tile of a pixel, the same on every grid; grids have at most 32,768 tiles a side."""
    return (F.floor(y / tile) * 32768 + F.floor(x / tile)).cast("int")


def cell_of(y: Column, x: Column, tile: int = TILE) -> Column:
    """Number of a pixel within its tile; tiles have at most 181 pixels a side."""
    return (F.pmod(y, F.lit(tile)) * tile + F.pmod(x, F.lit(tile))).cast("short")


def placed(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows with grid_id, y and x, and the tile and cell they are stored by."""
    if not 0 < tile <= 181:
        raise ValueError("tiles have 1 to 181 pixels a side")
    y, x = F.col("y"), F.col("x")
    return pixels.withColumns({"grid_id": F.col("grid_id").cast("short"), "tile": tile_of(y, x, tile), "cell": cell_of(y, x, tile)})


def write(rows: DataFrame, path: str, buckets: int, parts: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """rows with grid_id and tile as a table at path: a file for each bucket, in folders by ``parts``, in ``order``.

    Rows that come from tables with as many buckets are written where they are.  Null places make a
    bucket like others; an empty frame makes a table without files.
    """
    name = f"tiles_{uuid.uuid4().hex}"
    out = rows.repartition(buckets, *PLACE)
    if order or parts:
        out = out.sortWithinPartitions(*parts, *PLACE, *order)
    writer = out.write.format("parquet").option("path", path).bucketBy(buckets, *PLACE)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    store.made(path, name)
    return rows.sparkSession.table(name)


def read(spark: SparkSession, path: str, schema: str, buckets: int, parts: tuple[str, ...] = ()) -> DataFrame:
    """A table that an earlier session wrote: schema as DDL, with the columns of ``parts`` at its end."""
    name = f"tiles_{uuid.uuid4().hex}"
    by = f"PARTITIONED BY ({', '.join(parts)})" if parts else ""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet {by} CLUSTERED BY ({', '.join(PLACE)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    if parts:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def joined(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """rows with what a table of their grid (grid_id, tile, cell, ...) has for the pixel; NULL where it has none.

    A task holds the grid's part of one bucket in memory and streams the rows of all scenes past it.
    """
    return rows.join(grid.hint("shuffle_hash"), [*PLACE, "cell"], "left")
