"""Operator 4, sharding by extendible hashing.

Every row has a hash; the directory is indexed by its leading bits.  A bucket whose rows weigh
more than the byte limit splits on one more bit, and only such buckets do, until each shard fits.
Built from sums alone: bytes are added up per hash prefix of ``STEP`` more bits at a time, only
prefixes that are still too heavy go on to longer ones, and every prefix that fits and whose
parent does not becomes a shard.  The directory grows with the shards, stays a table and is never
collected.  Rows whose whole hashes agree (repeated rows) cannot be told apart by bits: they are
cut by running weight, in slices that each fit.

The hash is the MD5 of the id and of the text, so rows that repeat an id are spread as well.

Defined results: null text weighs 0 bytes; a row heavier than the limit is alone in its shard
(oversize is true); an empty table has no shards; repeated rows each come back with their shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import base, written

LIMIT = 1 << 20
STEP = 8
BITS = 60
SALTS = 1024  # groups in which rows of one hash are numbered


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, bits): bits is the hash as a string of BITS binary digits."""
    digest = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    number = F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0")
    return base(docs, "doc_id", "text").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), number.alias("bits"))


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(prefix, depth, shard_bytes): every shard, its hash prefix and its weight.

    Prefixes at BITS may be heavier than the limit: their rows have one hash.
    """
    rows = rows.groupBy("bits").agg(F.sum("n_bytes").alias("n_bytes"))
    shards, heavy, depth = None, None, 0
    while depth <= BITS:
        depths = range(depth, min(depth + STEP, BITS + 1))
        level = F.explode(F.array(*[F.lit(d) for d in depths]))
        here = rows if heavy is None else rows.join(heavy.select(F.col("prefix").alias("root")).hint("shuffle_merge"), F.substring("bits", 1, depth - 1) == F.col("root"), "left_semi")
        # one sum per prefix of the longest depth, then the shorter ones from those sums
        cells = here.groupBy(F.substring("bits", 1, depths[-1]).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        sums = cells.withColumn("depth", level).groupBy(F.expr("substring(cell, 1, depth)").alias("prefix"), "depth").agg(F.sum("n_bytes").alias("shard_bytes"))
        sums = written(sums, "prefixes")
        parents = sums.where(F.col("shard_bytes") > limit).select("prefix", "depth")
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
        split = parents.select(F.col("prefix").alias("parent"), (F.col("depth") + 1).alias("depth"))
        own = fits.where(F.col("depth") > depth).join(split.hint("shuffle_merge"), ["parent", "depth"], "left_semi").unionByName(fits.where(F.col("depth") == depth)).select("prefix", "depth", "shard_bytes")
        shards = own if shards is None else shards.unionByName(own)
        heavy = parents.where(F.col("depth") == depths[-1])
        depth += STEP
        if depth > BITS or heavy.isEmpty():
            break
    return shards


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard_id, depth, shard_bytes, oversize) of every row.

    shard_id is the prefix in binary digits ("*" where one shard holds all), with a slice number
    where rows of one whole hash had to be cut.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = written(placed(docs).withColumn("salt", salt), "placed")
    found = written(directory(rows, limit), "directory")
    spread = [r.depth for r in found.select("depth").distinct().orderBy("depth").collect()]  # at most BITS + 1 numbers
    keys = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.substring("bits", 1, d).alias("prefix")) for d in spread]).cast("array<struct<depth:int,prefix:string>>"))
    tried = rows.withColumn("key", keys).select("doc_id", "n_bytes", "salt", F.col("key.depth").alias("depth"), F.col("key.prefix").alias("prefix"))
    joined = tried.join(found.hint("shuffle_merge"), ["depth", "prefix"])
    name = F.when(F.col("prefix") == "", F.lit("*")).otherwise(F.col("prefix"))
    light = joined.where(F.col("shard_bytes") <= limit).select("doc_id", "n_bytes", name.alias("shard_id"), "depth", "shard_bytes", F.lit(False).alias("oversize"))
    same = joined.where(F.col("shard_bytes") > limit)
    per = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(n_bytes, 1)"))
    # rows of one hash are equal, so slices of equal counts have equal weights; they are numbered within
    # each salt, after the rows of the salts before it
    counts = same.groupBy("prefix", "salt").agg(F.count(F.lit(1)).alias("rows"))
    by_salt = Window.partitionBy("prefix").orderBy("salt")
    before = F.sum("rows").over(by_salt) - F.col("rows")
    offsets = counts.select("prefix", "salt", before.alias("before"), F.sum("rows").over(Window.partitionBy("prefix")).alias("all"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("prefix", "salt").orderBy("doc_id")) - 1
    cut = same.join(offsets.hint("shuffle_merge"), ["prefix", "salt"]).withColumn("per", per).withColumn("slice", F.floor(rank / F.col("per")))
    weight = F.col("n_bytes") * F.least(F.col("per"), F.col("all") - F.col("slice") * F.col("per"))
    heavy = cut.withColumn("weight", weight.cast("long")).select("doc_id", "n_bytes", F.concat_ws(":", name, F.col("slice").cast("string")).alias("shard_id"), "depth", F.col("weight").alias("shard_bytes"), (F.col("n_bytes") > limit).alias("oversize"))
    return light.unionByName(heavy)
