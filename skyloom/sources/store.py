"""Tables written once in the shared folder of the session, for frames that are read more than once.

The folder is spark.checkpoint.dir; where that is unset, a local master gets a folder of its own and a
cluster an error.  Results are read lazily, so tables stay until the ``dropped`` block around them ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("tables of the block at hand", default=None)
SALTS = 32  # parts that the pixels of one scene are dealt to when facts of the scene join them


def folder(spark: SparkSession) -> str:
    have = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{folder(spark)}/tables/raster-{uuid.uuid4().hex}"


def made(path: str, table: str | None = None) -> None:
    """Notes files, and the name they have in the catalog, for the ``dropped`` block at hand."""
    block = _made.get()
    if block is not None:
        block.append((path, table))


def written(df: DataFrame) -> DataFrame:
    """``df`` computed now, written as Parquet and read again: one computation, any number of reads."""
    path = fresh(df.sparkSession)
    made(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropped(spark: SparkSession) -> Iterator[list[tuple[str, str | None]]]:
    """Deletes at its end the tables that were written inside; write or read results whole by then."""
    block: list[tuple[str, str | None]] = []
    token = _made.set(block)
    try:
        yield block
    finally:
        _made.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path, table in block:
            if table is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def with_facts(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """Pixel rows joined with facts of their scene, or of other keys.

    The pixels of a key are dealt to SALTS tasks by y, each with its own copy of the facts; no side is
    broadcast by a hint, so a run with millions of scenes has a plan too.
    """
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.col("y"), F.lit(SALTS)).cast("int")).join(copies, [*(keys or ("scene_id",)), "_salt"]).drop("_salt")
