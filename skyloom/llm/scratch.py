"""Tables written in the shared folder of the session, to cut lineage and to read a result twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: ContextVar[list[str] | None] = ContextVar("tables of the run at hand", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode only, where that is unset, a folder of our own."""
    have = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", have)
    return have


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropped(spark: SparkSession) -> Iterator[list[str]]:
    """The tables that this thread writes inside are deleted at the end; results must have been written
    or read whole by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def base(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever other columns the table has."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
