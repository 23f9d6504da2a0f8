"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and
returns a DataFrame, which is written as Parquet and read again for the next.  All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup
from skyloom.llm.queries import PATTERN, RANKS
from skyloom.llm.scratch import dropped, shared_dir, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; null, letterless and undecided texts go."""
    return language_id.keep_identified(docs.select(*COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of exact copies: the document that the operator keeps, once; of rows that
    repeat its doc_id and text but for white space, one with most code points."""
    keep = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_digest")).distinct()
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), exact_dedup.SPACES, ""), 256)
    rows = docs.select(*COLUMNS, digest.alias("digest"))
    stay = rows.join(keep.hint("shuffle_merge"), (F.col("digest") == F.col("keep_digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("doc_id").alias("again"))
    if not repeated.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        first = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc(), *COLUMNS[1:]))
        once = stay.join(repeated, same, "left_semi").withColumn("place", first).where("place = 1").drop("place")
        stay = stay.join(repeated, same, "left_anti").unionByName(once)
    return stay.select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, 0.8); each row
    is judged by its own text, also where rows repeat a doc_id."""
    gone = written(near_dedup.near_dedup(docs).where("not kept").select("doc_id", "rid").distinct(), "gone")
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("rid"))
    return rows.join(gone.hint("shuffle_merge"), ["doc_id", "rid"], "left_anti").select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that a smaller document has; emptied ones go."""
    found = substring_dedup.cuts(docs).select("doc_id", "rid", "cut_text")
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("rid"))
    joined = rows.join(found.hint("shuffle_merge"), ["doc_id", "rid"], "left")
    text = F.coalesce("cut_text", "text")
    n_chars = F.when(F.col("cut_text").isNull(), F.col("n_chars")).otherwise(F.char_length("cut_text").cast("long"))
    return joined.where("cut_text is null or cut_text <> ''").select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.packed(docs, RANKS, PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("substring_dedup", substring),
    ("best_fit_packing", pack),
]

#: Compression, MinHash and tokenisation have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline/{name}-{uuid.uuid4().hex}"
        with dropped(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
