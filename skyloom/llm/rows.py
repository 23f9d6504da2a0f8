"""Rows of documents by a key, and the texts of those that a later step asks for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import base


def with_row_key(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, text); rid tells rows with one doc_id and different texts apart."""
    return base(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, rid, text) of the wanted rows (doc_id, rid).

    The texts are shuffled once whatever the number of wanted rows.  Rows that repeat both keys are
    thinned out where they are read, to one for each task that an adaptive plan splits a key into,
    and then to one.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
                new = np.concatenate([[last is None or bool((keys[:, 0] != last).any())], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
                last = keys[:, -1]
                yield batch.filter(pa.array(new))

    rows = with_row_key(docs).where("doc_id is not null")
    found = rows.join(wanted.hint("shuffle_merge"), ["doc_id", "rid"], "left_semi").mapInArrow(thin, rows.schema)
    return found.groupBy("doc_id", "rid").agg(F.first("text").alias("text"))
