"""Operator 2, language identification by compression with per-language dictionaries.

Each label is a raw-content zstandard dictionary of at most ``DICTIONARY`` bytes, cut from at most
``SAMPLE`` of its texts (drawn by a hash of id and text; of each at most ``EXCERPT`` characters,
from a place that depends on the hash; long texts fill a dictionary with about 110 of them).  That
bounded sample is all that is fitted.  All dictionaries together are at most ``TOTAL`` bytes: with
over 292 labels each gets less, none is left out.  A text is reduced to its letters in lower case,
cut into blocks so that the dictionary keeps its weight in long texts, and every block is
compressed with every dictionary; the language with the smallest total wins.  The margin is the
saving over the second language; a text is rejected below ``MARGIN``.

Defined results: null text, or text without a letter, is ``und`` with score 0 and is rejected;
so is everything when no labelled text was given.  Rows with null text or label teach nothing.
Equal totals go to the language first in name and are rejected.  Repeated rows each come back.
An empty table gives an empty result.  The label, source and id are never read when predicting.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import base

DICTIONARY = 112 << 10
SAMPLE = 600
EXCERPT = 1024
TOTAL = 32 << 20
LABELS = 50_000  # label counts that are broadcast; more are shuffled
BLOCK = 1024
SHORT = 256
LEVELS = ((6, 4), (12, 3))
PAD = b" " * 64  # compressible, so that a short block is not stored as it is for every language alike
MARGIN = 0.002
_OTHER = re.compile(r"[\W\d_]+")
_built: dict[int, dict[str, tuple[zstandard.ZstdCompressor, ...]]] = {}


def letters(text: str) -> bytes:
    """The words of letters of a text in lower case; empty if it has no letter."""
    out = _OTHER.sub(" ", text.lower()).strip()
    return out.encode() if any(map(str.isalpha, out)) else b""


def learn(docs: DataFrame) -> dict[str, bytes]:
    """The dictionary of each label, from a bounded sample of the labelled rows (doc_id, text, lang)."""
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 40))
    rows = base(docs, "doc_id", "text", "lang").where("text is not null and lang is not null").withColumn("draw", drawn)
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).cache()
    labels = counts.count()
    if not labels:
        return {}
    most = min(DICTIONARY, max(256, TOTAL // labels))
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.col("n"))
    start = 1 + F.pmod(F.xxhash64("doc_id", "text", F.lit("start")), F.greatest(F.lit(1), F.char_length("text") - EXCERPT + 1)).cast("int")
    small = F.broadcast(counts) if labels <= LABELS else counts.hint("shuffle_merge")
    some = rows.join(small, "lang").where(F.col("draw") < share * (1 << 40)).select("lang", "draw", F.substring(F.col("text"), start, F.lit(EXCERPT)).alias("part"))
    by_draw = Window.partitionBy("lang").orderBy("draw", "part")
    first = some.withColumn("place", F.row_number().over(by_draw)).where(F.col("place") <= SAMPLE)
    before = F.sum(F.octet_length("part")).over(Window.partitionBy("lang").orderBy("place")) - F.octet_length("part")
    pools: dict[str, list[bytes]] = {}
    for row in first.withColumn("before", before).where(F.col("before") < 2 * most).orderBy("lang", "place").collect():  # at most about twice the dictionaries
        pools.setdefault(row.lang, []).append(letters(row.part))
    counts.unpersist()
    return {lang: b" ".join(p for p in parts if p)[:most] for lang, parts in pools.items()}


def _compressors(dictionaries: dict[str, bytes]) -> dict[str, tuple[zstandard.ZstdCompressor, ...]]:
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _built:
        _built.clear()
        made = {}
        for lang, content in sorted(dictionaries.items()):
            pair = []
            for level, match in LEVELS:
                d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(level, min_match=match, dict_size=len(content), source_size=BLOCK, write_content_size=False, write_checksum=False, write_dict_id=False)
                d.precompute_compress(compression_params=how)
                pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
            made[lang] = tuple(pair)
        _built[key] = made
    return _built[key]


def sizes(data: bytes, compressors: dict[str, tuple[zstandard.ZstdCompressor, ...]]) -> dict[str, int]:
    """Compressed bytes of all blocks of a text with each language's dictionary."""
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return {lang: sum(len((short if len(b) < SHORT else usual).compress(b + PAD)) for b in blocks) for lang, (usual, short) in compressors.items()}


def decide(found: dict[str, int]) -> tuple[str, float, float]:
    """(language, score from 0 to 1, margin) of the sizes of a text."""
    first, *rest = sorted(found, key=lambda x: (found[x], x))
    margin = 1 - found[first] / found[rest[0]] if rest else 1.0
    return first, 1 - math.exp(-20 * margin), margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, margin, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(shared.value)
        for batch in batches:
            pred, score, margin = [], [], []
            for text in batch.column(1):
                data = letters(text.as_py()) if text.is_valid and compressors else b""
                p, s, m = decide(sizes(data, compressors)) if data else ("und", 0.0, 0.0)
                pred.append(p)
                score.append(s)
                margin.append(m)
            ok = pa.array([m >= MARGIN for m in margin], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), ok], names=["doc_id", "lang_pred", "score", "margin", "accepted"])

    return base(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of documents whose language is clear, with dictionaries from their own labels."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(shared.value)
        at = columns.index("text")
        for batch in batches:
            data = [letters(t.as_py()) if t.is_valid and compressors else b"" for t in batch.column(at)]
            yield batch.filter(pa.array([bool(d) and decide(sizes(d, compressors))[2] >= MARGIN for d in data], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
