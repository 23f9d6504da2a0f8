"""Operator 6, quality rules: robust multivariate outliers among documents' statistics.

Each text gives five counts; their transformed vector (length, word length, symbols, repeated
lines, repeated words) is held against a minimum-covariance-determinant estimate of its language
and source.  The estimate is found by concentration steps over all rows, from one start (medians and
median deviations): distances under the present estimate are binned in Spark (sixteen bins for
each doubling, the last one in part), the ``SHARE`` of rows with the smallest distances gives the
next mean and covariance, and a group's steps go on, however many, until its determinant stops
falling.  Tests hold the verdicts against many random starts with exact distances.  Bins, sums and
products combine before the shuffle, so a source with a third of all rows is a few hundred rows.
Groups with fewer than ``LEAST`` rows use the estimate of their language, then that of all rows.

Defined results: null and empty texts have no words and fail the base rule; rows that fail it are
left out of the estimates; null languages and sources are groups of their own; where even all
rows are fewer than LEAST, the base rule alone decides; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import base, written

SHARE = 0.75
LEAST = 40
BROADCAST_ROWS = 10_000
CUTOFF = 30.86  # fixed value: quantile 0.99999 of chi-square with 5 degrees of freedom
QUANTILE_75 = 6.626  # fixed value: quantile 0.75 of the same
#: Least standard deviations: a clean collection has hardly any symbol or repeat, and one is no outlier.
FLOOR = (0.5, 0.1, 0.7, 0.7, 0.7)
N = 5
PAIRS = [(i, j) for i in range(N) for j in range(i, N)]
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                text = part.column(1)
                data, offsets = W.text_bytes(text)
                w = W.split_words(text)
                h, first = w.hashes(), w.first
                total = lambda x, at=offsets: (c := np.concatenate([[0], np.cumsum(x)]))[at[1:]] - c[at[:-1]]
                chars = total((data & 0xC0 != 0x80) & ~W._SPACE[data])
                symbols = total(_SYMBOL[data])
                mers = W.shingle_hashes(h, 8)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(mers)]
                inside = np.arange(len(mers)) + 8 <= first[owner + 1]
                at = np.flatnonzero(inside)
                key = W.mix64(mers[at] ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                twice = np.zeros(len(key), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                step = np.zeros(len(h) + 1, np.int64)
                np.add.at(step, at[twice], 1)
                np.add.at(step, at[twice] + 8, -1)
                repeat = total(np.cumsum(step)[:-1] > 0, first)
                lines = [_dup_lines(t.as_py().encode()) if t.is_valid else 0 for t in text]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2).cast(pa.string()), part.column(3).cast(pa.string()), *(pa.array(np.asarray(x), pa.int64()) for x in (np.diff(first), chars, symbols, lines, repeat))],
                    names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
                )

    return base(docs, "doc_id", "text", "lang", "source").mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with base_failed and, where that is false, the transformed vector x1..x5."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c: F.log1p(100.0 * F.col(c) / n)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "x1": F.log1p(n), "x2": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "x3": rate("n_symbols"), "x4": rate("n_dup_lines"), "x5": rate("n_repeat_words")})


def _keys() -> list:
    """Group names of a row, from its own group to all rows."""
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return [F.concat_ws("\x1f", tag("lang"), tag("source")), F.concat(F.lit("L"), tag("lang")), F.lit("A")]


ESTIMATE = "g string, n long, mean array<double>, inverse array<double>, spread double, logdet double"


def _estimate(g: str, n: int, mean: np.ndarray, cov: np.ndarray, spread: float) -> pd.DataFrame:
    """A row of ESTIMATE; standard deviations below FLOOR are raised to it."""
    low = np.maximum(np.square(FLOOR) - np.diag(cov), 0)
    cov = cov + np.diag(low)
    inverse = np.linalg.inv(cov)
    return pd.DataFrame({"g": [g], "n": [n], "mean": [mean.tolist()], "inverse": [[inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS]], "spread": [spread], "logdet": [float(np.linalg.slogdet(cov)[1])]})


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    row = pdf.iloc[0]
    return _estimate(row["g"], int(row["n"]), np.array(row["median"], float), np.diag(np.square(1.4826 * np.array(row["mad"], float))), 1.0)


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of one group from its bins of distances (a bounded number)."""
    pdf = pdf.sort_values("bin")
    count = pdf["count"].to_numpy(float)
    n = count.sum()
    h = max(SHARE * n, min(n, N + 1))
    share = np.clip((h - (np.cumsum(count) - count)) / count, 0, 1)
    weight = (share * count).sum()
    mean = (np.stack(pdf["sums"]) * share[:, None]).sum(axis=0) / weight
    second = (np.stack(pdf["products"]) * share[:, None]).sum(axis=0) / weight
    cov = np.zeros((N, N))
    for (i, j), v in zip(PAIRS, second, strict=True):
        cov[i, j] = cov[j, i] = v - mean[i] * mean[j]
    edge = 2.0 ** ((pdf["bin"].to_numpy()[np.flatnonzero(share > 0)[-1]] + 1) / 16)
    return _estimate(pdf["g"].iloc[0], int(n), mean, cov, max(1.0, edge / QUANTILE_75))


def _distance():
    """Squared Mahalanobis distance as a built-in expression over x1..x5, mean and inverse."""
    off = [F.col(f"x{i + 1}") - F.col("mean")[i] for i in range(N)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        out = out + off[i] * off[j] * F.col("inverse")[k]
    return out


def _with(rows: DataFrame, estimates: DataFrame, key: str) -> DataFrame:
    """rows with their group's estimate; a broadcast only behind a check of its size."""
    small = estimates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(estimates) if small else estimates.hint("shuffle_merge"), rows[key] == estimates["g"]).drop(estimates["g"])


def estimates(rows: DataFrame) -> DataFrame:
    """An ESTIMATE row for each group with LEAST rows; rows: x1..x5 and array keys."""
    x = [F.col(f"x{i + 1}") for i in range(N)]
    flat = rows.select(F.explode("keys").alias("key"), *x)
    large = written(flat.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.percentile_approx(c, 0.5, 1000) for c in x]).alias("median")).where(F.col("n") >= LEAST), "groups")
    centred = _with(flat, large.withColumnRenamed("key", "g"), "key")
    mads = [F.percentile_approx(F.abs(c - F.col("median")[i]), 0.5, 1000) for i, c in enumerate(x)]
    start = centred.groupBy(F.col("key").alias("g"), "n", "median").agg(F.array(*mads).alias("mad"))

    def step(now: DataFrame) -> DataFrame:
        near = _with(flat, now, "key").withColumn("d", _distance())
        bins = F.least(F.greatest(F.floor(16 * F.log2(F.col("d") + 1e-9)), F.lit(-200)), F.lit(600)).cast("int")
        binned = near.groupBy(F.col("key").alias("g"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.array(*[F.sum(c) for c in x]).alias("sums"), F.array(*[F.sum(x[i] * x[j]) for i, j in PAIRS]).alias("products"))
        return written(binned.groupBy("g").applyInPandas(_concentrate, ESTIMATE), "estimates")

    moving = step(written(start.groupBy("g").applyInPandas(_start, ESTIMATE), "estimates"))
    still = moving.limit(0)
    while not moving.isEmpty():  # determinants only fall, and the floors bound them from below
        then = step(moving).join(moving.select("g", F.col("logdet").alias("before")).hint("shuffle_merge"), "g")
        fell = written(then.where("logdet < before - 1e-3").drop("before"), "estimates")
        still = still.unionByName(moving.join(fell.select("g").hint("shuffle_merge"), "g", "left_anti"))
        moving = fell
    return written(still, "estimates")


def judged(docs: DataFrame) -> DataFrame:
    """Every row: (doc_id, counts, base_failed, distance, kept)."""
    rows = written(vectors(statistics(docs)), "statistics")
    keys = _keys()
    found = estimates(rows.where("not base_failed").withColumn("keys", F.array(*keys)))
    out = rows
    for level, key in enumerate(keys[:-1]):
        named = found.select(F.col("g").alias(f"g{level}"), F.struct("mean", "inverse", "spread").alias(f"e{level}"))
        keyed = out.withColumn("key", key)
        small = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        out = keyed.join(F.broadcast(named) if small else named.hint("shuffle_merge"), keyed["key"] == named[f"g{level}"], "left").drop("key", f"g{level}")
    whole = found.where("g = 'A'").first()  # one row of a few numbers
    numbers = [F.lit(None)] * 3 if whole is None else [F.array(*map(F.lit, whole["mean"])), F.array(*map(F.lit, whole["inverse"])), F.lit(whole["spread"])]
    kinds = ("array<double>", "array<double>", "double")
    out = out.withColumn("e2", F.struct(*[x.cast(k).alias(c) for x, k, c in zip(numbers, kinds, ("mean", "inverse", "spread"), strict=True)]))
    out = out.withColumn("e", F.coalesce("e0", "e1", "e2")).withColumns({"mean": F.col("e.mean"), "inverse": F.col("e.inverse"), "spread": F.col("e.spread")})
    distance = F.when(~F.col("base_failed"), _distance() / F.col("spread"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return out.withColumn("distance", distance).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
