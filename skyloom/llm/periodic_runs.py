"""Operator 12, periodic runs of words by an online sparse dynamic programme over diagonals.

Words are read from left to right.  Diagonal q (the lag) matches at a word that equals the one q
words before it; its match length is one more than at the word before, and a diagonal that stops
matching with length m emits the run of m + q words and period q at once, where that is long enough.

Which lags a word makes active: its earlier occurrences are told by their context of the last k
words, k = 8, 16, 32, ...  Of the occurrences with equal context only the nearest one can be a
smallest period of at most k words: in a run of smallest period q <= k (and 3 * q words or 24), a
context of k words recurs at multiples of q only, so the nearest occurrence is the one q before,
from word q + k of the run on until its end; and a diagonal that is the nearest for a word but not
for the next one has stopped matching, or else its stretch would have a smaller period and never
have been the nearest.  Each k therefore keeps one active lag a word, of more than k / 2 words where
k > 8, and a word is the end of a match of at least k words on it.  So the active lags of a
text are at most a few a word, also where one word fills the text, and all runs are found:
contexts double only while some recur.

A batch of rows is worked on at a time with numpy, each step for all its words; contexts never span
two rows.  Words are told apart by 64-bit hashes, and what is emitted is held against the words
themselves; rows where that fails are done again with exact names.  There is no shuffle.

Defined results: null and empty texts have no words, no run and the digests of empty strings; a
null doc_id leaves its text as it is (it has no checksum); repeated rows come back each; a text of
any length is one row, about 200 bytes a word; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import base

CONTEXT = 8
LEAST, TIMES = 24, 3
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """For each place of a text of n words the number of the original word that it takes."""
    at = np.arange(n)
    if doc_id is None or not n:
        return at
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return at
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def active_lags(name: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, words, lags) for each context length: the words with an active lag, in order of lag and word.

    ``name``: of each word, ``row``: its row, never falling.
    """
    k = CONTEXT
    if len(name) < k:
        return
    end = np.arange(k - 1, len(name))
    context = W.shingle_hashes(name, k)
    inside = row[end - (k - 1)] == row[end]
    end, context = end[inside], context[inside]
    while len(end):
        key = W.mix64(context + row[end].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        word = end[order[1:]][same]
        lag = word - end[order[:-1]][same]
        take = (lag <= k) & ((k == CONTEXT) | (lag > k // 2))
        word, lag = word[take], lag[take]
        order = np.lexsort((word, lag))
        yield k, word[order], lag[order]
        # only contexts that recur can be halves of longer ones that do
        again = np.zeros(len(end), bool)
        by_key = np.argsort(key, kind="stable")
        again[by_key[1:]] |= same
        again[by_key[:-1]] |= same
        end, context = end[again], context[again]
        at = np.searchsorted(end, end - k)
        both = (at < len(end)) & (end[np.minimum(at, len(end) - 1)] == end - k) & (row[end] == row[np.maximum(end - 2 * k + 1, 0)]) & (end >= 2 * k - 1)
        at, end = at[both], end[both]
        with np.errstate(over="ignore"):
            context = W.mix64(W.mix64(context[at]) * np.uint64(0xA24BAED4963EE407) + context[both])
        k *= 2


def emitted(name: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a batch, by start and then period; starts count in the batch."""
    found = []
    for k, word, lag in active_lags(name, row):
        if not len(word):
            continue
        stops = np.flatnonzero(np.concatenate([(word[1:] != word[:-1] + 1) | (lag[1:] != lag[:-1]) | (row[word[1:]] != row[word[:-1]]), [True]]))
        begins = np.concatenate([[0], stops[:-1] + 1])
        q = lag[stops]
        start = word[begins] - (k - 1) - q
        length = word[stops] + 1 - start
        long = length >= np.maximum(LEAST, TIMES * q)
        found.append((start[long], length[long], q[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def greatest(length: np.ndarray, period: np.ndarray) -> int:
    """The first run (they are in order of start and period) with the greatest length / period."""
    best = 0
    for i in np.flatnonzero(length / period >= (length / period).max() * (1 - 1e-12)).tolist():
        if int(length[i]) * int(period[best]) > int(length[best]) * int(period[i]):
            best = i
    return best


def _exact_names(text: str, taken: np.ndarray) -> np.ndarray:
    known: dict[bytes, int] = {}
    return W.mix64(np.array([known.setdefault(w, len(known)) for w in text.encode().split()], np.uint64)[taken])


def runs_of(part: pa.RecordBatch, rewrite: bool = True) -> Iterator[tuple]:
    """A row of RUNS for each row (doc_id, text) of a batch."""
    ids = part.column(0).to_pylist()
    w = W.split_words(part.column(1))
    size = np.diff(w.first)
    row = np.repeat(np.arange(len(size)), size)
    taken = [w.first[i] + planted(int(size[i]), ids[i] if rewrite else None) for i in range(len(ids))]
    source = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    name = w.hashes()[source]
    start, length, period = emitted(name, row)
    bound = np.searchsorted(start, w.first)
    for i, doc_id in enumerate(ids):
        a, b, first, n = bound[i], bound[i + 1], int(w.first[i]), int(size[i])
        s, m, q = start[a:b] - first, length[a:b], period[a:b]
        own = source[first : first + n]
        slices = lambda x, y: w.gather(own[x:y], 1)
        if any(slices(x, x + y - z) != slices(x + z, x + y) for x, y, z in zip(s.tolist(), m.tolist(), q.tolist(), strict=True)):
            s, m, q = emitted(_exact_names(part.column(1)[i].as_py(), own - first), np.zeros(n, np.int64))
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, s + q, 1)
        np.add.at(gone, s + m, -1)
        kept = own[np.cumsum(gone)[:n] == 0]
        report = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), m.tolist(), q.tolist(), strict=True))
        text = w.gather(kept, 1)[:-1] if len(kept) else b""
        g = greatest(m, q) if len(s) else None
        top = (None,) * 4 if g is None else (int(s[g]), int(m[g]), int(q[g]), 1000 * int(m[g]) // int(q[g]))
        yield doc_id, len(s), *top, hashlib.sha256(report.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text, list(zip(s.tolist(), m.tolist(), q.tolist(), strict=True))


def periodic_runs(docs: DataFrame, rewrite: bool = False, texts: bool = True) -> DataFrame:
    """A row a document as RUNS says; ``texts``: also the collapsed text and all runs.

    ``rewrite`` first repeats a part of about every tenth text, as the query's contract asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                rows = list(zip(*runs_of(part, rewrite), strict=True))
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                columns = [pa.array(c, kind) for c, kind in zip(rows, kinds, strict=False)]
                names = [x.split()[0] for x in RUNS.split(", ")]
                if texts:
                    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                    columns += [pa.array([t.decode() for t in rows[8]], pa.string()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in rows[9]], pa.list_(run_type))]
                    names += ["collapsed", "runs"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = RUNS + (", collapsed string, runs array<struct<start: long, length: long, period: long>>" if texts else "")
    return base(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
