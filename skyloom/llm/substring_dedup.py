"""Operator 10, repeated passages by compaction of a sparse De Bruijn graph of word k-mers.

The nodes are the k-mers that are smallest by hash in some window of ``WINDOW`` words (so each
window has exactly one, and equal windows have the same); the edges are the stretches of text
whose windows share a node.  A stretch is named by the BLAKE2b digest of its words, and its
windows and source coordinate (document, first window) are one row, about one for every twenty
words.

1. Nodes that a single document has are dropped: about nine rows in ten go here.
2. Parallel edges compact by a grouping: equal stretches keep their smallest document.
3. Repeated edges compact into paths through joins: each occurrence is joined with the one that
   starts where it ends; where all occurrences of an edge go on in the same edge, and all of that
   one come from it, the two do not branch.  Chains of such edges are folded to their first edge
   by pointer doubling, and an occurrence of a path is one long repeated span with its source.
4. Edges at nodes that branch (passages that end, begin or were edited there) are expanded to their
   single windows, but only for the smallest document of each distinct edge: the others are
   settled by it.  Windows, named by the digest of their words, are grouped once more.
5. Repeated windows become word spans per document and are cut from its text.

A repeat counts only where the digest of the words read at its source coordinate equals that of
its own words, so it is told by the words; hashes only choose the nodes.

Skew: a passage or line that a third of all documents share is one group of rows that combine
before the shuffle (minimum, maximum and count only); joins back are splittable by the adaptive
plan; no pair of occurrences is ever made.  Texts are shuffled once, to fetch those with shared
stretches; no side of a join is broadcast, so plans are the same at every size.

Defined results: null and empty texts have no words and stay empty; texts shorter than a window
are unchanged; a null doc_id is never a source and never cut; repeated rows of a doc_id never
cut each other; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .rows import texts_of, with_row_key
from .scratch import written

WINDOW = 50
K = 8
_PLACE = 28
_SEGMENT = 1 << 19


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def stretches(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Stretches of the rows whose words are h[first[i]:first[i+1]]: row, start, n, node."""
    k = min(K, window)
    out: list[tuple[np.ndarray, ...]] = []
    valid = np.zeros(max(0, len(h) - window + 1), bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= window:
            valid[a : b - window + 1] = True
    for s in range(0, len(valid), _SEGMENT):
        e = min(len(valid), s + _SEGMENT)
        ok = valid[s:e]
        if not ok.any():
            continue
        part = h[s : e + window - 1]
        mers = W.shingle_hashes(part, k)
        low = np.uint64((1 << _PLACE) - 1)
        packed = _smallest((mers & ~low) | np.arange(len(mers), dtype=np.uint64), window - k + 1)
        new = np.concatenate([[True], (packed[1:] != packed[:-1]) | ~ok[:-1]]) & ok
        begin = np.flatnonzero(new)
        bound = np.flatnonzero(new | ~ok | np.concatenate([[True], ~ok[:-1]]))
        after = np.searchsorted(bound, begin, "right")
        end = np.where(after < len(bound), np.append(bound, len(ok))[after], len(ok))
        node = mers[(packed[begin] & low).astype(np.int64)]
        out.append((begin + s, end - begin, node))
    if not out:
        return {c: np.zeros(0, np.int64) for c in ("row", "start", "n", "node")}
    start, n, node = (np.concatenate(x) for x in zip(*out, strict=True))
    row = np.searchsorted(first, start, "right") - 1
    return {"row": row, "start": start - first[row], "n": n, "node": node.view(np.int64)}


def edges(rows: DataFrame, window: int = WINDOW, named: bool = True) -> DataFrame:
    """(rid, doc_id, start, n, node, edge) of every stretch of every text of (doc_id, rid, text).

    edge is the digest of the words, or null where not ``named``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                w = W.split_words(part.column(2))
                found = stretches(w.hashes(), w.first, window)
                row = pa.array(found["row"], pa.int64())
                at = w.first[found["row"]] + found["start"]
                edge = [_digest(w.bytes_of(a, b)) for a, b in zip(at.tolist(), (at + found["n"] + window - 1).tolist(), strict=True)] if named else [None] * len(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(row), part.column(0).take(row), pa.array(found["start"], pa.int64()), pa.array(found["n"], pa.int32()), pa.array(found["node"], pa.int64()), pa.array(edge, pa.binary())],
                    names=["rid", "doc_id", "start", "n", "node", "edge"],
                )

    return rows.where("doc_id is not null").mapInArrow(run, "rid long, doc_id long, start long, n int, node long, edge binary")


def _listed(runs: DataFrame) -> DataFrame:
    """(doc_id, rid, runs): the runs (start, n) of each row as a list."""
    return runs.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def windows_of(texts: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, doc_id, start, name) of each single window of the asked stretches (doc_id, rid, start, n);
    name is the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                w = W.split_words(part.column(2))
                row, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, runs in enumerate(part.column(3).to_pylist()):
                    at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs])
                    row.append(np.full(len(at), i))
                    start.append(at)
                row, start = np.concatenate(row), np.concatenate(start)
                for s in range(0, len(row), _SEGMENT):
                    r, t = row[s : s + _SEGMENT], start[s : s + _SEGMENT]
                    name = [_digest(w.bytes_of(a, a + window)) for a in (w.first[r] + t).tolist()]
                    r = pa.array(r, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(1).take(r), part.column(0).take(r), pa.array(t, pa.int64()), pa.array(name, pa.binary())], names=["rid", "doc_id", "start", "name"])

    some = texts.join(_listed(asked).hint("shuffle_merge"), ["doc_id", "rid"]).select("doc_id", "rid", "text", "runs")
    return some.mapInArrow(run, "rid long, doc_id long, start long, name binary")


def chains(copies: DataFrame) -> DataFrame:
    """(edge, head, before): of each edge that is not the first of its nonbranching path, the first
    edge and the windows from its start to this one's.

    copies: (doc_id, rid, start, n, edge), all occurrences of some edges, each once.
    """
    after = copies.select("doc_id", "rid", F.col("start").alias("end"), F.col("edge").alias("next"))
    steps = written(copies.withColumn("end", F.col("start") + F.col("n")).join(after.hint("shuffle_merge"), ["doc_id", "rid", "end"], "left").select("edge", "n", "next"), "steps")
    leave = steps.groupBy("edge").agg(F.min("next").alias("next"), F.max("next").alias("other"), F.count("next").alias("m"), F.count(F.lit(1)).alias("all"), F.first("n").alias("n"))
    enter = steps.where("next is not null").groupBy("next").agg(F.min("edge").alias("edge"), F.max("edge").alias("other"), F.count(F.lit(1)).alias("m")).where("edge = other and edge <> next")
    alone = leave.where("next = other and m = all").select("edge", "next", "n", "m")
    # a document ends, so the edges of a cycle cannot all go on in one edge only
    open_ = written(alone.join(enter.select("edge", "next", "m").hint("shuffle_merge"), ["edge", "next", "m"]).join(leave.select(F.col("edge").alias("next"), F.col("all").alias("m")).hint("shuffle_merge"), ["next", "m"]).select(F.col("next").alias("edge"), F.col("edge").alias("head"), F.col("n").cast("long").alias("before")), "links")
    done = open_.limit(0)
    while not open_.isEmpty():
        up = open_.unionByName(done).select(F.col("edge").alias("head"), F.col("head").alias("higher"), F.col("before").alias("more"))
        folded = written(open_.join(up.hint("shuffle_merge"), "head", "left"), "links")
        done = done.unionByName(folded.where("higher is null").select("edge", "head", "before"))
        open_ = folded.where("higher is not null").select("edge", F.col("higher").alias("head"), (F.col("before") + F.col("more")).alias("before"))
    return done


def repeated(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(runs, texts): runs of n windows that also start in a smaller document, as (rid, doc_id, start,
    n, source_id, source_start), and the texts (doc_id, rid, text) of rows that have any."""
    rows = with_row_key(docs)
    # small sides are written first: a join of two exchanges is one that an adaptive plan can split
    nodes = written(edges(rows, window, named=False).groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("node"), "nodes")
    met = written(edges(rows, window).join(nodes.hint("shuffle_merge"), "node", "left_semi").distinct(), "met")
    found = met.groupBy("node", "edge").agg(F.min(F.struct("doc_id", "start")).alias("source"), F.max("doc_id").alias("last"))
    found = written(found, "edges")
    branches = written(found.groupBy("node").agg(F.count(F.lit(1)).alias("branches")), "branches")
    known = found.join(branches.hint("shuffle_merge"), "node").select("edge", "source", "last", "branches")
    met = written(met.drop("node").join(known.hint("shuffle_merge"), "edge"), "met")
    copies = met.where("source.doc_id < last").select("doc_id", "rid", "start", "n", "edge", "source")
    folded = chains(copies)
    length = folded.join(copies.select("edge", "n").distinct().hint("shuffle_merge"), "edge").groupBy("head").agg(F.max(F.col("before") + F.col("n")).alias("length"))
    part = folded.select("edge", F.lit(0).cast("long").alias("length")).unionByName(length.select(F.col("head").alias("edge"), "length"))
    paths = copies.where("doc_id > source.doc_id").join(part.hint("shuffle_merge"), "edge", "left").where("length is null or length > 0")
    columns = ["rid", "doc_id", "start", "n", F.col("source.doc_id").alias("source_id"), F.col("source.start").alias("source_start")]
    whole = written(paths.withColumn("n", F.coalesce(F.col("length"), F.col("n").cast("long"))).select(*columns), "spans")
    asked = met.where("branches > 1 and doc_id = source.doc_id").select("doc_id", "rid", "start", "n")
    wanted = written(asked.select("doc_id", "rid").union(whole.select("doc_id", "rid")).distinct(), "wanted")
    texts = written(texts_of(docs, wanted), "texts")
    single = written(windows_of(texts, asked, window), "windows")
    firsts = single.groupBy("name").agg(F.min(F.struct("doc_id", "start")).alias("source"), F.max("doc_id").alias("last")).where("source.doc_id < last").select("name", "source")
    firsts = written(firsts, "firsts")
    again = single.join(firsts.hint("shuffle_merge"), "name").where("doc_id > source.doc_id").withColumn("n", F.lit(1).cast("long"))
    return whole.unionByName(again.select(*columns)), texts


def spans(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, doc_id, source_id, start, end, source_start): runs of ``repeated`` that continue each
    other in both documents, joined to the longest word spans; end is exclusive."""
    run = found.distinct().withColumn("diagonal", F.col("start") - F.col("source_start"))
    w = Window.partitionBy("rid", "source_id", "diagonal").orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    mark = run.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    mark = mark.withColumn("island", F.sum("fresh").over(w))
    out = mark.groupBy("rid", "doc_id", "source_id", "diagonal", "island").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) + (window - 1)).alias("end"))
    return out.select("rid", "doc_id", "source_id", "start", "end", (F.col("start") - F.col("diagonal")).alias("source_start"))


def _keep_mask(n: int, runs: list[dict], window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    for r in runs:
        step[r["start"]] += 1
        step[r["start"] + r["n"] + window - 1] -= 1
    return np.cumsum(step)[:n] == 0


def plain(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, sha256) of the words of each text of (doc_id, rid, text), joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                w = W.split_words(part.column(2))
                sha = [hashlib.sha256(w.bytes_of(a, b)[:-1]).hexdigest() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(sha, pa.string())], names=["rid", "doc_id", "n_words", "sha256"])

    return rows.mapInArrow(run, "rid long, doc_id long, n_words long, sha256 string")


def cuts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, rid, n_removed, cut_text, cut_sha256) of each distinct row that loses words; cut_text is
    the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                gone, text, sha = [], [], []
                for t, runs in zip(part.column(2), part.column(3), strict=True):
                    words = t.as_py().encode().split()
                    keep = _keep_mask(len(words), runs.as_py(), window)
                    kept = b" ".join(words[i] for i in np.flatnonzero(keep))
                    gone.append(len(words) - int(keep.sum()))
                    text.append(kept.decode())
                    sha.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.int64()), pa.array(text, pa.string()), pa.array(sha, pa.string())], names=["doc_id", "rid", "n_removed", "cut_text", "cut_sha256"])

    runs, texts = repeated(docs, window)
    lists = _listed(runs.select("doc_id", "rid", "start", "n"))
    some = texts.join(lists.hint("shuffle_merge"), ["doc_id", "rid"]).select("doc_id", "rid", "text", "runs")
    return some.mapInArrow(run, "doc_id long, rid long, n_removed long, cut_text string, cut_sha256 string")


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of docs: (rid, doc_id, n_words, n_removed, cut_text, kept_sha256).

    cut_text is null where nothing was removed, else the kept words joined by one space.
    """
    found = written(cuts(docs, window), "cuts")
    out = plain(with_row_key(docs)).join(found.hint("shuffle_merge"), ["doc_id", "rid"], "left")
    return out.select("rid", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "cut_text", F.coalesce("cut_sha256", "sha256").alias("kept_sha256"))
