"""Operator 8, near-duplicate groups: banded MinHash, Bayesian pruning, exact verification.

1. One pass over the texts makes a document's set of word shingles, its size, a BLAKE2b digest of
   the shingles' own words and a MinHash signature.  Equal sets collapse to their smallest
   doc_id; the digest names them from here on.
2. Signatures are banded; the number of bands is the least that misses a pair at the threshold
   with probability at most ``miss``.  Documents that share a band value are candidates.
3. Candidates are compared in tiles: a bucket of at most ``TILE`` documents is one tile.  Of a
   larger bucket, ``PIVOTS`` documents meet slices of all others first; what is then still
   outside the bucket's largest component meets slices of all others, so every candidate pair
   that could still join two components is looked at, and rows grow with (documents still
   outside) x (slices), never as pairs.  A tile compares signatures batch by batch and drops a
   pair once the posterior probability that it reaches the threshold falls below ``miss``
   (uniform prior; after n agreeing-or-not hashes with m agreements the similarity is
   Beta(m+1, n-m+1)).
4. The texts of candidates are fetched once, and every survivor is verified on its words: shingles are told apart by the words themselves, not by hashes.  A
   tile answers with links that connect the same documents as all of its verified pairs do (a
   star to the smallest of each of its components), so a large group of copies never expands
   into pairs.
5. Components of the links are found in Spark and given to all documents.

No side of a join is broadcast: plans are the same at every size.

Defined results: null and empty texts have no shingles and are linked with nothing; texts with
fewer words than a shingle are one shingle; null doc_ids come back as their own, kept; every
row has its own set's group, also where rows repeat a doc_id; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .rows import texts_of, with_row_key
from .scratch import written

ROWS = 5
BATCH = 25
TILE = 512
PIVOTS = 128
SLICE = 1024
SEED = 8


def band_count(similarity: float, miss: float) -> int:
    """Least number of bands of ROWS hashes that misses a pair at the threshold this rarely."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**ROWS)))


def prune_table(similarity: float, miss: float, hashes: int) -> np.ndarray:
    """least[n]: fewest agreements among n hashes at which P(similarity >= threshold) >= miss.

    For a Beta(m+1, n-m+1) posterior that tail is P(Binomial(n+1, threshold) <= m).
    """
    least = np.zeros(hashes + 1, np.int32)
    for n in range(1, hashes + 1):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            log = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(similarity) + (n + 1 - m) * math.log1p(-similarity)
            tail += math.exp(log)
        least[n] = m
    return least


def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 32, (2, hashes), dtype=np.uint64).astype(np.uint32)
    return draw[0][:, None], draw[1][:, None] | np.uint32(1)


def document_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray, bytes | None]]:
    """(row, sorted distinct shingle hashes, digest of the shingles) of each row of a batch."""
    at = 0
    for part in W.chunks(batch):
        w = W.split_words(part.column(part.schema.get_field_index("text")), lower=True)
        h = w.hashes()
        s = W.shingle_hashes(h, words)
        for i in range(part.num_rows):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= words:
                found, where = np.unique(s[a : b - words + 1], return_index=True)
                content = w.gather(a + where, words)
            else:
                found, content = W.shingle_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64), w.bytes_of(a, b)
            yield at + i, found, hashlib.blake2b(content, digest_size=16).digest() if len(found) else None
        at += part.num_rows


def signatures(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """(doc_id, rid, n_shingles, node, signature); the last two are null for empty sets.

    rid tells rows with one doc_id and different texts apart; node is the digest of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, factor = _functions(hashes)
        for batch in batches:
            sizes, digest, sig, pending, bounds = [], [], [], [], [0]

            def flush() -> None:
                if not pending:
                    return
                x = (np.concatenate(pending) >> np.uint64(32)).astype(np.uint32)
                starts = np.array(bounds[:-1])
                if len(x) <= 4096:
                    low = np.minimum.reduceat((x[None, :] ^ flip) * factor, starts, axis=1)
                else:
                    low = np.full((hashes, 1), np.uint32(0xFFFFFFFF))
                    for k in range(0, len(x), 4096):
                        low = np.minimum(low, ((x[None, k : k + 4096] ^ flip) * factor).min(axis=1, keepdims=True))
                sig.extend(row.tobytes() for row in np.ascontiguousarray(low.T))
                pending.clear()
                bounds[:] = [0]

            order: list[int] = []
            for row, found, name in document_sets(batch, words):
                sizes.append(len(found))
                digest.append(name)
                if name is None:
                    continue
                order.append(row)
                if bounds[-1] + len(found) > 4096:
                    flush()
                pending.append(found)
                bounds.append(bounds[-1] + len(found))
            flush()
            full: list[bytes | None] = [None] * batch.num_rows
            for row, one in zip(order, sig, strict=True):
                full[row] = one
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(full, pa.binary())], names=["doc_id", "rid", "n_shingles", "node", "signature"])

    return with_row_key(docs).mapInArrow(run, "doc_id long, rid long, n_shingles long, node binary, signature binary")


def band_values(reps: DataFrame, bands: int) -> DataFrame:
    """(node, band, value) of each signature, read from its bytes by built-in functions."""
    width = 4 * ROWS
    return reps.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.substring("signature", (b * width + 1).cast("int"), F.lit(width))))).alias("band", "value"))


def _by_tile(batches: Iterator[pa.RecordBatch], work, chunk: int = 4096) -> Iterator[pd.DataFrame]:
    """Calls work(frame) on each run of rows with one tile; batches come sorted by tile."""
    held: list[pd.DataFrame] = []
    out: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        cut = np.flatnonzero(pdf["tile"].to_numpy()[1:] != pdf["tile"].to_numpy()[:-1]) + 1
        edges = [0, *cut.tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:], strict=False):
            piece = pdf.iloc[a:b]
            if held and held[0]["tile"].iloc[0] != piece["tile"].iloc[0]:
                done = work(held[0] if len(held) == 1 else pd.concat(held))
                held = []
                if done is not None and len(done):
                    out.append(done)
                    n += len(done)
            held.append(piece)
        if n >= chunk:
            yield pd.concat(out)
            out, n = [], 0
    if held:
        done = work(held[0] if len(held) == 1 else pd.concat(held))
        if done is not None and len(done):
            out.append(done)
    if out:
        yield pd.concat(out)


def survivors(tiles: DataFrame, least: np.ndarray, hashes: int) -> DataFrame:
    """Rows (tile, side, node, doc_id, rid) of tiles(.., band, label, signature) with a surviving pair.

    side 0: meets both sides; side 1: meets side 0 only.  Pairs with one label are connected
    already; a pair that shares an earlier band is looked at there.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        side, label, band = pdf["side"].to_numpy(), pd.factorize(pdf["label"])[0], int(pdf["band"].iloc[0])
        sig = np.frombuffer(b"".join(pdf["signature"]), "<u4").reshape(len(pdf), hashes)
        left = np.flatnonzero(side == 0)
        alive = np.zeros(len(pdf), bool)
        for i in left:
            other = np.arange(i + 1, len(pdf)) if len(left) == len(pdf) else np.flatnonzero((side == 1) | (np.arange(len(pdf)) > i))
            other = other[label[other] != label[i]]
            for k in range(0, hashes, BATCH):
                if not len(other):
                    break
                n = min(hashes, k + BATCH)
                agree = (sig[other, k:n] == sig[i, k:n]).sum(axis=1) + (0 if k == 0 else agree[keep])
                keep = agree >= least[n]
                other = other[keep]
            if len(other) and band:
                shared = (sig[other, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(other), band, ROWS).all(axis=2).any(axis=1)
                other = other[~shared]
            if len(other):
                alive[i] = True
                alive[other] = True
        return pdf.loc[alive, ["tile", "side", "node", "doc_id", "rid"]] if alive.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _by_tile(batches, work):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    dealt = tiles.select("tile", "band", "side", "node", "doc_id", "rid", "label", "signature").repartition("tile").sortWithinPartitions("tile", "node")
    return dealt.mapInArrow(run, "tile long, side int, node binary, doc_id long, rid long")


def exact_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text as numbers; equal numbers are equal shingles, by their words."""
    known: dict[bytes, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in t.encode().lower().split()), np.int64) for t in texts]
    code = every = np.concatenate(ids)
    for k in range(1, words):
        code = np.unique(code[:-1] * len(known) + every[k:], return_inverse=True)[1] if len(code) > 1 else code[:0]
    at, short, out = 0, {}, []
    for x in ids:
        own = code[at : at + len(x) - words + 1] if len(x) >= words else np.array([-1 - short.setdefault(x.tobytes(), len(short))])
        out.append(np.unique(own))
        at += len(x)
    return out


def tile_links(sets: list[np.ndarray], left: np.ndarray, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Index pairs that connect what the verified pairs left x all connect: a star per component."""
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    if n <= 8:
        both = [(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True))) for i in left for j in range(n) if j != i and (j > i or j not in left)]
    else:
        value = np.concatenate(sets)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        fresh = np.concatenate([[True], value[1:] != value[:-1]])
        group = np.cumsum(fresh) - 1
        shared = np.bincount(group)[group] > 1  # what a single document has can't be in an intersection
        column, owner = group[shared], owner[shared]
        column = np.unique(column, return_inverse=True)[1] if len(column) else column
        wide = int(column.max()) + 1 if len(column) else 0
        common = np.zeros((len(left), n), np.float32)
        step = max(1, (4 << 20) // n)
        bound = np.searchsorted(column, np.arange(0, wide + step, step))
        for k, (a, b) in enumerate(zip(bound, bound[1:], strict=False)):
            part = np.zeros((n, min(step, wide - k * step)), np.float32)
            part[owner[a:b], column[a:b] - k * step] = 1
            common += part[left] @ part.T
        common = np.rint(common).astype(np.int64)
        num, den = similarity
        union = size[left][:, None] + size[None, :] - common
        hit = den * common >= num * union
        hit[np.arange(len(left)), left] = False
        i, j = np.nonzero(hit)
        both = [(int(left[a]), int(b), -1) for a, b in zip(i, j, strict=True)]
    num, den = similarity
    for i, j, inter in both:
        if inter < 0 or den * inter >= num * (size[i] + size[j] - inter):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(n) if find(i) != i]


def verified(alive: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of tiles' surviving members, each tile verified on its texts."""
    num, den = round(similarity * 100), 100

    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        pdf = pdf.sort_values(["node", "side"]).drop_duplicates("node")
        node = pdf["node"].to_numpy()
        links = tile_links(exact_sets(list(pdf["text"]), words), np.flatnonzero(pdf["side"].to_numpy() == 0), (num, den))
        return pd.DataFrame({"a": [node[i] for i, _ in links], "b": [node[j] for _, j in links]}) if links else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _by_tile(batches, work):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    joined = alive.join(texts.hint("shuffle_merge"), ["doc_id", "rid"])
    dealt = joined.select("tile", "side", "node", "text").repartition("tile").sortWithinPartitions("tile", "node", "side")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, miss: float = 1e-5) -> DataFrame:
    """Every row of ``docs`` with its group: (doc_id, rid, n_shingles, component_id, kept)."""
    bands = band_count(similarity, miss)
    hashes = bands * ROWS
    least = prune_table(similarity, miss, hashes)
    rows = written(signatures(docs, words, hashes), "signatures")
    known = rows.where("signature is not null and doc_id is not null")
    reps = known.groupBy("node").agg(F.min(F.struct("doc_id", "rid")).alias("key"), F.first("signature").alias("signature"))
    reps = written(reps.select("node", "key.doc_id", "key.rid", "signature"), "representatives")
    buckets = written(band_values(reps, bands).groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = band_values(reps, bands).join(buckets.hint("shuffle_merge"), ["band", "value"]).select("band", F.xxhash64("band", "value").alias("bucket"), "n", "node")
    members = written(members, "members")
    # signatures and texts of all candidates are fetched once, for both rounds
    known = written(reps.join(members.select("node").distinct().hint("shuffle_merge"), "node", "left_semi"), "candidates")
    texts = written(texts_of(docs, known.select("doc_id", "rid")), "texts")

    def resolve(tiles: DataFrame) -> DataFrame:
        alive = written(survivors(tiles.join(known.hint("shuffle_merge"), "node"), least, hashes), "survivors")
        return verified(alive, texts, words, similarity)

    tiles = members.where(F.col("n") <= TILE).select(F.col("bucket").alias("tile"), "band", F.lit(0).alias("side"), "node", F.col("node").alias("label"))
    large = members.where(F.col("n") > TILE)
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    slice_of = F.pmod(F.xxhash64("node"), slices).cast("int")
    hot = not large.isEmpty()
    if hot:
        pivot = F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(float(PIVOTS)) / F.col("n")
        pivots = large.where(pivot).select("bucket", "band", "node", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(0).alias("side"))
        others = large.where(~pivot).select("bucket", "band", "node", slice_of.alias("slice"), F.lit(1).alias("side"))
        tiles = tiles.unionByName(pivots.unionByName(others).select(F.xxhash64("bucket", "slice").alias("tile"), "band", "side", "node", F.col("node").alias("label")))
    links = written(resolve(tiles), "links")
    labels = components(links)
    if hot:
        labelled = written(large.join(labels.hint("shuffle_merge"), "node", "left").select("bucket", "band", "n", "node", F.coalesce("component", "node").alias("label")), "labelled")
        sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("bucket", F.col("main.label").alias("main"), F.col("main.m").alias("m"))
        split = labelled.join(main.hint("shuffle_merge"), "bucket")
        groups = F.ceil((F.col("n") - F.col("m")) / TILE).cast("int")
        group_of = F.pmod(F.xxhash64(F.lit("group"), "node"), groups).cast("int")
        rest = split.where("label <> main").select("bucket", "band", "node", "label", group_of.alias("g"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(0).alias("side"))
        everyone = split.select("bucket", "band", "node", "label", F.explode(F.sequence(F.lit(0), groups - 1)).alias("g"), slice_of.alias("slice"), F.lit(1).alias("side"))
        more = rest.unionByName(everyone).select(F.xxhash64("bucket", "g", "slice", F.lit(2)).alias("tile"), "band", "side", "node", "label")
        links = written(links.unionByName(resolve(more)), "links")
        labels = components(links)
    grouped = reps.select("node", "doc_id").join(labels.hint("shuffle_merge"), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("label"))
    grouped = written(grouped, "grouped")
    first = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(first.hint("shuffle_merge"), "label").select("node", "component_id")
    keyed = rows.select("doc_id", "rid", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = keyed.join(named.hint("shuffle_merge"), "node", "left").select("doc_id", "rid", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
