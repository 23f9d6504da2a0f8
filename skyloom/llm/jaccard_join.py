"""Operator 13, exact Jaccard join of word-shingle sets in the metric space of Jaccard distances.

Distance is 1 - |a & b| / |a | b|, a metric; documents link within RADIUS = 1 - similarity.

1. A pass over the texts counts shingles a few megabytes at a time; those that many documents of
   such a block have are listed (``LISTED`` at most, 8 bytes each) and come last in the order of
   shingles: unlisted before listed, each by hash.  The list changes the order only, no result.
2. A second pass makes each document's set, its size, a digest of its words (equal sets are one node
   from here on) and its first n - ceil(similarity * n) + 1 shingles in that order.  Two linked
   documents share one of these at least, and documents that share none are further apart.
3. Pivots: the documents with one such shingle elect the smallest of them as pivot, and each is a
   member of its pivots' regions.  So all that can link meets around a pivot, and no region is
   larger than the documents that share a shingle.
4. A member leaves a region that holds no other one of a size within the radius (the sizes are the
   distances to the empty set as a pivot).  A set's shingles are also counted in classes by hash, about one for eight.  The sum of absolute differences of two
   sets' counts is a distance that is never above the size of their symmetric difference, so a
   member whose counts are too far from those of all others of its region leaves it, unread.
5. Regions of at most ``TILE`` documents and ``TILE_BYTES`` bytes are joined at once on whole sets,
   told by the words of their texts: each document in turn is a pivot whose distances link what is
   within the radius and spare the pairs whose distances to it differ by more (triangle inequality).
6. Larger regions are divided by pivots of their own into Voronoi cells; a document is also
   replicated to every cell whose pivot is at most 2 * RADIUS further than its nearest, which is
   where the triangle inequality lets partners be.  Cells whose documents all are connected already
   are done (a group of thousands of near copies ends here); the others are regions again,
   recursively.
7. Where a division doesn't pay (unlike documents, all equally far from all pivots), the documents
   outside the region's largest component meet slices of all its documents: rows grow with
   (documents outside) x (slices), never as pairs.  This is exact, too.
8. Components of the links are found in Spark and given to all documents.

Links are told by words.  Sizes, first shingles and counts are of 64-bit hashes of shingles; only two
shingles of one document with one hash could change these.

Defined results: null and empty texts have no shingles and are linked with nothing; texts with
fewer words than a shingle are one shingle; null doc_ids come back as their own; every row has its
own set's group, also where rows repeat a doc_id; a region with very long texts is cut by bytes, and
two texts of any length are compared with each other; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .near_dedup import _by_tile, document_sets, exact_sets
from .rows import texts_of, with_row_key
from .scratch import written

BLOCK = 16 << 20  # bytes of text in which frequent shingles are looked for
OFTEN = 3  # different texts of a block that make a shingle frequent
LISTED = 1 << 20
TILE, TILE_BYTES = 256, 4 << 20
SLICE, GROUP = 1024, 256
PIVOTS = 16
COUNTS, COUNTED = (256, 1 << 16), 1024  # least and most classes of shingles; documents of a region whose counts are compared
DEPTH = 4  # divisions of a region by pivots
WINDOWS = 8  # pivots of a small region whose distances are kept


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that are frequent in some block of texts, the most frequent ones if too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[np.ndarray]) -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(times[often])], names=["token", "times"])

        held, size, seen = [], 0, set()
        for batch in batches:
            for part in W.chunks(batch):
                w = W.split_words(part.column(0), lower=True)
                h = w.hashes()
                shingles, n = W.shingle_hashes(h, words), np.diff(w.first)
                sums = np.concatenate([[0], np.cumsum(h)])[w.first].astype(np.uint64)  # modulo 2**64
                new = []
                for k, key in enumerate((sums[1:] - sums[:-1]).tolist()):
                    if key not in seen:
                        seen.add(key)
                        new.append(shingles[w.first[k] : max(w.first[k], w.first[k + 1] - words + 1)])
                held.extend(new)
                size += 8 * int(n.sum())
                if size >= BLOCK * 2:
                    yield found(held)
                    held, size, seen = [], 0, set()
        if held:
            yield found(held)

    counted = docs.select("text").mapInArrow(run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = counted.orderBy(F.desc("times"), "token").limit(LISTED).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def documents_sets(docs: DataFrame, words: int, num: int, den: int, listed: np.ndarray) -> DataFrame:
    """(doc_id, rid, n_shingles, n_bytes, node, prefix, plain, counts): the first shingles of each set, ``plain`` of them
    unlisted, and how many it has of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            sizes, digests, prefixes, plain, counts = [], [], [], [], []
            for _, found, digest in document_sets(batch, words):
                n = len(found)
                take = n - -(-num * n // den) + 1 if n else 0
                late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found if len(last) else np.zeros(n, bool)
                early = found[~late][:take]
                sizes.append(n)
                digests.append(digest)
                plain.append(len(early))
                classes = min(max(COUNTS[0], 1 << max(0, n // 8 - 1).bit_length()), COUNTS[1])
                counts.append(np.minimum(np.bincount((found % np.uint64(classes)).astype(np.int64), minlength=classes), 255).astype(np.uint8).tobytes())
                prefixes.append(np.concatenate([early, found[late][: take - len(early)]]).tobytes())
            n_bytes = np.diff(W.text_bytes(batch.column(2))[1])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(plain, pa.int32()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "n_shingles", "n_bytes", "node", "prefix", "plain", "counts"])

    return with_row_key(docs).mapInArrow(run, "doc_id long, rid long, n_shingles long, n_bytes long, node binary, prefix binary, plain int, counts binary")


def regions_of(sets: DataFrame) -> DataFrame:
    """(region, id) of every document with a pivot: region is the pivot's id, ids are hashes of nodes.

    Nodes that should share an id are members wherever one of them is, so nothing is lost by it.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = [np.frombuffer(p, np.int64) for p in batch.column(1).to_pylist()]
            size = np.array([len(p) for p in prefix], np.int64)
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            late = place >= np.repeat(batch.column(2).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(late)], names=["token", "id", "late"])

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, leader = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[token is None or t[0] != token], t[1:] != t[:-1]])
            group = np.cumsum(new) - 1
            starts = i[new]
            lead = np.where(group >= 0, starts[group], leader) if len(starts) else np.full(len(i), leader)
            token, leader = t[-1], lead[-1]
            lead, i = lead[lead != i], i[lead != i]
            if len(i):
                order = np.lexsort((i, lead))
                lead, i = lead[order], i[order]
                first = np.concatenate([[True], (lead[1:] != lead[:-1]) | (i[1:] != i[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(lead[first]), pa.array(i[first])], names=["region", "id"])

    spread = sets.select(F.xxhash64("node").alias("id"), "prefix", "plain").mapInArrow(tokens, "token long, id long, late boolean")
    early = spread.where("not late").select("token", "id").repartition("token").sortWithinPartitions("token", "id").mapInArrow(elect, "region long, id long")
    late = spread.where("late").select("token", "id")
    elected = late.groupBy("token").agg(F.min("id").alias("region"), F.max("id").alias("last")).where("region <> last").select("token", "region")
    frequent = late.join(elected.hint("shuffle_merge"), "token").where("id <> region").select("region", "id")
    pairs = written(early.unionByName(frequent).distinct(), "pairs")
    return pairs.unionByName(pairs.select("region", F.col("region").alias("id")).distinct())


def of_like_size(members: DataFrame, num: int, den: int) -> DataFrame:
    """(region, id, n) of members(region, id, n_shingles) whose region holds another one of a size that allows a
    link, by classes of sizes; n: how many the region has."""
    half = F.floor(2 * F.log(F.col("n_shingles").cast("double")) / math.log(den / num)).cast("int")  # sizes two classes apart can link
    rows = members.select("region", "id", half.alias("half"))
    counts = written(rows.groupBy("region", "half").agg(F.count(F.lit(1)).alias("m")), "counts")
    around = counts.select("region", "m", F.explode(F.sequence(F.col("half") - 3, F.col("half") + 3)).alias("half"))
    full = around.groupBy("region", "half").agg(F.sum("m").alias("m")).where("m > 1").join(counts.select("region", "half", F.col("m").alias("own")).hint("shuffle_merge"), ["region", "half"])
    sizes = full.groupBy("region").agg(F.sum("own").alias("n"))
    kept = rows.join(full.select("region", "half").hint("shuffle_merge"), ["region", "half"], "left_semi")
    return written(kept.join(sizes.hint("shuffle_merge"), "region").select("region", "id", "n"), "like")


def near_by_counts(members: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Members' rows without those whose counts are too far from all others' of their region; regions of more
    than COUNTED documents stay whole."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        size, alive = pdf["n_shingles"].to_numpy(), np.zeros(len(pdf), bool)
        order = np.argsort(size, kind="stable")
        classes = np.array([len(c) for c in pdf["counts"]])
        count: dict[int, np.ndarray] = {}  # of the rows with so many classes or twice as many, which are added up in pairs
        for c in np.unique(classes).tolist():
            count[c] = np.zeros((len(pdf), c), np.int16)
            for k in np.flatnonzero((classes == c) | (classes == 2 * c)).tolist():
                count[c][k] = np.frombuffer(pdf["counts"].iloc[k], np.uint8).astype(np.int16).reshape(-1, c).sum(axis=0)
        last = np.searchsorted(num * size[order], den * size[order], "right")  # sizes that allow a link
        for i in range(len(pdf) - 1):
            other = order[i + 1 : last[i]]
            if len(other):
                both = size[other] + size[order[i]]
                own = count[classes[order[i]]]
                most = (both - np.abs(own[other] - own[order[i]]).sum(axis=1, dtype=np.int64)) // 2  # of the intersection
                near = other[den * most >= num * (both - most)]
                if len(near):
                    alive[near] = alive[order[i]] = True
        return pdf.loc[alive, ["region", "node", "doc_id", "rid", "n_bytes"]] if alive.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _by_tile(batches, work):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    few = members.where(F.col("n") <= COUNTED).join(reps.hint("shuffle_merge"), "id").withColumn("tile", F.col("region"))
    many = members.where(F.col("n") > COUNTED).join(reps.select("id", "node", "doc_id", "rid", "n_bytes").hint("shuffle_merge"), "id")
    near = few.drop("id", "n").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "region long, node binary, doc_id long, rid long, n_bytes long")
    return near.unionByName(many.select("region", "node", "doc_id", "rid", "n_bytes"))


class _Overlaps:
    """Sizes of intersections of one set with all sets of a tile."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(value, kind="stable")
        self.owner, self.first = owner[order], np.searchsorted(value[order], np.arange(int(value.max()) + 2 if len(value) else 1))
        self.low = int(value.min()) if len(value) else 0
        if self.low < 0:  # short texts have numbers below zero
            self.first = np.searchsorted(value[order], np.arange(self.low, int(value.max()) + 2))

    def of(self, i: int) -> np.ndarray:
        s = self.sets[i] - min(self.low, 0)
        a, b = self.first[s], self.first[s + 1]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))
        return np.bincount(self.owner[at], minlength=len(self.sets))


def region_links(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Index pairs within the radius that connect what all such pairs of a side-0 set with any set connect."""
    over = _Overlaps(sets)
    size, root, radius = over.size, np.unique(label, return_inverse=True)[1], 1 - num / den + 1e-9
    place, links, windows = np.arange(len(sets)), [], []
    for i in np.flatnonzero(side == 0).tolist():
        other = (root != root[i]) & ((side != 0) | (place > i)) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i]))
        for row in windows:
            other &= np.abs(row - row[i]) <= radius
        if not other.any():
            continue
        common = over.of(i)
        union = size + size[i] - common
        if len(windows) < WINDOWS:
            windows.append(1 - common / union)
        for j in np.flatnonzero(other & (den * common >= num * union)).tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def _tiles(rows: DataFrame, texts: DataFrame, work, schema: str) -> DataFrame:
    """work(frame) of each tile, a frame of rows with their texts in order of node and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for pdf in _by_tile(batches, work):
            batch = pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)
            arrow = batch.schema
            yield batch

    dealt = rows.join(texts.hint("shuffle_merge"), ["doc_id", "rid"]).repartition("tile").sortWithinPartitions("tile", "node", "side")
    return dealt.mapInArrow(run, schema)


def joined(rows: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of tiles; rows: tile, side (0 meets all, 1 only side 0), label, node, doc_id, rid."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        pdf = pdf.drop_duplicates("node")
        node = pdf["node"].to_numpy()
        links = region_links(exact_sets(list(pdf["text"]), words), pdf["side"].to_numpy(), pdf["label"].to_numpy(), num, den)
        return pd.DataFrame({"a": [node[i] for i, _ in links], "b": [node[j] for _, j in links]}) if links else None

    return _tiles(rows.select("tile", "side", "label", "node", "doc_id", "rid"), texts, work, "a binary, b binary")


def voronoi(rows: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(region, node, cells, links) of rows in slices; side 0: pivots, in every slice; ``own``: whose answer counts.

    cells: pivots whose distance is at most 2 * radius above the nearest one's, that one first.
    """
    radius = 1 - num / den

    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        pdf = pdf.drop_duplicates("node")
        node, own = pdf["node"].to_numpy(), pdf["own"].to_numpy()
        over = _Overlaps(exact_sets(list(pdf["text"]), words))
        pivots = np.flatnonzero(pdf["side"].to_numpy() == 0)
        common = np.stack([over.of(int(i)) for i in pivots])
        union = over.size[None, :] + over.size[pivots][:, None] - common
        distance, near = 1 - common / union, den * common >= num * union
        nearest = distance.argmin(axis=0)
        window = distance <= distance.min(axis=0) + 2 * radius + 1e-9
        window[nearest, np.arange(len(node))] = False
        mine = np.flatnonzero(own)
        cells = [[node[pivots[nearest[j]]], *node[pivots[window[:, j]]]] for j in mine]
        return pd.DataFrame({"region": pdf["region"].to_numpy()[mine], "node": node[mine], "cells": cells, "links": [list(node[pivots[near[:, j]]]) for j in mine]})

    return _tiles(rows.select("tile", "region", "side", "own", "node", "doc_id", "rid"), texts, work, "region long, node binary, cells array<binary>, links array<binary>")


def _sized(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"))
    return rows.join(written(sizes, "sizes").hint("shuffle_merge"), "region")


def _slices(rows: int) -> F.Column:
    """How many slices of ``rows`` documents and TILE_BYTES bytes a region has."""
    return F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")


def _part(name: str, parts) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(name), "node"), parts).cast("int")


def all_links(spark: SparkSession, rows: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links that connect all documents within the radius that share a region.

    rows: region, node, doc_id, rid, n_bytes.
    """
    KEEP = ("region", "node", "doc_id", "rid", "n_bytes")
    small = (F.col("n") <= TILE) & (F.col("bytes") <= TILE_BYTES) | (F.col("n") <= 2)
    links = spark.createDataFrame([], "a binary, b binary")
    labels = spark.createDataFrame([], "node binary, component binary")
    blocks = None
    for depth in range(DEPTH + 1):
        sized = written(_sized(rows), "regions")
        label = sized.join(labels.hint("shuffle_merge"), "node", "left").withColumn("label", F.coalesce("component", "node")) if depth else sized.withColumn("label", F.col("node"))
        tiles = label.where(small).withColumn("tile", F.col("region")).withColumn("side", F.lit(0))
        links = written(links.unionByName(joined(tiles, texts, words, num, den)), "links")
        large = sized.where(~small)
        if large.isEmpty():
            break
        if depth == DEPTH:
            blocks = large if blocks is None else blocks.unionByName(large)
            break
        slices = _slices(SLICE)
        wanted = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), (F.lit(float(TILE_BYTES)) * F.col("n") / F.col("bytes")).cast("int")))
        chance = F.pmod(F.xxhash64(F.lit("pivot"), F.lit(depth), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < wanted / F.col("n")
        drawn = large.groupBy("region").agg(F.min("node").alias("first"))
        large = written(large.join(drawn.hint("shuffle_merge"), "region").withColumn("pivot", chance | (F.col("node") == F.col("first"))).drop("first"), "large")
        pivots = large.where("pivot").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("side", F.lit(0)).withColumn("own", F.col("slice") == _part("slice", slices))
        others = large.where("not pivot").withColumn("slice", _part("slice", slices)).withColumn("side", F.lit(1)).withColumn("own", F.lit(True))
        dealt = pivots.unionByName(others).withColumn("tile", F.xxhash64("region", "slice"))
        placed = written(voronoi(dealt, texts, words, num, den), "placed")
        near = placed.select(F.explode("links").alias("a"), F.col("node").alias("b")).where("a <> b")
        links = written(links.unionByName(near), "links")
        labels = written(components(links), "labels")
        # regions that are connected are done; the others go on in cells if these are fewer and smaller
        named = placed.join(labels.hint("shuffle_merge"), "node", "left").select("region", "node", "cells", F.coalesce("component", "node").alias("label"))
        cells = written(named.select("region", "node", "label", F.explode("cells").alias("cell")), "cells")
        counts = cells.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
        counts = written(counts.join(large.select("region", "n").distinct().hint("shuffle_merge"), "region"), "counts")
        pays = counts.groupBy("region").agg(((F.sum("m") <= 2 * F.max("n")) & (F.max("m") <= 0.75 * F.max("n"))).alias("pays"), (F.min("low") < F.max("high")).alias("open"))
        pays = written(pays.where("open").select("region", "pays"), "pays")
        stuck = large.drop("pivot").join(pays.where("not pays").select("region").hint("shuffle_merge"), "region", "left_semi")
        blocks = stuck if blocks is None else blocks.unionByName(stuck)
        onward = counts.where("low < high").join(pays.where("pays").hint("shuffle_merge"), "region").select("region", "cell")
        rows = cells.join(onward.hint("shuffle_merge"), ["region", "cell"]).join(large.select(*KEEP).hint("shuffle_merge"), ["region", "node"])
        rows = rows.select(F.xxhash64("region", "cell").alias("region"), *KEEP[1:])
    if blocks is None or blocks.isEmpty():
        return links
    labels = written(components(links), "labels")
    label = written(blocks.join(labels.hint("shuffle_merge"), "node", "left").select(*KEEP, "n", "bytes", F.coalesce("component", "node").alias("label")), "blocks")
    parts = label.groupBy("region", "label").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("region").agg(F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = label.join(main.select("region", F.col("main.label").alias("main"), F.col("main.m").alias("m")).hint("shuffle_merge"), "region")
    slices, groups = _slices(SLICE), F.greatest(F.ceil((F.col("n") - F.col("m")) / GROUP), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    rest = split.where("label <> main").withColumn("g", _part("group", groups)).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("side", F.lit(0))
    everyone = split.withColumn("g", F.explode(F.sequence(F.lit(0), groups - 1))).withColumn("slice", _part("slice", slices)).withColumn("side", F.lit(1))
    tiles = rest.unionByName(everyone).withColumn("tile", F.xxhash64("region", "g", "slice", F.lit(2)))
    return written(links.unionByName(joined(tiles, texts, words, num, den)), "links")


def jaccard_join(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Every row of ``docs`` with its group: (doc_id, rid, n_shingles, component_id)."""
    spark = docs.sparkSession
    num, den = round(similarity * 100), 100
    sets = written(documents_sets(docs, words, num, den, frequent_shingles(with_row_key(docs), words)), "sets")
    known = sets.where("node is not null and doc_id is not null")
    members = written(regions_of(known), "members")
    reps = known.groupBy("node").agg(F.min(F.struct("doc_id", "rid", "n_bytes")).alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("counts").alias("counts"))
    reps = written(reps.select(F.xxhash64("node").alias("id"), "node", "key.*", "n_shingles", "counts"), "representatives")
    like = of_like_size(members.join(reps.select("id", "n_shingles").hint("shuffle_merge"), "id"), num, den)
    rows = written(near_by_counts(like, reps, num, den), "rows")
    texts = written(texts_of(docs, rows.select("doc_id", "rid").distinct()), "texts")
    labels = components(all_links(spark, rows, texts, words, num, den))
    grouped = reps.select("node", "doc_id").join(labels.hint("shuffle_merge"), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("label"))
    grouped = written(grouped, "grouped")
    first = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(first.hint("shuffle_merge"), "label").select("node", "component_id")
    keyed = sets.select("doc_id", "rid", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return keyed.join(named.hint("shuffle_merge"), "node", "left").select("doc_id", "rid", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
