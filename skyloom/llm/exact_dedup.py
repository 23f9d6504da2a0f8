"""Operator 1, exact deduplication against a history held in a minimal perfect hash.

The history is a table of distinct text digests.  Its digests are spread over buckets by their
leading bits; each bucket gets a minimal perfect hash of its own: levels of bit arrays, where a
digest takes the first level at which no other digest of the bucket shares its bit, and its slot
is the rank of that bit.  Slot i holds the whole digest and the locator of the text that wins
among its copies (doc_id, code points, count).  Any digest maps to some slot, so a lookup
compares all 32 bytes: equal means a repeat of the slot's text, anything else is a nonmember,
and nonmembers are grouped among themselves.

Scale: incoming rows are combined per digest before the shuffle, so a text with a third of all
rows costs one row per task; a bucket holds about ``BUCKET`` digests whatever the input; the last
join of rows with their groups is one an adaptive plan splits when skewed.

Defined results: null text is the empty text; empty texts are equal to each other; of equal
texts the one with most code points before normalisation stays, then the smallest doc_id; null
doc_ids lose ties, and are kept where no copy has an id; repeated rows each come back as a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import base, partitions, written

BUCKET = 50_000
SPACES = "[\\x20\\x09-\\x0D]"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_points) of every row: SHA-256 of the text without white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return base(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2(F.regexp_replace(text, SPACES, ""), 256)).alias("digest"), F.char_length(text).alias("n_points"))


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: the locator of its winner (doc_id is 0 where not known) and the copies."""
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("unknown"), "doc_id"))
    found = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
    return found.select("digest", (-F.col("best.less")).alias("n_points"), F.coalesce("best.doc_id", F.lit(0)).cast("long").alias("doc_id"), (~F.col("best.unknown")).alias("known"), "copies")


def _bucket(n: int):
    """Leading 31 bits of the digest, modulo the number of buckets."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(n)).cast("int")


def _words(digest: pd.Series) -> np.ndarray:
    """Digests as an n x 4 array of unsigned 64-bit words."""
    return np.frombuffer(b"".join(digest), "<u8").reshape(-1, 4)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each digest at a level."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] * np.uint64(2 * level + 0x9E3779B97F4A7C15) ^ words[:, (level + 1) % 4]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_hash(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(levels of bits, slot of each digest) for distinct digests; slots are 0..n-1."""
    n, levels, slot, left, base_rank = len(words), [], np.empty(len(words), np.int64), np.arange(len(words)), 0
    while len(left):
        size = max(2, 2 * len(left))
        at = _position(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        sits = alone[at]
        slot[left[sits]] = base_rank + (np.cumsum(alone) - 1)[at[sits]]
        base_rank += int(alone.sum())
        left = left[~sits]
    assert base_rank == n
    return levels, slot


def find_slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 where no level has its bit."""
    out, left, base_rank = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = _position(words[left], k, len(bits))
        hit = bits[at]
        out[left[hit]] = base_rank + (np.cumsum(bits) - 1)[at[hit]]
        base_rank += int(bits.sum())
        left = left[~hit]
    return out


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its levels as packed bits, and its slots as packed columns.

    ``history`` has distinct digests with their winner, as ``winners`` makes them.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = _words(pdf["digest"])
        levels, slot = build_hash(words)
        order = np.argsort(slot)
        pack = lambda x, kind: np.ascontiguousarray(x[order], kind).tobytes()
        return pd.DataFrame(
            {
                "bucket": [pdf["bucket"].iloc[0]],
                "sizes": [[len(x) for x in levels]],
                "bits": [[np.packbits(x).tobytes() for x in levels]],
                "digests": [pack(words, "<u8")],
                "doc_ids": [pack(pdf["doc_id"].to_numpy(), "<i8")],
                "known": [pack(pdf["known"].to_numpy(), "u1")],
                "points": [pack(pdf["n_points"].to_numpy(), "<i4")],
                "copies": [pack(pdf["copies"].to_numpy(), "<i8")],
            }
        )

    keyed = history.select(_bucket(buckets).alias("bucket"), "digest", "n_points", "doc_id", "known", "copies")
    return keyed.groupBy("bucket").applyInPandas(build, "bucket int, sizes array<int>, bits array<binary>, digests binary, doc_ids binary, known binary, points binary, copies binary")


def probe(index: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """Groups after incoming distinct digests met the index; both kinds of rows of a bucket meet in one task.

    Returns (digest, n_points, doc_id, known, copies, member): for each history slot its winner and its
    copies with those of incoming repeats, and each nonmember as it came.
    """

    def look_up(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        frames = []
        if len(old):
            row = old.iloc[0]
            levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(row["sizes"], row["bits"], strict=True)]
            held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
            slots = pd.DataFrame(
                {
                    "n_points": np.frombuffer(row["points"], "<i4"),
                    "doc_id": np.frombuffer(row["doc_ids"], "<i8"),
                    "known": np.frombuffer(row["known"], "u1").astype(bool),
                    "copies": np.frombuffer(row["copies"], "<i8"),
                    "member": True,
                }
            )
            slots.insert(0, "slot", np.arange(len(held)))
            if len(new):
                words = _words(new["digest"])
                slot = find_slots(levels, words)
                there = slot >= 0
                there[there] = (held[slot[there]] == words[there]).all(axis=1)
                hits = new[there].assign(slot=slot[there])
                both = pd.concat([slots, hits.assign(member=True)[list(slots)]])
                both = both.sort_values(["slot", "n_points", "known", "doc_id"], ascending=[True, False, False, True], kind="stable")
                copies = both.groupby("slot")["copies"].sum()
                slots = both.drop_duplicates("slot").set_index("slot").assign(copies=copies).reset_index()
                new = new[~there]
            slots["digest"] = [held[i].tobytes() for i in slots["slot"]]
            frames.append(slots.drop(columns="slot"))
        if len(new):
            frames.append(new.assign(member=False))
        cols = ["digest", "n_points", "doc_id", "known", "copies", "member"]
        return pd.concat([f[cols] for f in frames]) if frames else pd.DataFrame({c: [] for c in cols})

    new = incoming.select(_bucket(buckets).alias("bucket"), "digest", "n_points", "doc_id", "known", "copies")
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(look_up, "digest binary, n_points int, doc_id long, known boolean, copies long, member boolean")


def bucket_count(df: DataFrame, rows: int) -> int:
    return max(partitions(df.sparkSession), -(-rows // BUCKET), 1)


def dedup_batches(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each row of both batches (as ``digests`` makes them) with the fate of its text.

    Returns (doc_id, digest, n_points, keep_id, keep_points, group_size, member).
    """
    n = bucket_count(history, history.count() + incoming.count())
    index = build_index(winners(history), n)
    groups = probe(index, winners(incoming), n)
    found = groups.select(F.col("digest"), F.when(F.col("known"), F.col("doc_id")).alias("keep_id"), F.col("n_points").alias("keep_points"), F.col("copies").alias("group_size"), "member")
    return history.unionByName(incoming).join(found.hint("shuffle_merge"), "digest")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Exact copies of one table, taken as two batches: the rows whose id has an even CRC-32 are
    the history, the others are looked up in it.  Every row comes back.

    Returns (doc_id, keep_id, group_size, kept, text_sha256, in_history).
    """
    rows = written(digests(docs), "digests")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1)) % 2 == 0
    out = dedup_batches(rows.where(even), rows.where(~even))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history"))
