"""Operator 5, packing of token sequences by linear grouping.

Documents are tokenised and ended by one id; only longer ones than a sequence are cut, with the
short piece first.  Pieces are dealt by place to shards of about ``SHARD`` pieces; a shard is
packed in one task, alike at any input size, and leaves at most a few sequences part filled:

1. Pieces longer than ``LARGE`` are sorted and split into ``GROUPS`` groups of equal cardinality;
   each length is rounded up to the longest of its group, which leaves few sizes.
2. Configurations of those sizes are built one after another: the largest size left, completed
   by the combination of sizes with the best fill that a subset-sum table finds, repeated as
   often as all its sizes last.
3. Actual pieces replace the rounded ones, longest first.
4. Small pieces, longest first, go where they fit best in the room that is really left (rounding
   included); what fits nowhere opens a new sequence.

Defined results: null text is the empty text, one sequence of the end id; repeated rows give
repeated pieces; an empty table gives an empty result; a null doc_id is packed as any other.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import base, written

CAPACITY = 2048
SHARD = 30_000
GROUPS = 64
LARGE = CAPACITY // 8
END = 0
_MEMO = 100_000
RUN = 256
#: The characters that the pattern's \\s stands for.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPECIAL = {"<|endoftext|>": 50256}  # a fixed value of the public vocabulary
_loaded: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Ids of texts as packed unsigned 32-bit values, from the ranks and pattern of the byte-level BPE.

    A text is cut where a single space follows a character that is no white space; the pattern
    never joins what stands on both sides of such a cut, so parts can be encoded one by one and
    frequent parts are remembered.  Texts with other runs of spaces are encoded whole, but for runs
    of over ``RUN`` characters: the pattern takes all of a run but its last character as one piece
    (all of it at the end of a text), which is merged by itself, as matching it would go beyond the
    pattern engine's stack.
    """

    def __init__(self, ranks: str, pattern: str) -> None:
        import re

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=table, special_tokens=_SPECIAL)
        self.odd = re.compile(r"\s |<\|endoftext\|>")
        self.runs = re.compile(f"[{_WHITE}]{{{RUN},}}")
        self.memo: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        found = self.memo.get(text)
        if found is None:
            found = self.ordinary(text)
            if len(self.memo) < _MEMO and len(text) < 64:
                self.memo[text] = found
        return found

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if len(text) < RUN:
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        out, at = [], 0
        for m in self.runs.finditer(text):
            end = m.end() - (m.end() < len(text))
            if m.start() > at:
                out.append(self.encoding.encode_ordinary(text[at : m.start()]))
            out.append(self.encoding._encode_single_piece(text[m.start() : end]))
            at = end
        if at < len(text):
            out.append(self.encoding.encode_ordinary(text[at:]))
        return b"".join(np.array(x, "<u4").tobytes() for x in out)

    def encode(self, text: str) -> bytes:
        if self.odd.search(text):
            parts = [text]
            for name, number in _SPECIAL.items():  # special tokens are looked for before anything else
                parts = [p for part in parts for p in ([part] if isinstance(part, int) else _between(part.split(name), number))]
            return b"".join(np.array([p], "<u4").tobytes() if isinstance(p, int) else self.ordinary(p) for p in parts)
        first, *rest = text.split(" ")
        return b"".join([self.part(first), *(self.part(" " + p) for p in rest)])


def _between(parts: list[str], number: int) -> list[str | int]:
    out: list[str | int] = []
    for k, p in enumerate(parts):
        out += [number, p] if k else [p]
    return out


def encoder(ranks: str, pattern: str) -> Encoder:
    if (ranks, pattern) not in _loaded:
        _loaded[ranks, pattern] = Encoder(ranks, pattern)
    return _loaded[ranks, pattern]


def cut_points(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, and before them the rest."""
    rest = n % CAPACITY
    return ([(0, rest)] if rest else []) + [(s, CAPACITY) for s in range(rest, n, CAPACITY)]


def pieces(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(ranks, pattern)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = use.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut_points(len(ids) // 4)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return base(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, {size index: how many}) that use up counts of the sizes (falling order)."""
    left, out = list(counts), []
    for big in range(len(sizes)):
        while left[big]:
            room = capacity - sizes[big]
            left[big] -= 1
            # bit t of reach[j]: sizes from j on, within their counts, can fill exactly t
            can, steps = 1, []
            mask = (1 << (room + 1)) - 1
            for j in range(len(sizes) - 1, big - 1, -1):
                if left[j] and sizes[j] <= room:
                    before, most = can, min(left[j], room // sizes[j])
                    for _ in range(most):
                        grown = can | (before << sizes[j]) & mask
                        if grown == can:
                            break
                        before, can = (before << sizes[j]) & mask, grown
                    steps.append((j, most, can))
            fill = can.bit_length() - 1
            config = {big: 1}
            for k in range(len(steps) - 1, -1, -1):
                j, most, _ = steps[k]
                below = steps[k - 1][2] if k else 1
                for m in range(most + 1):
                    if fill - m * sizes[j] >= 0 and below >> (fill - m * sizes[j]) & 1:
                        if m:
                            config[j] = config.get(j, 0) + m
                            fill -= m * sizes[j]
                        break
            left[big] += 1
            times = min(left[j] // m for j, m in config.items())
            for j, m in config.items():
                left[j] -= m * times
            out.append((times, config))
    return out


def pack(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces given in falling order of length."""
    n_large = int((length > LARGE).sum())
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    used: list[int] = []
    if n_large:
        groups = min(GROUPS, n_large)
        edge = np.linspace(0, n_large, groups + 1).round().astype(int)
        rounded: dict[int, list[int]] = {}
        for a, b in zip(edge, edge[1:], strict=False):
            rounded.setdefault(int(length[a]), []).extend(range(a, b))
        sizes = sorted(rounded, reverse=True)
        turn = [iter(rounded[s]) for s in sizes]
        for times, config in configurations(sizes, [len(rounded[s]) for s in sizes]):
            for _ in range(times):
                fill = 0
                for j, m in config.items():
                    for _ in range(m):
                        i = next(turn[j])
                        sequence[i], offset[i] = len(used), fill
                        fill += int(length[i])
                used.append(fill)
    room: dict[int, list[int]] = {}
    for s, fill in enumerate(used):
        room.setdefault(CAPACITY - fill, []).append(s)
    order = sorted(room)
    for i in range(n_large, len(length)):
        n = int(length[i])
        at = bisect_left(order, n)
        if at < len(order):
            free = order[at]
            s = room[free].pop()
            if not room[free]:
                del room[free], order[at]
        else:
            free, s = CAPACITY, len(used)
            used.append(0)
        sequence[i], offset[i] = s, CAPACITY - free
        free -= n
        if free:
            if free not in room:
                room[free] = []
                insort(order, free)
            room[free].append(s)
    return sequence, offset


def pack_pieces(found: DataFrame, shards: int) -> DataFrame:
    """``found`` with sequence_id and offset."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort((column("ids_crc32"), column("piece"), table.column("doc_id").fill_null(0).to_numpy(), -column("length")))
        sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sequence[order], offset[order] = pack(column("length")[order])
        sequence += np.int64(table.column("shard")[0].as_py()) << 32
        return table.drop_columns("shard").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # by place in the written table, so that a row that is repeated many times is dealt to all shards
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    dealt = found.withColumn("shard", shard)
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most CAPACITY tokens."""
    found = written(pieces(docs, ranks, pattern), "pieces")
    return pack_pieces(found, max(1, -(-found.count() // SHARD)))
