"""Operator 7, language-model scores by a weighted backoff automaton of order three.

Training counts words, pairs and triples (an end token closes every document and is the context
of the next one's first word).  Words are smoothed by one, pairs and triples by a Dirichlet prior
towards the shorter context: p(w|c) = (n(cw) + K p(w|c')) / (n(c) + K).  As an automaton: the
root, every known word and every seen pair are states; a seen triple uvw is an arc from uv to vw,
a seen pair uv an arc from u to uv, a word an arc from the root to its state (to the root itself
if unknown), weighing log10 p.  The failure arc of a state leads to that of its shorter context
and weighs log10 K / (n(c) + K).  The weights of a state sum to one.  A text is read once from
left to right: the state is carried, failure arcs are followed until an arc of the next word
leaves the state, and weights add up.  As a state stands for at most two words, long texts are
read in lanes that take up the state two words early; that gives the same sums.

The model is as large as the corpus, so no task and no driver holds it.  Consecutive texts of a
partition form blocks of about ``BLOCK`` bytes, whatever their ids, so repeated rows spread.  A
block sends its distinct n-grams with their training counts, sorted, cut by hash range and packed
as differences; each range's task adds the counts of all blocks up and answers every block with
the totals of its own n-grams, in its own order.  From the answers a block builds the part of the
automaton that its texts can reach, which gives the same scores as the whole.  A range adds up
about ``RANGE`` n-grams and empty cells are not sent, so rows are at most (blocks x ranges) and
never more than the blocks' distinct n-grams.  Words are told by 64-bit hashes; pairs and triples
by as many bits as make it rarer than 2^-``SLACK`` for one to share its key with another in the
corpus at hand (64 at most).  Counts are 64-bit.

Defined results: null and empty texts are the end token alone; upper-case A-Z count as lower
case; rows with a null doc_id are trained on; without any training text every token is unknown;
repeated rows count and come back each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import partitions, written

BLOCK = 8 << 20
RANGE = 4 << 20
LANE = 512
SLACK = 20
PRIOR = (1000.0, 20.0)  # of pairs, of triples
END = np.uint64(0x51ED270B2C1F9A37)
_PAIR, _TRIPLE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
BLOCKS = "block long, n_tokens long, doc_id binary, known binary, train binary, first binary, text binary"
CELLS = "block long, range int, words binary, n_words binary, pairs binary, n_pairs binary, triples binary, n_triples binary"
TOTALS = "block long, range int, words binary, pairs binary, triples binary, seen long, total long"
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(x: np.ndarray) -> bytes:
    """Numbers of up to 64 bits as compressed planes of their bytes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def blocks(docs: DataFrame) -> DataFrame:
    """BLOCKS of (doc_id, text, train): the rows of consecutive texts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, W.Words]] = []
        place, made, size = TaskContext.get().partitionId() << 32, 0, 0

        def block() -> pa.RecordBatch:
            ids = pa.chunked_array([b.column(0) for b, _ in held]).combine_chunks()
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.first) for _, w in held]))])
            row = {
                "block": place + made,
                "n_tokens": int(first[-1]) + len(ids),
                "doc_id": ids.fill_null(0).to_numpy().tobytes(),
                "known": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                "train": np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b, _ in held]).tobytes(),
                "first": pack(first),
                "text": zstandard.ZstdCompressor(level=3).compress(b"".join(w.data.tobytes() for _, w in held)),
            }
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()})

        for batch in batches:
            for part in W.chunks(batch, "text", BLOCK // 4):
                held.append((part, W.split_words(part.column(1), lower=True)))
                size += len(held[-1][1].data)
                if size >= BLOCK:
                    yield block()
                    held, size, made = [], 0, made + 1
        if held:
            yield block()

    return docs.select("doc_id", "text", "train").mapInArrow(run, BLOCKS)


class Tokens(NamedTuple):
    """The tokens of a block: their hashes, n+1 offsets of the rows, whether each is trained on."""

    hash: np.ndarray
    after: np.ndarray
    train: np.ndarray

    @classmethod
    def read(cls, row: dict) -> "Tokens":
        first = unpack(row["first"]).astype(np.int64)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
        end = np.flatnonzero(data == 0x20)
        words = W.Words(data, np.concatenate([np.zeros(min(1, len(end)), np.int64), end[:-1] + 1]), end, first)
        after = first + np.arange(len(first))
        out = np.full(after[-1], END)
        rest = np.ones(len(out), bool)
        rest[after[1:] - 1] = False
        out[rest] = words.hashes()
        return cls(out, after, np.repeat(np.frombuffer(row["train"], bool), np.diff(after)))

    def keys(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(key of the n-gram that ends at each position, where there is none) of each order."""
        t = self.hash
        yield t, None
        with np.errstate(over="ignore"):
            pair = W.mix64(np.concatenate([[END], t[:-1]]) * _PAIR + t)
            yield pair >> np.uint64(64 - bits), None
            triple = W.mix64(np.concatenate([pair[:1], pair[:-1]]) * _TRIPLE + t) >> np.uint64(64 - bits)
        opens = np.zeros(len(t), bool)
        opens[self.after[:-1]] = True  # the context of a first word is the end token alone
        yield triple, opens

    def counted(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each order: sorted distinct keys, their training counts, the place of each position's
        key (-1 where there is none), and a position of each key."""
        for key, without in self.keys(bits):
            here = np.arange(len(key)) if without is None else np.flatnonzero(~without)
            order = here[np.argsort(key[here])]
            new = np.ones(len(order), bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            start = np.flatnonzero(new)
            at = np.full(len(key), -1, np.int32)
            at[order] = np.cumsum(new) - 1
            n = np.add.reduceat(self.train[order].astype(np.int64), start) if len(start) else start
            yield key[order[start]], n, at, order[start]


def totals(found: DataFrame, ranges: int, bits: int) -> DataFrame:
    """TOTALS of every block and range: counts over all blocks, in the order of the block's n-grams.

    seen and total, on one row of each range: its distinct trained words and its trained tokens.
    """
    names = ("words", "pairs", "triples")
    edge = [np.array([((1 << b) * k) // ranges for k in range(ranges)], np.uint64) for b in (64, bits, bits)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                cells: dict[str, list] = {"block": [], "range": [], **{p + c: [] for c in names for p in ("", "n_")}}
                orders = [(keys, n, np.append(np.searchsorted(keys, e), len(keys))) for e, (keys, n, _, _) in zip(edge, Tokens.read(row).counted(bits), strict=True)]
                for r in range(ranges):
                    if all(cut[r] == cut[r + 1] for _, _, cut in orders):
                        continue
                    cells["block"].append(row["block"])
                    cells["range"].append(r)
                    for c, e, (keys, n, cut) in zip(names, edge, orders, strict=True):
                        cells[c].append(pack(np.diff(keys[cut[r] : cut[r + 1]], prepend=e[r])))
                        cells[f"n_{c}"].append(pack(n[cut[r] : cut[r + 1]]))
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64() if c == "block" else pa.int32() if c == "range" else pa.binary()) for c, v in cells.items()})

    def answer(table: pa.Table) -> pa.Table:
        r, out = table.column("range")[0].as_py(), {"block": table.column("block"), "range": table.column("range")}
        for c, e in zip(names, edge, strict=True):
            keys = [e[r] + np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in table.column(c)]
            every = np.concatenate(keys)
            order = np.argsort(every)
            new = np.ones(len(every), bool)
            new[1:] = every[order[1:]] != every[order[:-1]]
            start = np.flatnonzero(new)
            n = np.concatenate([unpack(x.as_py()) for x in table.column(f"n_{c}")]).astype(np.int64)
            total = np.add.reduceat(n[order], start) if len(start) else start
            mine = np.empty(len(every), np.int64)
            mine[order] = total[np.cumsum(new) - 1]
            out[c] = pa.array([pack(x) for x in np.split(mine, np.cumsum([len(k) for k in keys])[:-1])], pa.binary())
            if c == "words":
                rest = [0] * (table.num_rows - 1)
                out |= {"seen": pa.array([int((total > 0).sum()), *rest], pa.int64()), "total": pa.array([int(total.sum()), *rest], pa.int64())}
        return pa.table(out).select(["block", "range", *names, "seen", "total"])

    return found.mapInArrow(ask, CELLS).groupBy("range").applyInArrow(answer, TOTALS)


class Automaton:
    """The states, arcs and failure arcs that the texts of one block can reach.

    States: 0 the root, then the words, then the pairs.  Arcs: the words', the pairs', the triples'.
    """

    def __init__(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, pair_of: np.ndarray, triple_of: np.ndarray, train_tokens: int, vocabulary: int) -> None:
        """words, pairs, triples: training counts; pair_of: (first word, second word) of each pair;
        triple_of: (first pair, second pair) of each triple."""
        u, v = pair_of
        uv, vw = triple_of
        k2, k3 = PRIOR
        self.known = words > 0
        self.root = (words + 1.0) / (train_tokens + 1.0 * (vocabulary + 1))
        by_pair = (pairs + k2 * self.root[v]) / (words[u] + k2)
        by_triple = (triples + k3 * by_pair[vw]) / (pairs[uv] + k3)
        state = np.where(self.known, 1 + np.arange(len(words)), 0)
        pair_state = np.where(pairs > 0, 1 + len(words) + np.arange(len(pairs)), -1)
        self.weight = np.log10(np.concatenate([self.root, by_pair, by_triple]))
        self.source = np.concatenate([np.zeros(len(words), np.int64), np.where(pairs > 0, state[u], -1), np.where(triples > 0, pair_state[uv], -1)])
        self.target = np.concatenate([state, pair_state, pair_state[vw]])
        self.fail_weight = np.log10(np.concatenate([[1.0], k2 / (words + k2), k3 / (pairs + k3)]))
        self.fail = np.concatenate([np.zeros(1 + len(words), np.int64), state[v]])
        self.depth = np.repeat(np.array([0, 1, 2], np.int8), [1, len(words), len(pairs)])
        self.first_arc = (0, len(words), len(words) + len(pairs))
        self.state = state

    def traverse(self, at: list[np.ndarray], opens: np.ndarray, start: int) -> np.ndarray:
        """Weight of each step over the tokens of a block, the state carried from left to right.

        at: the word, pair and triple that end at each position, -1 for none; opens: positions where
        a text begins, from the state start.
        """
        n = len(opens)
        lane = np.arange(0, n, LANE)
        state, out = np.zeros(len(lane), np.int64), np.zeros(n)
        for k in range(-2, LANE):
            live = (lane + k >= 0) & (lane + k < n)
            here = lane[live] + k
            s = np.where(opens[here], start, state[live])
            total, chosen = np.zeros(len(here)), np.full(len(here), -1, np.int64)
            for order in (2, 1, 0):
                gram = at[order][here]
                arc = gram + self.first_arc[order]
                leaves = (chosen < 0) & (gram >= 0) & (self.source[arc * (gram >= 0)] == s)
                chosen[leaves] = arc[leaves]
                fails = (chosen < 0) & (self.depth[s] == order)
                total[fails] += self.fail_weight[s[fails]]
                s = np.where(fails, self.fail[s], s)
            state[live] = self.target[chosen]
            if k >= 0:
                out[here] = total + self.weight[chosen]
        return out


def block_scores(row: dict, counts: list[np.ndarray], bits: int, train_tokens: int, vocabulary: int) -> pa.Table:
    """SCORES of a block's rows from the totals of its distinct words, pairs and triples."""
    tokens = Tokens.read(row)
    after = tokens.after
    (words, _, w, _), (_, _, p, p_first), (_, _, t, t_first) = tokens.counted(bits)
    end = int(np.searchsorted(words, END))
    before = np.concatenate([[end], w[:-1]])
    model = Automaton(*counts, (before[p_first], w[p_first]), (p[t_first - 1], p[t_first]), train_tokens, vocabulary)
    opens = np.zeros(len(w), bool)
    opens[after[:-1]] = True
    steps = model.traverse([w, p, t], opens, int(model.state[end]))
    total = lambda x: np.add.reduceat(x, after[:-1])
    return pa.table(
        {
            "doc_id": pa.array(np.frombuffer(row["doc_id"], np.int64), mask=~np.frombuffer(row["known"], bool)),
            "n_tokens": pa.array(np.diff(after), pa.int64()),
            "n_known": pa.array(total(model.known[w].astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(after) - 1, train_tokens), pa.int64()),
            "base_score": pa.array(total(np.log10(model.root)[w]), pa.float64()),
            "score": pa.array(total(steps), pa.float64()),
        }
    )


def key_bits(tokens: int) -> int:
    """Bits of the keys of pairs and triples for a corpus of so many tokens."""
    return min(64, (2 * tokens + 1).bit_length() + SLACK)


def scores(docs: DataFrame, train: "F.Column") -> DataFrame:
    """SCORES of every row of docs: (doc_id, n_tokens, n_known, train_tokens, base_score, score).

    train: a boolean column expression; the rows to learn from.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train"))
    found = written(blocks(read), "blocks")
    tokens = found.agg(F.sum("n_tokens")).first()[0] or 0
    bits = key_bits(tokens)
    answers = written(totals(found, max(partitions(docs.sparkSession), -(-2 * tokens // RANGE)), bits), "totals")
    sums = answers.agg(F.sum("seen").alias("seen"), F.sum("total").alias("total")).first()
    vocabulary, train_tokens = sums.seen or 0, sums.total or 0

    def score(block: pa.Table, answer: pa.Table) -> pa.Table:
        order = np.argsort(answer.column("range").to_numpy())
        counts = [np.concatenate([unpack(answer.column(c)[int(k)].as_py()) for k in order]).astype(np.int64) for c in ("words", "pairs", "triples")]
        return block_scores(block.to_pylist()[0], counts, bits, train_tokens, vocabulary)

    return found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
