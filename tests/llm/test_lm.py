import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from skyloom.llm import lm_score
from tests.llm.test_dedup import DATA, table

K2, K3 = lm_score.PRIOR


def brute(rows):
    """Backoff automaton as dictionaries, walked token by token."""
    toks = lambda t: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    uni, pair, triple = Counter(), Counter(), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            w = toks(t)
            uni.update(w)
            pair.update(zip([None, *w], w))
            triple.update(zip([None, *w], w, w[1:]))
    n, v = sum(uni.values()), len(uni)
    root = lambda w: (uni[w] + 1) / (n + v + 1)
    p2 = lambda u, w: (pair[u, w] + K2 * root(w)) / (uni[u] + K2)
    arcs = {((u,), w): math.log10(p2(u, w)) for u, w in pair}
    arcs |= {((u, x), w): math.log10((c + K3 * p2(x, w)) / (pair[u, x] + K3)) for (u, x, w), c in triple.items()}
    fail = {(u,): math.log10(K2 / (c + K2)) for u, c in uni.items()} | {k: math.log10(K3 / (c + K3)) for k, c in pair.items()}
    out = []
    for i, t in rows:
        state, score, base, known = (None,) if uni[None] else (), 0.0, 0.0, 0
        for w in toks(t):
            while state and (state, w) not in arcs:
                score += fail[state]
                state = state[1:] if state[1:] in fail else ()
            score += arcs[state, w] if state else math.log10(root(w))
            state = (*state, w)[-2:]
            while state and state not in fail:
                state = state[1:]
            base += math.log10(root(w))
            known += uni[w] > 0
        out.append((i, len(toks(t)), known, n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def run(docs):
    got = lm_score.scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    return sorted(((r[0], r[1], r[2], r[3], round(r[4], 6), round(r[5], 6)) for r in got), key=str)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 50_000)
    monkeypatch.setattr(lm_score, "LANE", 37)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert run(docs) == want
    assert sum(r[5] for r in want) > sum(r[4] for r in want)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a\tb"), (None, "b b b"), (5, "zz " * 100_000), (5, "zz"), (16, "a b " * 20_000 + "c")]
    assert run(table(spark, rows)) == brute(rows)
    assert run(table(spark, [])) == []
    held = [(i, "x y") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert run(table(spark, held)) == brute(held)


def test_repeated_rows_and_long_white_space(spark):
    rows = [(8, "one two three one two")] * 500 + [(9, " " * 2_000_000 + "one\n" + "\n" * 2_000_000 + "two")]
    assert run(table(spark, rows)) == brute(rows)


def test_counts_beyond_32_bits():
    big = np.array([0, 1, 255, 1 << 33, (1 << 63) - 1], np.uint64)
    assert (lm_score.unpack(lm_score.pack(big)) == big).all() and len(lm_score.unpack(lm_score.pack(big[:0]))) == 0


def test_lanes_carry_the_same_state(monkeypatch):
    rng = np.random.default_rng(5)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 12, n)) for n in (0, 1, 2, 3, 500, 40, 7)]
    w = lm_score.W.split_words(pa.array(text), lower=True)
    row = {"first": lm_score.pack(w.first), "text": zstandard.ZstdCompressor().compress(w.data.tobytes()), "train": np.array([True, False, True, True, True, False, True]).tobytes()}
    row |= {"doc_id": np.arange(7).tobytes(), "known": np.ones(7, bool).tobytes()}
    counts = [n for _, n, _, _ in lm_score.Tokens.read(row).counted(64)]
    found = []
    for lane in (2, 3, 17, 10_000):
        monkeypatch.setattr(lm_score, "LANE", lane)
        found.append(lm_score.block_scores(row, counts, 64, 548, 13).column("score").to_numpy().round(9).tolist())
    assert all(x == found[0] for x in found)


def test_weights_of_a_state_sum_to_one():
    uni = np.array([5, 3, 0])
    pairs, pair_of = np.array([2, 3, 2, 1]), (np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]))
    triples, triple_of = np.array([1, 2]), (np.array([1, 1]), np.array([2, 3]))
    a = lm_score.Automaton(uni, pairs, triples, pair_of, triple_of, 8, 2)
    assert abs((10**a.weight[:3]).sum() - 1) < 1e-12
    for state in (1, 2, 1 + 3 + 1):
        total = 0.0
        for word in range(3):
            s, p = state, 1.0
            while True:
                arcs = [i for i in range(len(a.source)) if a.source[i] == s and word == (i if i < 3 else pair_of[1][i - 3] if i < 7 else pair_of[1][triple_of[1][i - 7]])]
                if arcs:
                    break
                p, s = p * 10 ** a.fail_weight[s], a.fail[s]
            total += p * 10 ** a.weight[arcs[0]]
        assert abs(total - 1) < 1e-12
