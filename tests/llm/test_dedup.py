import hashlib
import re

import numpy as np
from pyspark.sql import types as T

from skyloom.llm import exact_dedup, near_dedup
from skyloom.llm import words as W

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("n", T.LongType())])
DATA = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[key])[1]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out)


def test_exact_edge_cases(spark):
    rows = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \n"), (6, "a\tb "), (7, "é" * 5), (8, "é é é é é"), (9, "x" * 300_000), (10, "x" * 300_000), (11, "ab ")]
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(table(spark, rows)).drop("in_history").collect())
    assert got == brute_exact(rows)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    twice = exact_dedup.exact_dedup(table(spark, [(1, "q"), (1, "q"), (None, "q")])).collect()
    assert len(twice) == 3 and all(r.group_size == 3 and r.keep_id == 1 for r in twice)


def test_exact_extreme_ids(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "a"), (high, "a "), (high - 1, "a "), (None, "b"), (high, "b"), (high - 1, "b"), (low, " c"), (low + 1, " c"), (2**53 + 1, "d"), (None, "d" * 3)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table(spark, rows)).collect()}
    assert got == {
        (low, high - 1, 3, False), (high, high - 1, 3, False), (high - 1, high - 1, 3, True), (None, high - 1, 3, False), (high, high - 1, 3, False), (high - 1, high - 1, 3, True),
        (low, low, 2, True), (low + 1, low, 2, False), (2**53 + 1, 2**53 + 1, 1, True), (None, None, 1, True),
    }


def test_perfect_hash():
    words = np.random.default_rng(3).integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    levels, slot = exact_dedup.build_hash(words)
    assert sorted(slot) == list(range(5000))
    assert (exact_dedup.find_slots(levels, words) == slot).all()


def test_exact_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = exact_dedup.exact_dedup(docs)
    assert sorted(tuple(r) for r in got.drop("in_history").collect()) == brute_exact(rows)
    assert {r.in_history for r in got.select("in_history").distinct().collect()} == {True, False}


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_near(rows, n, num):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                x = len(sets[a] & sets[b])
                if 100 * x >= num * (len(sets[a]) + len(sets[b]) - x):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in near_dedup.near_dedup(docs, 3, 0.85).drop("rid").collect()) == brute_near(rows, 3, 85)


def test_near_hot_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 16)
    monkeypatch.setattr(near_dedup, "PIVOTS", 4)
    monkeypatch.setattr(near_dedup, "SLICE", 16)
    rng = np.random.default_rng(1)
    text = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for i in range(150):
        copy = list(text)
        for k in rng.integers(0, 120, rng.integers(0, 9)):
            copy[k] = f"v{rng.integers(0, 9999)}"
        rows.append((i, " ".join(copy)))
    got = sorted(tuple(r) for r in near_dedup.near_dedup(table(spark, rows), 3, 0.85, miss=1e-9).drop("rid").collect())
    assert got == brute_near(rows, 3, 85)


def test_near_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "one"), (6, "a b c d"), (7, " \n"), (8, "a B c d")]
    got = sorted(tuple(r) for r in near_dedup.near_dedup(table(spark, rows), 3, 0.85).drop("rid").collect())
    assert got == brute_near(rows, 3, 85)
    assert near_dedup.near_dedup(table(spark, [])).count() == 0
    odd = near_dedup.near_dedup(table(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (2, "x y z")]), 3, 0.85).collect()
    assert len(odd) == 4 and all(r.kept for r in odd)


def colliding(n=1024):
    """Two words that agree under every polynomial hash modulo 2^64."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_near_words_that_polynomials_confuse(spark):
    a, b = colliding()
    words = [f"w{i}" for i in range(60)]
    one, two = list(words), list(words)
    for k in range(3, 60, 10):
        one[k], two[k] = a, b
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, a), (4, b), (5, a)]
    for n, num in ((3, 85), (5, 80)):
        got = sorted(tuple(r) for r in near_dedup.near_dedup(table(spark, rows), n, num / 100).drop("rid").collect())
        assert got == brute_near(rows, n, num)


def test_near_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(7, text)] * 400 + [(7, "another text of row seven")] * 3 + [(2, text + " end"), (9, "x y z")]
    got = near_dedup.near_dedup(table(spark, rows), 3, 0.85).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(7, 78, 2), (7, 3, 7), (2, 79, 2), (9, 1, 9)}


def test_exact_sets_are_told_by_words():
    sets = near_dedup.exact_sets(["a b c d", "b c d A", "a b", "A B", "b a", "x"], 3)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 1]
    assert len(np.intersect1d(sets[0], sets[1])) == 1 and (sets[2] == sets[3]).all() and sets[2] != sets[4]


def test_words_match_regex():
    import pyarrow as pa

    texts = ["a  b\tc d", None, "", " x", "É é\x0b\x0cz", "long" * 400_000 + " end", "12345678 123456789 1234567 12345678x", *colliding()]
    w = W.split_words(pa.array(texts))
    want = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert np.diff(w.first).tolist() == [len(w) for w in want]
    flat = [x for ws in want for x in ws]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == flat
    assert len(set(w.hashes().tolist())) == len(set(flat))
