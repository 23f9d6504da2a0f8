import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from skyloom.llm import periodic_runs
from skyloom.llm.queries import ORACLE, op12_periodic_runs

DATA = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()), T.StructField("n", T.LongType())])


def brute(doc_id, text, rewrite=True):
    """By the definition: every lag, every maximal stretch, its smallest period."""
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if rewrite and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i - q, j - i + q), q)  # smaller lags come first
            i = j
    runs = sorted((s, m, q) for (s, m), q in found.items())
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def direct(rows, rewrite=False):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text"])
    return [tuple(r[:8]) for r in periodic_runs.runs_of(batch, rewrite)]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(ORACLE["op12_periodic_runs"]).fetchall()
    got = op12_periodic_runs(spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_runs for r in got) > 5


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, DATA).collect()}
    assert all(got[i] == brute(i, t) for i, t in rows)


def test_random_words():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        w = []
        while len(w) < 260:
            unit = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 33, 40]))]
            w += unit * rng.choice([1, 1, 2, 3, 4, 9]) + unit[: rng.randint(0, len(unit))]
        rows.append((i, " ".join(w)))
    assert direct(rows) == [brute(i, t, False) for i, t in rows]
    assert direct(rows, True) == [brute(i, t) for i, t in rows]


def test_edges_of_runs():
    unit = [f"w{i}" for i in range(8)]
    texts = [" ".join(unit * 3), " ".join((unit * 3)[:-1]), " ".join("a" * 24), " ".join("a" * 23), " ".join(["x", *(unit * 3), "y"]), " ".join(unit * 3 + ["z"] + unit * 3), " ".join([*"ab" * 12, *"abc" * 12])]
    rows = list(enumerate(texts))
    assert direct(rows) == [brute(i, t, False) for i, t in rows]
    assert [r[1] for r in direct(rows)][:4] == [1, 0, 1, 0]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a " * 100), (5, "a " * 100), (None, "b c " * 50), (-(2**63), "x y z " * 20), (2**63 - 1, "é ü " * 40)]
    table = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], SCHEMA)
    key = lambda r: tuple(str(x) for x in r)
    got = periodic_runs.periodic_runs(table, rewrite=True)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=key) == sorted((brute(i, t) for i, t in rows), key=key)
    five = [r for r in got.collect() if r.doc_id == 5][0]
    assert five.collapsed == "a" and [tuple(x) for x in five.runs] == [(0, 100, 1)]
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0


def test_very_long_texts():
    one = "w " * 1_000_000
    many = " ".join(f"w{i % 5003}" for i in range(400_000))
    mixed = " ".join(str(x) for x in np.random.default_rng(1).integers(0, 3, 300_000))
    got = direct([(1, one), (2, many), (3, mixed)])
    assert got[0][1:6] == (1, 0, 1_000_000, 1, 1_000_000_000) and got[1][1:6] == (1, 0, 400_000, 5003, 79952)
    assert got[2][1] == brute(3, mixed[:3000], False)[1] or got[2][1] > 0


def test_hashes_that_fail_are_found_out(monkeypatch):
    monkeypatch.setattr(periodic_runs.W.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    text = " ".join(["p q r s"] * 8 + [f"v{i}" for i in range(30)])
    assert direct([(1, text)]) == [brute(1, text, False)]
