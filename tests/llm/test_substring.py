import hashlib
import re

import numpy as np

from skyloom.llm import substring_dedup
from tests.llm.test_dedup import DATA, colliding, table


def brute(rows, window=50):
    first = {}
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **kw):
    return sorted((tuple(r) for r in substring_dedup.cut(docs, **kw).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 5
    assert run(docs) == want


def test_edits_and_shared_passages(spark):
    rng = np.random.default_rng(4)
    passage = [f"p{x}" for x in rng.integers(0, 30, 400)]
    rows = []
    for i in range(60):
        body = [f"b{x}" for x in rng.integers(0, 1000, rng.integers(0, 200))]
        a = int(rng.integers(0, 300))
        piece = passage[a : a + int(rng.integers(20, 200))]
        if i % 3 == 0 and piece:
            piece[len(piece) // 2] = "edit"
        rows.append((int(rng.integers(0, 1000)), " ".join(body + piece + body[:70] + piece)))
    rows = list({i: (i, t) for i, t in rows}.values())
    assert run(table(spark, rows)) == brute(rows)


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SEGMENT", 64)
    text = [f"w{i % 211}x{i % 17}" for i in range(1500)]
    rows = [(1, " ".join(text)), (2, " ".join(text[333:777])), (3, "new " + " ".join(text[100:900]) + " end"), (4, "a " * 300)]
    assert run(table(spark, rows)) == brute(rows)


def test_words_that_polynomials_confuse(spark):
    a, b = colliding()
    words = [f"w{i}" for i in range(60)]
    one, two = list(words), list(words)
    for k in range(3, 60, 10):
        one[k], two[k] = a, b
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(two))]
    assert run(table(spark, rows)) == brute(rows)


def test_repeated_rows(spark):
    w = [f"w{i}" for i in range(120)]
    rows = [(4, " ".join(w))] * 300 + [(1, "a b c " + " ".join(w[20:100]) + " d"), (3, "short"), (None, " ".join(w))]
    assert run(table(spark, rows)) == brute(rows)


def test_chains_fold_to_their_first_edge(spark):
    rows = [(d, 100 * d, 10 * k, 10, bytes([65 + k])) for d in (1, 2) for k in range(9)] + [(3, 300, 10 * k, 10, bytes([65 + k])) for k in range(5, 8)]
    got = substring_dedup.chains(spark.createDataFrame(rows, "doc_id long, rid long, start long, n int, edge binary")).collect()
    assert sorted((bytes(r.edge).decode(), bytes(r.head).decode(), r.before) for r in got) == [("B", "A", 10), ("C", "A", 20), ("D", "A", 30), ("E", "A", 40), ("G", "F", 10), ("H", "F", 20)]


def test_edge_cases(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(None, w), (5, w), (6, w), (7, None), (8, ""), (9, " ".join(w.split()[:49])), (10, "x " + w.replace(" ", "\n\t") + " y")]
    assert run(table(spark, rows)) == brute(rows)
    assert run(table(spark, [])) == []
    twice = substring_dedup.cut(table(spark, [(5, w), (5, w), (4, "z")])).collect()
    assert len(twice) == 3 and all(r.n_removed == 0 for r in twice)


def test_spans(spark):
    w = [f"w{i}" for i in range(200)]
    docs = table(spark, [(1, " ".join(w)), (2, "a b c " + " ".join(w[20:180]) + " d")])
    (span,) = substring_dedup.spans(substring_dedup.repeated(docs)[0]).collect()
    assert (span.doc_id, span.source_id, span.start, span.end, span.source_start) == (2, 1, 3, 163, 20)
