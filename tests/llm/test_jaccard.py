import random

import duckdb
import numpy as np
import pytest

from skyloom.llm import jaccard_join as J
from skyloom.llm.queries import ORACLE, op13_ngram_jaccard_join
from tests.llm.test_dedup import DATA, brute_near, colliding, table


def found(spark, rows, words=5, similarity=0.8):
    return sorted(tuple(r) for r in J.jaccard_join(table(spark, rows), words, similarity).drop("rid").collect())


def wanted(rows, words=5, num=80):
    return [r[:3] for r in brute_near(rows, words, num)]


def test_query_against_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = sorted(map(tuple, op13_ngram_jaccard_join(spark, DATA).collect()))
    assert got == sorted(con.execute(ORACLE["op13_ngram_jaccard_join"]).fetchall())
    rows = con.execute("select doc_id, text from documents").fetchall()
    assert got == wanted(rows) and len({r[2] for r in got}) < len(got)


def corpus(n, unlike, seed=1):
    """Near copies of a few texts, and unlike texts that share a passage."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for g in range(3):
        text = [f"w{rng.randrange(500)}" for _ in range(90)]
        for _ in range(n):
            copy = list(text)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(90)] = f"v{rng.randrange(9999)}"
            rows.append(" ".join(copy))
    for _ in range(unlike):
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([14, 15, 16, 60]))]
        rows.append(" ".join(passage + own if rng.random() < 0.5 else own + passage))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("tile", "tile_bytes", "depth"), [(256, 4 << 20, 4), (12, 4 << 20, 4), (12, 4 << 20, 0), (40, 6000, 2), (30, 4 << 20, 1)])
def test_regions_of_any_size(spark, monkeypatch, tile, tile_bytes, depth):
    for name, value in (("TILE", tile), ("TILE_BYTES", tile_bytes), ("DEPTH", depth), ("SLICE", 2 * tile), ("GROUP", tile), ("PIVOTS", 4)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(40, 60)
    assert found(spark, rows) == wanted(rows)


def test_cells_of_clusters(spark, monkeypatch):
    """Clusters that share a frequent passage: cells pay, and links across them are found."""
    for name, value in (("TILE", 8), ("SLICE", 32), ("GROUP", 8), ("PIVOTS", 12), ("OFTEN", 10**9)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(8)
    rows, shared = [], [f"s{i}" for i in range(30)]
    for _ in range(10):
        text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(12):
            copy = shared + text
            for p in rng.sample(range(30, 90), rng.choice([0, 1, 2, 3])):
                copy[p] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    assert found(spark, rows) == wanted(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "one"), (6, "a b c d e f"), (7, " \n"), (8, "a B c d e f"), (9, "a b c d"), (10, "b a c d")]
    assert found(spark, rows) == wanted(rows)
    assert found(spark, []) == []
    odd = found(spark, [(2, "a b c d e"), (2, "a b c d e"), (2, "x y z q r"), (5, "x y z q r")])
    assert odd == [(2, 1, 2)] * 3 + [(5, 1, 2)]
    assert J.jaccard_join(table(spark, [(None, "a b c"), (3, "a b c")])).where("doc_id is null and component_id is null").count() == 1


def test_at_the_threshold(spark):
    """Sets of n shingles that differ in just as many as the threshold allows, or one more."""
    rows = []
    for k, n in enumerate((9, 10, 18, 27, 45, 90)):
        base = [f"b{k}x{i}" for i in range(n + 4)]
        for cut in range(12):
            rows.append((len(rows), " ".join(base[: n + 4 - cut] + [f"c{k}x{cut}y{i}" for i in range(cut)])))
    assert found(spark, rows) == wanted(rows)


def test_words_that_polynomials_confuse(spark):
    a, b = colliding()
    words = [f"w{i}" for i in range(60)]
    one, two = list(words), list(words)
    for k in range(3, 60, 10):
        one[k], two[k] = a, b
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, a), (4, b), (5, a)]
    assert found(spark, rows) == wanted(rows)


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    long = [f"w{x}" for x in rng.integers(0, 10**6, 300_000)]
    near = long[:270_000] + [f"v{x}" for x in rng.integers(0, 10**6, 30_000)]
    far = long[:150_000] + near[270_000:] * 5
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(long) + " end"), (5, "x " * 500_000)]
    assert [r[2] for r in found(spark, rows)] == [1, 1, 3, 1, 5]


def test_region_links():
    sets = [np.arange(0, 10), np.arange(0, 9), np.arange(1, 11), np.arange(50, 60), np.array([-1]), np.array([-1])]
    links = J.region_links(sets, np.zeros(6, int), np.arange(6), 80, 100)
    assert sorted(links) == [(0, 1), (0, 2), (4, 5)]
    assert J.region_links(sets, np.ones(6, int), np.arange(6), 80, 100) == []
