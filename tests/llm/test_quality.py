import re
from collections import Counter

import numpy as np

from skyloom.llm import quality
from tests.llm.test_dedup import DATA


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [(901, None, None, None), (902, "", "en", None), (903, "a\n\na\n a\na", "en", "s"), (904, "x y z w x y z w x y z w é é\r\n" * 4000, "en", "s")]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r[0]: tuple(r)[3:] for r in quality.statistics(docs).collect()}
    assert got == want


def test_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.judged(docs)
    assert out.count() == docs.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.6


def test_estimate_is_robust(spark):
    rng = np.random.default_rng(1)
    clean = rng.multivariate_normal(np.zeros(5), np.eye(5) + 0.5, 3000)
    data = np.concatenate([clean, rng.normal(12, 1, (500, 5))])
    rows = spark.createDataFrame([(["A"], *map(float, r)) for r in data], "keys array<string>, x1 double, x2 double, x3 double, x4 double, x5 double")
    (found,) = quality.estimates(rows).collect()
    assert found.n == 3500 and np.abs(found.mean).max() < 0.15


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, key string, g0 long"
    assert quality.judged(spark.createDataFrame([], schema)).count() == 0
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(None, words, None, None, "x", 1), (1, None, None, "s", "x", 1), (2, words, "en", None, "x", 1), (2, words, "en", None, "x", 1)]
    out = quality.judged(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.kept) for r in out) == [("1", False), ("2", True), ("2", True), ("None", True)]
    rows = [(i, words, None if i % 2 else "en", None, "x", 1) for i in range(100)]
    assert all(r.kept for r in quality.judged(spark.createDataFrame(rows, schema)).collect())


def fast_mcd(x, rng):
    """Distances by the best of 300 random starts, concentrated on exact distances until they stand still."""
    n, h, best = len(x), int(np.ceil(quality.SHARE * len(x))), None
    for _ in range(300):
        some = rng.choice(n, quality.N + 1, replace=False)
        while True:
            mean, cov = x[some].mean(axis=0), np.cov(x[some].T, bias=True)
            cov = cov + np.diag(np.maximum(np.square(quality.FLOOR) - np.diag(cov), 0))
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            then = np.argsort(d, kind="stable")[:h]
            if len(then) == len(some) and set(then) == set(some):
                break
            if len(some) == h and np.linalg.slogdet(cov)[1] >= last - 1e-9:
                break
            some, last = then, np.linalg.slogdet(cov)[1] if len(some) == h else np.inf
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], d / max(1.0, np.sort(d)[h - 1] / quality.QUANTILE_75)
    return best[1]


def test_verdicts_equal_many_exact_starts(spark):
    rng = np.random.default_rng(2)
    groups = {}
    for g, n in enumerate((60, 150, 300)):
        a = rng.normal(0, 1, (5, 5))
        clean = rng.multivariate_normal(rng.normal(0, 3, 5), a @ a.T + 0.3 * np.eye(5), n)
        far = clean.mean(axis=0) + rng.choice([-1, 1], 5) * 40 + rng.normal(0, 1, (n // 6, 5))
        groups[f"g{g}"] = np.concatenate([clean, far])
    rows = spark.createDataFrame([([g], *map(float, r)) for g, x in groups.items() for r in x], "keys array<string>, x1 double, x2 double, x3 double, x4 double, x5 double")
    found = {r.g: r for r in quality.estimates(rows).collect()}
    for g, x in groups.items():
        off = x - np.array(found[g].mean)
        ours = sum(off[:, i] * off[:, j] * c for (i, j), c in zip(quality.PAIRS, found[g].inverse, strict=True)) / found[g].spread
        want = fast_mcd(x, rng)
        assert np.mean((ours > quality.CUTOFF) == (want > quality.CUTOFF)) > 0.98
        assert (ours[-(len(x) // 7) :] > quality.CUTOFF).all() and (want[-(len(x) // 7) :] > quality.CUTOFF).all()


def test_base_columns_equal_sql(spark):
    import duckdb

    sql = """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
             c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
             r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM c WHERE n > 1) GROUP BY doc_id),
             l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
        FROM t LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)"""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = quality.judged(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(sql).fetchall())
