import numpy as np
import pytest
from pyspark.sql import types as T

from skyloom.llm import whitening
from skyloom.llm.queries import op11_embedding_whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType()), T.StructField("n", T.LongType())])


def brute(rows, k=32):
    """{vec_id: (deviation, projections)} and e, trace of good rows, by a full decomposition."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    centred = np.array([[n * a - s for a, s in zip(r, total, strict=True)] for r in x], float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in good], dev, centred @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.square(centred).sum() * n


def compare(got, rows, k=32):
    ids, dev, want, share = brute(rows, k)
    assert len(got) == len(ids) * min(k, want.shape[1])
    y = np.full(want.shape, np.nan)
    at = {i: a for a, i in enumerate(ids)}
    for r in got:
        assert r.n == len(ids) and r.deviation == dev[at[r.vec_id]] and r.identity_error < 1e-10
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        y[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((y * want).sum(axis=0))
    assert np.abs(y - want * sign).max() < 1e-7


def test_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    compare(op11_embedding_whitening(spark, DATA).collect(), rows)


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(5) * [3, 2, 1, 0.5, 0.25]).tolist()) for i in range(60)]
    rows += [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (94, rows[0][1])]
    table = lambda r: spark.createDataFrame([(i, v, "a", 1) for i, v in r], SCHEMA)
    compare(whitening.whitened(table(rows)).collect(), rows)
    compare(whitening.whitened(table(rows), 2).collect(), rows, 2)
    odd = rows + [(95, [1.0, 2.0]), (96, []), (97, [1e300] * 5)]
    assert whitening.whitened(table(odd)).count() == 5 * 61
    assert whitening.whitened(table([])).count() == 0
    assert whitening.whitened(table([(1, None)])).count() == 0
    assert whitening.whitened(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whitened(table([(None, [1.0, 5.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0])])).collect()
    assert len(flat) == 3 and {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)


@pytest.mark.parametrize(("d", "k"), [(200, 32), (120, 10), (40, 40), (3, 32)])
def test_jacobi_davidson(d, k):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.sort(np.concatenate([rng.random(d - 3) * 50 + 1, [50.0, 50.0, 400.0]]))[::-1]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    calls = []
    got, u = whitening.jacobi_davidson(lambda b: calls.append(b.shape) or v @ b, d, k)
    k = min(k, d)
    assert np.abs(got - e[:k]).max() < 1e-11 and np.abs(u.T @ u - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(v @ u - u * got, axis=0).max() < 1e-11
    assert len(calls) < 400


def test_minres():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 4))
    assert np.abs(a @ whitening.minres(lambda y: a @ y, b, 200, 1e-12) - b).max() < 1e-8
