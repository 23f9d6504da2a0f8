"""Operator 11, whitening of embeddings by Jacobi-Davidson on distributed centred products.

1. Vectors are checked and brought to whole numbers ``floor(64 * c) + 1000000``, written once.
   Counts and per-dimension sums are exact 64-bit sums.
2. The covariance is never formed.  Its product with a block of vectors is one pass over the
   rows: each task centres its rows exactly (n*x - S is a whole number), multiplies and adds up;
   Spark adds the tasks' sums per entry, so the driver gets (dimensions x block) numbers whatever
   the number of rows or tasks.
3. Jacobi-Davidson in blocks: Rayleigh-Ritz in the search space, leading Ritz pairs whose residual
   has reached double precision are locked, the others get corrections from the projected
   equation (I - QQ')(V - e)(I - QQ') t = -r, solved roughly by MINRES with all right sides in one
   pass a step; the space is expanded by them and restarted where it gets too wide.
4. Rows are projected in one pass; the identity error is measured on those very values.

The driver holds a few blocks of (dimensions x 3 * components) numbers and no row.

Defined results: rows whose vector is null, holds a null, NaN or infinite entry or one whose whole
number is beyond 2**62 are dropped, and so are rows whose length is not the most frequent one
(the longest of such); null and repeated vec_ids come back as they are, a row each; components
whose eigenvalue is below 1e-12 of the largest have no unit variance and are left out, so equal
vectors, one vector and empty tables give no rows; deviation is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import base, written

SCALE, SHIFT = 64, 1_000_000
STEPS = 6  # of MINRES for each correction
ROUNDS = 500
SEED = 11
RESIDUAL = 64 * np.finfo(float).eps  # of the largest eigenvalue
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Product = Callable[[np.ndarray], np.ndarray]


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) with x as packed 64-bit whole numbers, and the number of dimensions."""
    plain = base(rows, "vec_id", vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("c"))
    good = plain.where(F.col("c").isNotNull() & F.forall("c", lambda v: F.coalesce(F.abs(v) < 2.0**62 / SCALE, F.lit(False)) & ~F.isnan(v)))
    most = good.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("d")).limit(1).collect()
    d = most[0].d if most else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            x = np.floor(SCALE * c).astype("<i8") + SHIFT
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "x"])

    return written(good.where(F.size("c") == d).mapInArrow(run, "vec_id long, x binary"), "vectors"), d


def _block(batch: pa.RecordBatch, d: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(batch.num_rows, d)


def added(vectors: DataFrame, d: int, work: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of work(block of rows), entry by entry; ``kind``: long (exact) or double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_block(batch, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["sums"])

    sums = vectors.select("x").mapInArrow(run, f"sums array<{kind}>").select(F.posexplode("sums").alias("k", "v"))
    found = sums.groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return np.array([r.v for r in found], np.int64 if kind == "long" else float)


def minres(apply: Product, right: np.ndarray, steps: int, tolerance: float = 0.05) -> np.ndarray:
    """Rough solutions of apply(t) = right, a column each, apply symmetric; one apply a step for all columns."""
    safe = lambda v: np.where(v == 0, 1.0, v)
    t = np.zeros_like(right)
    v_old, w, w_old = t.copy(), t.copy(), t.copy()
    v, beta = right.copy(), np.linalg.norm(right, axis=0)
    eta, first = beta.copy(), beta.copy()
    c, s, c_old, s_old = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        v = v / safe(beta)
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        onward = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, onward)
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        c_old, c, s_old, s = c, delta / safe(rho), s, onward / safe(rho)
        w_old, w = w, np.where(rho > 0, (v - rho3 * w_old - rho2 * w) / safe(rho), 0.0)
        t = t + c * eta * w
        eta = -s * eta
        v_old, v, beta = v, p, onward
        if (np.abs(eta) <= tolerance * first).all():
            break
    return t


def _orthonormal(new: np.ndarray, have: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the columns of ``have``."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        new = new - have @ (have.T @ new)
        q, size, _ = np.linalg.svd(new, full_matrices=False)
        new = q[:, size > 1e-8]
        if not new.shape[1]:
            break
    return new


def jacobi_davidson(product: Product, d: int, k: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric operator."""
    k = min(k, d)
    locked, values = np.zeros((d, 0)), []
    space = _orthonormal(np.random.default_rng(SEED).standard_normal((d, min(d, k + 4))), locked)
    image = product(space)
    largest = 0.0
    for _ in range(ROUNDS):
        small = space.T @ image
        e, s = np.linalg.eigh((small + small.T) / 2)
        space, image, e = space @ s[:, ::-1], image @ s[:, ::-1], e[::-1]
        largest = max(largest, abs(e[0]), *[abs(v) for v in values])
        wanted = k - len(values)
        off = image[:, :wanted] - space[:, :wanted] * e[:wanted]
        off = off - locked @ (locked.T @ off)
        done = np.linalg.norm(off, axis=0) <= RESIDUAL * largest
        ready = int(np.argmin(done)) if not done.all() else len(done)
        locked, values = np.hstack([locked, space[:, :ready]]), [*values, *e[:ready].tolist()]
        space, image, e, off = space[:, ready:], image[:, ready:], e[ready:], off[:, ready:]
        wanted -= ready
        if not wanted:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        if space.shape[1] > 2 * wanted + 4:
            space, image = space[:, : wanted + 4], image[:, : wanted + 4]
        known = np.hstack([locked, space[:, :wanted]])
        clear = lambda y: y - known @ (known.T @ y)
        shift = e[: off.shape[1]]
        right = -clear(off)
        fix = clear(minres(lambda y: clear(product(clear(y)) - clear(y) * shift), right, steps))
        more = _orthonormal(np.hstack([fix, off]) if space.shape[1] + len(values) + fix.shape[1] >= d else fix, np.hstack([locked, space]))
        if not more.shape[1]:  # the corrections say nothing new
            more = _orthonormal(np.random.default_rng(len(values)).standard_normal((d, wanted)), np.hstack([locked, space]))
        if more.shape[1]:
            space, image = np.hstack([space, more]), np.hstack([image, product(more)])
        else:  # the search space is everything: products anew, as only rounding is left
            space = _orthonormal(space, locked)
            image = product(space)
    raise ArithmeticError("eigenvectors did not reach double precision")


def whitened(rows: DataFrame, components: int = 32, vector: str = "embedding") -> DataFrame:
    """Each remaining row and component: see WHITENED."""
    spark = rows.sparkSession
    vectors, d = whole_vectors(rows, vector)
    head = added(vectors, d, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "long") if d else []
    if not len(head):
        return spark.createDataFrame([], WHITENED)
    n, total = int(head[0]), head[1:]
    centred = lambda x: (n * x - total).astype(float) / n

    def product(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ block)

        return added(vectors, d, work, "double").reshape(block.shape) / n

    trace = float(added(vectors, d, lambda x: np.array([np.square(centred(x)).sum()]), "double")[0]) / n
    if trace <= 0:
        return spark.createDataFrame([], WHITENED)
    e, u = jacobi_davidson(product, d, components)
    e, u = e[e > 1e-12 * e[0]], u[:, e > 1e-12 * e[0]]
    k, weights = len(e), u / np.sqrt(e)

    def moments(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ weights
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    found = added(vectors, d, moments, "double")
    mean = found[k * k :] / n
    error = float(np.abs(found[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    share = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _block(part, d)
                m, apart = len(x), n * x - total
                beyond = np.square(apart.astype(float)).sum(axis=1) > 9.2e18
                deviation = pa.array(np.square(apart).sum(axis=1), pa.int64(), mask=beyond)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("vec_id")).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(each),
                        pa.array((centred(x) @ weights).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, WHITENED)
