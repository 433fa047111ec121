"""Whitening of embeddings by a matrix-free Jacobi-Davidson iteration.

The covariance is never formed: a product with a block of vectors is one pass over the stored rows, which sums
x (x' u) of centred rows task by task. A subspace grows by corrections of its leading Ritz vectors; a correction solves
the equation projected off what is locked and off the Ritz vectors, by MINRES, all columns of a block in the same passes.
Ritz pairs are locked, leading ones first, when their residual is at double precision. The driver holds a few blocks of
(dimensions x components) numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
#: Entries beyond this count as this.
FAR = 2.0**62
#: Spare Ritz vectors of the first block, MINRES steps for a correction, and the blocks that a basis may hold.
SPARE = 8
INNER = 4
BLOCKS = 4
#: A residual is at double precision at so many roundings of the largest eigenvalue; it may stall below the second.
PRECISE, STALLED = 32, 1 << 14
ROUNDS = 200
EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


def _minres(product: Product, shifts: np.ndarray, off: np.ndarray, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Columns t with (I - off off')(A - shift)(I - off off') t close to rhs, after `steps` of MINRES from zero."""
    clear = lambda x: x - off @ (off.T @ x)
    safe = lambda x: np.where(x == 0, 1.0, x)
    v_old, v = np.zeros_like(rhs), clear(rhs)
    beta = np.linalg.norm(v, axis=0)
    v = v / safe(beta)
    eta, beta_here = beta.copy(), np.zeros_like(beta)
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    w_old, w, t = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    for _ in range(steps):
        p = clear(product(v) - v * shifts)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta_here * v_old
        beta_next = np.linalg.norm(p, axis=0)
        # two old rotations and a new one turn the tridiagonal matrix's column into a triangular one
        delta = c * alpha - c_old * s * beta_here
        rho = np.hypot(delta, beta_next)
        above, further = s * alpha + c_old * c * beta_here, s_old * beta_here
        c_new, s_new = delta / safe(rho), beta_next / safe(rho)
        w_old, w = w, (v - further * w_old - above * w) / safe(rho)
        live = (rho > 0) & (beta > 0)
        t = t + np.where(live, c_new * eta, 0) * w
        eta = np.where(live, -s_new * eta, 0)
        v_old, v = v, np.where(beta_next > 0, p / safe(beta_next), 0)
        beta_here, c_old, c, s_old, s = beta_next, c, c_new, s, s_new
    return t


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` adds to the orthonormal columns of `against`."""
    room = len(new) - against.shape[1]
    for _ in range(2):
        new = new - against @ (against.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
    if not room or not new.shape[1]:
        return new[:, :0]
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-8 * s[0]][:, :room]
    for _ in range(2):
        u = np.linalg.qr(u - against @ (against.T @ u))[0]
    return u


def jacobi_davidson(product: Product, d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    Every residual is at double precision, or has stopped falling within STALLED roundings of the largest eigenvalue.
    """
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    basis = np.linalg.qr(rng.standard_normal((d, min(d, k + SPARE))))[0]
    image = product(basis)
    best = np.inf
    for _ in range(ROUNDS):
        inner = basis.T @ image
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = basis @ y, image @ y
        largest = max(values[0] if len(values) else 0.0, abs(theta[0]) if len(theta) else 0.0)
        rest = np.linalg.norm(au - u * theta, axis=0)
        whole = locked.shape[1] + u.shape[1] == d
        now = float(rest[: k - len(values)].max(initial=0))
        bar = (STALLED if now >= best / 2 or whole else PRECISE) * EPS * largest
        best = min(best, now)
        done = int(np.argmin(np.append(rest <= bar, False)))
        done = min(done, k - len(values))
        if done:
            locked, values = np.hstack([locked, u[:, :done]]), np.append(values, theta[:done])
            u, au, theta, rest, best = u[:, done:], au[:, done:], theta[done:], rest[done:], np.inf
        if len(values) == k:
            return values, locked
        want = k - len(values)
        if u.shape[1] > BLOCKS * (k + SPARE):
            u, au, theta = (x[..., : 2 * (k + SPARE)] for x in (u, au, theta))
        aim = u[:, :want]
        t = _minres(product, theta[:want], np.hstack([locked, aim]), -(au - u * theta)[:, :want], INNER)
        new = _orthonormal(t, np.hstack([locked, u]))
        if not new.shape[1] and not whole:
            new = _orthonormal(rng.standard_normal((d, want)), np.hstack([locked, u]))
        basis = np.hstack([u, new])
        image = np.hstack([au, product(new)]) if not whole else product(basis)
    raise ArithmeticError(f"{k - len(values)} of {k} components have not settled: residual {best}")


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n x - S, exact: longs, or whole numbers of any size."""
    return (x.astype(object) if wide else x) * n - np.array(sums, object if wide else np.int64)


def _summed(rows: DataFrame, task: Callable[[np.ndarray], np.ndarray], d: int, n: int, sums: list[int], wide: bool, shape: tuple[int, int]) -> np.ndarray:
    """The sum of task(centred rows) over all rows; partial sums are added in Spark, the driver gets one array."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += task((_centred(_rows(batch.column(0), d), n, sums, wide) / n).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    got = rows.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(shape)


def whiten(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), most: int = COMPONENTS) -> DataFrame:
    """`keep`, component, n, deviation, whitened, explained, identity_error; one row per usable row and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and so are those of another length than
    most (of equally many, the longer). Repeated rows count and are returned each time. Directions without variance are
    no components, so equal vectors or a single one give no rows, like an empty table. Entries beyond 2^62 / 64 count as
    that; a deviation beyond 64 bits is null. Extra columns are not read.
    """
    spark = vectors.sparkSession
    c = lambda v: F.least(F.greatest(F.floor(v.cast("double") * SCALE), F.lit(-int(FAR))), F.lit(int(FAR))) + SHIFT
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    rows = saved(usable.select(F.struct(*keep).alias("row"), F.transform("embedding", c).alias("x")))
    out = T.StructType([*rows.schema["row"].dataType.fields, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())])
    for name in ("whitened", "explained", "identity_error"):
        out = out.add(name, T.DoubleType())
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    d, n = sizes[0]
    rows = rows.where(F.size("x") == d)
    each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs("v")).alias("top")).collect()  # d rows
    sums = [int(r["s"]) for r in sorted(each, key=lambda r: r["i"])]
    wide = (2 * n * max(r["top"] for r in each)) ** 2 * d >= 2**63
    of = lambda task, shape: _summed(rows, task, d, n, sums, wide, shape)

    def product(u: np.ndarray) -> np.ndarray:
        return of(lambda x: x.T @ (x @ u), (d, u.shape[1])) / n if u.shape[1] else u

    trace = float(of(lambda x: np.array([[(x * x).sum()]]), (1, 1))[0, 0]) / n
    values, axes = jacobi_davidson(product, d, min(most, d)) if trace else (np.zeros(0), np.zeros((d, 0)))
    k = int((values > d * EPS * STALLED * values[:1].sum()).sum())
    if not k:
        return spark.createDataFrame([], out)
    values, axes = values[:k], axes[:, :k] / np.sqrt(values[:k])
    moments = of(lambda x: np.vstack([(x @ axes).T @ (x @ axes), (x @ axes).sum(0)]), (k + 1, k)) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                moved = _centred(_rows(part.column(1), d), n, sums, wide)
                deviation = [v if v < 2**63 else None for v in (int(v) for v in (moved * moved).sum(1))]
                m = part.num_rows
                at = pa.array(np.repeat(np.arange(m, dtype=np.int32), k))
                names = part.column(0)
                columns = [names.field(i).take(at) for i in range(names.type.num_fields)]
                columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(at)]
                columns += [pa.array(((moved / n).astype(float) @ axes).ravel()), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return rows.select("row", "x").mapInArrow(run, out)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
