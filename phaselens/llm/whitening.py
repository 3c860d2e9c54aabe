"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V is never formed. A pass over the vectors multiplies it with
a block of columns: each task sums X'(XQ) over its centred rows, the tasks'
sums are added in ``GROUPS`` groups, and the driver gets one small matrix a
group, whatever the number of rows or tasks. From a random block of
``components`` and half as many guard columns, each cycle

* applies a Chebyshev polynomial of V, by its three-term recurrence (one
  pass a degree), which stays small on the unwanted part [a, b] of the
  spectrum and grows steeply above it. b is the block's least Ritz value; a is
  a lower bound from a Lanczos vector that rides along in the same passes (0
  until it says more);
* makes the block orthonormal (QR) and takes its Ritz pairs (Rayleigh-Ritz;
  its product with V is the next filter's first step).

It ends when the residuals |Vu - eu| of all wanted pairs reach rounding, and
raises if they can't be brought to 1e-12 of the largest eigenvalue and 1e-5 of
the pair's own: the result is certified or there is none. A vector's entries are whole numbers, so n and
the sums S are exact, and rows are centred as x - floor(S/n) - (S mod n)/n
before anything is multiplied.

Input cases: rows whose vector is null, empty or holds null or non-finite
entries are dropped; if lengths differ, the length of the most rows (of
equals, the longer) is the table's and rows of others are dropped; repeated
rows and ids count and return as often as they stand, a null id stays null;
extra columns are ignored. Components whose eigenvalue is 0 to rounding (1e-9
of the largest) can't be whitened and are not returned, so equal vectors, a
single vector and an empty table give an empty result. A ``deviation`` past 64
bits is null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaselens.llm.vectors import Vectors

SCALE = 64
SHIFT = 1_000_000
GROUPS = 32


@dataclass(frozen=True)
class Whitening:
    components: int = 32
    guard: int = 16  # least number of further columns of the block
    degree: int = 12  # most passes of a cycle
    spread: float = 1e10  # a cycle lets the first pair outgrow the last wanted by this at most
    cycles: int = 60
    rounding: float = 3e-15  # residual, of the largest eigenvalue, at which to stop
    certified: float = 1e-12  # residual, of the largest eigenvalue, that must be reached
    relative: float = 1e-5  # and of the pair's own
    zero: float = 1e-9  # eigenvalues up to this, of the largest, are taken as 0
    seed: int = 11


# ------------------------------------------------------------ the iteration

class _Lanczos:
    """Lower bound of the spectrum from one vector, one product at a time."""

    def __init__(self, d: int, rng):
        v = rng.standard_normal(d)
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []
        self.low = 0.0

    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def learn(self, product: np.ndarray) -> None:
        if len(self.alpha) >= min(len(product) - 1, 40):
            return
        v = self.basis[-1]
        self.alpha.append(float(v @ product))
        w = product - self.alpha[-1] * v - (self.beta[-1] * self.basis[-2] if self.beta else 0)
        for _ in range(2):
            for b in self.basis:
                w = w - (b @ w) * b
        beta = float(np.linalg.norm(w))
        theta, s = np.linalg.eigh(np.diag(self.alpha) + np.diag(self.beta, 1) + np.diag(self.beta, -1))
        self.low = max(0.0, float(theta[0] - beta * abs(s[-1, 0])))
        if beta <= 1e-12 * max(abs(theta[-1]), 1e-300):
            self.alpha += [0.0] * len(product)  # the space is used up: no further steps
            return
        self.beta.append(beta)
        self.basis.append(w / beta)


def _ritz(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and their products."""
    h = q.T @ w
    theta, z = np.linalg.eigh((h + h.T) / 2)
    z = z[:, ::-1]
    return theta[::-1], q @ z, w @ z


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], d: int, params: Whitening) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, largest residual) of the
    ``components`` leading pairs of the d x d operator ``apply``."""
    p = params
    k = min(p.components, d)
    m = min(d, k + max(p.guard, k // 2))
    rng = np.random.default_rng(p.seed)
    q = np.linalg.qr(rng.standard_normal((d, m)))[0]
    rider = _Lanczos(d, rng)

    def product(block):
        both = apply(np.column_stack([block, rider.vector()]))
        rider.learn(both[:, -1])
        return both[:, :-1]

    theta, q, w = _ritz(q, product(q))
    best, still = np.inf, 0
    for _ in range(p.cycles):
        top = float(theta[0])
        far = np.linalg.norm(w[:, :k] - q[:, :k] * theta[:k], axis=0)
        worst = float(far.max())
        still = still + 1 if worst > best / 2 else 0
        best = min(best, worst)
        certified = worst <= p.certified * top and bool((far <= p.relative * theta[:k])[theta[:k] > p.zero * top].all())
        if top <= 0 or certified and (worst <= p.rounding * top or still >= 2):
            break
        if m == d:  # the block is the whole space: only rounding is left
            q = np.linalg.qr(q)[0]
            theta, q, w = _ritz(q, product(q))
            continue
        a, b = rider.low, float(theta[-1])
        a = a if a < b * (1 - 1e-6) else 0.0
        half, centre = max((b - a) / 2, 1e-8 * top), (b + a) / 2
        grow = [np.arccosh(max(1.0, (x - centre) / half)) for x in (top, float(theta[k - 1]))]
        degree = int(np.clip(np.log(p.spread) / max(grow[0] - grow[1], 1e-9), 1, p.degree))
        sigma = first = half / (top - centre)
        before, now = q, (w - centre * q) * (first / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (product(now) - centre * now) * (2 * after / half) - (sigma * after) * before
            sigma = after
        q = np.linalg.qr(now)[0]
        theta, q, w = _ritz(q, product(q))
    else:
        raise ValueError(f"the eigenpairs were not certified: residual {worst:.3g}, largest eigenvalue {theta[0]:.3g}")
    e, u = theta[:k], q[:, :k]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(k)])
    return e, u * np.where(sign == 0, 1, sign), best


# ---------------------------------------------------------- passes of Spark

class _Fit:
    """n, the sums S and centred rows of the table's vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d, self.sums = n, len(sums), np.array(sums, dtype=np.int64)
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def longs(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, x of the rows)."""
        v = Vectors(col)
        for rows in v.pieces(self.d):
            yield rows, v.scaled(rows, self.d, SCALE) + SHIFT

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n x - S)^2, exact; null past 64 bits."""
        far = np.abs(self.centred(x)).max() * self.n if len(x) else 0.0
        if self.n * (np.abs(x).max() if len(x) else 0) < 2 ** 62 and far * far * self.d < 2 ** 62:
            y = self.n * x - self.sums
            return pa.array((y * y).sum(axis=1))
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums.tolist())) for row in x.tolist()]
        return pa.array([y if y < 2 ** 63 else None for y in exact], pa.int64())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        v = Vectors(batch.column(0))
        for length in v.lengths():
            n, s = held.setdefault(length, [0, np.zeros(length, np.int64)])
            for rows in v.pieces(length):
                s += (v.scaled(rows, length, SCALE) + SHIFT).sum(axis=0)
                held[length][0] += len(rows)
    for length, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(length, length, np.int32)), pa.array(np.arange(length, dtype=np.int32)),
             pa.array(np.full(length, n)), pa.array(s)], ["length", "dim", "n", "s"])


def fit(vectors: DataFrame) -> _Fit | None:
    """n and S over all vectors of the table's length; None without any. The
    driver gets one row a dimension."""
    parts = vectors.mapInArrow(_sums, "length int, dim int, n long, s long")
    sums = parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    common = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).select("length")
    rows = sorted(sums.join(common, "length", "left_semi").select("dim", "n", "s").collect())
    return _Fit(rows[0]["n"], [r["s"] for r in rows]) if rows else None


def _summed(vectors: DataFrame, shape: tuple[int, ...], part: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """The sum of ``part``'s arrays over all batches of the table."""
    size = int(np.prod(shape))

    def task(batches):
        from pyspark import TaskContext

        total, seen = np.zeros(size), False
        for batch in batches:
            for x in part(batch.column(0)):
                total += x.reshape(-1)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "x"])

    def group(batches):
        total, seen = np.zeros(size), False
        for batch in batches:
            for raw in batch.column(1):
                total += np.frombuffer(raw.as_buffer())
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "x"])

    rows = vectors.mapInArrow(task, "g int, x binary").repartition("g").mapInArrow(group, "g int, x binary").select("x").collect()
    return sum((np.frombuffer(r["x"]) for r in rows), np.zeros(size)).reshape(shape)


def _covariance_product(vectors: DataFrame, f: _Fit, block: np.ndarray) -> np.ndarray:
    def part(col):
        for _, x in f.longs(col):
            c = f.centred(x)
            yield c.T @ (c @ block)

    return _summed(vectors, block.shape, part) / f.n


def _trace(vectors: DataFrame, f: _Fit) -> float:
    def part(col):
        for _, x in f.longs(col):
            yield np.array([np.square(f.centred(x)).sum()])

    return float(_summed(vectors, (1,), part)[0]) / f.n


def _identity_error(vectors: DataFrame, f: _Fit, project: np.ndarray) -> float:
    k = project.shape[1]

    def part(col):
        for _, x in f.longs(col):
            z = f.centred(x) @ project
            yield np.vstack([z.T @ z, z.sum(axis=0)])

    got = _summed(vectors, (k + 1, k), part) / f.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


FIELDS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
           params: Whitening = Whitening()) -> DataFrame:
    """One row per remaining vector and component: vec_id, component (from 1,
    by falling eigenvalue), n, deviation, whitened, explained,
    identity_error."""
    schema = T.StructType([T.StructField("vec_id", embeddings.schema[id_col].dataType), *T._parse_datatype_string(FIELDS).fields])
    vectors = embeddings.select(F.col(vector_col).alias("v"))
    f = fit(vectors)
    if f is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    e, u, _ = leading_pairs(lambda q: _covariance_product(vectors, f, q), f.d, params)
    live = e > params.zero * max(float(e[0]), 0.0)
    e, project = e[live], u[:, live] / np.sqrt(e[live])
    k = len(e)
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    explained = e / _trace(vectors, f)
    error = _identity_error(vectors, f, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component = np.arange(1, k + 1, dtype=np.int32)
        for batch in batches:
            for rows, x in f.longs(batch.column(1)):
                for i in range(0, len(rows), 4096):
                    part, own = x[i: i + 4096], rows[i: i + 4096]
                    many = len(own)
                    again = pa.array(np.repeat(np.arange(many), k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.repeat(own, k))), pa.array(np.tile(component, many)),
                         pa.array(np.full(many * k, f.n)), f.deviation(part).take(again),
                         pa.array((f.centred(part) @ project).reshape(-1)), pa.array(np.tile(explained, many)),
                         pa.array(np.full(many * k, error))], schema.fieldNames())

    return embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, schema)
