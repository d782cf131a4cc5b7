"""Embedding whitening: principal components of the distinct vectors, scaled to unit variance.

Each entry c becomes the whole number floor(256 c). The fit list holds every distinct vector once (a grouping with partial
combination, so a vector that fills a third of the table meets no single task). Sums are exact. Each task adds up its own
d x d products of centred rows, one row of the upper triangle an entry pair; Spark sums them. What reaches the driver is d sums and
d (d + 1) / 2 products, whatever the number of rows. There: Householder reflections bring the covariance to tridiagonal
form, Sturm counts bisect the leading eigenvalues, inverse iteration finds the vectors (reorthogonalised inside clusters of close
eigenvalues), the reflections carry them back. Mean and components are broadcast; rows are projected where they lie.

Rules: rows whose vector is null, empty or holds a null, NaN or infinity are left out, as are vectors of another length than most
(of equally frequent lengths the longest counts). Entries beyond 2^63 / 256 saturate. Equal vectors and repeated rows are all returned. A
component without variance can't be scaled and is left out, so a table with fewer independent directions than ``components``, a
single distinct vector or an empty table give fewer or no rows. ``deviation`` is exact and null beyond 2^63. Null ids are kept; other columns are
not read. Eigenvectors of equal eigenvalues are any orthonormal basis, the same for all rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut_lineage

SCALE = 256
COMPONENTS = 4
#: Rows that are worked on at once inside a batch.
SLICE = 4096
_EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and the Householder vectors that bring the symmetric ``a`` there."""
    a = np.array(a, float)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        size = float(np.linalg.norm(x))
        if size == 0 or not np.abs(x[1:]).any():
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        part = a[k + 1:, k + 1:]
        p = 2 * (part @ v)
        w = p - (v @ p) * v
        part -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
        mirrors.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: eigenvalues smaller than each entry of ``x``."""
    floor = max(_EPS * float(np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0)), np.finfo(float).tiny)
    q = diagonal[0] - x
    count = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < floor, -floor, q)
        q = diagonal[i] - x - off[i - 1] ** 2 / q
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of Gershgorin's interval."""
    d = len(diagonal)
    radius = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    rank = d - 1 - np.arange(k)  # eigenvalues below the wanted one
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        over = below(diagonal, off, middle) > rank
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return (low + high) / 2


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row swaps."""
    d = len(diagonal)
    one, two, three = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    under, x = off.copy(), right.copy()
    for i in range(d - 1):
        if abs(under[i]) > abs(one[i]):
            one[i], under[i] = under[i], one[i]
            two[i], one[i + 1] = one[i + 1], two[i]
            three[i], two[i + 1] = two[i + 1], three[i]
            x[i], x[i + 1] = x[i + 1], x[i]
        one[i] = one[i] if abs(one[i]) > floor else floor
        ratio = under[i] / one[i]
        one[i + 1] -= ratio * two[i]
        two[i + 1] -= ratio * three[i]
        x[i + 1] -= ratio * x[i]
    for i in range(d - 1, -1, -1):
        pivot = one[i] if abs(one[i]) > floor else floor
        x[i] = (x[i] - (two[i] * x[i + 1] if i + 1 < d else 0) - (three[i] * x[i + 2] if i + 2 < d else 0)) / pivot
    return x


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    d = len(a)
    diagonal, off, mirrors = tridiagonal(a)
    values = leading(diagonal, off, k)
    size = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) or 1.0
    vectors = np.zeros((k, d))
    for c in range(k):
        cluster = [j for j in range(c) if abs(values[j] - values[c]) <= 1e-3 * size]
        # Equal shifts would find the same vector again; a start of its own and a small step apart tell them from one another.
        shift = values[c] + (len(cluster) + 1) * 4 * _EPS * size
        x = np.random.default_rng(c).standard_normal(d)
        for _ in range(6):
            for j in cluster:
                x -= (vectors[j] @ x) * vectors[j]
            x /= np.linalg.norm(x)
            x = solve(diagonal, off, shift, x, _EPS * size)
            x /= np.abs(x).max()
        for _ in range(2):
            for j in cluster:
                x -= (vectors[j] @ x) * vectors[j]
            x /= np.linalg.norm(x)
        vectors[c] = x
    for first, v in reversed(mirrors):
        vectors[:, first:] -= 2 * np.outer(vectors[:, first:] @ v, v)
    return values, vectors


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their exact sums, eigenvalues and components of the covariance, its trace, and the largest
    deviation of the whitened covariance from the identity."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x: the usable rows with whole-number entries, all of one length; written once."""
    entry = lambda c: F.isnotnull(c) & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0).where(F.forall("v", entry))
    rows = cut_lineage(rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x")))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with column ``x`` as a matrix of whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x = part.column(part.schema.get_field_index("x"))
            yield part, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def exact_sum(x: np.ndarray) -> list[int]:
    if np.abs(x.astype(float)).max(initial=0) * len(x) < 2.0 ** 62:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(int(v) for v in column) for column in x.T]


def pairs(rows: DataFrame, centre: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Sum over the rows of (x - centre)(x - centre)', after ``turn`` if given. Each task sends its own sums."""
    d = len(centre) if turn is None else len(turn)
    shared = rows.sparkSession.sparkContext.broadcast((centre, turn))
    i, j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, by = shared.value
        total, seen = np.zeros((d, d)), False
        for _, x in matrices(batches):
            y = x.astype(float) - middle
            y = y if by is None else y @ by.T
            total += y.T @ y
            seen = True
        if seen:
            a, b = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], names=["i", "j", "s"])

    got = rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((d, d))
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["s"].to_numpy()
    return out + np.triu(out, 1).T


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``whole``; None without rows."""
    listed = cut_lineage(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for _, x in matrices(batches):
            n, part = n + len(x), exact_sum(x)
            total = [a + b for a, b in zip(total, part)] if total else part
        if n:
            # Place -1 counts the rows.
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))], names=["i", "s"])

    got = {r["i"]: int(r["s"]) for r in listed.mapInArrow(sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    if not got:
        return None
    n = got.pop(-1)
    total = tuple(got[i] for i in range(len(got)))
    centre = np.array([s / n for s in total])
    covariance = pairs(listed, centre) / n
    trace = float(np.trace(covariance))
    if trace <= 0:
        return Whitening(n, total, np.zeros(0), np.zeros((0, len(total))), 0.0)
    values, vectors = eigen(covariance, min(components, len(total)))
    clear = values > len(total) * _EPS * trace
    values, vectors = values[clear], vectors[clear]
    # The whitened rows' sum is 0 but for rounding of the mean; their covariance is centred with the same mean.
    whitened = pairs(listed, centre, vectors / np.sqrt(values)[:, None]) / n
    error = float(np.abs(whitened - np.eye(len(values))).max(initial=0))
    return Whitening(n, total, values, vectors, trace, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact."""
    largest = max(max(abs(s) for s in sums) + n * int(np.abs(x.astype(float)).max(initial=0)), 1)
    if largest * largest * x.shape[1] < 1 << 62:
        return [int(v) for v in ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)]
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, component (from 1), deviation, whitened: the rows of ``whole`` in the model's components."""
    id_type = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((np.array([s / model.n for s in model.sums]), model.components / np.sqrt(model.values)[:, None], model.n, model.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, turn, n, sums = shared.value
        k = len(turn)
        for part, x in matrices(batches):
            if k == 0:
                continue
            values = (x.astype(float) - centre) @ turn.T
            again = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                                              pa.array(deviations(x, n, sums), pa.int64()).take(again), pa.array(values.ravel())],
                                             names=["id", "component", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(run, f"id {id_type}, component int, deviation bigint, whitened double")


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole(df, id_column, vector)
    model = fit(rows, components) or Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array(F.lit(0.0))
    if not len(model.values):
        rows = rows.limit(0)
    return project(rows, model).select(F.col("id").alias(id_column), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                                       share[F.col("component") - 1].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
