"""Embedding whitening: streaming moments of all vectors, merged across partitions, and a symmetric eigen-solve."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import keep, slices, small_batches

#: An entry c counts as floor(SCALE * c) + SHIFT, held within ± LIMIT so that doubles tell all of them apart.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 52
#: Components that are returned.
COMPONENTS = 32
#: States of moments that a task merges at a time, in number and in bytes.
MERGED, MERGED_BYTES = 32, 64 << 20
#: Eigenvalues below this share of the largest are no variance but rounding.
FLAT = 1e-12
STATE = "part long, n long, mean binary, m2 binary, high array<long>, low array<long>"


def gauged(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers that stand for the entries."""
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT).astype(np.int64) + SHIFT


class Moments:
    """n, mean, sum of products of deviations, and the exact sum of the whole numbers, of vectors met one by one."""

    def __init__(self, d: int):
        self.n, self.mean, self.m2 = 0, np.zeros(d), np.zeros((d, d))
        self.high, self.low = np.zeros(d, np.int64), np.zeros(d, np.int64)

    def add(self, vector: np.ndarray, buffer: np.ndarray) -> None:
        """Welford's update, of rank one."""
        self.n += 1
        delta = vector - self.mean
        self.mean += delta / self.n
        np.multiply(delta[:, None], delta[None, :] * ((self.n - 1) / self.n), out=buffer)
        self.m2 += buffer

    def add_sums(self, whole: np.ndarray) -> None:
        """Exact sums, in two halves that don't run over."""
        self.high += (whole >> 26).sum(axis=0)
        self.low += (whole & ((1 << 26) - 1)).sum(axis=0)

    def merge(self, other: Moments) -> None:
        """The parallel update: moments of both sets of vectors."""
        if not other.n:
            return
        n = self.n + other.n
        delta = other.mean - self.mean
        self.m2 += other.m2 + np.outer(delta, delta) * (self.n * (other.n / n))
        self.mean += delta * (other.n / n)
        self.n, self.high, self.low = n, self.high + other.high + (self.low + other.low >> 26), self.low + other.low & ((1 << 26) - 1)

    def row(self, part: int) -> pa.RecordBatch:
        values = [[part], [self.n], [self.mean.tobytes()], [self.m2.tobytes()], [self.high.tolist()], [self.low.tolist()]]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["part", "n", "mean", "m2", "high", "low"])

    @classmethod
    def of(cls, row: dict) -> Moments:
        mean = np.frombuffer(row["mean"])
        out = cls(len(mean))
        out.n, out.mean, out.m2 = row["n"], mean.copy(), np.frombuffer(row["m2"]).reshape(len(mean), -1).copy()
        out.high, out.low = np.array(row["high"], np.int64), np.array(row["low"], np.int64)
        return out

    def sums(self) -> list[int]:
        return [(int(h) << 26) + int(x) for h, x in zip(self.high, self.low)]


def _vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix of doubles) of the rows that take part."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == d)
    flat = pc.list_flatten(column.take(pa.array(at, pa.int64()))).cast(pa.float64())
    m = flat.to_numpy(zero_copy_only=False).reshape(len(at), d)  # nulls become nan
    fine = np.isfinite(m).all(axis=1)
    return at[fine], m[fine]


def _states(prepare, d: int):
    """Tasks' moments of prepare(batch): doubles, and whole numbers or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, buffer = None, np.empty((d, d))
        for piece in slices(batches):
            vectors, whole = prepare(piece)
            state = state or Moments(d)
            for v in vectors:
                state.add(v, buffer)
            if whole is not None:
                state.add_sums(whole)
        if state and state.n:
            yield state.row(TaskContext.get().partitionId())

    return run


def _merged(key, table):
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    out = Moments.of(rows[0])
    for r in rows[1:]:
        out.merge(Moments.of(r))
    return pa.Table.from_batches([out.row(key[0].as_py())])


def moments(df: DataFrame, prepare, d: int, label: str) -> Moments:
    """Moments over all rows: one state a task, merged by up to MERGED at a time until one is left."""
    small_batches(df.sparkSession)
    states = keep(df.mapInArrow(_states(prepare, d), STATE), label)
    at_once = max(2, min(MERGED, MERGED_BYTES // (8 * d * d)))
    while (most := states.agg(F.max("part")).first()[0] or 0) > 0:
        groups = states.groupBy(F.floor(F.col("part") / at_once).cast("long").alias("to"))
        states = keep(groups.applyInArrow(_merged, STATE), label)
        if most < at_once:
            break
    row = states.first()
    return Moments.of(row.asDict()) if row else Moments(d)


def _rounding(a: np.ndarray) -> float:
    """What is nothing beside the entries of a."""
    return float(np.abs(a).max(initial=0.0)) * np.finfo(float).eps / 1024


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q of the symmetric a = Q T Q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q, none = np.eye(n), _rounding(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = math.sqrt(float(x @ x))
        if norm <= none:
            a[k + 1 :, k] = 0.0
            continue
        x[0] += math.copysign(norm, x[0])
        x /= math.sqrt(float(x @ x))
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = p - (x @ p) * x
        rest -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix: QR steps with Wilkinson's shift on the
    tridiagonal form, each chased down as rotations."""
    n = len(a)
    d, e, q = _tridiagonal(np.asarray(a, float))
    q = np.ascontiguousarray(q.T)  # rows are vectors
    hi, steps, none = n - 1, 0, _rounding(np.asarray(a, float))
    while hi > 0:
        small = np.abs(e[:hi]) <= np.finfo(float).eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1])) + none
        e[:hi][small] = 0.0
        if e[hi - 1] == 0.0:
            hi -= 1
            continue
        steps += 1
        if steps > 60 * n:
            raise ArithmeticError("no eigenvalues found")
        zeros = np.flatnonzero(e[:hi] == 0.0)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a0, a1, b = d[k], d[k + 1], e[k]
            d[k] = c * c * a0 + 2 * c * s * b + s * s * a1
            d[k + 1] = s * s * a0 - 2 * c * s * b + c * c * a1
            e[k] = (c * c - s * s) * b + c * s * (a1 - a0)
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            pair = q[k : k + 2]
            q[k], q[k + 1] = c * pair[0] + s * pair[1], c * pair[1] - s * pair[0]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


@dataclass
class Model:
    d: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # columns
    trace: float
    identity_error: float | None = None

    def centred(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x - S/n as doubles, and the same exactly: whole parts and what n-ths to take off."""
        q = np.array([s // self.n for s in self.sums], np.int64)
        r = np.array([s % self.n for s in self.sums], np.int64)
        return (whole - q) - r / self.n, whole - q, r

    def whiten(self, whole: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; 0 on components without variance."""
        e = self.values[:COMPONENTS]
        scale = np.where(e > FLAT * max(float(e[0]), 0.0), 1 / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)
        return self.centred(whole)[0] @ self.vectors[:, :COMPONENTS] * scale

    def deviations(self, whole: np.ndarray) -> list[int | Decimal]:
        """Sum over dimensions of (n x - S)², exact."""
        _, parts, r = self.centred(whole)
        bound = self.n * (int(np.abs(parts).max(initial=0)) + 1)
        if self.d * bound * bound < 1 << 63:
            return ((self.n * parts - r) ** 2).sum(axis=1).tolist()
        exact = self.n * parts.astype(object) - r.astype(object)
        return [int(x) for x in (exact * exact).sum(axis=1)]


def fit(rows: DataFrame, vec_col: str = "embedding") -> Model | None:
    """The model of all vectors that take part; None if there are none. Vectors of other lengths than the commonest (of two
    as common, the shorter) take no part."""
    entries = rows.select(F.col(f"`{vec_col}`").alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    d = entries.filter(fine).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if d is None or not d["d"]:
        return None
    d = d["d"]

    def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = gauged(_vectors(batch.column(0), d)[1])
        return x.astype(float), x

    m = moments(entries, whole, d, "moments")
    v = m.m2 / m.n
    values, vectors = eigen(v)
    model = Model(d, m.n, m.sums(), values, vectors, float(np.trace(v)))
    k = min(d, COMPONENTS)
    again = moments(entries, lambda batch: (model.whiten(gauged(_vectors(batch.column(0), d)[1])), None), k, "whitened")
    live = np.flatnonzero(values[:k] > FLAT * max(float(values[0]), 0.0))
    model.identity_error = float(np.abs((again.m2 / again.n - np.eye(k))[np.ix_(live, live)]).max(initial=0.0))
    return model


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row whose vector is whole and component up to COMPONENTS: id_col, component (from 1 by falling eigenvalue), n,
    deviation, whitened, explained, identity_error.

    Left out are null vectors, vectors with null or non-finite entries, and vectors of another length than most; empty ones
    have no components. Equal rows are vectors each; a null id stays null. Entries beyond ± LIMIT count as that. Ties
    between eigenvalues leave the choice of components to the solver, the same for all rows. Components without variance
    (less than FLAT of the first) are 0 and don't count for identity_error; explained is null if nothing varies. Empty
    tables give no rows; other columns are ignored.

    The table is read three times: for the moments, for those of the whitened vectors, for the result. A task holds one
    matrix of d x d, and the driver gets one.
    """
    model = fit(rows, vec_col)
    own = rows.select(rows[f"`{id_col}`"].cast("long").alias("id"), rows[f"`{vec_col}`"].alias("v"))
    if model is None:
        return own.limit(0).select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in SCHEMA.split(", ")[1:])])
    k = min(model.d, COMPONENTS)
    explained = model.values[:k] / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            at, m = _vectors(piece.column(1), model.d)
            if not len(at):
                continue
            x = gauged(m)
            deviation = model.deviations(x)
            if max(deviation) < 1 << 63:
                exact = pa.array(deviation, pa.int64()).cast(pa.decimal128(38, 0))
            else:
                exact = pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(at)), k))
            size = len(at) * k
            share = pa.array(np.tile(explained, len(at)), pa.float64(), from_pandas=True)
            columns = [piece.column(0).take(pa.array(at, pa.int64())).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(size, model.n)), exact.take(each), pa.array(model.whiten(x).ravel()), share, pa.array(np.full(size, model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    small_batches(rows.sparkSession)
    out = own.mapInArrow(run, SCHEMA)
    return out.withColumnRenamed("vec_id", id_col)
