"""Embedding whitening by TSQR.

1. Entries become whole numbers, so that rows can be told apart and summed exactly.
   The fit list is each distinct vector once; it is written to the shared folder.
2. Sums of each dimension are exact (Python integers in tasks, decimals between
   them); rows are centred by the sums over the count.
3. Each task reduces its centred rows to one upper triangle by QR, block by block.
4. Triangles are merged FAN at a time, level by level, until one is left.
5. The singular values and right vectors of that triangle are the square roots of
   n * eigenvalue and the eigenvectors of the covariance, which is never formed, so
   nothing is squared before it is decomposed.

A task holds a block of rows and FAN triangles (dimension squared); the driver gets
the sums and the last triangle, whose size is fixed by the dimension.

Rows whose vector is null, or has null or non-finite entries, are left out.  The
commonest length of the others (of equal ones the largest) is the dimension; rows of
another length stay and have null results, as has a component without variance
(a tail of rounding errors counts as none).  Entries beyond 64 bits are held at its
ends; a deviation beyond 64 bits is null.  Repeated rows and ids stay as they are,
ids may be null or of any type, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, own_names, written, written_and_counted

#: Triangles that are merged at once.
FAN = 16
#: Numbers of a block of rows that is decomposed at once.
BLOCK_CELLS = 1 << 20
SCALE = 256


@dataclass(frozen=True)
class Whitening:
    """What whitens a row: n vectors with exact sums, components as rows."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    #: Largest absolute entry of the covariance of the whitened fit list minus the identity.
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows as components over the square roots of their eigenvalues; NaN where
        there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)
        return (x - self.mean) @ self.components.T * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact squared length of n * x - sums; None beyond 64 bits."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            far = self.n * x - np.array(self.sums, np.int64)
            return (far * far).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def whole_vectors(df: DataFrame, vector: str = "embedding", out: str = "x") -> DataFrame:
    """Rows with a vector of finite entries, and it as whole numbers."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.filter(F.col(vector).isNotNull() & good).withColumn(out, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    step = max(1, BLOCK_CELLS // max(1, width))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield _rows(batch.column(0).slice(i, step), width)


def _summing(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for x in _blocks(batches, width):
            # halves of 32 bits, so that no sum of a block leaves 64 bits
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + v for t, h, v in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["k", "s"])

    return run


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, square; fewer rows are filled up with zeros."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.vstack([rows, np.zeros((width - len(rows), width))])
    return np.linalg.qr(rows, mode="r")


def _triangle_row(node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["node", "r"])


def _reducing(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((len(mean), len(mean)))
        any_row = False
        for x in _blocks(batches, len(mean)):
            r, any_row = triangle(np.vstack([r, x - mean])), True
        if any_row:
            yield _triangle_row(TaskContext.get().partitionId(), r)

    return run


def _merging(width: int, fan: int):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["node"].to_numpy())  # the same result however rows arrive
        each = group["r"].combine_chunks().take(pa.array(order)).flatten().to_numpy().reshape(-1, width)
        return pa.Table.from_batches([_triangle_row(int(group["node"][0].as_py()) // fan, triangle(each))])

    return run


def tsqr(rows: DataFrame, mean: np.ndarray, fan: int = FAN) -> np.ndarray:
    """R of all centred rows: a triangle for each task, merged by a tree."""
    width = len(mean)
    level, left = written_and_counted(rows.mapInArrow(_reducing(mean), "node long, r array<double>"), F.lit(True))
    while left > fan:
        above, count = written_and_counted(level.groupBy(F.floor(F.col("node") / fan)).applyInArrow(_merging(width, fan), "node long, r array<double>"), F.lit(True))
        dropped(level)
        level, left = above, count
    last = [np.array(r["r"]).reshape(width, width) for r in level.orderBy("node").collect()]  # fan at most
    dropped(level)
    return triangle(np.vstack(last)) if last else np.zeros((width, width))


def _checking(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.components)
        total, square = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, len(model.sums)):
            w = np.nan_to_num(model.whitened(x))
            total, square = total + w.sum(axis=0), square + w.T @ w
        values = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["k", "s"])

    return run


def _identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Measured on the rows, not derived from the decomposition."""
    k = int((model.eigenvalues > 0).sum())
    if not k:
        return None
    sums = {r["k"]: r["s"] for r in rows.mapInArrow(_checking(model), "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    all_k = len(model.components)
    values = np.array([sums.get(i, 0.0) for i in range(all_k + all_k * all_k)]) / model.n
    covariance = values[all_k:].reshape(all_k, all_k) - np.outer(values[:all_k], values[:all_k])
    return float(np.abs(covariance[:k, :k] - np.eye(k)).max())


def fit(rows: DataFrame, vector: str = "x", components: int = 4) -> Whitening | None:
    """Fit whitening to the distinct vectors of whole numbers; None without a vector
    of one entry at least."""
    width = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if width is None or width["d"] < 1:
        return None
    width = width["d"]
    listed, n = written_and_counted(rows.filter(F.size(vector) == width).select(F.col(vector).alias("x")).distinct(), F.lit(True))
    exact = listed.mapInArrow(_summing(width), "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").alias("s"))
    by_dimension = {r["k"]: int(r["s"]) for r in exact.collect()}  # one row for each dimension
    sums = tuple(by_dimension[k] for k in range(width))
    mean = np.array([s / n for s in sums])
    _, singular, right = np.linalg.svd(tsqr(listed, mean))
    noise = max(n, width) * np.finfo(float).eps * max(singular[0], np.abs(mean).max())
    singular = np.where(singular > noise, singular, 0.0)
    trace = float((singular**2).sum())
    kept = slice(0, min(components, width))
    model = Whitening(n, sums, right[kept], singular[kept] ** 2 / n, singular[kept] ** 2 / trace if trace else np.full(len(right[kept]), np.nan), None)
    model = Whitening(model.n, model.sums, model.components, model.eigenvalues, model.explained, _identity_error(listed, model))
    dropped(listed)
    return model


def _applying(model: Whitening, at: int, schema: pa.Schema):
    """Rows with, for each component, its number, whitened value and share."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.sums)
        step = max(1, BLOCK_CELLS // width)
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                vectors = batch.column(at)
                fits = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == width)
                x = _rows(vectors.take(pa.array(fits)), width)
                values = np.full((batch.num_rows, k), np.nan)
                values[fits] = model.whitened(x)
                deviation: list[int | None] = [None] * batch.num_rows
                for j, v in zip(fits.tolist(), model.deviation(x), strict=True):
                    deviation[j] = v
                rows = pa.array(np.repeat(np.arange(batch.num_rows), k))
                columns = [batch.column(j).take(rows) for j in range(batch.num_columns) if j != at]
                shares = np.tile(model.explained, batch.num_rows)
                made = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(deviation, pa.int64()).take(rows),
                    pa.array(values.ravel(), from_pandas=True),
                    pa.array(shares, from_pandas=True),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *made], schema, strict=True)], schema=schema)

    return run


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row for each row with a whole vector and each component, with all other
    columns of df and component, deviation, whitened, explained, n, identity_error
    (with underscores before them where df has such columns)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    x, component, deviation, whitened, explained, n, error = own_names(df.drop(vector), "x", "component", "deviation", "whitened", "explained", "n", "identity_error")
    rows = whole_vectors(df, vector, "_whole" if x == vector else x)
    x = "_whole" if x == vector else x
    rows = rows.select(*[c for c in df.columns if c != vector], x)
    model = fit(rows, x, components)
    out = rows.drop(x).withColumns({component: F.lit(0), deviation: F.lit(None).cast("long"), whitened: F.lit(None).cast("double"), explained: F.lit(None).cast("double")})
    if model is None:
        return out.limit(0).withColumns({n: F.lit(0).cast("long"), error: F.lit(None).cast("double")})
    made = rows.mapInArrow(_applying(model, len(rows.columns) - 1, to_arrow_schema(out.schema)), out.schema)
    return made.withColumns({n: F.lit(model.n).cast("long"), error: F.lit(model.identity_error).cast("double")})
