"""Embedding whitening: leading components of the covariance by block Lanczos, never forming the matrix.

Entries become whole numbers ``floor(256 * c)``. The fit list is each distinct vector of
those once; it is written packed, and every pass over it is one job: tasks centre their
rows, multiply them with the current block and give one small block each, which Spark adds
up by entry. The driver holds blocks of the vectors' length only (basis: length squared at
most), nothing that grows with the rows.

Block Lanczos with full reorthogonalisation: each new block is made orthogonal to all
earlier ones, twice. Directions that vanish (breakdown) are replaced by random ones
orthogonal to the basis, a restart in what is not reached yet. It ends when the residuals
``|V y - e y|`` of all wanted components are below ``TOLERANCE`` of the largest eigenvalue,
or the basis is complete. The trace, of which an eigenvalue's share is ``explained``, is the
sum of the deviations ``sum((n * x - S)^2) / n^2`` over the fit list, divided by n.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry go;
shorter vectors count as padded with zeros (an empty one is the zero vector); entries
beyond ``LARGEST`` are cut to it; a deviation that doesn't fit in a long is null; components
whose eigenvalue is 0 but for rounding aren't returned, so equal vectors, a single one and
an empty table give no rows; equal eigenvalues have any basis of their space; repeated rows
and ids get repeated results; a null id stays null; extra columns are ignored. Entries of
other rows beyond the fitted length don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import finished, map_arrow, read_table, stored

SCALE = 256
LARGEST = 1 << 62
COMPONENTS = 4
BLOCK = 8
TOLERANCE = 1e-14
SEED = 11
#: Entries that a kernel holds at once.
CHUNK = 1 << 20


@dataclass
class Whitening:
    """A fitted transform; all of it has the size of a few vectors."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.components) / np.sqrt(self.eigenvalues)


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows, x``: vectors of one length at a time, without those that are null or hold what isn't a number."""
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    value = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    good = np.asarray(column.is_valid()) & (bad[start[1:]] == bad[start[:-1]])
    for length in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == length))
        step = max(1, CHUNK // max(1, length))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            with np.errstate(over="ignore"):
                x = np.floor(value[start[part][:, None] + np.arange(length)] * SCALE)
            yield part, np.clip(x, -LARGEST, LARGEST).astype(np.int64)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as bytes: the width of its entries (2, 4 or 8), then the entries up to the last that isn't 0."""
    for batch in batches:
        for _, x in whole_numbers(batch.column(0)):
            length = x.shape[1] - np.argmax((x != 0)[:, ::-1], 1) if x.shape[1] else np.zeros(len(x), np.int64)
            length[~x.any(1)] = 0
            most = np.abs(x).max(1, initial=0)
            width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
            for n, w in {*zip(length.tolist(), width.tolist(), strict=True)}:
                some = x[(length == n) & (width == w), :n].astype(f"<i{w}")
                body = np.concatenate([np.full((len(some), 1), w, np.uint8), some.view(np.uint8).reshape(len(some), n * w)], 1)
                offsets = np.arange(len(some) + 1, dtype=np.int32) * (1 + n * w)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())])], names=["x"])


def unpack(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """Rows of ``dims`` whole numbers."""
    for batch in batches:
        column = batch.column(0).cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        size, width = np.diff(offsets), data[offsets[:-1]].astype(np.int64)
        if dims and len(size) and (size == 1 + dims * width[0]).all() and (width == width[0]).all():
            # The common case: no vector ends in zeros, so all rows are alike and nothing has to be gathered.
            rows = data[offsets[0] : offsets[-1]].reshape(len(size), -1)
            for i in range(0, len(size), max(1, CHUNK // dims)):
                yield np.ascontiguousarray(rows[i : i + max(1, CHUNK // dims), 1:]).view(f"<i{width[0]}").astype(np.int64)
            continue
        for n, w in {*zip(size.tolist(), width.tolist(), strict=True)}:
            rows = offsets[:-1][(size == n) & (width == w)]
            for i in range(0, len(rows), max(1, CHUNK // max(1, dims))):
                part = rows[i : i + max(1, CHUNK // max(1, dims))]
                x = np.zeros((len(part), dims), np.int64)
                x[:, : (n - 1) // w] = np.ascontiguousarray(data[part[:, None] + np.arange(1, n)]).view(f"<i{w}").reshape(len(part), -1)
                yield x


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """``x``, every distinct vector once, packed."""
    return map_arrow(rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v")), pack, "x binary").distinct()


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * dims, 0
        for x in unpack(batches, dims):
            small = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            sums = [a + int(b) for a, b in zip(sums, (x if small else x.astype(object)).sum(0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([*map(str, sums), str(n)])], names=["i", "s"])

    got = map_arrow(fit, run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r.i: int(r.s) for r in got.collect()}  # one row for each dimension
    return by.get(dims, 0), [by.get(i, 0) for i in range(dims)]


def added(fit: DataFrame, dims: int, shape: tuple[int, ...], kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``kernel`` over the fit list, added up by entry; the array comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for x in unpack(batches, dims):
            out += kernel(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(out.size), pa.int32()), pa.array(out.ravel())], names=["i", "v"])

    out = np.zeros(int(np.prod(shape)))
    for r in map_arrow(fit, run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out.reshape(shape)


def orthonormal(wanted: np.ndarray, basis: np.ndarray, width: int, least: float, rng: np.random.Generator) -> np.ndarray:
    """Up to ``width`` unit columns orthogonal to ``basis``: first from ``wanted``, in place of those that vanish random ones."""
    width, out = min(width, basis.shape[0] - basis.shape[1]), basis
    columns = [*wanted.T]
    while out.shape[1] < basis.shape[1] + width:
        given = bool(columns)
        v = columns.pop(0) if given else rng.standard_normal(basis.shape[0])
        before = np.linalg.norm(v)
        for _ in range(2):
            v = v - out @ (out.T @ v)
        norm = np.linalg.norm(v)
        if norm <= (least if given else 1e-8 * before):
            continue
        v = v / norm
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues, their unit vectors, and the number of products with a symmetric matrix that only ``multiply`` knows."""
    rng, passes = np.random.default_rng(seed), 0
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = orthonormal(rng.standard_normal((dims, min(block, dims))), basis, block, 0.0, rng)
    while True:
        product, passes = multiply(new), passes + 1
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product])
        small = basis.T @ image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        value, vector = value[::-1][:wanted], vector[:, ::-1][:, :wanted]
        found = basis @ vector
        residual = np.linalg.norm(image @ vector - found * value, axis=0)
        complete = basis.shape[1] == dims
        if complete or (len(value) == min(wanted, dims) and np.all(residual <= tolerance * max(value[0], 0.0))):
            return value, found / np.linalg.norm(found, axis=0), passes
        scale = np.linalg.norm(product)
        new = orthonormal(product, basis, block, 1e-13 * scale, rng)


def fit_whitening(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The leading components of the covariance of the distinct vectors; None where there are none."""
    fit = stored(fit_list(rows, vector), "fit")
    width = F.conv(F.hex(F.substring("x", 1, 1)), 16, 10).cast("int")
    dims = int(fit.agg(F.max((F.octet_length("x") - 1) / width)).first()[0] or 0)
    if dims == 0:
        return None
    n, sums = totals(fit, dims)
    mean = np.array([s / n for s in sums])
    # The deviations (n x - S)^2 over n^2; the trace is their mean.
    trace = float(added(fit, dims, (1,), lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n

    def multiply(v: np.ndarray) -> np.ndarray:
        def kernel(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ v)

        return added(fit, dims, v.shape, kernel) / n

    value, found, _ = block_lanczos(multiply, dims, components, max(block, components))
    real = value > max(dims, 16) * np.finfo(float).eps * max(value[0], 0.0) if trace > 0 else np.zeros(len(value), bool)
    value, found = value[real], found[:, real]
    if not len(value):
        return None
    found = found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    out = Whitening(n, sums, found, value, trace)
    k = len(value)

    def moments(x: np.ndarray) -> np.ndarray:
        w = out.project(x)
        return np.vstack([w.sum(0), w.T @ w])

    m = added(fit, dims, (k + 1, k), moments) / n
    out.identity_error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n * x - S)^2)`` of each row, exact; None where it doesn't fit in a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if x.shape[1] * most * most < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    near = ((x * float(n) - np.array([float(s) for s in sums])) ** 2).sum(1)
    exact = lambda row: sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True))
    got = [exact(row) if about < 1e19 else None for row, about in zip(x, near, strict=True)]
    return [v if v is not None and v < 1 << 63 else None for v in got]


def whiten(rows: DataFrame, fitted: Whitening | None, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """One row for each vector and component."""
    kind = rows.select(F.col(f"`{id_}`").alias("vec_id")).schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if fitted is not None else ():
            for part, x in whole_numbers(batch.column(1)):
                k, dims = len(fitted.eigenvalues), len(fitted.sums)
                wide = np.zeros((len(x), dims), np.int64)
                wide[:, : min(dims, x.shape[1])] = x[:, :dims]
                row = np.repeat(np.arange(len(x)), k)
                share = fitted.eigenvalues / fitted.trace
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(part[row])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(row), fitted.n, np.int64)),
                        pa.array(deviations(wide, fitted.n, fitted.sums), pa.int64()).take(pa.array(row)),
                        pa.array(fitted.project(wide).ravel()),
                        pa.array(np.tile(share, len(x))),
                        pa.array(np.full(len(row), fitted.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_arrow(rows.select(F.col(f"`{id_}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return finished(spark, "whitened", lambda: whiten(rows, fit_whitening(rows)))
