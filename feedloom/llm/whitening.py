"""Whitened vectors from an exact scatter matrix, counted on bit slices.

Entries become integers x = floor(scale * c) + offset. The fit list holds each distinct x
vector once. Its sums and cross-products are exact: a task shifts a block of rows by the
block's least entry per dimension, packs each bit plane of each dimension across the rows
into 64-bit words, and adds popcount(plane & plane) times the planes' weights; the shift is
then undone in integers. Rows of the matrix meet by (length, row), so no task adds whole
matrices of all others. The driver takes one matrix of sums (dimension squared entries),
centres it in integers, n * C - S * S', divides once, and finds eigenvectors.

Vectors that are null or empty, or hold a null or a non-finite entry, are left out. Entries whose x is beyond 64
bits count as the nearest 64-bit integer. Vectors of different lengths are fitted apart. A
component whose eigenvalue is not above rounding (fewer than that many independent
dimensions) has a null whitened value and is no part of identity_error. A deviation beyond
64 bits is null. Rows that share or lack an id each have their result. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import NO_ID, arrow, mapped, rows_out, travels, written

travels(__name__)

SCALE, OFFSET = 64, 1_000_000
BLOCK = 1 << 14         # rows whose bits are packed together
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PLAIN = 62              # bits that 64-bit sums may use


def integers(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * value) + offset, held within 64 bits."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    plain = np.clip(scaled, -2.0 ** 62, 2.0 ** 62).astype(np.int64) + np.int64(offset)
    far = np.abs(scaled) >= 2.0 ** 62
    if far.any():
        plain[far] = [min(max((int(v) if np.isfinite(v) else int(np.sign(v)) << 70) + offset, LEAST), MOST) for v in scaled[far].tolist()]
    return plain


def quantised(rows: DataFrame, scale: int, offset: int) -> DataFrame:
    """(id, size, x) of the usable rows; x is a vector of little-endian 64-bit integers."""
    fields = "id long, size int, x binary"
    schema = arrow(fields)

    def task(batches):
        for batch in batches:
            id_, vectors = np.asarray(batch.column(0)), batch.column(1)
            length = np.diff(np.asarray(vectors.offsets))
            low = np.asarray(vectors.offsets)[:-1] - vectors.offsets[0].as_py()
            flat = vectors.flatten()
            values = np.asarray(flat.fill_null(np.nan))
            # a null list has no entries here, and neither has an empty one
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            low = np.where(np.asarray(vectors.is_valid()), low, 0)
            length = np.where(np.asarray(vectors.is_valid()), length, 0)
            kept = np.flatnonzero((length > 0) & (bad[low + length] == bad[low]))
            for n in np.unique(length[kept]).tolist():
                own = kept[length[kept] == n]
                x = integers(values[low[own][:, None] + np.arange(n)], scale, offset).astype("<i8")
                yield rows_out(schema, [id_[own], np.full(len(own), n), [r.tobytes() for r in x]])

    return mapped(rows, task, fields)


# ---------------------------------------------------------------- exact scatter

def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, int]:
    """(dimension * planes, words): each bit of each column of unsigned numbers, packed across rows into 64-bit words."""
    n, dims = shifted.shape
    planes = max(int(shifted.max()).bit_length(), 1)
    words = np.zeros((dims, planes, -(-n // 64)), np.uint64)
    room = np.zeros((dims, words.shape[2] * 8), np.uint8)
    for k in range(planes):
        one = np.packbits((shifted >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=0)
        room[:, :len(one)] = one.T
        words[:, k] = room.view(np.uint64)
    return words.reshape(dims * planes, -1), planes


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns of 64-bit integers, as Python integers."""
    n, dims = x.shape
    base = [int(v) for v in x.min(0)]
    words, planes = bit_planes(x.view(np.uint64) - x.min(0).view(np.uint64))   # the difference fits into unsigned 64 bits
    weight = np.array([1 << k for k in range(planes)], object)
    counts = np.bitwise_count(words).sum(1, dtype=np.int64).reshape(dims, planes)
    sums = counts.astype(object) @ weight
    cross = np.zeros((dims, dims), object)
    plain = 2 * planes + n.bit_length() < PLAIN
    for i in range(dims):
        both = np.zeros(dims - i, np.int64 if plain else object)
        for k in range(planes):
            shared = np.bitwise_count(words[i * planes + k] & words[i * planes:]).sum(1, dtype=np.int64).reshape(dims - i, planes)
            both = both + (shared @ (np.int64(1) << np.arange(planes) + k) if plain else shared.astype(object) @ (weight << k))
        cross[i, i:] = cross[i:, i] = [int(v) for v in both]
    base, sums = np.array(base, object), np.array([int(v) for v in sums], object)
    cross = cross + np.outer(base, sums) + np.outer(sums, base) + n * np.outer(base, base)
    return sums + n * base, cross


def totals(fit: DataFrame, block: int = BLOCK) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per vector length: number of vectors, sums and cross-products of the fit list."""
    fields = "size int, dim int, blob binary"
    schema = arrow(fields)

    def partial(batches):
        found: dict[int, list] = {}
        held: dict[int, list[bytes]] = {}

        def add(n: int) -> None:
            sums, cross = scatter(np.frombuffer(b"".join(held[n]), "<i8").reshape(-1, n))
            have = found.setdefault(n, [0, 0, 0])
            found[n] = [have[0] + len(held[n]), have[1] + sums, have[2] + cross]
            held[n] = []

        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(n, []).append(x)
                if len(held[n]) >= block:
                    add(n)
        for n, vectors in held.items():
            if vectors:
                add(n)
        for n, (count, sums, cross) in found.items():
            yield rows_out(schema, [[n] * n, range(n), [pickle.dumps((count, sums[i], cross[i].tolist())) for i in range(n)]])

    def add_rows(batches):
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for n, i, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count, total, cross = pickle.loads(blob)
                have = found.setdefault((n, i), [0, 0, np.zeros(n, object)])
                found[n, i] = [have[0] + count, have[1] + total, have[2] + np.array(cross, object)]
        if found:
            yield rows_out(schema, [[n for n, _ in found], [i for _, i in found], [pickle.dumps((c, t, x.tolist())) for c, t, x in found.values()]])

    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for n, i, blob in mapped(mapped(fit.select("size", "x"), partial, fields).repartition("size", "dim"), add_rows, fields).collect():   # one matrix per vector length
        count, total, cross = pickle.loads(blob)
        _, sums, matrix = out.setdefault(n, (count, np.zeros(n, object), np.zeros((n, n), object)))
        sums[i], matrix[i] = total, cross
    return out


class Fit:
    """Components of one vector length."""

    def __init__(self, n: int, sums: np.ndarray, cross: np.ndarray, components: int):
        self.n, self.sums = n, [int(s) for s in sums]
        centred = n * cross - np.outer(sums, sums)
        square = n * n
        variance = np.array([[int(v) / square for v in row] for row in centred])     # each quotient rounded once
        values, vectors = np.linalg.eigh(variance)
        k = min(components, len(values))
        self.values, self.vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        self.trace = sum(int(centred[i, i]) for i in range(len(values))) / square
        self.given = self.values > len(values) * np.finfo(float).eps * max(values[-1], 0)
        self.explained = np.maximum(self.values, 0) / self.trace if self.trace else np.zeros(k)
        self.span = max(abs(s) for s in self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where that holds it, else Python integers."""
        widest = self.n * int(np.abs(x.astype(object)).max() if x.min() == LEAST else np.abs(x).max()) + self.span
        if widest.bit_length() < PLAIN:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) / self.n @ self.vectors[:, self.given] / np.sqrt(self.values[self.given])


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond 64 bits."""
    if centred.dtype != object:
        widest = int(np.abs(centred).max())
        if (widest * widest * centred.shape[1]).bit_length() < PLAIN:
            return (centred * centred).sum(1).tolist()
        centred = centred.astype(object)
    found = [int(v) for v in (centred * centred).sum(1)]
    return [v if v <= MOST else None for v in found]


def identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the fit list's whitened values, less the identity."""
    fields = "size int, n long, blob binary"
    schema = arrow(fields)

    def joined(a, b):
        """Count, mean and centred products of two lists together."""
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def partial(batches):
        found: dict[int, tuple] = {}
        for batch in batches:
            size, x = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for n in np.unique(size).tolist():
                own = np.frombuffer(b"".join([x[i] for i in np.flatnonzero(size == n)]), "<i8").reshape(-1, n)
                w = fits[n].whitened(fits[n].centred(own))
                mean = w.mean(0)
                part = (len(w), mean, (w - mean).T @ (w - mean))
                found[n] = joined(found[n], part) if n in found else part
        if found:
            yield rows_out(schema, [list(found), [p[0] for p in found.values()], [np.r_[p[1][None], p[2]].tobytes() for p in found.values()]])

    def add(batches):
        found: dict[int, tuple] = {}
        for batch in batches:
            for size, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = int(fits[size].given.sum())
                both = np.frombuffer(blob).reshape(k + 1, k)
                part = (n, both[0], both[1:])
                found[size] = joined(found[size], part) if size in found else part
        if found:
            yield rows_out(schema, [list(found), [p[0] for p in found.values()], [p[2].tobytes() for p in found.values()]])

    parts = mapped(mapped(fit.select("size", "x"), partial, fields).repartition("size"), add, fields)
    out = {}
    for size, n, blob in parts.collect():       # one small matrix per vector length
        k = int(fits[size].given.sum())
        out[size] = float(np.abs(np.frombuffer(blob).reshape(k, k) / n - np.eye(k)).max(initial=0.0))
    return out


def whiten(rows: DataFrame, components: int = 16, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    given = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = written(quantised(given, scale, offset), "whitening-rows")
    # equal vectors meet once per task before the exchange
    fit = written(whole.select("size", "x").distinct(), "whitening-fit")
    fits = {size: Fit(n, sums, cross, components) for size, (n, sums, cross) in totals(fit).items()}
    errors = identity_errors(fit, fits)
    fields = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = arrow(fields)

    def project(batches):
        for batch in batches:
            id_, size, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                fitted = fits[n]
                k = len(fitted.values)
                centred = fitted.centred(np.frombuffer(b"".join([x[i] for i in own]), "<i8").reshape(-1, n))
                values = np.full((len(own), k), np.nan)
                values[:, fitted.given] = fitted.whitened(centred)
                yield rows_out(schema, [
                    np.repeat(id_[own], k), np.tile(np.arange(1, k + 1), len(own)), np.full(len(own) * k, fitted.n),
                    pa.array(deviations(centred), pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))),
                    pa.array(values.ravel(), mask=~np.tile(fitted.given, len(own))),
                    np.tile(fitted.explained, len(own)), np.full(len(own) * k, errors[n])])

    return mapped(whole, project, fields).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("vec_id"), *[f.name for f in schema][1:])
