"""Whitening of embeddings: principal components of a distributed covariance, refined in mixed precision.

Tasks sum products of centred vectors; Spark adds the sums by entry, so a matrix of the vectors' own
length is all that reaches the driver. Its eigenvectors are first taken in float32. Ogita-Aishima steps
then correct them by matrix products alone, taken in higher precision from slices whose products are
exact in float64. Where eigenvalues are too close for a step to tell their vectors apart, the small
problem within the cluster is solved by itself and the steps go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.session import cut_lineage

#: Whole numbers per unit of an entry, and what is added to them.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no whole number that sums of all rows could hold; such vectors are left out.
LARGEST = 2.0**40
#: Whole numbers below this have squares that float64 and long halves hold exactly.
EXACT = 2**52


@dataclass(frozen=True)
class Whitening:
    """Components of vectors of one length: mean, unit eigenvectors (a column each), eigenvalues and shares of the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part of the mean goes first, so that nothing is rounded but the last digit."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.float64) / self.n
        return (x - whole).astype(np.float64) - rest

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, over the root of their eigenvalues; NaN where a component has no variance."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (self.centred(x) @ self.vectors) * scale


def _slices(a: np.ndarray, parts: int = 3) -> list[np.ndarray]:
    """``a`` as a sum of matrices, every row of each with so few bits that products of two such matrices are exact."""
    bits = int(np.ceil((53 + np.log2(max(a.shape[1], 2))) / 2))
    out, rest = [], a.astype(np.longdouble)
    for _ in range(parts):
        top = np.abs(rest).max(axis=1, keepdims=True).astype(np.float64)
        unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) + bits - 53)
        piece = (np.rint(rest / unit) * unit).astype(np.float64)
        out.append(piece)
        rest = rest - piece
    return out


def precise_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of float64 or longer entries in extended precision, by exact float64 products of slices."""
    left, right = _slices(a), _slices(b.T)
    total = np.zeros((a.shape[0], b.shape[1]), np.longdouble)
    # The smallest products first.
    for order in range(2 * len(left) - 2, -1, -1):
        for i in range(len(left)):
            if 0 <= order - i < len(right):
                total += left[i] @ right[order - i].T
    return total


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Positions of values that a chain of gaps up to ``apart`` holds together, two or more of them."""
    order = np.argsort(-values, kind="stable")
    breaks = np.flatnonzero(-np.diff(values[order]) > apart) + 1
    return [g for g in np.split(order, breaks) if len(g) > 1]


def refine(matrix: np.ndarray, vectors: np.ndarray, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix from approximate eigenvectors, to the precision of float64.

    A step takes r = I - X'X and s = X'AX. Eigenvalues are s_ii / (1 - r_ii); a vector is corrected by the
    others in the measure (s_ij + l_j r_ij) / (l_j - l_i), or r_ij / 2 where eigenvalues are closer than
    the step can tell. Those clusters then turn by the eigenvectors of their own shifted sub-matrix.
    """
    a, x = matrix.astype(np.longdouble), vectors.astype(np.longdouble)
    eye, norm = np.eye(len(a)), float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    noise = len(a) * float(np.finfo(np.longdouble).eps) * norm
    values = np.zeros(len(a))
    for _ in range(most):
        r = eye - precise_product(x.T, x)
        s = precise_product(x.T, precise_product(a, x))
        # Rounding must not tell s_ij from s_ji, or small gaps would turn the difference into lost orthogonality.
        r, s = (r + r.T) / 2, (s + s.T) / 2
        exact = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(exact)
        apart = float(2 * (np.linalg.norm(off.astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2)))
        gap = exact[None, :] - exact[:, None]
        # Entries that rounding alone explains correct nothing.
        told = (np.abs(gap) > apart) & (np.abs(off) > noise)
        e = np.where(told, (s + exact[None, :] * r) / np.where(told, gap, 1), r / 2)
        x = x + precise_product(x, e)
        values = exact.astype(np.float64)
        for group in _clusters(values, apart):
            centre = exact[group].mean()
            own = x[:, group]
            small = precise_product(own.T, precise_product(a, own) - centre * own)
            size = float(np.abs(small).max())
            if np.abs(small - np.diag(np.diag(small))).max() > noise:
                # In units of its size, so that the sub-problem's digits are those of the gaps inside the cluster.
                small = ((small + small.T) / 2 / size).astype(np.float64)
                x[:, group] = precise_product(own, np.linalg.eigh(small)[1].astype(np.longdouble))
        if float(np.abs(e).max()) < 1e-17:
            break
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))
    return values[order], x.astype(np.float64)


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors: float32 first, then refined."""
    size = np.abs(matrix).max(initial=0.0)
    if size == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    values, vectors = refine(matrix / size, np.linalg.eigh((matrix / size).astype(np.float32))[1])
    return values * size, vectors


def whole_vectors(table: DataFrame, vector: str) -> DataFrame:
    """The rows with a whole, finite vector, and ``__x``: floor(64 c) + 1000000 of its entries.

    Rows go whose vector is null, has null or non-finite entries, or an entry of 2^40 / 64 or more.
    """
    entries = F.col(vector).cast("array<double>")
    fits = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    return table.where(F.col(vector).isNotNull() & F.coalesce(fits, F.lit(False))).withColumn("__x", F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(SHIFT)))


def _stacked(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """Rows by the length of their vectors, with the vectors as a matrix."""
    for rows in batches:
        sizes = rows[column].map(len)
        for size, some in rows.groupby(sizes, sort=True):
            if size:
                yield int(size), some, np.stack(some[column].to_numpy())


def _summed(fit: DataFrame, products: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Sums over all rows of a square matrix for each task's rows, by vector length. Spark adds them entry by entry."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for size, _, x in _stacked(batches, "__x"):
            sums[size] = sums.get(size, 0.0) + products(size, x)
        for size, m in sums.items():
            i, j = np.triu_indices(len(m))
            yield pd.DataFrame({"size": size, "i": i, "j": j, "value": m[i, j]})

    entries = fit.mapInPandas(partial, "size int, i int, j int, value double").groupBy("size", "i", "j").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for size, rows in entries.toPandas().groupby("size"):  # a matrix of the vectors' own length, whatever the number of rows
        m = np.zeros((rows["i"].max() + 1,) * 2)
        m[rows["i"], rows["j"]] = rows["value"]
        out[int(size)] = m + np.triu(m, 1).T
    return out


def _counted(fit: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Number of vectors and exact sums of each entry, by vector length."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple[int, np.ndarray]] = {}
        for size, _, x in _stacked(batches, "__x"):
            n, sums = seen.get(size, (0, np.zeros(size, object)))
            seen[size] = n + len(x), sums + x.sum(axis=0).astype(object)
        for size, (n, sums) in seen.items():
            yield pd.DataFrame({"size": size, "i": np.arange(size), "n": n, "total": [Decimal(int(s)) for s in sums]})

    rows = fit.mapInPandas(partial, "size int, i int, n bigint, total decimal(38,0)").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = {}
    for size, some in rows.toPandas().groupby("size"):
        some = some.sort_values("i")
        out[int(size)] = int(some["n"].iloc[0]), tuple(int(t) for t in some["total"])
    return out


def fit_whitening(fit: DataFrame, components: int) -> tuple[dict[int, Whitening], dict[int, float]]:
    """For each vector length, the whitening of distinct ``__x`` vectors and the error of the whitened covariance."""
    blank = {size: Whitening(n, sums, np.eye(size), np.ones(size), np.ones(size)) for size, (n, sums) in _counted(fit).items()}

    def centred_products(size: int, x: np.ndarray) -> np.ndarray:
        c = blank[size].centred(x)
        return c.T @ c

    models = {}
    for size, products in _summed(fit, centred_products).items():
        n, sums = blank[size].n, blank[size].sums
        values, vectors = eigenvectors(products / n)
        trace = float(np.trace(products / n))
        kept = min(components, size)
        # What rounding leaves of a variance of zero isn't one.
        values = np.where(values > trace * size * np.finfo(np.float64).eps, values, 0.0)
        models[size] = Whitening(n, sums, vectors[:, :kept], values[:kept], (values / trace if trace > 0 else values)[:kept])

    def whitened_products(size: int, x: np.ndarray) -> np.ndarray:
        w = models[size].projected(x)[:, models[size].values > 0]
        return w.T @ w

    found = _summed(fit, whitened_products)
    errors = {size: float(np.abs(m / models[size].n - np.eye(len(m))).max(initial=0.0)) for size, m in found.items() if len(m)}
    return models, errors


def squared_distance(n: int, sums: tuple[int, ...], x: np.ndarray) -> list[int]:
    """The exact sum of (n x - S)^2 over the entries of each row."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    near = x - whole
    if n * (int(np.abs(near).max(initial=0)) + 1) >= EXACT:
        d = near.astype(object) * n - np.array(rest, object)
        return [int(v) for v in (d * d).sum(axis=1)]
    d = near * n - np.array(rest, np.int64)
    high, low = d >> 26, d & ((1 << 26) - 1)
    parts = ((high * high).sum(axis=1), (2 * high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(int(a) << 52) + (int(b) << 26) + int(c) for a, b, c in zip(*parts, strict=True)]


def whiten(table: DataFrame, key: str, vector: str, components: int = 16) -> DataFrame:
    """``key``, component (from 1), n, deviation (decimal), whitened, explained and identity_error: a row for each row and component.

    The fit list is every distinct vector of whole numbers (see ``whole_vectors``) once; each length of
    vectors has its own. ``n`` is its size, ``deviation`` the exact squared distance from the mean times
    n squared, ``whitened`` the centred row on the component over the root of its eigenvalue, ``explained``
    the eigenvalue's share of the trace, ``identity_error`` the largest departure of the whitened
    covariance from the identity, taken anew from the fit list.

    Rows with a null, a null entry or a non-finite entry in the vector are dropped, as are entries that no
    sum of whole numbers holds; vectors of zeros stay, empty vectors have no component. Repeated rows
    and rows without a key each give their rows. A vector shorter than ``components`` has as many as its
    length. Where a component has no variance (one distinct vector, say), whitened is null and explained
    0; the error is over the others, and null if there are none. Empty tables give no rows; other columns
    aren't read.
    """
    # Keys go through the tasks as text: pandas would turn whole numbers with nulls among them into floats.
    named = table.select(F.col(key).cast("string").alias("__key"), F.col(vector).alias("__v"))
    rows = whole_vectors(named, "__v").select("__key", "__x")
    fit = cut_lineage(rows.select("__x").distinct(), "whitening")
    models, errors = fit_whitening(fit, components)

    def applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for size, some, x in _stacked(batches, "__x"):
            model = models[size]
            kept = len(model.values)
            whitened = model.projected(x)
            yield pd.DataFrame({
                "row_key": some["__key"].repeat(kept), "component": np.tile(np.arange(1, kept + 1), len(x)), "n": model.n,
                "deviation": np.repeat(np.array([Decimal(d) for d in squared_distance(model.n, model.sums, x)], object), kept),
                "whitened": pd.array(whitened.ravel(), "Float64"), "explained": np.tile(model.explained, len(x)), "identity_error": errors.get(size),
            })

    out = rows.mapInPandas(applied, "row_key string, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumn("row_key", F.col("row_key").cast(table.schema[key].dataType)).withColumnRenamed("row_key", key)
