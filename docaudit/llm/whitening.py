"""Embedding whitening by QDWH spectral divide and conquer.

Entries become integers, so sums and second moments are exact whatever the order in which tasks deliver them. The
covariance of the distinct vectors is centred before it is multiplied: first the sums, then the products of what lies
beside the rounded mean. Its eigenvectors come from spectral projectors: the polar factor ``U`` of the covariance less a
shift has eigenvalue 1 above the shift and -1 below it, so ``(U + I) / 2`` projects on the upper invariant subspace.
Both subspaces are split again until each holds one component. ``U`` is found by dynamically weighted Halley steps on QR
factors. Mean and components, whose size hangs on the dimensions alone, are then broadcast and applied to every row.
"""

from __future__ import annotations

import dataclasses
import decimal
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.session import ship_package

from .common import written

#: Entries become ``floor(SCALE * entry) + OFFSET``.
SCALE, OFFSET = 64, 1_000_000
#: Larger entries count as this one, so that no integer overflows.
MOST = 2.0**62
#: Components with less than this share of the variance are rounding errors of a space that the vectors do not fill.
LEAST_SHARE = 1e-12
#: Vectors that one matrix product takes.
PRODUCT_ROWS = 4_096
#: Sums travel in two parts, as one decimal might be too short.
HALF = 1 << 64
#: Dimensions up to which the driver holds the covariance and splits it.
MOST_DIMENSIONS = 8_192

EPS = np.finfo(float).eps


def entries(vector: str | Column) -> Column:
    """``floor(SCALE * entry) + OFFSET`` of every entry; null where the vector is null or holds a null or non-finite entry."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    held = lambda x: F.least(F.lit(MOST), F.greatest(F.lit(-MOST), x.cast("double") * SCALE))
    return F.when(fine, F.transform(v, lambda x: F.floor(held(x)).cast("long") + OFFSET))


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without a zero eigenvalue, by QDWH."""
    n = len(a)
    size = np.linalg.norm(a, 2)
    x, low, one = a / size, 1.0, np.eye(n)
    # A lower bound of the smallest singular value: the smallest diagonal entry of R bounds it up to a modest factor.
    low = min(1.0, max(EPS, np.abs(np.diag(np.linalg.qr(x, "r"))).min() / (10 * np.sqrt(n))))
    for _ in range(30):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wide = np.sqrt(1 + d)
        p = wide + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * wide)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        new = (new + new.T) / 2
        step, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (p + q * low * low) / (1 + r * low * low))
        if step <= 10 * EPS * np.sqrt(n) or (step <= np.cbrt(EPS) and 1 - low < EPS):
            break
    return x


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthogonal basis, whose first ``rank`` vectors span what the projector keeps: pivoted QR and a second turn."""
    left, columns = projector.copy(), []
    for _ in range(rank):  # the columns that stand out most
        k = int(np.argmax((left * left).sum(axis=0)))
        v = left[:, k] / np.linalg.norm(left[:, k])
        columns.append(v)
        left -= np.outer(v, v @ left)
    first, _ = np.linalg.qr(projector @ np.stack(columns, axis=1))
    return np.linalg.qr(np.hstack([first, (np.eye(len(projector)) - projector)]), "complete")[0]


def split_spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix.

    A matrix that no shift splits is a multiple of the identity up to rounding; any basis serves it.
    """
    n, scale = len(a), np.linalg.norm(a)
    done: list[tuple[float, np.ndarray]] = []
    todo = [(a, np.eye(n))]
    while todo:
        part, basis = todo.pop()
        k, part = len(part), (part + part.T) / 2
        spread = part - np.trace(part) / k * np.eye(k)
        if k == 1 or np.linalg.norm(spread) <= 4 * EPS * np.sqrt(k) * scale:
            done += [(float(part[i, i]), basis[:, i]) for i in range(k)]
            continue
        # The diagonal's median, then its mean, then other quantiles. The mean of the diagonal is the eigenvalues' own
        # mean, so some eigenvalue lies on each side of it.
        diagonal = np.sort(np.diag(part))
        for shift in (np.median(diagonal), diagonal.mean(), *np.quantile(diagonal, [0.25, 0.75]), *(diagonal.mean() + t * np.linalg.norm(spread) / np.sqrt(k) for t in (1e-3, -1e-3, 1e-2, -1e-2, 0.1, -0.1, 0.5, -0.5))):
            if np.linalg.norm(part - shift * np.eye(k)) == 0:
                continue
            projector = (polar_factor(part - shift * np.eye(k)) + np.eye(k)) / 2
            rank = round(float(np.trace(projector)))
            if not 0 < rank < k:
                continue
            turn = _range(projector, rank)[:, :k]
            turned = turn.T @ part @ turn
            # What couples the two subspaces must be rounding; else the shift met an eigenvalue.
            if np.linalg.norm(turned[rank:, :rank]) <= 100 * EPS * np.sqrt(k) * scale:
                break
        else:
            raise ArithmeticError("no shift splits the spectrum")
        todo += [(turned[:rank, :rank], basis @ turn[:, :rank]), (turned[rank:, rank:], basis @ turn[:, rank:])]
    done.sort(key=lambda x: -x[0])
    return np.array([e for e, _ in done]), np.stack([v for _, v in done], axis=1)


@dataclasses.dataclass
class Whitening:
    """``n`` distinct vectors with ``sums`` by dimension (exact), and their leading components."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def apply(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Exact sums of ``(n * x - S) ** 2`` and the whitened components of rows of integers."""
        sums = np.array(self.sums, object)
        span = max((abs(self.n * int(edge) - s) for s, column in zip(self.sums, x.T, strict=True) for edge in (column.min(), column.max())), default=0) if len(x) else 0
        fits = span * span * max(1, x.shape[1]) < 1 << 63 and self.n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) < 1 << 62
        beside = self.n * x - sums.astype(np.int64) if fits else self.n * x.astype(object) - sums
        deviation = [int(d) for d in (beside * beside).sum(axis=1)]
        centred = beside.astype(float) / self.n if fits else np.array([[float(Fraction(v, self.n)) for v in row] for row in beside.tolist()])
        return deviation, centred @ (self.vectors / np.sqrt(self.values))


def _filled(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; those that are shorter are filled up with the entry of a zero."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), width), OFFSET, np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of integers, exact: in floating point while all sums stay below 2^53, else in Python integers."""
    most = int(np.abs(y).max(initial=0)) if y.dtype != object else max((abs(v) for v in y.ravel()), default=0)
    if most * most * max(1, len(y)) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _moments(rows: DataFrame, width: int, centre: list[int] | None) -> dict[int, int]:
    """Exact sums over the rows ``x``: by dimension, or of products (``i * width + j``, ``i <= j``) beside ``centre``."""
    upper = np.triu_indices(width)
    cells = np.arange(width) if centre is None else upper[0] * width + upper[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells), object)
        for b in batches:
            for at in range(0, b.num_rows, PRODUCT_ROWS):
                x = _filled(b.column(0).slice(at, PRODUCT_ROWS), width)
                if centre is None:
                    total += x.astype(object).sum(axis=0)
                elif max(np.abs(x).max(initial=0), *map(abs, centre)) < 1 << 61:
                    total += products(x - np.array(centre, np.int64))[upper]
                else:
                    total += products(x.astype(object) - np.array(centre, object))[upper]
        halves = zip(*(divmod(int(t), HALF) for t in total), strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int64()), *(pa.array([decimal.Decimal(h) for h in half], pa.decimal128(38, 0)) for half in halves)], names=["cell", "high", "low"]
        )

    sums = rows.mapInArrow(run, "cell long, high decimal(38,0), low decimal(38,0)").groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {r["cell"]: int(r["high"]) * HALF + int(r["low"]) for r in sums.toLocalIterator()}


def fit(df: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """Covariance and leading components of the distinct vectors of ``df``; None without any variance.

    Null vectors and those with a null or non-finite entry take no part, a repeated vector counts once, shorter vectors
    count as filled up with zeros. Components without variance (all vectors equal in that direction) are left out, so
    there are fewer where the vectors do not fill the space. Equal eigenvalues leave their eigenvectors free. The driver
    holds the covariance (dimensions squared, at most ``MOST_DIMENSIONS``) and no row.
    """
    ship_package(df.sparkSession)
    rows = df.select(entries(f"`{vector}`").alias("x")).filter("x IS NOT NULL")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    if width > MOST_DIMENSIONS:
        raise ValueError(f"{width} dimensions; the covariance of more than {MOST_DIMENSIONS} is not held by one driver")
    # Filled up before they are compared: a vector that ends in zeros may be written shorter.
    full = F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("x")))
    rows = written(rows.select(full.alias("x")).distinct(), "whitening-distinct")
    n = rows.count()
    sums = _moments(rows, width, None)
    centre = [(2 * sums[i] + n) // (2 * n) for i in range(width)]
    cells = _moments(rows, width, centre)
    beside = [sums[i] - n * centre[i] for i in range(width)]
    v = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            v[i, j] = v[j, i] = float(Fraction(n * cells[i * width + j] - beside[i] * beside[j], n * n))
    trace = float(np.trace(v))
    if not trace:
        return None
    values, vectors = split_spectrum(v)
    used = min(components, int((values > LEAST_SHARE * trace).sum()))
    values, vectors = values[:used], vectors[:, :used]
    turn = vectors / np.sqrt(values)
    error = float(np.abs(turn.T @ v @ turn - np.eye(used)).max())
    return Whitening(n, [sums[i] for i in range(width)], trace, values, vectors, error)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """A row for each vector and component: ``key``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` (decimal, null beyond 38 digits) is the exact sum of ``(n * x - S) ** 2`` over the dimensions; the error
    is that of the whole fit. Rows with a null key stay, repeated rows are whitened each, other columns are left out, whatever their names.
    Rows without a usable vector give nothing, and so does a table that is empty or whose vectors are all equal.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(df, vector, components)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)
    rows = df.select(F.col(f"`{key}`").alias("key"), entries(f"`{vector}`").alias("x")).filter("x IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        count = len(m.values)
        for whole in batches:
            for at in range(0, whole.num_rows, PRODUCT_ROWS):
                b = whole.slice(at, PRODUCT_ROWS)
                deviation, white = m.apply(_filled(b.column(1), len(m.sums)))
                each = pa.array(np.repeat(np.arange(b.num_rows), count))
                same = lambda x, k, b=b: pa.array(np.full(b.num_rows * count, x), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(each),
                        pa.array(np.tile(np.arange(1, count + 1), b.num_rows), pa.int32()),
                        same(m.n, pa.int64()),
                        pa.array([decimal.Decimal(d) if d < 10**38 else None for d in deviation], pa.decimal128(38, 0)).take(each),
                        pa.array(white.ravel()),
                        pa.array(np.tile(m.explained, b.num_rows)),
                        same(m.identity_error, pa.float64()),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
