"""Whitening of embeddings by refined principal components.

Entries become whole numbers, ``x = floor(1024 c) + 100000``. The covariance of ``x`` is
summed over the partitions from vectors centred on the whole part of their mean, in
integer arithmetic that never rounds; what the mean has beyond its whole part is taken
out exactly at the end. Eigenvectors start from a decomposition in float32 and are then
corrected by matrix products in extended precision, each step about doubling the digits
that are right. Eigenvalues too close for the step at hand form clusters; a cluster's
own small eigenproblem turns its vectors into place before the steps go on. The matrix
has one row a dimension, whatever the number of vectors, and is all that the driver sees.

Rows whose vector is null or empty, holds null or non-finite entries or entries beyond
``LARGEST`` in size, or has another length than most vectors (of equally frequent
lengths: the longest) are dropped. Rows are handled one by one otherwise: null and
repeated keys give rows of their own, other columns do not matter, and a table without
usable vectors gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import map_batches

SCALE, SHIFT = 1024, 100_000
#: Entries up to this size keep every product below exact in the parts it is made of.
LARGEST = float(1 << 30)
#: Rows whose products are summed in float64 at once; 2048 products of 42 bits are exact.
ROWS = 2048
HALF = 20  # bits of the lower part of a centred entry
#: Extended precision; more digits than float64 where the platform has them.
WIDE = np.longdouble
#: Variance below this share of the whole counts as none.
NO_VARIANCE = 1e-15
#: Most dimensions whose covariance (a row each) the driver takes.
MAX_DIM = 2048


def usable(column: pa.Array, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a list column without the rows that are dropped, a pair for
    each length (or for ``dim`` only)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in [dim] if dim else np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == length)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, length)
        with np.errstate(invalid="ignore"):
            good = (np.abs(values) <= LARGEST).all(1)
        yield at[good], values[good]


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def totals(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """Number of usable vectors and their sum in each dimension; ``(0, [])`` for none."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for _, values in usable(batch.column(0)):
                if len(values):
                    # Halves of 32 bits, so that sums of a partition fit in 64.
                    n, low, high = found.setdefault(values.shape[1], [0, 0, 0])
                    part = whole(values)
                    low, high = low + (part & 0xFFFFFFFF).sum(0), high + (part >> 32).sum(0)
                    found[values.shape[1]] = [n + len(part), low, high]
        for dim, (n, low, high) in found.items():
            yield {
                "dim": [dim] * dim, "place": list(range(dim)), "n": [n] * dim,
                "low": low.tolist(), "high": high.tolist(),
            }

    wide = "decimal(38,0)"
    parts = map_batches(vectors.select(column), "dim long, place long, n long, low long, high long", run)
    sums = parts.groupBy("dim", "place").agg(
        F.sum("n").alias("n"), *(F.sum(F.col(c).cast(wide)).alias(c) for c in ("low", "high"))
    )
    lengths = sums.where("place = 0").orderBy(F.desc("n"), F.desc("dim")).select("dim", "n").head()
    if lengths is None:
        return 0, []
    if lengths.dim > MAX_DIM:
        raise ValueError(f"vectors of {lengths.dim} dimensions; the covariance is built for {MAX_DIM} at most")
    rows = sums.where(F.col("dim") == lengths.dim).collect()  # a row a dimension
    by_place = {r.place: (int(r.high) << 32) + int(r.low) for r in rows}
    return lengths.n, [by_place[k] for k in range(lengths.dim)]


def moments(vectors: DataFrame, column: str, centre: np.ndarray) -> list[list[int]]:
    """Sums of products of the entries less ``centre``, for every two dimensions, exact.
    A partition multiplies its own rows and sends one row a dimension."""
    dim = len(centre)

    def run(batches):
        parts = np.zeros((3, dim, dim), np.int64)
        blocks = 0

        def sent():
            return {"place": list(range(dim)), **{c: list(parts[k]) for k, c in enumerate("abc")}}

        for batch in batches:
            for _, values in usable(batch.column(0), dim):
                centred = whole(values) - centre
                for at in range(0, len(centred), ROWS):
                    rows = centred[at : at + ROWS]
                    if np.abs(rows).max() <= 1 << (HALF + 1):
                        low = rows.astype(np.float64)
                        parts[2] += (low.T @ low).astype(np.int64)
                    else:
                        high, low = (rows >> HALF).astype(np.float64), (rows & ((1 << HALF) - 1)).astype(np.float64)
                        mixed = (high.T @ low).astype(np.int64)
                        parts[0] += (high.T @ high).astype(np.int64)
                        parts[1] += mixed + mixed.T
                        parts[2] += (low.T @ low).astype(np.int64)
                    blocks += 1
                    if blocks == 256:
                        yield sent()
                        parts[:], blocks = 0, 0
        if blocks:
            yield sent()

    ddl = "place long, a array<long>, b array<long>, c array<long>"
    cells = map_batches(vectors.select(column), ddl, run).select("place", F.posexplode(F.arrays_zip("a", "b", "c")))
    wide = lambda c: F.sum(F.col(f"col.{c}").cast("decimal(38,0)")).alias(c)
    sums = cells.groupBy("place", "pos").agg(wide("a"), wide("b"), wide("c"))
    out = [[0] * dim for _ in range(dim)]
    for r in sums.collect():  # dim * dim rows
        out[r.place][r.pos] = (int(r.a) << 2 * HALF) + (int(r.b) << HALF) + int(r.c)
    return out


def extended(rows: list[list[int]], divisor: int) -> np.ndarray:
    """Whole numbers over ``divisor`` in extended precision."""
    whole_, rest = (np.array([[f(v) for v in row] for row in rows]) for f in (float, lambda v: float(v - int(float(v)))))
    return (whole_.astype(WIDE) + rest.astype(WIDE)) / WIDE(divisor)


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of sorted values, parted wherever neighbours differ by more than ``gap``."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.abs(np.diff(values)) > gap) + 1)


def eigen(matrix: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix,
    to the last digits of float64, from a float32 start by Ogita and Aishima's steps."""
    a = matrix.astype(WIDE)
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(WIDE)
    one, tiny = np.eye(len(a), dtype=WIDE), np.finfo(WIDE).eps
    size = np.sqrt((a * a).sum())
    least = 64 * tiny * size * len(a)  # nearer eigenvalues differ by rounding only
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ a @ x
        found = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        # How far the present vectors may be off; nearer eigenvalues cannot be told apart.
        gap = max(least, 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())))
        order = np.argsort(-found, kind="stable")
        x, r, s, found = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], found[order]
        apart = found[None, :] - found[:, None]
        near = np.abs(apart) <= gap
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(near, r / 2, (s + found[None, :] * r) / apart)
        x = x + x @ e
        for group in clusters(found, gap):
            if len(group) > 1:
                x[:, group] = parted(a, x[:, group], found[group].mean())
        if gap <= least:
            break
    for _ in range(2):  # what turning near vectors leaves of each other's direction
        x = x @ (one + (one - x.T @ x) / 2)
    x = x / np.sqrt((x * x).sum(0))
    found = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-found, kind="stable")
    return found[order] * scale, x[:, order]


def parted(a: np.ndarray, x: np.ndarray, middle) -> np.ndarray:
    """The vectors of a cluster turned to the eigenvectors of the matrix within their
    span. Less its middle eigenvalue the small problem keeps the digits that differ."""
    small = x.T @ (a @ x - middle * x)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if not size:
        return x
    turn = np.linalg.eigh((small / size).astype(np.float64))[1][:, ::-1].astype(WIDE)
    return x @ turn


@dataclass
class Whitening:
    """What a fit finds. ``sums`` holds S, ``components`` a unit vector in each column."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """What is left of S once ``n`` times the centre is taken: 0 to n - 1."""
        return [s % self.n for s in self.sums]

    def whitener(self, k: int) -> np.ndarray:
        """Projection on the first components over the roots of their variances; NaN for
        a component without variance."""
        e = self.variances[:k].astype(np.float64)
        e = np.where(e > NO_VARIANCE * max(self.trace, 0), e, np.nan)
        return self.components[:, :k].astype(np.float64) / np.sqrt(e)

    def explained(self, k: int) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.variances[:k]]


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """Mean, covariance and components of all usable vectors; None if there are none."""
    n, sums = totals(vectors, column)
    if not n:
        return None
    out = Whitening(n, sums, np.empty(0), np.empty((0, 0)), 0.0)
    products, rest = moments(vectors, column, out.centre), out.rest
    # n squared times the covariance: what the whole centre left over comes out exactly.
    exact = [[n * products[i][j] - rest[i] * rest[j] for j in range(len(sums))] for i in range(len(sums))]
    out.trace = float(Fraction(sum(exact[i][i] for i in range(len(sums))), n * n))
    out.variances, out.components = eigen(extended(exact, n * n))
    return out


def squares(centred: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """Sum over dimensions of ``(n y - rest)^2`` for each row, exact."""
    if not len(centred):
        return []
    # Beyond 63 bits the terms are put together as Python numbers, three a row.
    largest = int(np.abs(centred).max())
    if (n * largest + n) ** 2 * len(rest) < 1 << 63:
        d = n * centred - np.array(rest, np.int64)
        return (d * d).sum(1).tolist()
    if largest * n * len(rest) < 1 << 63 and largest**2 * len(rest) < 1 << 63:
        own, with_rest = (centred * centred).sum(1).tolist(), (centred @ np.array(rest, np.int64)).tolist()
    else:
        own = [sum(v * v for v in row) for row in centred.tolist()]
        with_rest = [sum(v * t for v, t in zip(row, rest)) for row in centred.tolist()]
    constant = sum(t * t for t in rest)
    return [n * n * a - 2 * n * b + constant for a, b in zip(own, with_rest)]


def projected(vectors: DataFrame, model: Whitening, k: int, column: str, key: str | None, deviations: bool = True):
    """Rows ``key, w array<double>, deviation, deviation_exact`` of usable vectors."""
    centre, rest, n, turn = model.centre, model.rest, model.n, model.whitener(k)
    fraction = np.array([t / n for t in rest])

    def run(batches):
        for batch in batches:
            keys = batch.column(1)
            for at, values in usable(batch.column(0), len(centre)):
                centred = whole(values) - centre
                w = (centred - fraction) @ turn
                exact = squares(centred, n, rest) if deviations else [0] * len(w)
                yield {
                    "key": keys.take(pa.array(at)).to_pylist(), "w": list(w),
                    "deviation": [d if d < 1 << 63 else None for d in exact],
                    "deviation_exact": list(map(str, exact)),
                }

    rows = vectors.select(F.col(column), (F.col(key).cast("long") if key else F.lit(0).cast("long")).alias("key"))
    return map_batches(rows, "key long, w array<double>, deviation long, deviation_exact string", run)


def identity_error(vectors: DataFrame, model: Whitening, k: int, column: str = "embedding") -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the
    identity, over components that have variance; None where there is none. Each
    partition centres its rows on their own mean, and the means are put together."""
    there = np.flatnonzero(~np.isnan(model.whitener(k)[0])).tolist()
    if not there:
        return None
    rows = projected(vectors, model, k, column, None, deviations=False).select("w")

    def run(batches):
        n, mean, squares_ = 0, np.zeros(len(there)), np.zeros((len(there),) * 2)
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, there]
            own = w.mean(0)
            step = own - mean
            squares_ += (w - own).T @ (w - own) + np.outer(step, step) * n * len(w) / (n + len(w))
            mean, n = mean + step * len(w) / (n + len(w)), n + len(w)
        if n:
            size = len(there)
            yield {
                "i": list(range(size)), "n": [n] * size, "mean": mean.tolist(), "s": list(squares_), "means": [mean] * size,
            }

    parts = map_batches(rows, "i long, n long, mean double, s array<double>, means array<double>", run)
    cells = parts.select("i", "n", "mean", F.posexplode(F.arrays_zip("s", "means")))
    sums = cells.groupBy("i", "pos").agg(
        F.sum("n").alias("n"), F.sum("col.s").alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("col.means")).alias("m"),
        F.sum(F.col("n") * F.col("mean")).alias("a"), F.sum(F.col("n") * F.col("col.means")).alias("b"),
    )
    cov = (F.col("s") + F.col("m") - F.col("a") * F.col("b") / F.col("n")) / F.col("n")
    return sums.agg(F.max(F.abs(cov - F.when(F.col("i") == F.col("pos"), 1.0).otherwise(0.0)))).head()[0]


def whiten(
    vectors: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """A row for each usable vector and each of the first ``components`` (all, where there
    are fewer): ``key, component, n, deviation, whitened, explained, identity_error,
    deviation_exact``. ``deviation`` is null where it does not fit in 64 bits, which the
    decimal text beside it always has. ``whitened`` is null for components without
    variance, ``explained`` where no component has any."""
    model = fit(vectors, column)
    if model is None:
        k, explained, error, n = 0, [], None, 0
        rows = vectors.sparkSession.createDataFrame([], "key long, w array<double>, deviation long, deviation_exact string")
    else:
        k, n = min(components, len(model.sums)), model.n
        explained, error = model.explained(k), identity_error(vectors, model, k, column)
        rows = projected(vectors, model, k, column, key)
    shares = F.array(*[F.lit(e).cast("double") for e in explained]).cast("array<double>")
    place = F.col("pos") + 1
    return rows.select("key", "deviation", "deviation_exact", F.posexplode("w")).select(
        F.col("key").alias(key),
        place.cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("col"), F.col("col")).alias("whitened"),
        F.get(shares, F.col("pos")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_exact",
    )
