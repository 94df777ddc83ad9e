"""Whitening of embeddings onto leading components, found by FEAST contour integration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.session import cut_lineage

MOST = 2**24  # an entry of at least this size has squared deviations beyond exact sums
AT_ONCE = 4  # eigenvalues that one contour encloses, about: contours are solved side by side
NODES = 8  # of the quadrature on half a circle
ROUNDS = 40
ROWS_AT_ONCE = 4096
PAIR = "row_id bigint, square bigint, cross bigint, w array<double>"


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal matrix that Householder reflections turn a symmetric one into."""
    a = matrix.astype(np.float64).copy()
    for i in range(len(a) - 2):
        v = a[i + 1 :, i].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = v @ v
        if size == 0:
            continue
        rest = a[i + 1 :, i + 1 :]
        p = rest @ v * (2 / size)
        p -= v * (p @ v / size)
        rest -= np.outer(v, p) + np.outer(p, v)
        edge = a[i + 1 :, i] - v * (2 * (v @ a[i + 1 :, i]) / size)
        a[i + 1 :, i] = a[i, i + 1 :] = edge
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: by Sylvester's law the positive pivots of the shifted matrix's factors."""
    tiny = np.finfo(np.float64).tiny ** 0.5 * (1 + np.abs(diagonal).max(initial=0.0))
    above = np.zeros(len(shifts), dtype=np.int64)
    pivot = np.ones(len(shifts))
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0
    return above


def contours(matrix: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that together hold the ``most`` largest eigenvalues, ties at the end included.

    Ends lie in the middle of gaps of the spectrum, which inertia counts bracket. Eigenvalues too near to be told apart
    share an interval.
    """
    diagonal, off = tridiagonal(matrix)
    size = len(diagonal)
    edge = np.abs(diagonal) + np.append(np.abs(off), 0.0) + np.insert(np.abs(off), 0, 0.0)
    top = float((diagonal + edge - np.abs(diagonal)).max()) + 1e-9 * float(edge.max())
    low, high = np.full(size, float((diagonal - edge + np.abs(diagonal)).min()) - 1e-9 * float(edge.max())), np.full(size, top)
    order = np.arange(1, size + 1)
    for _ in range(40):  # brackets of all eigenvalues at once, from the largest on
        middle = (low + high) / 2
        enough = inertia(diagonal, off, middle) >= order
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    fine = 1e-9 * float(edge.max())
    cuts, held, out = [i for i in range(size - 1) if low[i] - high[i + 1] > fine], 0, []
    upper = top
    while held < min(most, size):
        wanted = min(held + AT_ONCE, most)
        end = next((i for i in cuts if i + 1 >= wanted), size - 1)
        lower = (low[end] + high[end + 1]) / 2 if end < size - 1 else low[end] - fine - 1e-3 * (top - low[end])
        counts = inertia(diagonal, off, np.array([lower, upper]))
        out.append((float(lower), float(upper), int(counts[0] - counts[1])))
        held, upper = end + 1, float(lower)
    return out


def feast(matrix: np.ndarray, low: float, high: float, inside: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues in (low, high), falling, and their unit eigenvectors as rows.

    Each round filters a subspace by quadrature of the resolvent along a circle through both ends, a complex solve a
    node, and takes Ritz pairs from it. It ends when as many of them lie inside as inertia counted and each solves the
    eigenvalue equation to rounding; otherwise it raises, so that none is missed silently.
    """
    size = len(matrix)
    width = min(size, inside + max(8, inside))
    middle, radius = (low + high) / 2, (high - low) / 2
    x, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 - x))
    space = np.random.default_rng(seed).normal(size=(size, width))
    scale = np.linalg.norm(matrix)
    for _ in range(ROUNDS):
        filtered = np.zeros((size, width))
        for t, weight in zip(turn, weights, strict=True):
            solved = np.linalg.solve((middle + radius * t) * np.eye(size) - matrix, space.astype(np.complex128))
            filtered += weight / 2 * (radius * t * solved).real
        basis, _ = np.linalg.qr(filtered)
        values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
        space = basis @ turned
        found = np.nonzero((values > low) & (values < high))[0][::-1]
        residual = np.linalg.norm(matrix @ space[:, found] - space[:, found] * values[found], axis=0)
        if len(found) == inside and residual.max(initial=0.0) <= 64 * np.finfo(np.float64).eps * scale:
            return values[found], space[:, found].T
    raise RuntimeError(f"{len(found)} of {inside} eigenvalues between {low} and {high} after {ROUNDS} rounds")


def leading_components(spark: SparkSession, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix and their unit eigenvectors as rows; a contour is a task.

    The matrix has one row a dimension and travels to the tasks, whatever the number of vectors. Signs are such that a
    component's largest entry is positive.
    """
    scale = float(np.abs(matrix).max(initial=0.0))
    if scale == 0:  # no direction differs from another
        return np.zeros(most), np.eye(most, len(matrix))
    scaled = matrix / scale

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high, inside in zip(batch["low"], batch["high"], batch["inside"], strict=True):
                values, vectors = feast(scaled, low, high, int(inside))
                yield pd.DataFrame({"value": values, "vector": list(vectors)})

    cut = contours(scaled, most)
    tasks = spark.createDataFrame(cut, "low double, high double, inside int").repartitionByRange(len(cut), "low")
    found = sorted(tasks.mapInPandas(solve, "value double, vector array<double>").collect(), key=lambda r: -r["value"])
    assert len(found) == sum(inside for *_, inside in cut)
    vectors = np.array([r["vector"] for r in found[:most]])
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return np.array([r["value"] for r in found[:most]]) * scale, vectors * signs[:, None]


def entries(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of all rows with divisor ``n``: rows are centred on whole numbers before multiplying, the rest is taken off.

    Each task adds up its rows' products, one row a task meets the others; sums of whole numbers below 2^53 are exact.
    """
    dims = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], dtype=np.float64) / n
    upper = np.triu_indices(dims)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = entries(batch)
            for lo in range(0, len(x), ROWS_AT_ONCE):
                y = (x[lo : lo + ROWS_AT_ONCE] - middle).astype(np.float64)
                total += y.T @ y
        one = pa.ListArray.from_arrays(np.array([0, len(upper[0])], dtype=np.int32), pa.array(total[upper]))
        yield pa.RecordBatch.from_arrays([one], ["products"])

    parts = rows.select("x").mapInArrow(multiply, "products array<double>").select(F.posexplode("products").alias("at", "p"))
    total = parts.groupBy("at").agg(F.sum(F.col("p").cast("decimal(38,3)")).alias("p")).collect()
    flat = np.zeros(len(upper[0]))
    flat[[r["at"] for r in total]] = [float(r["p"] / n) for r in total]
    out = np.zeros((dims, dims))
    out[upper] = flat
    out = out + np.triu(out, 1).T
    return out - np.outer(rest, rest)


def whiten(vectors: DataFrame, components: int, scale: int = 1024, shift: int = 100_000, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector on the leading ``components`` of all vectors' covariance, each to unit variance: one row a component.

    Entries become x = floor(scale * c) + shift. n vectors with sums S a dimension are the fit list; the components are
    unit eigenvectors of their covariance, numbered from 1 by falling eigenvalue e. Columns: row_id, component, n,
    deviation (sum of (n * x - S)^2, exact, decimal), whitened (x - S / n on the component, over sqrt(e)), explained (e
    over the trace), identity_error (largest absolute entry of the whitened rows' covariance minus the identity,
    measured on the rows). Vectors are never shuffled: tasks add up sums and products, whose number follows from the
    dimensions, and FEAST works on those.

    Null and empty vectors, vectors with null or non-finite entries, and with entries of 2^24 or more in size once
    scaled, take no part, nor do those with another length than the most frequent one (ties: the longer). With fewer
    dimensions than ``components`` there are as many components. A component without variance has null whitened values
    and no part in identity_error; without any variance explained and identity_error are null. Ids, null or repeated,
    and repeated rows stay as they are. No rows give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < MOST))
    kept = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    length = kept.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        empty = "row_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], empty)
    dims, n = length["d"], length["count"]
    turned = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")) + shift)
    rows = kept.filter(F.size(vector) == dims).select(F.col(row_id).cast("bigint").alias("row_id"), turned.alias("x"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((entries(b).sum(axis=0) for b in batches), np.zeros(dims, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.array([0, dims], dtype=np.int32), pa.array(total))], ["sums"])

    parts = rows.select("x").mapInArrow(add, "sums array<bigint>").select(F.posexplode("sums").alias("at", "s"))
    sums = [int(r["s"]) for r in parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()]
    spread = covariance(rows, n, sums)
    trace = float(np.trace(spread))
    values, axes = leading_components(spark, spread, min(components, dims))
    varies = values > dims * np.finfo(np.float64).eps * max(trace, 1e-300)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], dtype=np.int64)
    onto = (axes / np.sqrt(np.where(varies, values, 1.0))[:, None]).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                y = entries(batch) - middle
                # (y - rest / n)^2 * n^2 = n^2 * square - 2 * n * cross + the sum of rest^2
                square, cross = (y * y).sum(axis=1), (y * rest).sum(axis=1)
                w = (y - rest / n) @ onto
                flat = pa.array(w.reshape(-1), mask=np.tile(~varies, len(w)))
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(square), pa.array(cross), lists], ["row_id", "square", "cross", "w"])

    white = cut_lineage(rows.mapInArrow(project, PAIR))
    pairs = [(i, j) for i in np.nonzero(varies)[0].tolist() for j in np.nonzero(varies)[0].tolist() if i <= j]
    measured = white.agg(F.count(F.lit(1)), *[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) for i, j in pairs]).first()
    error = max((abs(v - (i == j)) for (i, j), v in zip(pairs, measured[1:], strict=True)), default=None)
    exact = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    deviation = exact(n * n) * F.col("square").cast("decimal(38,0)") - exact(2 * n) * F.col("cross").cast("decimal(38,0)") + exact(sum(int(r) ** 2 for r in rest))
    shares = F.lit([float(v) / trace for v in values] if trace > 0 else [None] * len(values)).cast("array<double>")
    return white.select("row_id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened")).select(
        "row_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
