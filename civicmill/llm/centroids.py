"""Lloyd's clustering on integers, with distance bounds that planar geometry loosens by less than a centroid's drift."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.session import cut_lineage

MOST = 2**26  # a component of at least this size has squared distances beyond a long
SLACK = 1e-9  # of a bound, for rounding
ROWS_AT_ONCE = 8192
STATE = "row_id bigint, v array<bigint>, cluster int, distance bigint, lower array<float>, scanned int"
PARTIAL = "cluster int, n bigint, far bigint, inertia bigint, scanned bigint, sums array<bigint>"


@dataclass(frozen=True)
class Centroid:
    components: list[int]
    members: int
    inertia: int
    scanned: int  # exact distances to other centroids that the last assignment of its members took


def squared_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of integer rows to integer centres."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * most * most * rows.shape[1] < 2**53:  # every sum is an integer below 2^53, exact as a float in any order
        r, c = rows.astype(np.float64), centres.astype(np.float64)
        return ((r * r).sum(axis=1)[:, None] - 2.0 * (r @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """At [i, j], the most by which any point within ``radius[i]`` of old centroid i can have come nearer to centroid j.

    In the plane of the old and new place of j and the sphere's centre, points whose distance to j fell by at least d
    lie inside a branch of a hyperbola with foci at those places, and that lies inside its asymptotes: they leave the
    middle of the move at an angle whose cosine is d over the drift. Seen from that middle the sphere covers angles
    from (angle of its centre) minus arcsin(radius / distance) on, so d is at most the drift times the cosine of the
    smallest of them, nothing beyond a right angle, and the whole drift if the sphere holds the middle or the axis.
    """
    move = new - old
    drift = np.linalg.norm(move, axis=1)
    seen = old[:, None, :] - ((old + new) / 2)[None, :, :]
    far = np.linalg.norm(seen, axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(np.einsum("ijd,jd->ij", seen, move) / (far * drift[None, :]), -1.0, 1.0))
        half = np.arcsin(np.clip(radius[:, None] / far, 0.0, 1.0))
    least = np.where(radius[:, None] < far, np.maximum(angle - half, 0.0), 0.0)
    moved = drift[None, :] * (np.maximum(np.cos(least), 0.0) + 1e-7)
    return np.where(drift[None, :] > 0, np.minimum(moved, drift[None, :]), 0.0)


def down(bound: np.ndarray) -> np.ndarray:
    """A bound as a 4-byte float that is not above it."""
    short = np.maximum(bound * (1 - SLACK) - SLACK, 0.0).astype(np.float32)
    return np.nextafter(short, np.float32(0), dtype=np.float32)


def scan(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, lower bounds of all, and distances taken."""
    square = squared_distances(rows, centres)
    nearest = square.argmin(axis=1)
    return nearest, square[np.arange(len(rows)), nearest], down(np.sqrt(square)), np.full(len(rows), len(centres) - 1)


def rescan(rows, cluster, lower, centres: np.ndarray, loosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after centroids moved: a vector nearer to its own than every loosened bound stays, others are scanned."""
    lower = down(lower.astype(np.float64) - loosen[cluster])
    own = ((rows - centres[cluster]) ** 2).sum(axis=1)
    near = np.sqrt(own.astype(np.float64)) * (1 + SLACK) + SLACK
    rival = lower <= near[:, None]
    rival[np.arange(len(rows)), cluster] = False
    nearest, square, taken = cluster.copy(), own.copy(), rival.sum(axis=1)
    for j in range(len(centres)):  # exact distances to the centroids that a bound does not rule out
        here = np.nonzero(rival[:, j])[0]
        if len(here):
            found = squared_distances(rows[here], centres[j : j + 1])[:, 0]
            lower[here, j] = down(np.sqrt(found))
            best = (found < square[here]) | ((found == square[here]) & (j < nearest[here]))
            nearest[here[best]], square[here[best]] = j, found[best]
    moved = nearest != cluster
    lower[moved, cluster[moved]] = down(np.sqrt(own[moved]))
    return nearest, square, lower, taken


def _assigned(state: DataFrame, centres: np.ndarray, loosen: np.ndarray | None) -> DataFrame:
    """``state`` with each vector's cluster for ``centres``, written: no vector is shuffled."""
    k = len(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                rows = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                if loosen is None:
                    nearest, square, lower, taken = scan(rows, centres)
                else:
                    cluster = batch.column("cluster").to_numpy().astype(np.int64)
                    before = batch.column("lower").flatten().to_numpy().reshape(-1, k)
                    nearest, square, lower, taken = rescan(rows, cluster, before, centres, loosen)
                offsets = np.arange(0, lower.size + 1, k, dtype=np.int32)
                bounds = pa.ListArray.from_arrays(offsets, pa.array(lower.reshape(-1)))
                found = [pa.array(nearest.astype(np.int32)), pa.array(square), bounds, pa.array(taken.astype(np.int32))]
                names = ["row_id", "v", "cluster", "distance", "lower", "scanned"]
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("v"), *found], names)

    return cut_lineage(state.mapInArrow(assign, STATE))


def _gathered(state: DataFrame, centres: np.ndarray) -> tuple[list[Centroid], np.ndarray, np.ndarray]:
    """Each cluster's figures, its radius, and the exact floor of its mean (an empty one's old place): k rows a task meet."""
    k, dims = centres.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, figures = np.zeros((k, dims), dtype=np.int64), np.zeros((k, 4), dtype=np.int64)
        for batch in batches:
            rows = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            cluster, distance, scanned = (batch.column(c).to_numpy() for c in ("cluster", "distance", "scanned"))
            for j in np.unique(cluster):
                here = cluster == j
                sums[j] += rows[here].sum(axis=0)
                far = max(figures[j, 1], distance[here].max())
                figures[j] += here.sum(), 0, distance[here].sum(), scanned[here].sum()
                figures[j, 1] = far
        held = np.nonzero(figures[:, 0])[0]
        offsets = np.arange(0, len(held) * dims + 1, dims, dtype=np.int32)
        columns = [pa.array(held.astype(np.int32)), *(pa.array(figures[held, i]) for i in range(4))]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(sums[held].reshape(-1)))], ["cluster", "n", "far", "inertia", "scanned", "sums"])

    parts = cut_lineage(state.select("v", "cluster", "distance", "scanned").mapInArrow(partial, PARTIAL))
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect()
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("inertia").alias("inertia"), F.sum("scanned").alias("scanned")).collect()
    of = {r["cluster"]: r for r in whole}
    means = centres.copy()
    for r in sums:
        means[r["cluster"], r["at"]] = r["x"] // of[r["cluster"]]["n"]  # Python's integer division floors
    radius = np.array([np.sqrt(float(of[j]["far"])) * (1 + SLACK) if j in of else 0.0 for j in range(k)])
    found = [Centroid(centres[j].tolist(), *((of[j]["n"], of[j]["inertia"], of[j]["scanned"]) if j in of else (0, 0, 0))) for j in range(k)]
    return found, radius, means


def cluster_vectors(vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 64, seed: int = 1, row_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[Centroid]]:
    """(row_id, cluster, distance) of each vector after ``rounds`` of assignment and means and one more assignment, and the centroids.

    Components become floor(scale * x). Centroids start as the ``k`` vectors with the smallest sha256 of
    ``seed:row_id``. A vector's squared distance to its own centroid is always exact. To every other centroid it keeps a
    lower bound, which a move loosens by what the move can bring to the sphere of its whole cluster (``loosening``);
    exact distances are taken only to centroids whose bound does not exceed the own distance, so results equal a full
    scan. Vectors stay in their partitions: each round writes them once with their bounds, and only k sums a task meet.

    Null vectors, vectors with another number of components than ``dims``, with null or non-finite components, or with
    one of 2^26 or more in size once scaled, take no part. Null ids hash as an empty text; repeated ids and rows are
    vectors of their own, ties among their hashes go by components. With fewer vectors than ``k`` there are as many
    centroids; none give no rows. A distance's tie goes to the smaller number; an empty cluster keeps its centroid.
    Other columns are ignored.
    """
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < MOST))
    kept = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == dims) & fine)
    rows = kept.select(F.col(row_id).cast("bigint").alias("row_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    mixed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(mixed, "v").limit(k).select("v").collect()
    spark: SparkSession = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], STATE).select("row_id", "cluster", "distance"), []
    centres = np.array([r["v"] for r in first], dtype=np.int64)
    state, loosen = rows, None
    for _ in range(rounds):
        state = _assigned(state, centres, loosen)
        _, radius, means = _gathered(state, centres)
        loosen = loosening(centres.astype(np.float64), means.astype(np.float64), radius)
        centres = means
    state = _assigned(state, centres, loosen)
    found, _, _ = _gathered(state, centres)
    return state.select("row_id", "cluster", "distance"), found
