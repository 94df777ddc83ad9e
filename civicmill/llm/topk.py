"""Exact top-k search by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.session import cut_lineage

ITEM_BLOCK = 8192  # rows of a block of candidates
QUERY_BLOCK = 2048  # rows of a block of queries
CHUNK = 128  # queries bounded at once inside a task
LEVELS = (4, 16)  # segments, coarse to fine
OUT = "query_id bigint, vec_id bigint, score bigint"


def floor_components(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as bigint; null where the vector is null or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def segment_features(rows: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(length) * mean and sqrt(length) * deviation, side by side.

    The dot product of two such rows is at least the inner product of the vectors: inside a segment of length m it is
    m * mean * mean' plus the product of the deviations from the mean, and that is at most m * dev * dev' (Cauchy).
    In terms of distance, |q|^2 + |x|^2 minus twice this bound is the lower bound on the squared distance.
    """
    cut = np.array_split(np.arange(rows.shape[1]), min(segments, rows.shape[1]))
    parts = [(np.sqrt(len(c)), rows[:, c].mean(axis=1), rows[:, c].std(axis=1)) for c in cut]
    return np.stack([m * mean for m, mean, _ in parts] + [m * dev for m, _, dev in parts], axis=1)


def best_of(a: np.ndarray, b: np.ndarray, score: np.ndarray, item_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs (query row, item row, score) of each query row, sorted; ties to the smaller id."""
    order = np.lexsort((item_ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], score[keep]


def block_top_k(queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, item row, score) of each query's k best items of one block; ties to the smaller id.

    The bounds' threshold may let most pairs through. Exact scores raise it to a query's k-th best of its block, so
    only about k pairs a query are sorted.
    """
    found = []
    exact_items = items.astype(np.float64)
    norms = np.linalg.norm(exact_items, axis=1)
    # integers below 2^53 are exact as floats, whatever the order of their sums
    safe = float(np.abs(queries).max(initial=0)) * float(np.abs(items).max(initial=0)) * items.shape[1] < 2.0**53
    item_levels = [segment_features(exact_items, s) for s in LEVELS]
    for start in range(0, len(queries), CHUNK):
        q = queries[start : start + CHUNK]
        wide = q.astype(np.float64)
        slack = 1e-9 * np.outer(np.linalg.norm(wide, axis=1), norms).max(initial=0.0) + 1e-6  # of rounding
        own = query_ids[start : start + CHUNK, None] == item_ids[None, :]
        levels = [segment_features(wide, s) for s in LEVELS]
        fine = levels[-1] @ item_levels[-1].T
        fine[own] = -np.inf
        top = min(k, len(items))
        # the exact scores of the k items with the best bounds give a threshold that no better item can miss
        best = np.argpartition(-fine, top - 1, axis=1)[:, :top]
        first = np.einsum("qd,qkd->qk", q, items[best])
        first[np.take_along_axis(own, best, axis=1)] = np.iinfo(np.int64).min
        threshold = first.min(axis=1).astype(np.float64)
        coarse = levels[0] @ item_levels[0].T >= threshold[:, None] - slack
        near = coarse & (fine >= threshold[:, None] - slack) & ~own
        some = np.nonzero(near.any(axis=0))[0]  # items that survive for some query of the chunk
        if safe:
            score = np.where(near[:, some], wide @ exact_items[some].T, -np.inf)
            if len(some) > k:
                threshold = np.maximum(threshold, np.partition(score, len(some) - k, axis=1)[:, len(some) - k])
            qi, xi = np.nonzero(score >= threshold[:, None])
            found.append(best_of(qi + start, some[xi], score[qi, xi].astype(np.int64), item_ids, k))
            continue
        qi, xi = np.nonzero(near)
        for lo in range(0, len(qi), 200_000):  # bounded memory for the exact step
            a, b = qi[lo : lo + 200_000], xi[lo : lo + 200_000]
            score = np.einsum("pd,pd->p", q[a], items[b])
            keep = score >= threshold[a]
            found.append(best_of(a[keep] + start, b[keep], score[keep], item_ids, k))
    if not found:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    return best_of(*(np.concatenate(x) for x in zip(*found, strict=True)), item_ids, k)


def exact_top_k(vectors: DataFrame, k: int, is_query: Column, row_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """For each row that ``is_query`` marks, the k highest integer inner products among all other rows; ties to the smaller id.

    Items and queries are cut into blocks of bounded size; each pair of blocks is one cogroup. Inside it bounds from
    segment means and deviations, coarse to fine, rule out most pairs, and exact products decide the rest. The best k
    of every block then compete by a window whose groups Spark limits to k before the shuffle. The work is queries
    times rows, which the stated query set asks for.

    Null vectors, and vectors with null or non-finite components, take no part, nor do rows without an id. Vectors
    are compared only with vectors of their own length. Rows with the query's id count as its own; other repeated ids
    are rows of their own. A query without candidates gives no row. Other columns are ignored.
    """
    rows = vectors.select(F.col(row_id).cast("bigint").alias("id"), floor_components(F.col(vector), scale).alias("v"), is_query.alias("is_query"))
    rows = cut_lineage(rows.filter("id is not null and v is not null and size(v) > 0"))
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    item_blocks, query_blocks = -(-n_rows // ITEM_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    place = F.xxhash64("id", "v")
    items = rows.select("id", "v", F.pmod(place, F.lit(item_blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("a"))
    queries = rows.filter("is_query").select("id", "v", F.pmod(place, F.lit(query_blocks)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("b"))
    keys = [F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.size("v").alias("d")]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, x = np.stack(left["v"].to_numpy()).astype(np.int64), np.stack(right["v"].to_numpy()).astype(np.int64)
        q_ids, x_ids = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        qi, xi, score = block_top_k(q, q_ids, x, x_ids, k)
        return pd.DataFrame({"query_id": q_ids[qi], "vec_id": x_ids[xi], "score": score})

    left, right = queries.select("id", "v", *keys).groupBy("a", "b", "d"), items.select("id", "v", *keys).groupBy("a", "b", "d")
    met = left.cogroup(right).applyInPandas(meet, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
