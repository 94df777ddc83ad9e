"""Ordered state, top-k and digests that hold when one key carries a large share of the rows.

A window partitioned by a hot key sorts that whole key in one task. The helpers here never do that: either
the answer is an algebraic aggregate (combined on the map side), or the key is cut into ordered buckets and
only one summary row per bucket is carried across.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.session import cut_lineage


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by a total order. Aggregation, not a window: map-side combine keeps hot keys cheap."""
    return _pick(df, keys, order, F.max_by)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by a total order."""
    return _pick(df, keys, order, F.min_by)


def _pick(df, keys, order, chooser):
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """k first rows per key. Spark limits each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def global_top_k(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """k first rows overall; the numbering window sees only those k rows."""
    few = df.orderBy(*order).limit(k)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def samples(df: DataFrame, keys: Sequence[str], value: str, k: int, out: str) -> DataFrame:
    """The k smallest distinct values per key joined with '|'. Only k rows per key are ever collected."""
    few = top_k(df.select(*keys, value).distinct(), keys, [F.col(value)], k, "_r")
    return few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), "|").alias(out))


# Rows of a bucket in ``running``, about: bounds come from Spark's sample of the rows.
BUCKET_ROWS = 500_000


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows: int | None = None) -> DataFrame:
    """``df`` as a written table with a bucket number that never falls along (keys, order).

    Bounds are quantiles of the whole tuple, so they cut inside a hot key and inside equal days alike, and their number
    follows from the row count: no bucket grows with the data.
    """
    written = cut_lineage(df)
    many = -(-written.count() // (rows or BUCKET_ROWS)) or 1
    if many == 1:  # all rows fit one bucket: no second pass
        return written.withColumn(out, F.lit(0))
    # written again: the number of the partition is fixed only by the table
    return cut_lineage(written.repartitionByRange(many, *keys, *order).withColumn(out, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Running sums (current row included), maxima of earlier rows, and previous-row values, in key order.

    Rows are cut into buckets of bounded size by (keys, order) and shuffled by (keys, bucket); per key only one summary
    row per bucket meets in a task, so a key with a third of all rows, or all rows of one day, is spread. Null keys are
    one key.
    """
    sums, maxima, lags = sums or {}, maxima or {}, lags or {}
    seq = F.struct(*[F.col(c) for c in order])
    work = df
    for name, expr in {**sums, **maxima}.items():
        work = work.withColumn(f"_in_{name}", expr)
    for name, expr in lags.items():
        # wrapped in a struct so that a null value differs from "no previous row"
        work = work.withColumn(f"_in_{name}", F.struct(expr.alias("v")))
    work = bucketed(work, keys, order, "_b", rows)

    part = [*keys, "_b"]
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy(*part).agg(
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxima],
        *[F.max_by(f"_in_{n}", seq).alias(f"_t_{n}") for n in lags],
    )
    prior = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    prior_rows = prior.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in part],
        *[F.sum(f"_t_{n}").over(prior_rows).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(prior_rows).alias(f"_c_{n}") for n in maxima],
        *[F.lag(f"_t_{n}").over(prior).alias(f"_c_{n}") for n in lags],
    )
    local = work
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_in_{name}").over(upto))
    for name in maxima:
        local = local.withColumn(f"_l_{name}", F.max(f"_in_{name}").over(before))
    for name in lags:
        local = local.withColumn(f"_l_{name}", F.lag(f"_in_{name}").over(inside))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part])
    joined = local.join(carry, same, "left")
    kept = [F.col(c) for c in df.columns]
    return joined.select(
        *kept,
        *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxima],
        *[F.coalesce(f"_l_{n}", f"_c_{n}")["v"].alias(n) for n in lags],
    )


def run_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, rows: int | None = None) -> DataFrame:
    """(keys, out): how many runs of equal values each key's rows form in order.

    Runs are counted inside buckets of a bounded number of rows; of each bucket only its count and its first and last
    value meet the key's other buckets, where a run that goes on is counted once less. No row is joined.
    """
    work = bucketed(df.select(*keys, *order, F.struct(value).alias("_v")), keys, order, "_b", rows)
    seq = F.struct(*[F.col(c) for c in order])
    before = F.lag("_v").over(Window.partitionBy(*keys, "_b").orderBy(*order))
    new = F.coalesce(~F.col("_v").eqNullSafe(F.col("_p")), F.lit(True))
    parts = work.withColumn("_p", before).groupBy(*keys, "_b").agg(F.count_if(new).alias("_n"), F.min_by("_v", seq).alias("_first"), F.max_by("_v", seq).alias("_last"))
    goes_on = F.col("_first").eqNullSafe(F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))).cast("int")
    return parts.withColumn("_on", goes_on).groupBy(*keys).agg((F.sum("_n") - F.sum("_on")).alias(out))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows: int | None = None) -> DataFrame:
    """Exact row numbers per key without gathering the key in one task."""
    return running(df, keys, order, sums={out: F.lit(1).cast("bigint")}, rows=rows)


def multiset_digest(*columns: str) -> list[Column]:
    """Order-free content digest of a group: row count, and two independent sums of per-row hashes.

    Hash sums combine on the map side, so no group is ever collected and sorted to be hashed.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    digest = F.md5(text)
    lo = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    hi = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return [F.count(F.lit(1)).alias("rows"), F.sum(lo).alias("digest_lo"), F.sum(hi).alias("digest_hi")]
