"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.session import cut_lineage

# A side of at most this many rows may be hinted as a broadcast; every hint stands behind a count of that side.
BROADCAST_ROWS = 300_000


def checked_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay within ``most``; else unchanged, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def gathered(df: DataFrame) -> pd.DataFrame:
    """The rows of a table whose size is bounded, on the driver: as columns, never as one Python object a row."""
    return df.toArrow().to_pandas()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes the fast built-in, where both agree."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def ranked(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], rank: str, total: str) -> DataFrame:
    """Adds each row's exact rank (from 0) within ``keys`` by ``order``, and the number of rows of its key.

    ``bucket`` must not fall as ``order`` rises. Rows meet by (keys, bucket), so a key with a third of all rows is
    spread over its buckets; only one count per bucket meets by key. ``df`` is read twice: pass a written table.
    Key columns must not be null.
    """
    rows = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    # one running sum gives the offsets; the total is its last value
    offsets = counts.select(
        *part,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias(total),
    )
    inside = Window.partitionBy(*part).orderBy(*order)
    local = rows.withColumn("_local", F.row_number().over(inside) - 1)
    return local.join(offsets, part).withColumn(rank, F.col("_offset") + F.col("_local")).drop("_bucket", "_offset", "_local")


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (src, dst); only nodes with an edge.

    Alternating large-star and small-star steps. Each is a minimum per node (combined before the shuffle) and a join
    of the edges with those minima, so a hub's neighbours are never gathered; AQE splits the hub's join. Every round
    is written to the shared folder. Ends when the edges no longer change, after a logarithmic number of rounds.
    """
    edges = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    edges = cut_lineage(edges)
    mark, rounds = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark or rounds == max_rounds:
            break
        mark, rounds = now, rounds + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
