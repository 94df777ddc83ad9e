"""Digests of row groups as hash trees: equal roots mean equal rows, and unequal ones lead to the leaves that differ.

A row's leaf is named by the first hex digits of the hash of its identity, so it does not depend on the other rows, and
a group of any size is spread over 16^depth leaves. A leaf hashes its rows in the order of their hashes, with the count
of equal rows; a node hashes its children in order. The order of arrival plays no part, repeated rows do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.session import cut_lineage

LEAF_ROWS = 4096  # about, of the largest group


def row_hash(columns: Sequence[str]) -> Column:
    """sha256 of the columns, each with its length, so that no two rows share a text. A null is not an empty text."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def packed(digest) -> Column:
    """A hex digest as its bytes, in the same order: half as much to shuffle and write."""
    return F.unhex(digest)


def spelled(digest) -> Column:
    """Bytes as lower-case hex."""
    return F.lower(F.hex(digest))


def leaf_of(identity: Sequence[str], depth: int) -> Column:
    return F.substring(row_hash(identity), 1, depth) if depth else F.lit("")


def depth_for(rows: DataFrame, keys: Sequence[str], leaf_rows: int = LEAF_ROWS) -> int:
    """Levels below the root at which the largest group's leaves hold about ``leaf_rows`` rows. Two trees compare at equal depth."""
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    depth = 0
    while most > leaf_rows * 16**depth:
        depth += 1
    return depth


def leaves(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int, identity: Sequence[str] | None = None) -> DataFrame:
    """(keys, prefix, rows, digest): equal rows are counted before they meet, so a leaf gathers distinct rows only."""
    one = rows.select(*keys, leaf_of(identity or columns, depth).alias("prefix"), packed(row_hash(columns)).alias("_h"))
    counted = one.groupBy(*keys, "prefix", "_h").agg(F.count(F.lit(1)).alias("_n"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_h", "_n"))), lambda r: F.concat(spelled(r["_h"]), F.lit("*"), r["_n"].cast("string"))), ",")
    return counted.groupBy(*keys, "prefix").agg(F.sum("_n").alias("rows"), F.sha2(told, 256).alias("digest"))


def _above(level: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", packed("digest").alias("d")))), lambda x: F.concat(x["prefix"], F.lit("="), spelled(x["d"]))), ",")
    up = level.groupBy(*keys, F.substring("prefix", 1, length).alias("_p") if length else F.lit("").alias("_p"))
    return up.agg(F.sum("rows").alias("rows"), F.sha2(told, 256).alias("digest")).withColumnRenamed("_p", "prefix")


def tree(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int, identity: Sequence[str] | None = None) -> list[DataFrame]:
    """The levels of every group's tree, the root first: (keys, prefix, rows, digest). Rows are hashed once, leaves written."""
    lowest = leaves(rows, keys, columns, depth, identity)
    levels = [cut_lineage(lowest.withColumn("digest", packed("digest"))).withColumn("digest", spelled("digest")) if depth else lowest]
    for length in reversed(range(depth)):
        levels.insert(0, _above(levels[0], keys, length))
    return levels


def roots(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int = 0, identity: Sequence[str] | None = None) -> DataFrame:
    """(keys, rows, digest) of every group."""
    return tree(rows, keys, columns, depth, identity)[0].drop("prefix")


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def differing_leaves(before: Sequence[DataFrame], after: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, prefix, rows_before, rows_after) of the leaves that differ: from the roots down, only below nodes that differ."""
    assert len(before) == len(after), "trees of one depth"
    at: DataFrame | None = None
    short = lambda level: level.withColumn("digest", packed("digest"))
    for length, (old, new) in enumerate(zip(map(short, before), map(short, after), strict=True)):
        if at is not None:
            up = cut_lineage(at.select(*keys, "prefix")).select(*keys, F.col("prefix").alias("_up")).alias("u")
            below = lambda level, up=up, n=length: level.alias("l").join(
                up, _same(keys, "l", "u") & (F.substring("l.prefix", 1, n - 1) == F.col("u._up") if n > 1 else F.lit(True)), "left_semi"
            )
            old, new = below(old), below(new)
        both = old.alias("o").join(new.alias("n"), _same(keys, "o", "n") & (F.col("o.prefix") == F.col("n.prefix")), "full")
        differ = both.filter(~F.col("o.digest").eqNullSafe(F.col("n.digest")))
        # a null key is a key: which side holds the node is told by its prefix, never by its key
        pick = lambda c: F.when(F.col("n.prefix").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        at = differ.select(*[pick(c) for c in (*keys, "prefix")], F.coalesce("o.rows", F.lit(0)).alias("rows_before"), F.coalesce("n.rows", F.lit(0)).alias("rows_after"))
    return at
