"""Evaluation folds that no group of companions crosses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.operators.votes import root_of
from civicmill.session import cut_lineage


def companion_groups(records: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """(key, grp): the smallest key that a record reaches over ``edges`` (src, dst), in either direction.

    Every node that has a smaller neighbour hooks to the smallest one, hooks are followed to their roots by doubling,
    and the graph shrinks to its roots. Only nodes without a smaller neighbour are left, at most half, so the rounds are
    logarithmic whatever the shape. A hub's neighbours are never gathered: a minimum per node is all that meets. Edges
    to keys that are no records join their neighbours all the same. Null ends are no edges, null keys no records.
    """
    left = cut_lineage(edges.filter("src <> dst").select("src", "dst").distinct())
    found = records.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().select(F.col(key), F.col(key).alias("grp"))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("_least"))
        roots = cut_lineage(root_of(hooks.select("id", F.when(F.col("_least") < F.col("id"), F.col("_least")).alias("parent"))).select("id", "root"))
        found = cut_lineage(found.join(roots.withColumnRenamed("id", "grp"), "grp", "left").select(key, F.coalesce("root", "grp").alias("grp")))
        to = lambda c, roots=roots: roots.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
        left = cut_lineage(left.join(to("src"), "src").join(to("dst"), "dst").filter("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
    return found


def plan_folds(sizes: dict[int, int], folds: int) -> list[tuple[int, int, int]]:
    """(size, first rank, fold): the largest groups first, each into the lightest fold, on counts of groups of a size.

    Groups of a size are dealt in as few runs as the levels of the folds allow, so the work follows the number of sizes,
    not of groups.
    """
    load = [0] * folds
    runs = []
    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        while left:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            lightest, level = order[0], load[order[0]]
            above = next((load[f] for f in order if load[f] > level), None)
            if above is None and left >= folds:  # all level: an even share each
                share = left // folds
                for f in order:
                    runs.append((size, rank, f))
                    load[f] += share * size
                    rank += share
                left -= share * folds
                continue
            alone = order[1:] and load[order[1]] > level
            take = min(left, max(1, -(-(load[order[1]] - level) // size))) if alone else 1
            runs.append((size, rank, lightest))
            load[lightest] += take * size
            rank, left = rank + take, left - take
    return runs


def balanced_folds(groups: DataFrame, folds: int, key: str = "key", seed: int = 3) -> DataFrame:
    """(key, grp, fold): whole groups only; folds differ by at most the largest group.

    The driver plans on one count per group size. Groups of a size are numbered in a seeded order, over buckets, so a
    size that most groups have is spread.
    """
    sized = cut_lineage(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).withColumn("mix", F.xxhash64(F.lit(seed), "grp")))
    counts = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs: dict[int, list[tuple[int, int]]] = {}
    for size, first, fold in plan_folds(counts, folds):
        runs.setdefault(size, []).append((first, fold))
    spark = groups.sparkSession
    plan = spark.createDataFrame(list(runs.items()), "size bigint, runs array<struct<first:bigint,fold:int>>")
    numbered = scale.row_numbers(sized, ["size"], ["mix", "grp"], "rank")
    mine = F.filter("runs", lambda r: r["first"] < F.col("rank"))
    placed = numbered.join(plan, "size").select("grp", F.element_at(mine, -1)["fold"].alias("fold"))
    return groups.join(placed, "grp").select(key, "grp", "fold")


def fold_report(folds: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """One row: records, groups, edges that cross folds (must be 0), and whether folds differ by at most the largest group."""
    at = lambda c: folds.select(F.col(key).alias(c), F.col("fold").alias(f"_{c}"))
    crossing = edges.join(at("src"), "src").join(at("dst"), "dst").agg(F.count_if(F.col("_src") != F.col("_dst")).alias("crossing"))
    sizes = folds.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"))
    spread = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") - F.min("n")).alias("spread"))
    out = sizes.withColumn("crossing", crossing.scalar()).withColumn("_spread", spread.scalar())
    return out.select("records", "groups", "largest", "crossing", (F.col("_spread") <= F.col("largest")).alias("balanced"))
