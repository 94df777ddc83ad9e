"""Permutation test of the spread of bucket rates, for pools with any number of buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # buckets that one draw splits among, about
EXACT = 10**9 - 1  # cases up to which numpy draws from the hypergeometric law itself


def split_hits(generator: np.random.Generator, sizes: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """How many of each round's ``hits`` fall into each part, the parts having ``sizes`` cases: a row a part.

    Shuffling outcomes gives the multivariate hypergeometric law; it is drawn part by part, each against what is left.
    """
    left, rest, out = hits.astype(np.int64).copy(), int(sizes.sum()), np.zeros((len(sizes), len(hits)), dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        rest -= size
        if rest == 0:
            out[i] = left
        elif size + rest <= EXACT:
            out[i] = generator.hypergeometric(size, rest, left)
        else:  # the law's normal limit; its error at a billion cases is far below one case in a thousand rounds
            whole = float(size + rest)
            mean = left * (size / whole)
            deviation = np.sqrt(mean * (rest / whole) * ((whole - left) / (whole - 1)))
            drawn = np.rint(generator.normal(mean, deviation)).astype(np.int64)
            out[i] = np.clip(drawn, np.maximum(0, left - rest), np.minimum(size, left))
        left -= out[i]
    return out


def generator_of(seed: int, node: int) -> np.random.Generator:
    """Counter-based and keyed by the node, so that a lost task's draws come again and no two nodes share any."""
    return np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), node & (2**64 - 1)]))


def permutation_spread(rows: DataFrame, pool: str, key: str, *, minimum: int = 25, rounds: int = 200, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(pool, cases, hits, buckets, spread, beaten, p, fails): how often shuffled outcomes spread bucket rates as far.

    ``rows``: pool, key and y (0 or 1). A bucket with fewer than ``minimum`` cases states no rate; such buckets count
    as one remainder. Rows are reduced to counts, and counts are drawn instead of rows shuffled: first a pool's hits
    among blocks of buckets, then a block's among its buckets, each block in a task of its own. Only least and greatest
    rate a round leave a block. With fewer than two buckets the spread is 0 and every shuffle reaches it. A null pool is
    a pool, a null key a bucket; rows with a null outcome are no cases.
    """
    named = rows.filter("y IS NOT NULL").select(F.col(pool).alias("pool"), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")).alias("bucket"), "y")
    counts = named.groupBy("pool", "bucket").agg(F.count(F.lit(1)).alias("cases"), F.sum("y").cast("bigint").alias("hits"))
    usable = F.col("cases") >= minimum
    rate = F.when(usable, F.col("hits") / F.col("cases"))
    seen = counts.groupBy("pool").agg(
        F.sum("cases").alias("cases"),
        F.sum("hits").alias("hits"),
        F.count_if(usable).alias("buckets"),
        F.sum(F.when(~usable, F.col("cases"))).alias("loose"),
        (F.max(rate) - F.min(rate)).alias("spread"),
    )
    many = F.ceil(F.col("buckets") / F.lit(block)).cast("bigint")
    wide = seen.filter("buckets >= 2").select("pool", "cases", "hits", "loose", many.alias("blocks"))
    placed = counts.filter(usable).join(wide.select(F.col("pool").alias("_p"), "blocks"), F.col("pool").eqNullSafe(F.col("_p")))
    placed = placed.select("pool", "bucket", "cases", F.pmod(F.xxhash64("bucket"), F.col("blocks")).alias("block"))
    blocks = placed.groupBy("pool", "block").agg(F.sum("cases").alias("cases"), F.sort_array(F.collect_list(F.struct("bucket", "cases"))).alias("parts"))
    node = lambda *c: F.xxhash64(F.lit(seed), *c)
    # one row a pool: its blocks' sizes, a number for every ``block`` buckets
    top = blocks.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("block", "cases"))).alias("blocks"))
    top = top.join(wide.select(F.col("pool").alias("_p"), "hits", "loose"), F.col("pool").eqNullSafe(F.col("_p"))).withColumn("node", node("pool"))

    def among_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = [b["block"] for b in r.blocks]
                sizes = np.array([b["cases"] for b in r.blocks] + [0 if pd.isna(r.loose) else int(r.loose)], dtype=np.int64)
                drawn = split_hits(generator_of(seed, r.node), sizes, np.full(rounds, r.hits))[:-1]
                yield pd.DataFrame({"pool": [r.pool] * len(ids), "block": ids, "drawn": list(drawn)})

    kind = rows.schema[pool].dataType.simpleString()
    given = top.select("pool", "blocks", "hits", "loose", "node").mapInPandas(among_blocks, f"pool {kind}, block bigint, drawn array<bigint>")
    inner = blocks.join(given.select(F.col("pool").alias("_p"), F.col("block").alias("_b"), "drawn"), F.col("pool").eqNullSafe(F.col("_p")) & (F.col("block") == F.col("_b")))

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                sizes = np.array([p["cases"] for p in r.parts], dtype=np.int64)
                rates = split_hits(generator_of(seed, r.node), sizes, np.asarray(r.drawn)) / sizes[:, None]
                yield pd.DataFrame({"pool": [r.pool] * rounds, "round": range(rounds), "least": rates.min(axis=0), "most": rates.max(axis=0)})

    ends = inner.select("pool", "parts", "drawn", node("pool", "block").alias("node")).mapInPandas(inside, f"pool {kind}, round int, least double, most double")
    shuffled = ends.groupBy("pool", "round").agg((F.max("most") - F.min("least")).alias("s"))
    spreads = seen.select(F.col("pool").alias("_p"), F.col("spread").alias("_o"))
    beaten = shuffled.join(spreads, F.col("pool").eqNullSafe(F.col("_p"))).groupBy("pool").agg(F.count_if(F.col("s") >= F.col("_o") - 1e-12).alias("beaten"))
    out = seen.alias("s").join(beaten.select(F.col("pool").alias("_p"), "beaten"), F.col("s.pool").eqNullSafe(F.col("_p")), "left")
    spread = F.when(F.col("buckets") >= 2, F.round("spread", 6)).otherwise(0.0)
    out = out.select(F.col("s.pool").alias(pool), "cases", "hits", "buckets", spread.alias("spread"), F.coalesce("beaten", F.lit(rounds)).alias("beaten"))
    return out.withColumn("p", F.col("beaten") / rounds).withColumn("fails", F.col("p") > 0.05)
