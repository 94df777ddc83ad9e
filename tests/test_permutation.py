"""The permutation test by split draws against shuffled rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from civicmill.operators import permutation as P


def plain(rows, minimum, rounds):
    """Outcomes of all rows shuffled, as often as asked."""
    keys, outs = [k for _, k, _ in rows], [y for *_, y in rows]

    def spread(outs):
        n, h = {}, {}
        for k, y in zip(keys, outs, strict=True):
            n[k], h[k] = n.get(k, 0) + 1, h.get(k, 0) + y
        rates = [h[k] / n[k] for k in n if n[k] >= minimum]
        return max(rates) - min(rates) if len(rates) > 1 else 0.0

    seen, rng, beat = spread(outs), random.Random(5), 0
    for _ in range(rounds):
        rng.shuffle(outs)
        beat += spread(outs) >= seen - 1e-12
    return seen, beat / rounds


def test_p_agrees_with_shuffled_rows(spark):
    rng = random.Random(1)
    pools = {f"p{i}": [(f"p{i}", f"k{rng.randrange(12)}" if rng.random() < 0.9 else None, int(rng.random() < 0.5 + d * rng.random())) for _ in range(400)] for i, d in enumerate((0.0, 0.1, 0.3))}
    pools["signal"] = [("signal", f"k{i % 4}", int(rng.random() < (0.8 if i % 4 else 0.4))) for i in range(400)]
    pools["one"] = [("one", "k", 1)] * 60
    pools["small"] = [("small", f"k{i}", i % 2) for i in range(40)]
    rows = [r for p in pools.values() for r in p]
    df = spark.createDataFrame([*rows, ("p0", "k1", None)], "pool string, k string, y int")
    for block in (1024, 3):  # one block a pool, and several
        got = {r["pool"]: r for r in P.permutation_spread(df, "pool", "k", rounds=1000, block=block).collect()}
        for name, mine in pools.items():
            seen, p = plain(mine, 25, 1000)
            assert (got[name]["cases"], got[name]["hits"], got[name]["spread"]) == (len(mine), sum(y for *_, y in mine), round(seen, 6))
            assert abs(got[name]["p"] - p) < 0.07
        assert got["signal"]["p"] == 0.0 and got["one"]["p"] == got["small"]["p"] == 1.0
    again = P.permutation_spread(df.repartition(7), "pool", "k", rounds=1000, block=3).collect()
    assert {r["pool"]: r["beaten"] for r in again} == {k: r["beaten"] for k, r in got.items()}  # every draw can be had again


def test_a_pool_with_very_many_keys_is_spread(spark):
    rows = spark.range(300_000).select(F.lit("hot").alias("pool"), (F.col("id") % 100_000).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y"))
    r = P.permutation_spread(rows, "pool", "k", minimum=2, rounds=20).first()
    assert (r["cases"], r["buckets"], r["spread"], r["p"]) == (300_000, 100_000, 1.0, 1.0)


def test_draws_follow_the_law_at_any_size():
    sizes = np.array([10, 30, 0, 60])
    drawn = P.split_hits(P.generator_of(1, 2), sizes, np.full(20_000, 40))
    assert (drawn.sum(axis=0) == 40).all() and (drawn <= sizes[:, None]).all()
    assert np.allclose(drawn.mean(axis=1), 40 * sizes / 100, atol=0.1)
    assert np.allclose(drawn.var(axis=1), 40 * (sizes / 100) * (1 - sizes / 100) * 60 / 99, atol=0.2)
    large = P.split_hits(P.generator_of(1, 2), np.array([2 * 10**9, 3 * 10**9]), np.full(2000, 10**9))
    assert (large.sum(axis=0) == 10**9).all() and abs(large[0].mean() - 4 * 10**8) < 2000
