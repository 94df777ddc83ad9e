"""Companion groups against a plain search, and folds that no group crosses."""

import collections
import random

import pytest

from civicmill.operators import folds as Fo


def plain(keys, edges):
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for k in sorted(set(near) | set(keys)):
        if k not in out:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = k
                    todo += near[x]
    return {k: out[k] for k in keys}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_groups_equal_a_plain_search(spark, shape):
    rng = random.Random(1)
    keys = list(range(300))
    places = rng.sample(keys, 300)
    edges = {
        "random": [(rng.randrange(330), rng.randrange(330)) for _ in range(160)] + [(None, 1), (2, None), (5, 5)],
        "path": list(zip(places, places[1:], strict=False)),
        "star": [(299, i) for i in range(299)],
        "none": [],
    }[shape]
    records = spark.createDataFrame([(k,) for k in keys] + [(None,), (7,)], "key int")
    got = Fo.companion_groups(records, spark.createDataFrame(edges, "src int, dst int")).collect()
    assert {r["key"]: r["grp"] for r in got} == plain(keys, edges) and len(got) == 300


def test_plan_deals_every_group_to_the_lightest():
    rng = random.Random(2)
    for _ in range(200):
        folds = rng.randrange(1, 6)
        sizes = {rng.randrange(1, 60): rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))}
        load, dealt = [0] * folds, collections.Counter()
        runs = Fo.plan_folds(sizes, folds)
        for size, many in sizes.items():
            mine = sorted((first, fold) for s, first, fold in runs if s == size)
            assert mine[0][0] == 0
            for (a, fold), (b, _) in zip(mine, [*mine[1:], (many, 0)], strict=True):
                load[fold] += (b - a) * size
                dealt[size] += b - a
        assert dealt == sizes and max(load) - min(load) <= max(sizes)


def test_no_companion_pair_crosses(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(500)]
    edges = [(f"k{rng.randrange(40)}", f"k{rng.randrange(500)}") for _ in range(60)]
    e = spark.createDataFrame(edges, "src string, dst string")
    groups = Fo.companion_groups(spark.createDataFrame([(k,) for k in keys], "key string"), e)
    out = Fo.balanced_folds(groups, 4)
    report = Fo.fold_report(out, e).first()
    assert (report["records"], report["crossing"], report["balanced"]) == (500, 0, True)
    assert {r["fold"] for r in out.collect()} == {0, 1, 2, 3}
