"""Versioned store, incremental runs, keyed upsert, prune by zone figures, and hash trees."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from civicmill.operators import merkle
from civicmill.operators.recompute import DIGESTS, RESULTS, recompute
from civicmill.sources import store as St
from civicmill.sources.writers import PublishRefused

ROWS = "k string, t int, v string"


def files(path, table):
    """Every data file of a table with its time and size."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/{table}") for f in names if f.endswith(".parquet")}


def opened(df):
    return {f.removeprefix("file://") for f in df.inputFiles()}


def state(spark, changes=()):
    rows = [(f"k{i % 40}" if i % 3 else "hot", i, "same") for i in range(600)] + [(None, -1, "x")]
    rows = [(k, t, dict(changes).get(t, v)) for k, t, v in rows]
    return spark.createDataFrame([r for r in rows if r[2] != "gone"], ROWS)


def totals(df):
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max_by("v", "t").alias("last"))


def rows_of(df):
    return sorted(map(tuple, df.drop("part").collect()), key=str)


def test_second_run_computes_changed_keys_only(spark, tmp_path):
    store = St.Store(spark, str(tmp_path / "s"))
    seen = []

    def compute(df):
        seen.append({r[0] for r in df.select("k").distinct().collect()})
        return totals(df)

    run = recompute(store, state(spark), "k", ["t", "v"], compute, buckets=16)
    assert run.full == "first run" and rows_of(store.read(RESULTS)) == rows_of(totals(state(spark)))
    before = files(store.path, RESULTS)
    # k7 changes, k5 goes (rows 5, 125, 245, ... all of it), a new key comes
    gone = {t: "gone" for t in range(600) if t % 40 == 5 and t % 3}
    later = state(spark, {7: "other", **gone}).unionByName(spark.createDataFrame([("new", 1, "n")], ROWS))
    run = recompute(store, later, "k", ["t", "v"], compute)
    assert run.full == "" and run.changed == 3 and seen[-1] == {"k7", "new"}
    assert rows_of(store.read(RESULTS)) == rows_of(totals(later))
    assert before.items() <= files(store.path, RESULTS).items()  # nothing written before was touched
    assert len(run.parts) <= 3 and rows_of(store.read(RESULTS, at=store.snapshot(1))) == rows_of(totals(state(spark)))
    again = recompute(store, later.orderBy(F.desc("t")), "k", ["t", "v"], compute)
    assert again.version is None and store.snapshot().version == 2  # another order is no change


def test_a_run_that_ends_before_its_commit_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = St.Store(spark, str(tmp_path / "s"))
    recompute(store, state(spark), "k", ["t", "v"], totals, buckets=8)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(St.Store, "_publish", lost)
        with pytest.raises(KeyboardInterrupt):
            recompute(store, state(spark, {7: "other"}), "k", ["t", "v"], totals)
    fresh = St.Store(spark, store.path)
    assert fresh.snapshot().version == 1 and rows_of(fresh.read(RESULTS)) == rows_of(totals(state(spark)))
    assert recompute(fresh, state(spark, {7: "other"}), "k", ["t", "v"], totals).version == 2
    assert rows_of(fresh.read(RESULTS)) == rows_of(totals(state(spark, {7: "other"})))
    orphans = fresh.expire(keep=1)
    assert any("v00000002" in f for f in orphans) and rows_of(fresh.read(RESULTS)) == rows_of(totals(state(spark, {7: "other"})))
    assert fresh.snapshot(1) is None


def test_reasons_to_compute_everything(spark, tmp_path):
    store = St.Store(spark, str(tmp_path / "s"))
    shared = lambda when: spark.createDataFrame([("k1", "9:00"), ("k2", when)], "k string, time string")
    go = lambda **kw: recompute(store, state(spark), "k", ["t", "v"], totals, buckets=8, **kw)
    assert go(shared=shared("9:00")).full == "first run"
    moved = go(shared=shared("9:30"))  # a shared input moved one key whose own rows did not change
    assert moved.full == "" and moved.changed == 1
    assert go(shared=shared("9:30"), signature="code 2").full == "signature"
    assert go(shared=shared("9:30"), signature="code 2", full_every=1).full == "scheduled"
    for content, why in ((b"", "digests damaged"), (b"no table" * 9, "unreadable")):
        newest = store.snapshot().parts(DIGESTS).popitem()[1]["folder"]
        with open(next(f for f in files(store.path, DIGESTS) if newest in f), "wb") as f:
            f.write(content)
        assert go(shared=shared("9:30"), signature="code 2").full == why
    assert rows_of(store.read(RESULTS)) == rows_of(totals(state(spark)))
    assert recompute(store, state(spark).limit(0), "k", ["t", "v"], totals, signature="code 2").full == "" and store.read(RESULTS).count() == 0


def test_two_runs_at_once_publish_one_version(spark, tmp_path):
    store = St.Store(spark, str(tmp_path / "s"))
    df = lambda v: spark.createDataFrame([("a", v)], "part string, v int")
    store.commit({"t": df(1)})
    at = store.snapshot()
    store.commit({"t": df(2)}, ["a"], based_on=at)
    with pytest.raises(PublishRefused, match="another run"):
        store.commit({"t": df(3)}, ["a"], based_on=at)
    assert [r["v"] for r in store.read("t").collect()] == [2]
    for bad in ("b", None, "../x"):
        with pytest.raises(PublishRefused, match="may not write"):
            store.commit({"t": spark.createDataFrame([(bad, 1)], "part string, v int")}, ["a"])


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    store = St.Store(spark, str(tmp_path / "s"))
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, ts int")
    base = [(f"k{i}" if i else None, 0, 5) for i in range(200)] + [("hot", 0, i) for i in range(50)]
    St.upsert(store, "t", frame(base), ["k"], "ts", buckets=32)
    before, first = files(store.path, "t"), store.snapshot()
    updates = [("k3", 1, 5), ("k4", 1, 4), ("fresh", 1, 1), (None, 1, 9)]
    St.upsert(store, "t", frame(updates), ["k"], "ts")
    want = {k: v for k, v, _ in base} | {"k3": 1, "fresh": 1, None: 1}  # an equal clock goes to the update, an older one does not
    assert {r["k"]: r["v"] for r in store.read("t").collect()} == want
    assert before.items() <= files(store.path, "t").items()
    old, new = first.parts("t"), store.snapshot().parts("t")
    moved = [p for p in new if new[p] != old.get(p)]
    assert 1 <= len(moved) <= 4 and all(new[p] == old[p] for p in old if p not in moved)
    assert len(opened(store.read("t", moved, first))) <= 4 < len(before)


def plain_prune(rows, limit):
    keep = None
    for i, stamp in sorted(rows):
        if stamp is None or stamp.strip().lower() in ("", "none", "nan", "null", "<na>"):
            keep = i
            break
        if stamp == "garbage":
            raise PublishRefused
        if stamp >= limit:
            keep = i
            break
    return [r for r in sorted(rows) if keep is not None and r[0] >= keep]


@pytest.mark.parametrize("seed", range(6))
def test_prune_equals_a_walk_and_opens_the_border_only(spark, tmp_path, seed):
    rng = random.Random(seed)
    day = lambda n: f"2026-{1 + n // 28:02d}-{1 + n % 28:02d}"
    rows = [(i, day(i // 10)) for i in range(1000)]
    odd = {0: (), 1: ((507, ""),), 2: ((300, None), (900, "")), 3: ((400, day(99)),), 4: ((650, "garbage"),), 5: ((200, "garbage"),)}[seed]
    for i, s in odd:
        rows[i] = (i, s)
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "i int, s string").withColumn("part", F.format_string("p%03d", F.floor(F.col("i") / 50)))
    store = St.Store(spark, str(tmp_path / "s"))
    store.commit({"log": log}, zones=St.log_zones("i", "s"), notes={})
    before, limit = files(store.path, "log"), day(60)
    try:
        want = plain_prune(rows, limit)
    except PublishRefused:
        with pytest.raises(PublishRefused, match="unreadable"):
            St.prune(store, "log", "i", "s", limit, 0)
        assert store.snapshot().version == 1
        return
    done = St.prune(store, "log", "i", "s", limit, 0)
    assert sorted((r["i"], r["s"]) for r in store.read("log").collect()) == want
    assert len(done["read"]) <= 1 and len(done["rewritten"]) <= 1
    assert before.items() <= files(store.path, "log").items()
    assert St.prune(store, "log", "i", "s", limit, 0)["version"] == done["version"]  # nothing left to drop


def brute_root(rows, depth):
    """(identity, content) rows of one group as a tree, in plain Python."""
    net = lambda values: "".join("-" if v is None else f"{len(v)}:{v}" for v in values)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaf = {}
    for identity, content in rows:
        h = sha(net(content))
        at = leaf.setdefault(sha(net(identity))[:depth], {})
        at[h] = at.get(h, 0) + 1
    level = {p: sha(",".join(sorted(f"{h}*{n}" for h, n in of.items()))) for p, of in leaf.items()}
    for length in reversed(range(depth)):
        up = {}
        for p, d in level.items():
            up.setdefault(p[:length], []).append(f"{p}={d}")
        level = {p: sha(",".join(sorted(c))) for p, c in up.items()}
    return level[""]


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_roots_equal_plain_trees(spark, depth):
    rng = random.Random(depth)
    rows = [(rng.choice(["a", "b", None]), str(rng.randrange(50)), rng.choice(["x", "", None, "1:y"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, i string, v string")
    got = {r["g"]: (r["rows"], r["digest"]) for r in merkle.roots(df, ["g"], ["i", "v"], depth, ["i"]).collect()}
    for g in ("a", "b", None):
        mine = [((i,), (i, v)) for k, i, v in rows if k == g]
        assert got[g] == (len(mine), brute_root(mine, depth))
    moved = merkle.roots(df.repartition(3), ["g"], ["i", "v"], depth, ["i"])
    assert {r["g"]: (r["rows"], r["digest"]) for r in moved.collect()} == got


def test_one_changed_row_of_a_hot_group_is_found_in_one_part(spark, tmp_path):
    base = spark.range(30_000).selectExpr("if(id % 10 = 0, concat('k', id % 70), 'hot') AS g", "cast(id AS string) AS i", "concat('v', id % 7) AS v")
    after = base.withColumn("v", F.when(F.col("i") == "12345", "changed").otherwise(F.col("v")))
    depth = merkle.depth_for(base, ["g"], leaf_rows=200)
    assert depth == 2
    old, new = (merkle.tree(df, ["g"], ["i", "v"], depth, ["i"]) for df in (base, after))
    found = merkle.differing_leaves(old, new, ["g"]).collect()
    assert [(r["g"], r["rows_before"] == r["rows_after"] < 400) for r in found] == [("hot", True)]
    store = St.Store(spark, str(tmp_path / "s"))
    store.commit({"rows": after.withColumn("part", F.concat(F.lit("l"), merkle.leaf_of(["i"], depth)))})
    leaf = store.read("rows", [f"l{found[0]['prefix']}"])
    assert {r["i"] for r in leaf.join(base.filter("g = 'hot'"), ["g", "i", "v"], "left_anti").filter("g = 'hot'").collect()} == {"12345"}
    assert len(opened(leaf)) < len(opened(store.read("rows"))) / 100
    assert merkle.differing_leaves(old, old, ["g"]).count() == 0
    gone = merkle.tree(base.filter("g <> 'k10'"), ["g"], ["i", "v"], depth, ["i"])
    assert {(r["g"], r["rows_after"]) for r in merkle.differing_leaves(old, gone, ["g"]).collect()} == {("k10", 0)}


def test_trees_travel_as_bytes(spark, monkeypatch):
    written = []
    keep = merkle.cut_lineage
    monkeypatch.setattr(merkle, "cut_lineage", lambda df: (written.append(df), keep(df))[1])
    rows = [(g, str(i), "é" * i) for g in ("a", None) for i in range(40)] * 2
    old, new = (merkle.tree(spark.createDataFrame(r, "g string, i string, v string"), ["g"], ["i", "v"], 1, ["i"]) for r in (rows, rows[1:]))
    assert all(dict(df.dtypes)["digest"] == "binary" for df in written[:2])  # half of what hex takes
    assert {r["g"]: r["digest"] for r in old[0].collect()} == {g: brute_root([((i,), (i, v)) for k, i, v in rows if k == g], 1) for g in ("a", None)}
    leaf = [(r["g"], r["rows_before"] - r["rows_after"]) for r in merkle.differing_leaves(old, new, ["g"]).collect()]
    assert leaf == [("a", 1)]
