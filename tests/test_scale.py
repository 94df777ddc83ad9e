"""Order-dependent and candidate-based operators against brute force, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.operators import calendar as O
from civicmill.operators import labels as L
from civicmill.operators import rates as R
from civicmill.operators import similarity as Sim
from civicmill.operators import votes as V
from civicmill.session import scratch_path, shared_dir
from civicmill.sources import writers as Wr


def test_running_equals_plain_window_under_skew(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.choice([None, 1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {r["t"]: (r["s"], r["m"], r["p"]) for r in scale.running(df, ["k"], ["t"], rows=150, sums={"s": F.coalesce("v", F.lit(0))}, maxima={"m": F.col("v")}, lags={"p": F.col("v")}).collect()}
    state = {}
    for k, t, v in rows:
        s, m, p = state.get(k, (0, None, None))
        assert got[t] == (s + (v or 0), m, p), (k, t)
        state[k] = (s + (v or 0), m if v is None else v if m is None else max(m, v), v)


def test_buckets_cut_inside_one_key_and_one_day(spark):
    """Nine rows in ten share one key and one day; no bucket may hold much more than its stated rows."""
    df = spark.range(40_000).selectExpr("if(id % 10 = 0, concat('k', id % 70), 'hot') AS k", "if(id % 10 = 1, date'2026-01-02', date'2026-01-01') AS day", "id")
    cut = scale.bucketed(df, ["k"], ["day", "id"], "b", rows=2_000)
    sizes = [r["count"] for r in cut.groupBy("b").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 4_000
    ends = cut.groupBy("b").agg(F.min(F.struct("k", "day", "id")).alias("lo"), F.max(F.struct("k", "day", "id")).alias("hi")).orderBy("b").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:], strict=False))
    numbered = scale.row_numbers(df, ["k"], ["day", "id"], "n", rows=2_000)
    hot = numbered.filter("k = 'hot'").agg(F.count("n"), F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(hot) == (36_000, 1, 36_000, 36_000)


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(200)], "k string, t int")
    assert sorted(r["n"] for r in scale.row_numbers(df, ["k"], ["t"], "n", rows=30).collect()) == list(range(1, 201))


def test_scratch_needs_a_shared_folder_off_local_masters():
    class Context:
        master = "yarn"
        applicationId = "app"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared"}
    assert scratch_path(Session(), "t").startswith("hdfs://shared/civicmill-app/t-")


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("x", 1), ("x", 2)], "k string, v int")
    c = spark.createDataFrame([("x", 2), ("x", 1), ("x", 1)], "k string, v int")
    d = lambda df: tuple(df.agg(*scale.multiset_digest("k", "v")).first())
    assert d(a) == d(b) != d(c)


def test_similar_titles_find_every_pair(spark):
    rng = random.Random(5)
    words = ["tax", "court", "school", "bill", "road", "land", "water", "fee"]
    titles = sorted({" ".join(rng.sample(words, rng.randrange(1, 6))) for _ in range(60)})
    df = spark.createDataFrame([("s", "h", t) for t in titles], "session string, head string, title string")
    got = {(r["title"], r["title_b"]) for r in Sim.similar_titles(df, 0.6).collect()}
    sets = {t: set(t.split()) for t in titles}
    want = {(a, b) for a in titles for b in titles if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 or a == b}
    assert got == want


def test_nearest_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    items = {i: set(rng.sample(vocab, 6)) | {"everywhere"} for i in range(80)}
    items[80] = items[0]
    queries = {1000 + i: set(rng.sample(vocab, 6)) | {"everywhere"} for i in range(40)} | {3: items[3], 0: items[0]}
    flat = lambda d: [(k, w) for k, ws in d.items() for w in ws]
    for least in (0.2, 0.5):
        found = Sim.nearest(spark.createDataFrame(flat(queries), "key int, tok string"), spark.createDataFrame(flat(items), "item int, tok string"), least)
        got = {r["key"]: (r["item"], round(r["similarity"], 9)) for r in found.collect()}
        want = {}
        for q, qs in queries.items():
            scored = sorted((-len(qs & ws) / len(qs | ws), i) for i, ws in items.items() if i != q)
            if -scored[0][0] >= least:
                want[q] = (scored[0][1], round(-scored[0][0], 9))
        assert got == want


def test_nearest_has_no_cap_on_common_tokens(spark):
    """A token in 2,000 items, more than any list length of old, still finds its neighbour."""
    items = spark.range(2_000).selectExpr("cast(id AS int) AS item", "explode(array('common', concat('own', id))) AS tok")
    one = spark.createDataFrame([(-1, "common"), (-1, "own1500")], "key int, tok string")
    assert [tuple(r) for r in Sim.nearest(one, items, 0.5).collect()] == [(-1, 1500, 1.0)]
    alone = spark.createDataFrame([(-1, "common")], "key int, tok string")
    assert [tuple(r) for r in Sim.nearest(alone, items, 0.5).collect()] == [(-1, 0, 0.5)]


def test_span_merge_equals_brute_force(spark):
    rng = random.Random(11)
    spans = sorted((s, s + rng.randrange(1, 40)) for s in (rng.randrange(0, 20000) for _ in range(300)))
    at = lambda m: f"2026-01-01 00:00:00 + {m}"
    df = spark.createDataFrame(spans, "a int, b int").select(*[(F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col(c))).alias(n) for c, n in (("a", "start"), ("b", "end"))])
    base = df.select(F.unix_timestamp(F.lit("2026-01-01").cast("timestamp"))).first()[0]
    got = sorted((r[0], r[1]) for r in O.merge_spans(df).select(((F.unix_timestamp("start") - base) / 60).cast("int"), ((F.unix_timestamp("end") - base) / 60).cast("int")).collect())
    want = []
    for s, e in spans:
        if want and s <= want[-1][1]:
            want[-1] = (want[-1][0], max(e, want[-1][1]))
        else:
            want.append((s, e))
    assert got == want, at(0)


def test_naive_bayes_equals_full_scoring(spark):
    import math
    rng = random.Random(13)
    words, labels = ["tax", "gun", "road", "school", "water"], ["A", "B", "C", "D"]
    train = [(" ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.choice(labels)) for _ in range(60)]
    heads = [(" ".join(rng.choices(words + ["unseen"], k=n)),) for n in (1, 2, 3, 4) for _ in range(4)]
    got = {r["h"]: (r["label"], round(r["margin"], 9)) for r in L.naive_bayes(spark.createDataFrame(heads, "h string"), spark.createDataFrame(train, "h string, label string")).collect()}
    cnt, tot, prior = {}, {}, {}
    for h, l in train:
        prior[l] = prior.get(l, 0) + 1
        for w in h.split():
            cnt[l, w] = cnt.get((l, w), 0) + 1
            tot[l] = tot.get(l, 0) + 1
    size = len({w for _, w in cnt})
    for (h,) in heads:
        sc = sorted(((sum(math.log((cnt.get((s, w), 0) + 0.1) / (tot.get(s, 0) + 0.1 * size)) for w in h.split()) + math.log(prior[s] / len(train)), s) for s in prior), reverse=True)
        assert got[h] == (sc[0][1], round(min(sc[0][0] - sc[1][0], 6.0), 9))


def test_peer_agreement_equals_brute_force(spark):
    rng = random.Random(17)
    votes = [(f"r{r}", f"m{m}", rng.random() < 0.5) for r in range(200) for m in range(9) if rng.random() < 0.8]
    grp = {f"m{m}": m % 2 for m in range(9)}
    got = {r["member"]: r["agreement"] for r in V.peer_agreement(spark.createDataFrame(votes, "vote_id string, member string, yes boolean"), spark.createDataFrame(list(grp.items()), "member string, grp int")).collect()}
    by = {}
    for r, m, y in votes:
        by.setdefault(r, {})[m] = y
    contested = {r: v for r, v in by.items() if sum(v.values()) >= 3 and len(v) - sum(v.values()) >= 3}
    for a in grp:
        shares = []
        for b in grp:
            if a != b and grp[a] == grp[b]:
                both = [v for v in contested.values() if a in v and b in v]
                if len(both) >= 10:
                    shares.append(sum(v[a] == v[b] for v in both) / len(both))
        assert got[a] == pytest.approx(sum(shares) / len(shares), abs=1e-6)


def test_permutation_null_separates_signal_from_noise(spark):
    rng = random.Random(19)
    rows = [("signal", f"b{i % 4}", int(rng.random() < (0.9 if i % 4 == 0 else 0.3))) for i in range(800)] + [("noise", f"b{i % 4}", int(rng.random() < 0.5)) for i in range(800)]
    got = {r["pool"]: r["p"] for r in R.permutation_null(spark.createDataFrame(rows, "pool string, k string, y int"), "pool", "k").collect()}
    assert got["signal"] == 0.0 and got["noise"] > 0.01


def test_prune_aborts_on_drift(spark):
    log = lambda stamps: spark.createDataFrame(list(enumerate(stamps)), "i int, s string")
    keep = lambda stamps: [r["i"] for r in Wr.prune(log(stamps), "i", "s", "2026-03-01", 30).orderBy("i").collect()]
    assert keep(["2026-01-01T00:00:00Z", "2026-02-20T00:00:00Z", "2026-01-02T00:00:00Z"]) == [1, 2]
    assert keep(["2026-01-01", "", "2026-01-02"]) == [1, 2]
    with pytest.raises(Wr.PublishRefused):
        keep(["2026-01-01", "garbage", "2026-02-20"])


def test_publish_keeps_last_good(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    guard = {"positive": F.min("v") > 0}
    assert Wr.publish(df, str(tmp_path / "t"), guard) == 1
    for bad in (df.limit(0), df.withColumn("v", -F.col("v"))):
        with pytest.raises(Wr.PublishRefused):
            Wr.publish(bad, str(tmp_path / "t"), guard)
    assert Wr.current_version(spark, str(tmp_path / "t")).count() == 2


def test_climb_handles_cycles_and_depth(spark):
    chain = [(f"n{i}", f"n{i + 1}", None) for i in range(20)] + [("n20", None, "TOP"), ("x", "y", None), ("y", "x", None)]
    got = {r["id"]: r["value"] for r in V.climb(spark.createDataFrame(chain, "id string, parent string, value string")).collect()}
    assert got["n0"] == "TOP" and got["n20"] == "TOP" and got["x"] is None
    deep = [(f"n{i}", f"n{i + 1}", None) for i in range(200)] + [("n200", None, "TOP"), ("x", "y", None), ("y", "x", None), ("z", "x", None)]
    nodes = spark.createDataFrame(deep, "id string, parent string, value string")
    got = {r["id"]: r["value"] for r in V.climb(nodes).collect()}
    assert len(got) == 204 and all((v == "TOP") == k.startswith("n") for k, v in got.items())
    roots = {r["id"]: r["root"] for r in V.root_of(nodes).collect()}
    assert all(v == ("n200" if k.startswith("n") else None) for k, v in roots.items())


def test_relative_chain_of_any_length(spark):
    chain = [("d", "m0", 600, None, 0)] + [("d", f"m{i}", None, f"m{i - 1}", i % 2) for i in range(1, 90)] + [("d", "a", None, "b", 1), ("d", "b", None, "a", 1), ("d", "c", None, "gone", 1)]
    got = {r["name"]: (r["minutes"], r["time_class"]) for r in O.relative_chain(spark.createDataFrame(chain, "date string, name string, minutes int, anchor string, offset int")).collect()}
    assert all(got[f"m{i}"] == (600 + i, "resolved") for i in range(90))
    assert all(got[k] == (None, "relative_unresolved") for k in "abc")


def test_two_tiers_step_down_then_up(spark):
    rows = [(3.5 - 0.01 * i, i < 60 or i % 2 == 0) for i in range(120)]
    s = spark.createDataFrame(rows, "conf double, ok boolean")
    got = {r["tier"]: r["cutoff"] for r in L.two_tier_cutoffs(s, s, 3.2).collect()}
    assert got["A"] is not None and (got["B"] is None or got["B"] < got["A"])


def test_linkage_of_many_copies(spark):
    """One bill and day with thousands of equal rows on both sides stays one comparison."""
    rows = spark.range(3000).selectExpr("id AS row_id", "'HB1' AS bill", "'2026-01-05' AS date", "'H' AS chamber", "'Reported from Finance' AS outcome")
    events = spark.range(3000).selectExpr("id + 10 AS event_id", "'HB1' AS bill", "'2026-01-05' AS date", "'H' AS chamber", "'H1' AS event_code", "'finance report' AS description", "'2026-01-05T09:00:00' AS event_date")
    got = O.linkage(rows, events).groupBy("linkage", "matched", "overlap", "best_event").count().collect()
    assert [tuple(r) for r in got] == [("B", 3000, 1, 10, 3000)]


def test_run_counts_equal_a_walk_across_buckets(spark):
    rng = random.Random(23)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.choice([None, "a", "a", "a", "b"])) for i in range(2000)]
    want, last = {}, {}
    for k, _, v in rows:
        if k not in last or last[k] != v:
            want[k] = want.get(k, 0) + 1
        last[k] = v
    df = spark.createDataFrame(rows, "k string, t int, v string")
    for size in (100, 10_000):
        assert {r["k"]: r["n"] for r in scale.run_counts(df, ["k"], ["t"], "v", "n", rows=size).collect()} == want
