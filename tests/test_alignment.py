"""Patience alignment by joins against a plain recursion."""

import difflib
import random

import pytest

from civicmill.functions import text as T
from civicmill.operators import alignment as A
from civicmill.operators import similarity as Sim
from civicmill.plans.standins import Tables
from tests.conftest import DATA


def plain(a, b):
    """Words aligned: equal ends, then words once on either side, as many as rise (by a quadratic search), then the gaps."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    once = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not once:
        return head + tail
    rank = []
    for k, (_, j) in enumerate(once):
        rank.append(1 + max((rank[m] for m in range(k) if once[m][1] < j), default=0))
    chain, need, below = [], max(rank), len(b)
    for k in range(len(once) - 1, -1, -1):
        if rank[k] == need and once[k][1] < below:
            chain.append(once[k])
            need, below = need - 1, once[k][1]
    chain = [(-1, -1), *chain[::-1], (len(a), len(b))]
    gaps = sum(plain(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(chain, chain[1:], strict=False))
    return head + tail + len(chain) - 2 + gaps


def test_random_pairs_equal_the_plain_recursion(spark):
    rng = random.Random(1)
    pairs = []
    for n in (0, 1, 2, 5, 30, 200):
        for words in (2, 12, 400):
            a = [f"w{rng.randrange(words)}" for _ in range(n)]
            b = list(a)
            for _ in range(rng.randrange(1 + n // 4)):
                i, j = sorted((rng.randrange(len(b) + 1), rng.randrange(len(b) + 1)))
                b = rng.choice([b[:i] + b[j:], b[:i] + [f"w{rng.randrange(words)}"] + b[i:], b[i:] + b[:i]])
            pairs += [(a, b), (b, a), (a, a)]
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)] + [(-1, None, "x"), (-2, "x", None), (-3, "", "x"), (-4, "  ", " ")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r["i"]: (r["words_a"], r["words_b"], r["aligned"]) for r in A.aligned_words(df, "a", "b").collect()}
    want = {i: (len(a), len(b), plain(a, b)) for i, (a, b) in enumerate(pairs)}
    assert got == want | {-1: (None,) * 3, -2: (None,) * 3, -3: (0, 1, 0), -4: (0, 0, 0)}
    pct = {r["i"]: r["pct"] for r in A.difference_pct(df.filter("i < 0 OR i = 2"), "a", "b").collect()}
    assert pct == {-1: None, -2: None, -3: None, -4: None, 2: None}


def test_all_version_pairs_equal_the_plain_recursion(spark):
    t = Tables(spark, DATA)
    p = Sim.version_pairs(t.versions).withColumn("a", T.normalize_text("text_a")).withColumn("b", T.normalize_text("text_b"))
    rows = A.aligned_words(p.select("bill", "kind", "from_label", "to_label", "a", "b"), "a", "b").collect()
    assert rows
    for r in rows:
        assert r["aligned"] == plain(r["a"].split(), r["b"].split())


def test_a_long_pair_finishes(spark):
    rng = random.Random(2)
    a = [f"w{rng.randrange(6000)}" for _ in range(20_000)]
    b = [w if rng.random() < 0.95 else "new" for w in a]
    b = b[5000:9000] + b[:5000] + b[9000:]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    pct = A.difference_pct(df, "a", "b").first()["pct"]
    kept = sum(m.size for m in difflib.SequenceMatcher(None, a[:5000] + a[9000:], b[4000:], autojunk=False).get_matching_blocks())
    assert pct == pytest.approx((1 - 2 * kept / 40_000) * 100, abs=2.0)


def test_rising_is_longest():
    rng = random.Random(3)
    for _ in range(300):
        places = rng.sample(range(40), rng.randrange(12))
        best = [1] * len(places)
        for k in range(len(places)):
            best[k] = 1 + max((best[m] for m in range(k) if places[m] < places[k]), default=0)
        got = [places[i] for i in A.rising(places)]
        assert got == sorted(got) and len(got) == max(best, default=0)


def test_rounds_shuffle_nothing(spark, monkeypatch):
    written = []
    keep = A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: (written.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    a = [f"w{i}" for i in range(200)]
    b = [w for w in a[:90] + a[100:60:-1] + a[100:] if w != "w7"]
    rows = [(" ".join(a), " ".join(b)), ("x a b x", "y b a x")]
    got = [r["aligned"] for r in A.aligned_words(spark.createDataFrame(rows, "a string, b string"), "a", "b").orderBy("words_a").collect()]
    assert got == [plain(x.split(), y.split()) for x, y in reversed(rows)]
    assert len(written) > 2
    assert sum("Exchange" in p for p in written) == 1  # equal pairs meet once, before the rounds
