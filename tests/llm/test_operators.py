"""Operators against brute force on a given folder, and on rows with every odd case."""

import collections
import json
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from civicmill.llm import decontamination, html, licenses, lm_score, packing, quality, queries, sharding, simhash, topk, urls
from civicmill.llm.common import components
from tests.conftest import DATA

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, copies, repeated rows and ids, and clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The MIT License, one two three four five six.", "en", "a"),
        (1, "The MIT License, one two three four five six.", "en", "a"),
        (2, "The MIT License, one two three four five six.", "en", None),
        (None, None, None, None),
        (None, "the mit license one", "en", "a"),
        (3, "", "en", "b"),
        (4, None, "en", "b"),
        (5, " \t\n\x0b ", None, "b"),
        (6, long, "en", "a"),
        (7, long + " end", "en", "a"),
        (8, "Ärger ÉCOLE   naïve cc by CC-BY gnu general public license \U0001f600", "de", "a"),
        (9, "a", "de", "a"),
        (9, "b", "de", "a"),
    ]
    data = [(*r, None if r[1] is None else len(r[1]), "x", 7, "y", 1.5) for r in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, row_id string, f int, _id string, rank double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def given(spark):
    return [tuple(r) for r in queries.table(spark, DATA, "documents").select("doc_id", "text", "source").collect()]


def words(text):
    return (text or "").encode().lower().split()


# --- 1 sharding
def check_shards(rows, texts, n):
    assert collections.Counter((r["row_id"], r["text_crc32"]) for r in rows) == collections.Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in texts)
    assert all(r["size"] >= 16 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    sizes = [len(by[s]) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in by[s]) == list(range(len(by[s]))) for s in by)
    held = collections.Counter((r["shard"], r["stratum"]) for r in rows)
    for stratum, m in collections.Counter(r["stratum"] for r in rows).items():
        assert all(abs(held[s, stratum] - m / n) <= 2 for s in range(n))


def test_shards_hold_the_mixture(spark, given):
    rows = sharding.interleaved_shards(queries.table(spark, DATA, "documents"), 8).collect()
    check_shards(rows, given, 8)
    assert rows[0]["law"] == "rows"


def test_shards_of_odd_rows(odd, none):
    rows = sharding.interleaved_shards(odd, 4).collect()
    check_shards(rows, [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], 4)
    assert sharding.interleaved_shards(none, 4).collect() == []


# --- 2 top-k
def best(vectors, k):
    ints = {i: [math.floor(64 * float(x)) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in ints:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:k]
            for rank, (score, i) in enumerate(scored, 1):
                yield q, rank, i, -score


def test_top_k_equals_brute_force(spark):
    table = queries.table(spark, DATA, "embeddings")
    got = sorted(tuple(r) for r in queries.op2_topk(spark, DATA).collect())
    assert got == sorted(best([tuple(r) for r in table.select("vec_id", "embedding").collect()], 20))


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [1.0, 0.5]), (8, [-1.0, 0.01]), (9, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id bigint, embedding array<double>, a int, score double")
    got = sorted(tuple(r) for r in topk.exact_top_k(df, 3, F.col("vec_id") % 20 == 0).collect())
    assert got == sorted(best(rows, 3))
    assert topk.exact_top_k(df.filter("false"), 3, F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_never_lose_the_best():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 64))
    items = np.floor(64 * (base[rng.integers(0, 6, 3000)] + 0.05 * rng.normal(size=(3000, 64)))).astype(np.int64)
    q, ids = items[:40], np.arange(3000)
    a, b, score = topk.block_top_k(q, ids[:40], items, ids, 20)
    for i in range(40):
        s = items @ q[i]
        want = sorted((-int(s[j]), j) for j in range(3000) if j != i)[:20]
        assert [(-int(x), int(j)) for j, x in zip(b[a == i], score[a == i], strict=True)] == want


def test_top_k_sorts_few_pairs(monkeypatch):
    """Where the bounds rule nothing out, exact scores do: only about k pairs a query are sorted."""
    rng = np.random.default_rng(2)
    items = np.floor(8 * rng.normal(size=(4000, 64))).astype(np.int64)
    items[3000:] = items[0]  # many copies of one vector
    q, ids, longest, sort = items[:300], np.arange(4000), [], np.lexsort
    monkeypatch.setattr(topk.np, "lexsort", lambda keys: longest.append(len(keys[0])) or sort(keys))
    a, b, score = topk.block_top_k(q, ids[:300], items, ids, 20)
    assert max(longest) < 300 * 40
    for i in (0, 1, 299):
        s = items @ q[i]
        want = sorted((-int(s[j]), j) for j in range(4000) if j != i)[:20]
        assert [(-int(x), int(j)) for j, x in zip(b[a == i], score[a == i], strict=True)] == want


# --- 3 urls
def test_verdicts_propagate_over_aliases(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "https://shop.example.org/a?x=1#f", link.format("http://Bad.example.net/fr/x")),
        (2, "http://other.example.org/b", link.format("https://shop.example.org/a?x=1")),
        (3, "http://www.example.com/en/1", link.format("http://other.example.org/b")),
        (4, "http://x.example.com/en/1", "<p>"),
        (5, "http://far.example.org/", '<meta http-equiv="refresh" content="0; url=/there">'),
        (6, "http://far.example.org/there", None),
        (7, None, link.format("http://bad.example.net/fr/x")),
        (8, "no scheme", None),
        (9, "http://plain.example.org", '<!-- <link rel="canonical" href="http://bad.example.net/fr/x"> -->'),
        (4, "http://x.example.com/en/1", "<p>"),
        (10, "http://EXAMPLE.com", ""),
        (11, "http://c.example.org/", ""),
    ]
    pages = spark.createDataFrame([(*r, "n", True) for r in rows], "page_id bigint, url string, html string, node string, rule boolean")
    moved = spark.createDataFrame([("http://far.example.org/there", "http://c.example.org/"), (None, "http://c.example.org/")], "src string, dst string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["reason"]) for r in urls.judge_urls(pages, queries.RULES, moved).collect())
    assert got == sorted([
        (1, "shop.example.org", "/a", None, "block", "alias"),
        (2, "other.example.org", "/b", None, "block", "alias"),
        (3, "www.example.com", "/en/1", "www.example.com/en/", "allow", "rule"),
        (4, "x.example.com", "/en/1", "example.com/en/", "block", "rule"),
        (4, "x.example.com", "/en/1", "example.com/en/", "block", "rule"),
        (5, "far.example.org", "/", None, "allow", "default"),
        (6, "far.example.org", "/there", None, "allow", "default"),
        (7, "", "", None, "allow", "default"),
        (8, "", "", None, "allow", "default"),
        (9, "plain.example.org", "", None, "allow", "default"),
        (10, "example.com", "", None, "allow", "default"),
        (11, "c.example.org", "/", None, "allow", "default"),
    ])
    assert urls.judge_urls(pages.filter("false"), queries.RULES).collect() == []


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(1000, 1100)] + [(5, 5), (3, 2)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(j, 7) for j in range(1000, 1100)} | {(7, 7), (2, 2), (3, 2)}


# --- 4 decontamination
def leaks(docs, items, share=0.8):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    for d, text in docs:
        w = cut(text)
        for i, t in items:
            v = cut(t)
            if v:
                n = min(5, len(v))
                s = runs(v, n)
                if len(s & runs(w, n)) >= decontamination.shingles_needed(len(s), share):
                    yield d, i


def test_contained_items_equal_brute_force(spark, given):
    items = [tuple(r) for r in queries.table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, DATA).collect()}
    assert got == set(leaks([(d, t) for d, t, _ in given], items))


def test_contained_items_of_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(5, "One two three, four five SIX", 1), (6, "one two three four five six", 2), (7, "", 3), (8, None, 4), (None, "public license", 5), (9, "École naïve", 6)], "item_id bigint, text string, n int")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated_documents(odd, benchmark).collect()}
    assert got == {(1, 5), (2, 5), (8, None), (8, 9)}
    left = decontamination.without_contaminated(odd, benchmark)
    assert left.columns == odd.columns and left.count() == odd.count() - 4
    assert decontamination.contaminated_documents(none, benchmark).collect() == [] and decontamination.contaminated_documents(odd, benchmark.filter("false")).collect() == []


# --- 5 quality
def test_model_sums_to_one_and_matches_counts(spark):
    texts = spark.createDataFrame([("a b a c a b d b a",), ("b a c a b",), ("c d c d a b",)], "body string")
    model = quality.fit(texts)
    size = len(model.uni)
    for v, u in ((quality.START, quality.START), (model.ids["a"], model.ids["b"]), (model.ids["d"], model.ids["a"])):
        total = 0.0
        for w in range(size):
            ids = np.array([quality.START, quality.START, u, v, w])
            total += 10 ** model.log_probabilities(ids, np.array([True, False, False, False, False]))[-1]
        assert total == pytest.approx(1.0, abs=1e-6)


def test_joined_scores_equal_the_model_and_learn_from_all_trusted_text(spark, odd, monkeypatch):
    long = [(i, " ".join(f"w{(i * 31 + j * j) % 977}" for j in range(25_000)), 1, 0) for i in range(80)]
    rows = spark.createDataFrame(long, "doc_id bigint, text string, quality int, toxic int")
    seen = []
    whole = quality.fit_tables
    monkeypatch.setattr(quality, "fit_tables", lambda texts: seen.append(texts.agg(F.sum(F.length("body"))).first()[0]) or whole(texts))
    quality.classify(rows.select("doc_id", "text", F.lit("en").alias("lang")), rows.drop("text"), ["doc_id"])
    assert seen[0] > 0.6 * sum(len(r[1]) for r in long) > 3_500_000
    texts = odd.filter("doc_id in (1, 6, 8)").select(F.col("text").alias("body"))
    model = quality.fit(texts)
    for local in (0, 40):
        monkeypatch.setattr(quality, "LOCAL_RUNS", local)
        for r in quality.with_surprise(odd, whole(texts), ["text"]).collect():
            flat, fresh, n = quality.framed([r["text"]], model.ids)
            assert r["_s"]["n"] == n[0]
            assert r["_s"]["bits"] == pytest.approx(-model.log_probabilities(flat, fresh).sum() / np.log10(2), rel=1e-4)


def test_tasks_hold_few_words_as_text_and_code_few_texts_at_once(spark, odd, monkeypatch):
    texts = odd.filter("doc_id in (1, 6, 8)").select(F.col("text").alias("body")).unionByName(spark.createDataFrame([("naïve quark naïve quark the zebra the",), ("zebra the quark lone",)], "body string"))
    asked = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(90, "the zebra naïve quark lone the zebra"), (91, "unheard quark of " * 40)], "doc_id bigint, text string"))

    def scores(tables):
        rows = quality.with_surprise(asked, tables, ["doc_id", "text"]).collect()
        return sorted((str(r["doc_id"]), r["text"] or "", r["_s"]["n"], round(r["_s"]["bits"], 3)) for r in rows)

    whole = quality.fit_tables(texts)
    want = scores(whole)
    monkeypatch.setattr(quality, "LOCAL_WORDS", 4)
    few = quality.fit_tables(texts)
    assert len(few.ids.local) <= 4 < len(few.ids.digests) and few.ids.size == whole.ids.size
    words = [*whole.ids.local]
    assert len({few.ids[w] for w in words} - {quality.UNKNOWN}) == len(words) and few.ids["unheard"] == quality.UNKNOWN
    assert scores(few) == want
    monkeypatch.setattr(quality, "LETTERS_AT_ONCE", 30)
    column = pa.array(["a" * 10, None, "b" * 100, "", "c" * 10, "d" * 29])
    assert [(i, len(some)) for i, some in quality.parts(column)] == [(0, 2), (2, 1), (3, 2), (5, 1)]


def test_runs_of_large_vocabularies_are_counted_and_found():
    size, rng = 3_000_000, np.random.default_rng(1)
    u, v, w = rng.choice(np.array([1, 7, 2_999_999, 1_500_000]), (3, 500))
    want = collections.Counter(zip(u.tolist(), v.tolist(), w.tolist(), strict=True))
    got = quality.distinct_runs(u, v, w, size)
    assert {(a, b, c): n for a, b, c, n in zip(*(x.tolist() for x in got), strict=True)} == want
    rows = [(*k, -float(n)) for k, n in want.items()][::2]
    hot = quality.Runs.of(pd.DataFrame(rows, columns=["u", "v", "w", "p"]), size)
    at, found = hot(*got[:3])
    known = {r[:3]: r[3] for r in rows}
    assert found.sum() == len(rows) and all(hot.p[a] == known[k] for a, f, k in zip(at, found, zip(*(x.tolist() for x in got[:3]), strict=True), strict=True) if f)


def test_quality_separates_held_out_labels(spark):
    out = quality.classify(queries.table(spark, DATA.replace("sf0.001", "sf0.01"), "documents"), queries.table(spark, DATA.replace("sf0.001", "sf0.01"), "labels"), ["doc_id", "lang"])
    labels = queries.table(spark, DATA.replace("sf0.001", "sf0.01"), "labels")
    rate = {r["quality"]: r["k"] for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert rate[1] >= 0.99 and rate[0] <= 0.5


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (8, 1, 0), (None, 1, 0), (9, None, None)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(odd, labels, ["doc_id", "text"])
    assert out.count() == odd.count()
    assert quality.classify(odd, labels.filter("false"), ["doc_id"]).filter("keep").count() == odd.count()
    assert quality.classify(none, labels, ["doc_id"]).collect() == []


# --- 6 packing
def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    for i, t in texts:
        ids = vocabulary.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = np.array(ids[at : at + capacity], dtype="<u4")
            want[i, k, at, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert collections.Counter((r["row_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(k[3] * n for k, n in want.items()) / capacity


def test_packing_round_trip(spark, given):
    used, bound = check_packing(packing.best_fit_packing(queries.table(spark, DATA, "documents"), queries.tokenizer_path()).collect(), [g[:2] for g in given], 2048)
    assert used <= 1.05 * bound + 1


def test_packing_of_odd_rows(spark, odd, none):
    extra = odd.unionByName(spark.createDataFrame([(11, "a<|endoftext|>b \x1cx\x1fy 'Tis ΑΣ ǅ x̂", None, None, 1, "", 1, "", 1.0)], odd.schema))
    check_packing(packing.best_fit_packing(extra, queries.tokenizer_path(), 64).collect(), [(r["doc_id"], r["text"]) for r in extra.collect()], 64)
    assert packing.best_fit_packing(none, queries.tokenizer_path()).collect() == []


def one_by_one(counts, capacity):
    """Best fit, longest first, a piece at a time."""
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


def test_plan_uses_every_piece_and_fills_gaps_exactly():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = dict(collections.Counter(rng.integers(1, 101, 400).tolist()))
        plan = packing.plan_sequences(counts, 100)
        used = collections.Counter()
        for parts, n in plan:
            assert sum(parts) <= 100
            for p in parts:
                used[p] += n
        assert used == counts
        assert sum(n for _, n in plan) <= one_by_one(counts, 100) + 1
    assert sorted(packing.plan_sequences({60: 1, 30: 1, 10: 1, 70: 1}, 100)) == [((60, 30, 10), 1), ((70,), 1)] or sum(n for _, n in packing.plan_sequences({60: 1, 30: 1, 10: 1, 70: 1}, 100)) == 2


# --- 7 scores
def test_base_scores_equal_brute_force_and_the_tree_predicts_better(spark, given):
    got = {r["doc_id"]: r for r in queries.op7_lm_score(spark, DATA).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in given}
    tokens = {i: [*words(t), None] for i, t, _ in given}
    counts = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total, types = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t), rel=1e-9)
    assert sum(r["score"] - r["base_score"] for r in got.values() if r["held_out"]) > 0


def brute_tree_scores(tokens, held):
    """Scores by a suffix tree of plain dictionaries: nodes are tuples of words, the end before a text included."""
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    words = collections.Counter(w for t in train for w in t)
    unit = sum(words.values()) + len(words) + 1
    retained = {(): {w: (n + 1) / unit for w, n in words.items() if n >= lm_score.MIN_COUNT}}
    rest = {(): 0.0}  # share that a node leaves to its suffix, and its own suffix's share of the same symbols
    candidates = {(w,): n for w, n in words.items() if n >= lm_score.MIN_CONTEXT}
    length = 1
    while candidates:
        follow = collections.defaultdict(collections.Counter)
        for t in train:
            padded = [None] * length + t
            for i, w in enumerate(t):
                follow[tuple(padded[i : i + length])][w] += 1
        grown = {}
        for node, total in candidates.items():
            q = retained[node[1:]]
            listed = {w: n for w, n in follow[node].items() if n >= lm_score.MIN_COUNT}
            if not listed:
                continue
            left, before = max(1 - sum(listed.values()) / total, 0), max(1 - sum(q[w] for w in listed), 1e-12)
            each = sum(n / total * math.log(n / total / q[w]) for w, n in listed.items())
            if 2 * total * (each + (left * math.log(left / before) if left > 0 else 0)) > len(listed) + 3 * math.sqrt(2 * len(listed)) + 10:
                grown[node] = {w: (n + lm_score.SMOOTHING * q[w]) / (total + lm_score.SMOOTHING) for w, n in listed.items()}
                rest[node] = math.log10(max(1 - sum(grown[node].values()), 1e-12) / before)
        more = {(*x, w): n for x in candidates for w, n in follow[x].items() if w is not None and n >= lm_score.MIN_CONTEXT and (*x, w)[1:] in grown}
        retained |= grown
        candidates, length = more, length + 1

    def log_p(node, w):
        if w in retained[node]:
            return math.log10(retained[node][w])
        return log_p(node[1:], w) + rest[node] if node else math.log10((words[w] + 1) / unit)

    out = []
    for t in tokens:
        score = 0.0
        for i, w in enumerate(t):
            node = ()
            while len(node) <= i:
                longer = ((None, *t)[i - len(node)], *node)
                if longer not in retained:
                    break
                node = longer
            score += log_p(node, w)
        out.append(score)
    return out, max(map(len, retained)), len(retained)


@pytest.mark.parametrize(("local_words", "local_entries"), [(300_000, 1_000_000), (3, 5)])
def test_scores_equal_a_brute_force_tree_of_any_depth(spark, monkeypatch, local_words, local_entries):
    monkeypatch.setattr(lm_score, "LOCAL_WORDS", local_words)
    monkeypatch.setattr(lm_score, "LOCAL_ENTRIES", local_entries)
    rng = np.random.default_rng(3)
    chain = "a b c a b d a c b d d a".split()  # three words tell the next one
    texts = [(i, " ".join(chain[j % 12] if rng.random() < 0.95 else f"e{rng.integers(40)}" for j in range(int(rng.integers(1, 200))))) for i in range(120)]
    texts += [(200 + i, "same text of several copies with an end") for i in range(80)] + [(300, "x " * 400), (301, ""), (302, "never seen")]
    tokens, held = [[*words(t), None] for _, t in texts], [i % 10 == 0 for i, _ in texts]
    want, deep, many = brute_tree_scores(tokens, held)
    assert deep >= 3 and many > 20
    got = {r["doc_id"]: r for r in lm_score.score_documents(spark.createDataFrame(texts, "doc_id bigint, text string"), F.col("doc_id") % 10 == 0).collect()}
    for (i, _), w in zip(texts, want, strict=True):
        assert got[i]["score"] == pytest.approx(w, rel=1e-9)


def test_lists_and_rest_of_each_node_sum_to_one(spark):
    rng = np.random.default_rng(4)
    chain = "a b c a b d a c b d d a".split()
    texts = [(i, False, " ".join(chain[j % 12] if rng.random() < 0.9 else "e" for j in range(300))) for i in range(40)]
    coded = lm_score.encoded(spark.createDataFrame(texts, "doc_id bigint, held_out boolean, body string"), {w: k for k, w in enumerate([b"a", b"b", b"c", b"d", b"e"], 1)})
    words = spark.createDataFrame([(s, 3000, p) for s, p in enumerate((0.05, 0.3, 0.2, 0.15, 0.2, 0.05))], "symbol bigint, n bigint, p double")  # 0.05 is left for unseen ones
    before = words.select(F.lit(0).cast("bigint").alias("node"), "symbol", "p")
    total = collections.Counter(w for _, _, t in texts for w in t.split())
    total = [len(texts), *(total[w] for w in "abcde")]
    first = [(int(x), 0, s, total[s]) for s, x in enumerate((lm_score.spread(np.arange(6)) + lm_score.level(1)).view(np.int64))]
    nodes, pairs, _ = lm_score.grow(coded, spark.createDataFrame(first, "node bigint, parent bigint, oldest bigint, total bigint"), before, 1)
    p = {r["symbol"]: r["p"] for r in before.collect()}
    assert nodes.count() >= 4
    for r in nodes.collect():
        listed = {x["symbol"]: x["p"] for x in pairs.filter(F.col("node") == r["node"]).collect()}
        others = 1 - sum(p[s] for s in listed)
        assert sum(listed.values()) + 10 ** r["back_off"] * others == pytest.approx(1.0, abs=1e-9)


def test_contexts_grow_by_one_symbol():
    rng, wrap = np.random.default_rng(5), 1 << 64
    lengths = np.array([1, 3, 9, 2])
    ids = rng.integers(0, 50, lengths.sum())
    place = np.concatenate([np.arange(n) for n in lengths])
    codes, at, node = lm_score.spread(ids), np.arange(len(ids)), np.zeros(len(ids), dtype=np.uint64)
    for length in range(1, 6):
        at, node = at[at % 7 != length], node[at % 7 != length]  # only some places stay
        node = lm_score.one_longer(node, codes, place, at, length)
        for i, got in zip(at, node, strict=True):
            before = [int(codes[i - b]) if place[i] >= b else int(lm_score.END_CODE) for b in range(1, length + 1)]
            assert int(got) == (sum(c * pow(int(lm_score.STEP), b, wrap) for b, c in enumerate(before)) + int(lm_score.level(length))) % wrap


@pytest.mark.parametrize("many", [0, 1, 5, 5000])
def test_places_in_a_sorted_table(many):
    rng = np.random.default_rng(6)
    table = np.unique(np.concatenate([rng.integers(0, 1 << 64, many, dtype=np.uint64), rng.integers(0, 40, many, dtype=np.uint64)]))  # some crowd
    wanted = np.concatenate([table, rng.integers(0, 1 << 64, 300, dtype=np.uint64), np.arange(60, dtype=np.uint64), [np.uint64((1 << 64) - 1)]])
    at, found = lm_score.Lookup(table)(wanted)
    assert found.tolist() == np.isin(wanted, table).tolist()
    assert (table[at[found]] == wanted[found]).all()


def test_scores_of_odd_rows(odd, none):
    rows = lm_score.score_documents(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    assert lm_score.score_documents(none).collect() == []
    assert lm_score.score_documents(odd, F.lit(True)).filter("n_known > 0").count() == 0


# --- 8 html
def test_articles_of_the_given_pages(spark):
    from html import unescape

    want = {}
    for r in queries.table(spark, DATA, "pages").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())
    got = queries.op8_html(spark, DATA).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_varying_slots_are_content_without_an_article_element(spark):
    page = "<body><header>Site</header><div id=wrap><div class=top>Our great site since 1999</div><div class=txt><h2>{0} title</h2><p>{0} text &amp; more<p>shared line</div><div class=end>All of it here</div></div><div class='cookie-notice'>{0} cookies</div><section id=comments><p>{0} wow</section><form>{0}</form><footer>{0}</footer>"
    rows = [(i, f"http://h.org/{i}", page.format(f"n{i}")) for i in range(8)] + [(8, "http://h.org/8", ""), (9, None, None), (10, "http://one.org/", "<p>only <b>b</b>old<script>x</script></p>tail<!-- c -->")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(pages).collect()}
    assert got == {**{i: f"n{i} title n{i} text & more shared line" for i in range(8)}, 8: "", 9: "", 10: "only bold tail"}
    assert html.extract_main_text(pages.filter("false")).collect() == []


def test_simple_tree_matching_is_the_largest():
    a = ["r", 0, 0, False, 0, [["p", 1, 0, False, 1, []], ["q", 2, 0, False, 2, [["s", 3, 0, False, 3, []]]], ["p", 4, 0, False, 4, []]]]
    b = ["r", 0, 0, False, 0, [["q", 2, 0, False, 1, [["s", 3, 0, False, 2, []]]], ["p", 9, 0, False, 3, []], ["p", 9, 0, False, 4, []]]]
    size, pairs = html.match(a, b)
    assert size == 4 and len(pairs) == 4
    assert html.main_text("<div>" * 3000 + "deep<p>x</p>" + "</div>" * 3000 + "<p>after", None) == "deep x after"
    json.loads(html.induce(["<p>a", "<p>b"]))


# --- 9 licenses
def check_base(rows, texts):
    for r, text in zip(rows, texts, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None)), text
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | set() and 0 <= r["score"] <= 1


def test_base_labels_equal_brute_force(spark, odd, none):
    for df in (queries.table(spark, DATA, "documents"), odd):
        keyed = df.select(F.concat_ws("|", "doc_id", "text").alias("doc_id"), "text")
        texts = {r["doc_id"]: r["text"] for r in keyed.collect()}
        rows = licenses.scan_licenses(keyed).collect()
        assert len(rows) == df.count()
        check_base(rows, [texts[r["doc_id"]] for r in rows])
    assert licenses.scan_licenses(none).collect() == []


def resolve(text, rules):
    """The rules one by one, then every span against every other."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(ASCII))
    line = " " + " ".join(w) + " "
    spans = set()
    for r in rules:
        for m in re.finditer(f" ({r.pattern})(?= )", line):
            start = line[: m.start()].count(" ")
            spans.add((start, start + len(m[1].split()), r.priority, r.label))
    inside = lambda s, t: t[0] <= s[0] and s[1] <= t[1] and t[2] <= s[2] and (t[0], t[1], t[2], t[3]) != s and ((t[0], -t[1], t[2], t[3]) < (s[0], -s[1], s[2], s[3]))
    kept = [s for s in spans if not any(inside(s, t) for t in spans)]
    return {s[3] for s in kept}, len({i for s in kept for i in range(s[0], s[1])}) / len(w)


def test_detections_are_suppressed_inside_stronger_ones(spark):
    rules = licenses.signatures()
    assert 150 <= len(rules) <= 600 and len({r.keyword for r in rules}) > 20
    texts = [
        "Licensed under the Apache License, Version 2.0; see GNU GPL v3 or later, and the MIT License",
        "CC BY-NC-SA 4.0 and CC BY 4.0. Redistribution and use in source and binary forms, with or without modification, are permitted",
        "GNU General Public License version 3 of the License, or (at your option) any later version. All rights reserved.",
        "SPDX-License-Identifier: MIT. Dedicated to the public domain. Mozilla Public License 2.0 MPL 2.0 cc0",
        "the licensee has no general license",
    ]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        labels, score = resolve(text, rules)
        assert set(filter(None, r["labels"].split(","))) == labels | set(filter(None, r["base_labels"].split(",")))
        assert r["score"] == pytest.approx(score)


# --- 10 SimHash
def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, radius=4):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    arr = sorted(prints)
    for i, a in enumerate(arr):
        for b in arr[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in prints}


def check_groups(rows, texts):
    prints = collections.defaultdict(list)
    for i, t in texts:
        prints[brute_fingerprint(t)].append(i)
    roots = grouped(set(prints))
    low = {}
    for f, ids in prints.items():
        known = [i for i in ids if i is not None]
        low[roots[f]] = min([*known, *([low[roots[f]]] if low.get(roots[f]) is not None else [])], default=None)
    want = collections.Counter((i, f, low[roots[f]]) for f, ids in prints.items() for i in ids)
    assert collections.Counter((r["row_id"], r["f"][0] % (1 << 64), r["component_id"]) for r in rows) == want


def test_groups_equal_brute_force(spark, given, odd, none):
    check_groups(simhash.near_groups(queries.table(spark, DATA, "documents")).collect(), [g[:2] for g in given])
    check_groups(simhash.near_groups(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.near_groups(none).collect() == []


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(4)
    rng = np.random.default_rng(4)
    assert len(masks) == 31
    for _ in range(5000):
        difference = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(difference & m == 0 for m in masks)


def test_hot_buckets_lose_no_link(spark):
    """Hundreds of words around one centre fill the buckets of every mask; components still are exact."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre}
    while len(prints) < 700:
        prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)))
    df = spark.createDataFrame([(0, simhash.signed(p)) for p in prints], "j smallint, fp bigint")
    got = {r["node"]: r["component"] for r in components(simhash.near_edges(df, 4).select("src", "dst")).collect()}
    want = grouped(prints)
    classes = lambda m: sorted(sorted(v) for v in collections.Counter() | _invert(m))
    assert classes({p: got.get(simhash.signed(p), simhash.signed(p)) for p in prints}) == classes(want)


def _invert(mapping):
    out = collections.defaultdict(list)
    for k, v in mapping.items():
        out[v].append(k)
    return {tuple(v): 1 for v in out.values()}


def test_one_row_of_each_group_stays(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = collections.Counter(r["text"] if r["text"] and r["text"].strip() else "" for r in rows)
    assert max(texts.values()) == 1 and sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 3, 6, 8, 9, 9]
    near = "the quick brown fox " + " ".join(f"w{i}x{i * 7 % 31}" for i in range(200))
    changed = near.replace("w100x18 ", "other ").replace("w50x9 ", "")
    df = spark.createDataFrame([(3, near), (2, changed), (5, "something else " + " ".join(f"v{i}" for i in range(150)))], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [2, 5]


def test_near_duplicates_are_verified_by_five_word_shingles(spark, given):
    """Proposed pairs below 0.8 are no duplicates, alone or in a bucket of hundreds; those above all are."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]

    def changed(words, k, tag):
        out = list(words)
        for n, i in enumerate(rng.choice(len(out), k, replace=False)):
            out[i] = f"{tag}x{n}"
        return out

    texts = {i: changed(base, int(rng.integers(1, 26)), f"t{i}") for i in range(0, 300)}
    apart = [f"v{i}" for i in rng.integers(0, 5000, 400)]
    texts |= {1000 + i: changed(apart, 6, f"a{i}") for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    sets = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, w in texts.items()}
    roots = {i: i for i in texts}

    def top(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                roots[max(top(a), top(b))] = min(top(a), top(b))
    want = {top(i) for i in texts}
    got = {r["doc_id"] for r in simhash.keep_one(df).select("doc_id").collect()}
    assert len(want) > 50 and want <= got and len(got - want) <= 0.02 * len(texts)


def test_pipeline_stages_keep_their_columns(spark):
    import corpus_pipeline

    folder = DATA.replace("sf0.001", "sf0.01")
    docs = queries.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        docs = corpus_pipeline.cut_lineage(out)
    assert 0.5 * 1000 < docs.count() < 1000
