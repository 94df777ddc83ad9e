"""Steps that must not grow faster than their input: fewer shuffles, no copies, the same rows."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from civicmill.functions import text as T
from civicmill.operators import diffs as G
from civicmill.operators import labels as L
from civicmill.operators import recompute as Re
from civicmill.operators import similarity as Sim
from civicmill.plans.standins import Tables
from civicmill.sources.store import Store
from tests.conftest import DATA
from tests.test_plans import formatted


def test_only_text_that_the_normal_form_changes_reaches_python(spark):
    same = re.compile(f"[{re.sub(r'x{([0-9A-F]+)}', lambda m: 'U' + m[1].zfill(8), T.UNCHANGED)}]")
    stays = [chr(c) for c in range(0x110000) if same.match(chr(c))]
    joined = {c for d in (unicodedata.decomposition(chr(x)) for x in range(0x110000)) if d and "<" not in d for c in (chr(int(p, 16)) for p in d.split()[1:])}
    assert len(stays) > 30_000 and not joined & set(stays)
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stays)
    texts = ["plain", "Élan für Bäume, ½", "Élan für Bäume", "Café", "ﬁn", "日本語", "한국어 Жук", "a b", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", T.normalize_text("t").alias("n")).collect()}
    assert got == {0: "plain", 1: "élan für bäume 1 2", 2: "élan für bäume", 3: "café", 4: "fin", 5: "日本語", 6: "한국어 жук", 7: "a b", 8: "", 9: ""}
    assert r"\x{4E00}" in formatted(df.select(T.normalize_text("t")))


def test_shingles_are_hashed_without_strings(spark):
    texts = ["", "a", "a b c", "a b c d e f g h", "a b c d e f g h i", "a b " * 20, "b a " * 20, "a b c d e f g i", "a b a b a b a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert "array_join" not in formatted(df.select(T.shingle_hashes("t", 8)))
    rows = {r.i: (set(r.s), r.h) for r in df.select("i", T.shingles("t", 8).alias("s"), T.shingle_hashes("t", 8).alias("h")).collect()}
    assert all(len(h) == len(set(h)) for _, h in rows.values())
    assert all(len(rows[i][0] & rows[j][0]) == len(set(rows[i][1]) & set(rows[j][1])) for i in rows for j in rows)


@pytest.mark.parametrize("frequent", [100_000, 3, 0])
def test_rarest_tokens_whatever_is_looked_up(spark, monkeypatch, frequent):
    monkeypatch.setattr(Sim, "FREQUENT_TOKENS", frequent)
    texts = [(1, "apple pear apple fig the"), (2, "apple pear plum"), (2, "apple kiwi"), (None, "pear lime"), (4, None), (5, "of the"), (6, "apple pear fig plum")]
    docs = spark.createDataFrame(texts, "k long, t string")
    out = Sim.rarest_tokens(docs, "k", "t", 2)
    if frequent > 10:
        assert "SortMergeJoin" not in formatted(out)  # tokens are not shuffled to meet their counts
    assert sorted(map(str, out.collect())) == sorted(f"Row(k={k}, tok='{t}', df={n})" for k, t, n in [
        (1, "apple", 4), (1, "fig", 2), (2, "kiwi", 1), (2, "plum", 2), (None, "lime", 1), (None, "pear", 4), (6, "fig", 2), (6, "plum", 2)])


def test_rarest_tokens_leave_common_ones_unsorted(spark, monkeypatch):
    """Documents with enough rarer tokens sort none of the common ones; the others, and repeated keys, keep all."""
    monkeypatch.setattr(Sim, "COMMON_TOKENS", 20, raising=False)
    word = lambda i: "w" + "".join(chr(97 + int(d)) for d in f"{i:03d}")
    common = [word(i) for i in range(20)]
    docs = [(i % 90, " ".join([*common, word(100 + i), word(101 + i), word(102 + i // 2)])) for i in range(100)]
    docs += [(200, " ".join(common[3:9])), (201, f"{common[0]} {word(100)}"), (None, " ".join([*common, word(100), word(300)])), (202, None)]
    sorted_rows, top_k = [], Sim.scale.top_k
    monkeypatch.setattr(Sim.scale, "top_k", lambda df, *a: sorted_rows.append(df.count()) or top_k(df, *a))
    got = Sim.rarest_tokens(spark.createDataFrame(docs, "k long, t string"), "k", "t", 2).collect()
    sets = [(k, set((t or "").split())) for k, t in docs]
    df = {w: sum(w in s for _, s in sets) for w in set().union(*(s for _, s in sets))}
    want = [(k, w, n) for k in {k for k, _ in sets} for n, w in sorted((df[w], w) for j, s in sets if j == k for w in s)[:2]]
    assert sorted(map(str, got)) == sorted(f"Row(k={k}, tok='{w}', df={n})" for k, w, n in want)
    assert sorted_rows[0] < 400


def test_history_diff_is_one_aggregation(spark):
    schema = "bill string, date string, refid string, action string, seq string"
    old = spark.createDataFrame([("a", "d", "r", "x", "1"), ("a", "d", "r", "y", "2"), ("a", "d", "", "gone", "1"), ("b", "d", None, "same", "1"), ("b", "d", None, "same", "1")], schema)
    new = spark.createDataFrame([("a", "d", "r", "z", "3"), ("a", "d", "r", "x", "1"), ("b", "d", " ", "same ", "9"), ("c", None, "r", None, "1")], schema)
    out = G.diff_history(old, new)
    assert "Join" not in formatted(out)
    assert sorted(map(tuple, out.collect())) == [("history_added", "c", "", "r", "", ""), ("history_edited", "a", "d", "r", "y", "z"), ("history_removed", "a", "d", "", "gone", "")]


def test_views_ask_for_methods_that_are_compiled(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    Tables(spark, DATA)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_a_run_writes_results_and_digests_once(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(Re, "cut_lineage", lambda df: written.append(df.columns) or df.localCheckpoint())
    rows = lambda v: spark.createDataFrame([(k, i, v if k == 3 else 0) for k in (1, 2, 3, None) for i in range(3)], "k int, i int, v int")
    compute = lambda df: df.groupBy("k").agg(F.sum("v").alias("s"))
    store = Store(spark, str(tmp_path))
    first = Re.recompute(store, rows(1), "k", ["i", "v"], compute, buckets=4)
    assert written == [] and (first.full, first.changed) == ("first run", 4)
    assert all(len(r.digest) == 24 for r in store.read(Re.DIGESTS).collect())
    second = Re.recompute(store, rows(2), "k", ["i", "v"], compute, buckets=4)
    assert (second.full, second.changed) == ("", 1)
    assert sorted((str(r.k), r.s) for r in store.read(Re.RESULTS).collect()) == [("1", 0), ("2", 0), ("3", 6), ("None", 0)]


def test_self_training_finds_similar_records_once(spark, monkeypatch):
    """Rounds only pick among the similar records found before them; the result is that of rounds computed anew."""
    rows, titles, texts = [], [], []
    for i in range(60):
        h = ["solar panels", "school boards", "motor vehicle", "city library", ""][i % 5]
        rows.append((i, "s", h, f"{h} act {i % 7}" if h else None, ["a", "b", None][i % 3]))
        titles += [(i, w) for w in (*h.split(), f"act{i % 7}")]
        texts += [(i, f"t{i % 9}"), (i, f"t{i % 4}"), (i, f"u{i // 6}"), (i, f"u{i // 3}")]
    records = spark.createDataFrame(rows, "key bigint, session string, h string, nt string, cm string")
    title_tokens, text_tokens = (spark.createDataFrame([*x, (None, "lost")], "key bigint, tok string") for x in (titles, texts))
    seed = spark.createDataFrame([(i, "good" if i % 5 < 2 else "poor") for i in range(0, 60, 4)] + [(0, "toxic"), (None, "poor"), (999, "good")], "key bigint, label string")
    vocab = spark.createDataFrame([("city library", "good"), ("motor vehicle", "unheard")], "h string, label string")
    taxonomy = spark.createDataFrame([("solar panels", "good"), ("motor", "poor"), ("school boards", "unheard")], "name string, label string")
    given = (records, title_tokens, text_tokens)

    targets = records.select("key").join(seed.select("key").distinct(), "key", "left_anti")
    trusted, before, stable, promoted_at = seed, None, False, []
    for _ in range(3):
        out = L.decide(L.route_votes(*given, trusted, vocab, taxonomy, cmte_min=2, targets=targets)).collect()
        promoted = [(r["key"], r["label"]) for r in out if r["conf"] >= 4.0]
        promoted_at.append(len(promoted))
        stable = before is not None and {k for k, _ in promoted} == before
        if stable:
            break
        before, trusted = {k for k, _ in promoted}, seed.unionByName(spark.createDataFrame(promoted, "key bigint, label string"))
    want = sorted((r["key"], r["label"], round(r["conf"], 9), r["agree"], r["routes"], stable) for r in out if r["conf"] >= 2.0)
    assert want and 0 < promoted_at[0] < len(out)

    calls, whole = [], Sim.similar_sets
    monkeypatch.setattr(Sim, "similar_sets", lambda *a: calls.append(a) or whole(*a))
    got = L.self_training(*given, seed, vocab, taxonomy, accept=2.0, promote=4.0, rounds=3, cmte_min=2).collect()
    assert sorted((r["key"], r["label"], round(r["conf"], 9), r["agree"], r["routes"], r["stable"]) for r in got) == want
    assert len(calls) == 2  # titles and texts, whatever the rounds
