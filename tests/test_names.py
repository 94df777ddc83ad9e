"""The block ratio as a fold against a plain recursion, and the dictionary match against brute force."""

import difflib
import random

from pyspark.sql import functions as F

from civicmill.operators import names as N

WORDS = ("House Agriculture", "Senate Agriculture", "House Courts of Justice", "Senate Commerce and Labor", "House Privileges and Elections")


def plain(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def mangled(rng):
    for w in WORDS:
        for _ in range(25):
            letters = list(w)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(letters))
                letters[i : i + rng.randrange(2)] = rng.choice([[], ["x"], [letters[i], letters[i]], [letters[-1]]])
            yield "".join(letters) if rng.random() < 0.8 else "".join(letters).upper()


def test_ratio_equals_the_plain_recursion(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("a", ""), ("", "b"), ("abcabba", "cbabac"), ("aaaa", "aa"), ("ab" * 12, "ba" * 12)]
    pairs += [("".join(rng.choices("abc ", k=rng.randrange(18))), "".join(rng.choices("abc ", k=rng.randrange(18)))) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["r"] for r in df.select("i", N.block_ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    assert {i: round(v, 9) for i, v in got.items()} == {i: round(plain(a, b), 9) for i, (a, b) in enumerate(pairs)}


def test_match_equals_brute_force_and_differs_from_edit_distance(spark):
    rng = random.Random(2)
    raw = sorted({*mangled(rng), *WORDS, "", "Rules", "Commerce and Labor Senate"})
    for cutoff in (0.95, 0.7):
        rows = spark.createDataFrame([(x,) for x in raw] * 2 + [(None,)], "raw string")
        got = {r["name"]: (r["n"], r["matched"], r["ratio"]) for r in N.matched_names(rows, "raw", WORDS, cutoff).collect()}
        want = {}
        for x in raw:
            best, top = None, 0.0
            for w in WORDS:
                r = plain(x.lower(), w.lower())
                if r > top:
                    best, top = w, r
            want[x] = (2, best, round(top, 6)) if top >= cutoff else (2, x, None)
        assert got == want
    # two swapped words: few edits apart by blocks, many by letters
    a, b = "senate labor and commerce", "senate commerce and labor"
    one = spark.range(1).select(N.block_ratio(F.lit(a), F.lit(b)).alias("r"), (1 - F.levenshtein(F.lit(a), F.lit(b)) / len(a)).alias("e")).first()
    assert abs(one["r"] - one["e"]) > 0.05
