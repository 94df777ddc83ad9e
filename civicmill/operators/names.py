"""Names against a small dictionary by the matching-block ratio."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION = "struct<a0:int,a1:int,b0:int,b1:int>"
BLOCK = "struct<i:int,j:int,k:int>"


def longest_block(a: Column, b: Column, region: Column) -> Column:
    """(i, j, k): the longest run of letters that both texts hold inside the region, or null. Ties: smallest i, then j.

    Lengths are tried from the longest down, and once a length is found the rest are passed over.
    """
    inside = F.substr(b, region["b0"] + 1, region["b1"] - region["b0"])
    most = F.least(region["a1"] - region["a0"], region["b1"] - region["b0"])

    def at(k: Column) -> Column:
        def place(i: Column) -> Column:
            return F.struct(i.alias("i"), F.position(F.substr(a, i + 1, k), inside).alias("j"))

        places = F.transform(F.sequence(region["a0"], region["a1"] - k), place)
        first = F.get(F.filter(places, lambda p: p["j"] > 0), F.lit(0))
        return F.when(first.isNotNull(), F.struct(first["i"].alias("i"), (first["j"] - 1 + region["b0"]).alias("j"), k.alias("k")))

    lengths = F.when(most > 0, F.sequence(most, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(lengths, F.lit(None).cast(BLOCK), lambda found, k: F.when(found.isNotNull(), found).otherwise(at(k)))


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the letters in matching blocks over all letters; 1 for two empty texts.

    The longest common block splits both texts, and what lies left and right of it is matched in the same way. A fold
    holds the regions still to do; every region with a block takes at least one letter of both texts out, which bounds
    the steps. Meant for names: the work is about cubic in their length.
    """
    whole = F.array(F.struct(F.lit(0).alias("a0"), F.length(a).alias("a1"), F.lit(0).alias("b0"), F.length(b).alias("b1")))
    start = F.struct(whole.cast(f"array<{REGION}>").alias("todo"), F.lit(0).alias("hit"))
    state = f"struct<todo:array<{REGION}>,hit:int>"

    def step(s: Column, _: Column) -> Column:
        region = F.element_at(s["todo"], -1)
        rest = F.slice(s["todo"], F.lit(1), F.size(s["todo"]) - 1)

        def split(m: Column) -> Column:
            left = F.struct(region["a0"].alias("a0"), m["i"].alias("a1"), region["b0"].alias("b0"), m["j"].alias("b1"))
            right = F.struct((m["i"] + m["k"]).alias("a0"), region["a1"].alias("a1"), (m["j"] + m["k"]).alias("b0"), region["b1"].alias("b1"))
            new = F.filter(F.array(left, right), lambda r: (r["a0"] < r["a1"]) & (r["b0"] < r["b1"]))
            return F.struct(F.concat(rest, new).alias("todo"), (s["hit"] + m["k"]).alias("hit"))

        # transform over one element binds the block, so that it is searched for once
        found = F.get(F.transform(F.array(longest_block(a, b, region)), lambda m: F.when(m.isNull(), F.struct(rest.alias("todo"), s["hit"].alias("hit"))).otherwise(split(m))), F.lit(0))
        return F.when(F.size(s["todo"]) == 0, s).otherwise(found).cast(state)

    letters = F.length(a) + F.length(b)
    hit = F.aggregate(F.sequence(F.lit(0), 2 * F.least(F.length(a), F.length(b))), start.cast(state), step)["hit"]
    return F.when(letters == 0, F.lit(1.0)).otherwise(2.0 * hit / letters)


def letter_bound(a: Column, entry: str) -> Column:
    """At least the block ratio of ``a`` to the constant ``entry``: the letters both have, in any order."""
    shared = F.lit(0)
    for letter, n in sorted(Counter(entry).items()):
        shared = shared + F.least(F.length(a) - F.length(F.replace(a, F.lit(letter), F.lit(""))), F.lit(n))
    return F.when(F.length(a) + len(entry) == 0, 1.0).otherwise(2.0 * shared / (F.length(a) + len(entry)))


def matched_names(names: DataFrame, column: str, dictionary: Sequence[str], cutoff: float = 0.95) -> DataFrame:
    """(name, n, matched, ratio): each distinct name with the dictionary entry of the highest block ratio, if it reaches ``cutoff``.

    Case is ignored; ties go to the earlier entry; without such an entry the name stands and the ratio is null. The
    dictionary is a constant list of a few dozen names. A bound from letter counts rules most entries out exactly, the
    others are compared one row each. A null name is no name and gives no row.
    """
    distinct = names.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("name IS NOT NULL")
    low = F.lower("name")
    offers = [F.struct(letter_bound(low, e.lower()).alias("bound"), F.lit(i).alias("at"), F.lit(e).alias("entry")) for i, e in enumerate(dictionary)]
    likely = F.filter(F.array(*offers), lambda o: o["bound"] >= cutoff)
    rows = distinct.select("name", "n", F.explode_outer(likely).alias("o"))
    scored = rows.select("name", "n", "o.at", "o.entry", F.when(F.col("o").isNotNull(), block_ratio(low, F.lower("o.entry"))).alias("r"))
    best = F.max(F.when(F.col("r") >= cutoff, F.struct("r", (-F.col("at")).alias("at"), "entry")))
    found = scored.groupBy("name").agg(F.first("n").alias("n"), best.alias("b"))
    return found.select("name", "n", F.coalesce("b.entry", "name").alias("matched"), F.round("b.r", 6).alias("ratio"))
