"""How much of two texts differs as sequences of words: patience alignment of all pairs at once.

Equal words at both ends of a region are aligned; then words that occur once on either side anchor it, as many of them
as keep their order on both sides; the gaps between anchors are the regions of the next round. A region is a row with the
words of both sides, so a round shuffles nothing and writes the words still open, and the rounds are as many as gaps nest.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.session import cut_lineage


def rising(places: list[int]) -> list[int]:
    """Indices of a longest rising run of distinct places, the last possible one: piles with the least end, read from the right."""
    ends: list[int] = []
    rank = []
    for p in places:
        at = bisect_left(ends, p)
        ends[at : at + 1] = [p]
        rank.append(at)
    out: list[int] = []
    need, below = len(ends) - 1, None
    for i in range(len(places) - 1, -1, -1):
        if rank[i] == need and (below is None or places[i] < below):
            out.append(i)
            need, below = need - 1, places[i]
    return out[::-1]


def _chain(anchors: Column) -> Column:
    """The anchors (a, b), given in order of a, that rise in b too, as many as can."""

    @F.pandas_udf("array<int>")
    def chosen(places: pd.Series) -> pd.Series:
        return places.map(lambda p: rising(list(p)))

    return F.transform(chosen(F.transform(anchors, lambda x: x["b"])), lambda i: F.get(anchors, i))


def _part(words, first, count) -> Column:
    """``count`` of the words from place ``first`` (from 0)."""
    place = F.sequence(F.lit(0).cast("int"), (count - 1).cast("int"))
    return F.when(count > 0, F.transform(place, lambda i: F.get(words, first + i))).otherwise(F.array().cast("array<string>"))


def _agree(a: Column, b: Column, most: Column) -> Column:
    """How many words two lists share from their beginnings on, at most ``most``."""
    same = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(most)


def _trimmed(regions: DataFrame) -> DataFrame:
    """Regions without the equal words at both ends, and ``ends``, how many those are."""
    c = F.col
    least = F.least(F.size("wa"), F.size("wb"))
    out = regions.withColumn("_head", _agree(c("wa"), c("wb"), least))
    out = out.withColumn("_tail", _agree(F.reverse("wa"), F.reverse("wb"), least - c("_head")))
    inner = lambda w: F.slice(w, c("_head") + 1, F.size(w) - c("_head") - c("_tail"))
    return out.withColumn("wa", inner(c("wa"))).withColumn("wb", inner(c("wb"))).withColumn("ends", c("_head") + c("_tail")).drop("_head", "_tail")


def _anchors(regions: DataFrame) -> DataFrame:
    """Adds ``chain``: places of the words that either side has once, as many as rise on both sides."""
    side = lambda w, n: F.transform(w, lambda x, i: F.struct(x.alias("word"), F.lit(n).alias("side"), i.alias("pos")))
    sort = regions.withColumn("_s", F.sort_array(F.concat(side("wa", 0), side("wb", 1))))
    at = lambda i: F.get(F.col("_s"), i)

    def anchor(x: Column, i: Column) -> Column:
        # in order of word and side a word of both sides, once each, stands on two places between other words
        other = lambda j: ~at(j)["word"].eqNullSafe(x["word"])
        pair = (x["side"] == 0) & (at(i + 1)["side"] == 1) & (at(i + 1)["word"] == x["word"]) & other(i - 1) & other(i + 2)
        return F.when(pair, F.struct(x["pos"].alias("a"), at(i + 1)["pos"].alias("b")))

    found = sort.withColumn("_all", F.sort_array(F.filter(F.transform("_s", anchor), lambda x: x.isNotNull()))).drop("_s")
    return found.withColumn("chain", _chain(F.col("_all"))).drop("_all")


def _gaps(chain: Column, wa: Column, wb: Column) -> Column:
    """The words between anchors, before the first and after the last, where both sides have some; none without an anchor."""
    n = F.size(chain)
    start = lambda g, side: F.when(g == 0, 0).otherwise(F.get(chain, g - 1)[side] + 1)
    end = lambda g, side, w: F.when(g == n, F.size(w)).otherwise(F.get(chain, g)[side])
    bounds = F.transform(F.sequence(F.lit(0), n), lambda g: F.struct(
        start(g, "a").alias("a"), (end(g, "a", wa) - start(g, "a")).alias("na"), start(g, "b").alias("b"), (end(g, "b", wb) - start(g, "b")).alias("nb")))
    both = F.filter(bounds, lambda x: (x["na"] > 0) & (x["nb"] > 0))
    cut = F.transform(both, lambda x: F.struct(_part(wa, x["a"], x["na"]).alias("wa"), _part(wb, x["b"], x["nb"]).alias("wb")))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<struct<wa:array<string>,wb:array<string>>>"))


def _round(regions: DataFrame) -> DataFrame:
    """(_a, _b, aligned, gaps) of every region, written: words aligned in it, and the regions that it leaves open."""
    done = _anchors(_trimmed(regions))
    aligned = (F.col("ends") + F.size("chain")).cast("bigint").alias("aligned")
    return cut_lineage(done.select("_a", "_b", aligned, _gaps(F.col("chain"), F.col("wa"), F.col("wb")).alias("gaps")))


def aligned_words(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with words_a, words_b and aligned, the number of words that the alignment of columns ``a`` and ``b`` pairs.

    Words are what blanks part. Equal pairs of texts are aligned once. A null text has null words and no alignment; an
    empty one has none to align. A region is one row with both sides' words, so memory follows the longest pair of texts.
    """
    cut = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    named = pairs.withColumn("_a", F.md5(a)).withColumn("_b", F.md5(b))
    texts = named.filter("_a IS NOT NULL AND _b IS NOT NULL").groupBy("_a", "_b").agg(F.any_value(a).alias("ta"), F.any_value(b).alias("tb"))
    texts = cut_lineage(texts.select("_a", "_b", cut("ta").alias("wa"), cut("tb").alias("wb")))
    size = texts.select("_a", "_b", F.size("wa").alias("words_a"), F.size("wb").alias("words_b"))
    step = _round(texts)
    every = step.select("_a", "_b", "aligned")
    while not step.filter(F.size("gaps") > 0).isEmpty():
        step = _round(step.select("_a", "_b", F.explode("gaps").alias("g")).select("_a", "_b", "g.wa", "g.wb"))
        every = every.unionByName(step.select("_a", "_b", "aligned"))
    total = size.join(every.groupBy("_a", "_b").agg(F.sum("aligned").alias("aligned")), ["_a", "_b"])
    return named.join(total, ["_a", "_b"], "left").drop("_a", "_b")


def difference_pct(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with pct: the percentage of both texts' words that the alignment leaves out; null if a side is missing or empty."""
    out = aligned_words(pairs, a, b)
    share = F.round((1 - 2 * F.col("aligned") / (F.col("words_a") + F.col("words_b"))) * 100, 1)
    return out.withColumn("pct", F.when((F.col("words_a") > 0) & (F.col("words_b") > 0), share)).drop("words_a", "words_b", "aligned")
