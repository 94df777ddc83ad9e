"""Companion bills, text overlap, nearest neighbours, version differences.

No operator lists all pairs of a group. Same-title groups are reported in factored form (members and pair
counts); each bill gets one companion; similar titles are found through their rare tokens; near neighbours
through posting lists no longer than a stated bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.functions import text as T
from civicmill.session import cut_lineage

FREQUENT_TOKENS = 100_000  # whose counts are looked up without a shuffle: a few MB
COMMON_TOKENS = 1_000  # that documents with enough rarer ones leave out before anything is sorted


def title_key(c) -> Column:
    return F.lower(I.blank(c))


def companion_groups(bills: DataFrame) -> DataFrame:
    """Same-title groups of a session with bills on both sides: members per side, number of (House, Senate) pairs,
    and the first bill of each side. The pair list itself is this table joined with its members on demand."""
    side = lambda p: F.when(F.col("bill").startswith(p), F.col("bill"))
    g = bills.withColumn("key", title_key("title")).filter("key <> ''").select("session", "key", "bill").distinct().groupBy("session", "key").agg(
        F.count(side("HB")).alias("house"), F.count(side("SB")).alias("senate"), F.min(side("HB")).alias("first_house"), F.min(side("SB")).alias("first_senate"))
    return g.filter("house > 0 AND senate > 0").withColumn("pairs", F.col("house") * F.col("senate"))


def counterparts_of(bills: DataFrame, tracked: DataFrame) -> DataFrame:
    """For a tracked list of bills: number, first and last of the same-title counterparts in the other chamber.

    Counterparts are reduced per title and side first, so a common title costs one row however many bills track it.
    """
    b = bills.withColumn("key", title_key("title")).filter("key <> ''").select("session", "key", "bill", F.substring("bill", 1, 2).alias("side")).distinct()
    mine = b.join(tracked.select("bill").distinct(), "bill", "left_semi")
    ends = b.groupBy("session", "key", F.when(F.col("side") == "HB", "SB").otherwise("HB").alias("side")).agg(
        F.count(F.lit(1)).alias("counterparts"), F.min("bill").alias("first"), F.max("bill").alias("last"))
    return mine.join(ends, ["session", "key", "side"]).select("bill", "key", "counterparts", "first", "last")


def divergence(bills: DataFrame, cut: str) -> DataFrame:
    """Companion pairs by joint outcome. Counted from the group members: both, neither, one of two."""
    passed = F.col("passed") == 1
    count = lambda p, ok: F.count_if(F.col("bill").startswith(p) & (passed if ok else ~passed))
    g = bills.withColumn("key", title_key("title")).filter("key <> ''").groupBy(cut, "session", "key").agg(
        count("HB", True).alias("hp"), count("HB", False).alias("hf"), count("SB", True).alias("sp"), count("SB", False).alias("sf"))
    c = F.col
    return g.groupBy(cut).agg(F.sum((c("hp") + c("hf")) * (c("sp") + c("sf"))).alias("pairs"), F.sum(c("hp") * c("sp")).alias("both"), F.sum(c("hf") * c("sf")).alias("neither"),
                              F.sum(c("hp") * c("sf")).alias("house_only"), F.sum(c("hf") * c("sp")).alias("senate_only"))


def similar_titles(titles: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of distinct titles of one block with token Jaccard >= threshold, each with itself included.

    Prefix filter: two sets that similar must share a token among the first n - ceil(threshold * n) + 1 in a
    common order. The order is rarest first, so a frequent token almost never becomes a join key.
    ``titles``: block columns session and head, and title.
    """
    t = titles.select("session", "head", "title").distinct().withColumn("w", F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"([a-z]{3,})"), F.lit(1))))
    tokens = t.select("session", "head", "title", F.size("w").alias("n"), F.explode("w").alias("tok"))
    df = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    # a title has few words: ordering them is a small per-row list
    ordered = tokens.join(df, "tok").groupBy("session", "head", "title", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))
    prefix = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    keyed = ordered.select("session", "head", "title", "n", F.transform("o", lambda x: x["tok"]).alias("w"), F.explode(prefix).alias("p")).select("session", "head", "title", "n", "w", F.col("p.tok").alias("tok"))
    other = keyed.select("session", "head", F.col("title").alias("title_b"), F.col("n").alias("n_b"), F.col("w").alias("w_b"), "tok")
    cand = keyed.join(other, ["session", "head", "tok"]).filter((F.col("title") != F.col("title_b")) & (F.least("n", "n_b") >= F.greatest("n", "n_b") * threshold))
    close = cand.filter(T.jaccard("w", "w_b") >= threshold).select("session", "head", "title", "title_b").distinct()
    return close.unionByName(t.select("session", "head", "title", F.col("title").alias("title_b")))


def companions(bills: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The companion of each bill: last opposite-chamber bill, by position, of an equal or similar title under
    the same session and head. Work is on distinct titles; copies of a title cost one row.

    ``bills``: bill, session, head, title, pos.
    """
    side = F.when(F.col("bill").startswith("H"), "H").otherwise("S")
    b = bills.filter("head <> ''").withColumn("side", side)
    last = b.groupBy("session", "head", "title", "side").agg(F.max(F.struct("pos", "bill")).alias("last"))
    offers = last.select("session", "head", F.col("title").alias("title_b"), F.col("side").alias("_other"), "last")
    met = similar_titles(b, threshold).join(offers, ["session", "head", "title_b"]).withColumn("side", F.when(F.col("_other") == "S", "H").otherwise("S"))
    partner = met.groupBy("session", "head", "title", "side").agg(F.max("last").alias("p"))
    return b.join(partner, ["session", "head", "title", "side"]).select("bill", F.col("p.bill").alias("companion"))


def compare_pairs(pairs: DataFrame, texts: DataFrame, k: int = 8) -> DataFrame:
    """Overlap measures of a pair table (house, senate).

    Work is on distinct texts: every text is known by the digest of its normal form, shingles are cut once per
    digest, each pair of digests is compared once, and copies only join their result. Shingles travel as hashes.
    """
    normal = T.normalize_text("text")
    digest = cut_lineage(texts.select("bill", normal.alias("n")).filter("n <> ''").select("bill", F.md5("n").alias("d")))
    known = pairs.join(digest.select(F.col("bill").alias("house"), F.col("d").alias("da")), "house", "left").join(
        digest.select(F.col("bill").alias("senate"), F.col("d").alias("db")), "senate", "left")
    different = known.filter(F.col("da") != F.col("db")).select("da", "db").distinct()
    # one text per digest that takes part in a comparison
    wanted = different.select(F.col("da").alias("d")).unionByName(different.select(F.col("db").alias("d"))).distinct()
    chosen = digest.join(wanted, "d", "left_semi").groupBy("d").agg(F.min("bill").alias("bill"))
    cut = texts.select("bill", "text").join(chosen, "bill").select("d", normal.alias("n")).select("d", T.shingle_hashes("n", k).alias("s"))
    met = different.join(cut.select(F.col("d").alias("da"), F.col("s").alias("a")), "da").join(cut.select(F.col("d").alias("db"), F.col("s").alias("b")), "db")
    counts = met.select("da", "db", F.size(F.array_intersect("a", "b")).alias("_i"), F.size("a").alias("_na"), F.size("b").alias("_nb"))
    j = known.join(counts, ["da", "db"], "left")
    equal, missing = F.col("da") == F.col("db"), F.col("da").isNull() | F.col("db").isNull()
    share = lambda x: F.when(missing, None).when(equal, 1.0).otherwise(x)
    jac = share(F.col("_i") / (F.col("_na") + F.col("_nb") - F.col("_i")))
    ab, ba = share(F.col("_i") / F.col("_na")), share(F.col("_i") / F.col("_nb"))
    absorbed = ((ab >= 0.80) | (ba >= 0.80)) & (jac < 0.50)
    verdict = F.when(missing, "unverifiable").when((jac >= 0.80) | absorbed, "confirmed").otherwise("weak")
    return j.select(*pairs.columns, F.round(jac, 4).alias("jaccard"), F.round(ab, 4).alias("house_in_senate"), F.round(ba, 4).alias("senate_in_house"),
                    absorbed.alias("absorbed"), F.when(~missing, K.similarity_label(jac)).alias("label"), verdict.alias("verdict"))


def drift_summary(compared: DataFrame) -> DataFrame:
    ok = F.col("verdict") == "confirmed"
    return compared.agg(F.count_if(ok).alias("confirmed"), F.count_if(ok & (F.col("jaccard") >= 0.999)).alias("in_sync"), F.count_if(ok & (F.col("jaccard") < 0.999)).alias("diverged"),
                        F.count_if(F.col("verdict") == "weak").alias("weak"), F.count_if(F.col("verdict") == "unverifiable").alias("unverifiable"))


def most_diverged(compared: DataFrame, k: int = 10) -> DataFrame:
    return scale.global_top_k(compared.filter((F.col("verdict") == "confirmed") & (F.col("jaccard") < 0.999)), [F.col("jaccard"), F.col("house"), F.col("senate")], k)


def rarest_tokens(docs: DataFrame, key: str, text: str, k: int = 12) -> DataFrame:
    """The k tokens of each document that fewest documents contain; ties alphabetical.

    Texts are cut once. Counts of the most frequent tokens travel to the documents, so of these each map task passes on
    k a document at most; only other tokens, if there are any, are shuffled by token to meet their counts. A document
    with k tokens that are not among the ``COMMON_TOKENS`` most frequent leaves those out, since none of them can be
    one of its k rarest: map tasks then sort few of its tokens and do not spill.
    """
    sets = cut_lineage(docs.select(key, T.subject_tokens(text).alias("w")))
    df = cut_lineage(sets.select(F.explode("w").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df")))
    top = df.orderBy(F.desc("df"), "tok").limit(COMMON_TOKENS + 1).collect()
    floor = top[-1]["df"] if len(top) > COMMON_TOKENS else 0
    common = [r["tok"] for r in top if r["df"] > floor]  # any other token is in fewer documents than each of these
    others = F.filter("w", lambda w: ~w.isin(common)) if common else F.col("w")
    tokens = sets.withColumn("_o", others).select(key, F.explode(F.when(F.size("_o") >= k, F.col("_o")).otherwise(F.col("w"))).alias("tok"))
    some = df.count() > FREQUENT_TOKENS
    frequent = F.broadcast(df.orderBy(F.desc("df"), "tok").limit(FREQUENT_TOKENS) if some else df)
    met = tokens.join(frequent, "tok")
    if some:
        # a merge join: by Spark's estimate the exploded tokens are as small as the texts' files, and would be broadcast
        met = met.unionByName(tokens.join(frequent.select("tok"), "tok", "left_anti").join(df.hint("merge"), "tok"))
    return scale.top_k(met, [key], [F.col("df"), F.col("tok")], k).select(key, "tok", "df")


def nearest(queries: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """Best other item by token Jaccard, among all items with a similarity of at least ``least``; ties: smaller item.

    ``queries``: key, tok. ``items``: item, tok. Exact: sets that similar share one of the first
    n - ceil(least * n) + 1 tokens in an order common to both sides, here the rarest first, so frequent tokens are
    join keys only for sets that have little else. Equal token sets are one set: copies are never paired. A key is
    not its own neighbour. Keys without a neighbour have no row.
    """
    return nearest_of(*similar_sets(queries, items, least))


def similar_sets(queries: DataFrame, items: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """What ``nearest`` compares: the token sets (k, asks, w, d) of both sides, d a digest of the set, and the pairs
    (d, e, similarity) of distinct sets of queries and items with a similarity of at least ``least``."""
    sides = queries.select(F.col("key").alias("k"), "tok", F.lit(True).alias("asks")).unionByName(items.select(F.col("item").alias("k"), "tok", F.lit(False).alias("asks"))).distinct()
    df = sides.filter("not asks").groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ordered = sides.join(df, "tok", "left").groupBy("k", "asks").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok"))).alias("o"))
    sets = cut_lineage(ordered.select("k", "asks", F.transform("o", lambda x: x["tok"]).alias("w"), F.md5(F.array_join(F.transform("o", lambda x: x["tok"]), " ")).alias("d")))
    distinct = lambda asks: sets.filter(F.col("asks") == asks).groupBy("d").agg(F.first("w").alias("w")).withColumn("n", F.size("w"))
    first = F.slice("w", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    asked = distinct(True).withColumn("tok", F.explode(first))
    offered = distinct(False).withColumn("tok", F.explode(first)).select(F.col("d").alias("e"), F.col("w").alias("v"), F.col("n").alias("m"), "tok")
    fits = F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9
    shared = F.size(F.array_intersect("w", "v"))
    # a merge join: a set is copied for each token of its prefix, which Spark's size estimate does not see
    met = asked.join(offered.hint("merge"), "tok").filter(fits).select("d", "e", (shared / (F.col("n") + F.col("m") - shared)).alias("similarity"))
    return sets, met.filter(F.col("similarity") >= least - 1e-9).distinct()


def nearest_of(sets: DataFrame, met: DataFrame) -> DataFrame:
    """The best item of each key of ``similar_sets``; ``sets`` may have lost items since."""
    # the two smallest items of a set: one of them is another than the key
    two = scale.top_k(sets.filter("not asks").select(F.col("d").alias("e"), F.col("k").alias("item")), ["e"], [F.col("item")], 2, "place")
    offers = met.join(two, "e")
    best = scale.top_k(offers, ["d"], [F.desc("similarity"), F.col("item")], 2, "rank").select("d", "item", "similarity")
    found = sets.filter("asks").select(F.col("k").alias("key"), "d").join(best, "d").filter("key <> item")
    picked = found.groupBy("key").agg(F.min_by(F.struct("item", "similarity"), F.struct((-F.col("similarity")).alias("s"), "item")).alias("b"))
    return picked.select("key", "b.item", "b.similarity")


def version_pairs(versions: DataFrame) -> DataFrame:
    """Consecutive versions and first-to-last of each bill. A version without text stays in the chain."""
    lagged = scale.running(versions, ["bill"], ["version"], lags={"_p": F.struct("label", "text", "version")})
    steps = lagged.filter(F.col("_p").isNotNull()).select("bill", F.lit("step").alias("kind"), F.col("_p.label").alias("from_label"), F.col("label").alias("to_label"),
                                                         F.col("_p.text").alias("text_a"), F.col("text").alias("text_b"))
    ends = versions.groupBy("bill").agg(F.min_by(F.struct("label", "text"), "version").alias("a"), F.max_by(F.struct("label", "text"), "version").alias("z"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    whole = ends.select("bill", F.lit("total").alias("kind"), F.col("a.label").alias("from_label"), F.col("z.label").alias("to_label"), F.col("a.text").alias("text_a"), F.col("z.text").alias("text_b"))
    return steps.unionByName(whole)
