"""Differences between snapshots, set differences, change feed.

Every side is reduced to one row per identity before the outer join, so no key multiplies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import ids as I


def union_repaired(left: DataFrame, right: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Union by name; columns one side lacks are filled with the given defaults."""
    return left.unionByName(right, allowMissingColumns=True).na.fill(dict(defaults))


def key_set_summary(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of both key sets, their intersection and both differences, in one aggregation."""
    tag = lambda df, name: df.select(*keys).distinct().withColumn("_s", F.lit(name))
    sides = tag(left, 1).unionByName(tag(right, 2)).groupBy(*keys).agg(F.sum("_s").alias("s"))
    return sides.agg(F.count_if(F.col("s") != 2).alias("left"), F.count_if(F.col("s") != 1).alias("right"), F.count_if(F.col("s") == 3).alias("both"),
                     F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"))


def _history_rows(rows: DataFrame) -> DataFrame:
    """Rows with their identity: by refid where there is one, else by the action text itself."""
    refid, action = I.blank("refid"), I.blank("action")
    return rows.select(I.blank("bill").alias("bill"), I.blank("date").alias("date"), F.when(refid != "", "refid").otherwise("action").alias("by"),
                       F.when(refid != "", refid).otherwise(action).alias("ident"), action.alias("action"), "seq")


def diff_history(previous: DataFrame, current: DataFrame) -> DataFrame:
    """history_added, history_edited, history_removed with the verbatim old and new text.

    The last row of either state per identity comes from one aggregation over both: no join, one shuffle.
    """
    keys = ["bill", "date", "by", "ident"]
    both = _history_rows(previous).withColumn("now", F.lit(False)).unionByName(_history_rows(current).withColumn("now", F.lit(True)))
    last = lambda now: F.max_by("action", F.when(F.col("now") == now, F.col("seq")))
    j = both.groupBy(*keys).agg(last(False).alias("old"), last(True).alias("new"))
    kind = F.when(F.col("old").isNull(), "history_added").when(F.col("new").isNull(), "history_removed").when(F.col("old") != F.col("new"), "history_edited")
    return j.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "kind", "bill", "date", F.when(F.col("by") == "refid", F.col("ident")).otherwise("").alias("refid"), F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))


def diff_schedule(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Cancelled or moved meetings that both snapshots know; new meetings are not reported here."""
    one = lambda df, t, s: df.groupBy(I.blank("date").alias("date"), I.blank("committee").alias("committee")).agg(
        F.max_by(F.struct(I.blank("time").alias("t"), F.upper(I.blank("status")).alias("s")), "event_id").alias("_v")).select("date", "committee", F.col("_v.t").alias(t), F.col("_v.s").alias(s))
    j = one(previous, "old", "_ps").join(one(current, "new", "_cs"), ["date", "committee"])
    kind = F.when((F.col("_cs") == "CANCELLED") & (F.col("_ps") != "CANCELLED"), "schedule_cancelled").when(F.col("old") != F.col("new"), "schedule_time_moved")
    return j.withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", "date", "committee", "old", F.when(F.col("kind") == "schedule_cancelled", "").otherwise(F.col("new")).alias("new"))


def diff_docket(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Bills added to or removed from a meeting's agenda."""
    keys = ["date", "committee", "bill"]
    tag = lambda df, v: df.select(*[I.blank(k).alias(k) for k in keys]).distinct().withColumn("_s", F.lit(v))
    both = tag(previous, 1).unionByName(tag(current, 2)).groupBy(*keys).agg(F.sum("_s").alias("s"))
    return both.filter("s <> 3").select(F.when(F.col("s") == 2, "docket_added").otherwise("docket_removed").alias("kind"), *keys)


WITNESS_FIELDS = ("time", "sort_time", "status", "location")


def change_feed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """ADDED and CHANGED meetings on a fixed list of fields. A location that was merely empty before is a backfill:
    typed as such so that it is counted, not announced. Absence is never reported as removal."""
    keys = ["date", "committee"]
    p = previous.select(*keys, *[F.col(f).alias(f"prev_{f}") for f in WITNESS_FIELDS], F.lit(True).alias("_known"))
    j = current.join(p, keys, "left")
    differs = [~F.col(f).eqNullSafe(F.col(f"prev_{f}")) for f in WITNESS_FIELDS]
    others, moved = differs[0] | differs[1] | differs[2], differs[3]
    backfill = ~others & moved & (I.blank("prev_location") == "") & (I.blank("location") != "")
    kind = F.when(F.col("_known").isNull(), "ADDED").when(backfill, "BACKFILL").when(others | moved, "CHANGED")
    return j.withColumn("event_type", kind).filter("event_type IS NOT NULL").select(*keys, "event_type", *WITNESS_FIELDS, *[f"prev_{f}" for f in WITNESS_FIELDS])


def unannounced(rows: DataFrame, announced: DataFrame) -> DataFrame:
    """Rows whose (bill, status) was not announced before."""
    return rows.join(announced.select("bill", "status").distinct(), ["bill", "status"], "left_anti")


def triage_routes(routes: DataFrame, consumed: DataFrame, parked: DataFrame, *, closed_areas: Sequence[str], write_words: Sequence[str], reference_suffixes: Sequence[str]) -> DataFrame:
    """First bucket that explains a route; what nothing explains is new."""
    norm = F.lower(I.blank("route"))
    mark = lambda df, flag: df.select(F.lower(I.blank("route")).alias("_n")).distinct().withColumn(flag, F.lit(True))
    r = routes.withColumn("_n", norm).groupBy("_n").agg(F.count(F.lit(1)).alias("n")).join(mark(consumed, "_c"), "_n", "left").join(mark(parked, "_p"), "_n", "left")
    area = F.element_at(F.split(F.regexp_replace("_n", "^/+", ""), "/"), 1)
    any_of = lambda words, test: F.greatest(*[test(w).cast("int") for w in words], F.lit(0)) == 1
    bucket = (F.when(F.col("_c"), "consumed").when(area.isin(*closed_areas), "non_public").when(any_of(write_words, lambda w: F.col("_n").contains(w)), "non_public")
              .when(any_of(reference_suffixes, lambda w: F.col("_n").endswith(w)), "reference").when(F.col("_p"), "parked").otherwise("new"))
    return r.select(F.col("_n").alias("route"), "n", bucket.alias("bucket"))


def fuzzy_names(names: DataFrame, column: str, dictionary: Sequence[str], cutoff: float = 0.95) -> DataFrame:
    """Closest dictionary entry of each distinct name, where the edit-distance ratio reaches the cut-off.

    The dictionary is a constant list (a few dozen names), carried inside the expression; only distinct names are
    compared. The ratio is 1 - distance / longer length, a built-in stand-in for a matching-block ratio.
    """
    distinct = names.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    low = F.lower("name")

    def score(entry: str) -> Column:
        e = F.lit(entry.lower())
        return F.struct((1 - F.levenshtein(low, e) / F.greatest(F.length(low), F.length(e), F.lit(1))).alias("ratio"), F.lit(entry).alias("entry"))

    best = F.array_max(F.array(*[score(x) for x in dictionary]))
    return distinct.withColumn("_b", best).select("name", "n", F.when(F.col("_b.ratio") >= cutoff, F.col("_b.entry")).otherwise(F.col("name")).alias("matched"), F.round("_b.ratio", 6).alias("ratio"))


def crosswalk(rows: DataFrame, code: Column, known: DataFrame) -> DataFrame:
    """Rows with their mapped session; unmappable and unmatched rows stay, typed, and zero matches is an error."""
    mapped = rows.withColumn("mapped", code)
    out = mapped.join(known.select(F.col("session").alias("mapped"), F.lit(True).alias("_known")).distinct(), "mapped", "left")
    state = F.when(F.col("mapped").isNull(), "unmappable").when(F.col("_known").isNull(), "unmatched").otherwise("matched")
    return out.withColumn("state", state).drop("_known")


def crosswalk_report(crosswalked: DataFrame) -> DataFrame:
    """Counts per state; raises inside the job when rows came in and none matched."""
    g = crosswalked.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("matched", "unmatched", "unmappable")], F.count(F.lit(1)).alias("rows"))
    guard = F.assert_true((F.col("rows") == 0) | (F.col("matched") > 0), F.lit("crosswalk matched nothing: a broken join, not an empty source"))
    return g.withColumn("_g", guard).filter(F.col("_g").isNull()).drop("_g")
