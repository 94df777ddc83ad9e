"""Event routes, refid classes, search and scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.functions import text as T
from civicmill.functions import times as C


def ministerial_codes(events: DataFrame, min_samples: int = 20) -> DataFrame:
    """Event codes seen often enough that never carry a meeting time nor a vote. One row per code."""
    code = I.blank("event_code")
    seen = events.filter(code != "").groupBy(code.alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(C.has_meeting_time("event_date")).alias("timed"), F.bool_or(I.blank("vote_tally") != "").alias("voted"))
    return seen.filter((F.col("n") >= min_samples) & ~F.col("timed") & ~F.col("voted")).select("code", "n")


def route_events(events: DataFrame, min_samples: int = 20) -> DataFrame:
    """Adds route and reason. The code set is an aggregate; Spark picks the join by its measured size."""
    codes = ministerial_codes(events, min_samples).select(F.col("code").alias("_code"), F.lit(True).alias("_ministerial"))
    joined = events.join(codes, I.blank("event_code") == F.col("_code"), "left")
    verdict = joined.withColumn("_v", K.route_event("_ministerial"))
    return verdict.select(*events.columns, F.col("_v.route").alias("route"), F.col("_v.reason").alias("reason"))


def fan_out(history: DataFrame) -> DataFrame:
    """Distinct bills per (refid, date). Pairs are made distinct first, so a hot refid combines on the map side."""
    r = F.upper(I.heal_cell("refid"))
    pairs = history.select(r.alias("_r"), "date", "bill").filter(F.col("_r") != "").distinct()
    return pairs.groupBy("_r", "date").agg(F.count(F.lit(1)).alias("fanout"))


def classify_refids(history: DataFrame, vote_keys: DataFrame) -> DataFrame:
    """Adds fanout, in_votes and refid_class."""
    keys = vote_keys.select(F.col("refid").alias("_r")).distinct().withColumn("_in", F.lit(True))
    # blank refids share no key: as nulls they take no part in the joins, wherever a third of the rows has none
    work = history.withColumn("_r", F.nullif(F.upper(I.heal_cell("refid")), F.lit("")))
    joined = work.join(fan_out(history), ["_r", "date"], "left").join(keys, "_r", "left")
    joined = joined.withColumn("fanout", F.coalesce("fanout", F.lit(0))).withColumn("in_votes", F.coalesce("_in", F.lit(False)))
    return joined.select(*history.columns, "fanout", "in_votes", K.refid_class(F.coalesce("_r", F.lit("")), "fanout", "in_votes", healed=True).alias("refid_class"))


def with_membership(rows: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Semi join kept as a column."""
    known = keys.select(on).distinct().withColumn(flag, F.lit(True))
    return rows.join(known, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def all_agree_index(reference: DataFrame, codes: DataFrame, description_columns: Sequence[str]) -> DataFrame:
    """Description keys whose every event code is administrative (governor or ministerial)."""
    exploded = reference.select(I.blank("event_code").alias("code"), F.explode(F.array(*description_columns)).alias("d"))
    keyed = exploded.select("code", T.description_key("d").alias("key")).filter((F.col("key") != "") & (F.col("code") != "")).distinct()
    known = codes.select("code").withColumn("_admin", F.lit(True))
    judged = keyed.join(known, "code", "left").withColumn("_ok", F.col("code").startswith("G") | F.coalesce("_admin", F.lit(False)))
    return judged.groupBy("key").agg(F.every("_ok").alias("agree"), F.count(F.lit(1)).alias("codes")).filter("agree").select("key", "codes")


def unknown_values(values: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Non-blank values outside the known vocabulary, with their volume. ``known`` is a constant list."""
    v = I.heal_cell(column)
    return values.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("value") != "") & ~F.col("value").isin(*known))


def novel_shapes(classified: DataFrame, min_volume: int = 25, known: Sequence[str] = K.REFID_SHAPES) -> DataFrame:
    """Shapes of unknown refids outside the acknowledged set, seen at least ``min_volume`` times."""
    shapes = classified.filter(F.col("refid_class") == "UNKNOWN_REFID").groupBy(I.shape_signature("refid").alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return shapes.filter((F.col("shape") != "") & ~F.col("shape").isin(*known) & (F.col("n") >= min_volume))


def search(bills: DataFrame, *, needle: str = "", origin: str | None = None, outcomes: Sequence[str] = (), haystack: Sequence[str] = ("bill", "title")) -> DataFrame:
    """Conjunction of facets and a substring over the joined fields."""
    condition = F.lit(True)
    if origin:
        condition = condition & F.col("bill").startswith(origin)
    if outcomes:
        condition = condition & F.col("outcome").isin(*outcomes)
    if needle.strip():
        condition = condition & F.lower(F.concat_ws(" ", *haystack)).contains(needle.strip().lower())
    return bills.filter(condition)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered result; Spark keeps only the rows up to its end."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def in_scope(rows: DataFrame, tracked: DataFrame, first: str, last: str) -> DataFrame:
    """Rows inside the date window whose bill is tracked."""
    return rows.filter(F.col("date").between(first, last)).join(tracked.select("bill"), "bill", "left_semi")
