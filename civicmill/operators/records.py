"""One record per bill: position, floor outcome, latest vote, lifecycle, completeness.

History is reduced to one row per bill before any join. All reductions but the referral count are plain
aggregates ("value of the newest row that sets it"), so a bill with a huge history costs no more than others.
The full history stays in its own table, keyed by bill: nesting it would collect a hot bill in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import classify as K
from civicmill.functions import ids as I

BILL_TYPE = r"^[HS]B"
BILL_ID = r"^[A-Z]{2,3}\d+$"


def committee_code(refid) -> Column:
    """Committee code a refid names, by reference ('H14') or by a committee vote ('H14V2610034'); else null."""
    r = F.upper(I.heal_cell(refid))
    code = F.regexp_extract(r, r"^([HS]\d{1,2})((\d{3})?V\d+)?$", 1)
    return F.when(code != "", code)


def is_referral(refid) -> Column:
    return F.upper(I.heal_cell(refid)).rlike(r"^[HS]\d{1,2}$")


def home_chamber(bill) -> Column:
    return F.when(F.col(bill).startswith("H"), "House").otherwise("Senate")


def _coded(history: DataFrame, committees: DataFrame) -> DataFrame:
    """Adds the tally, the committee code if the committee is known, and whether a code of the right shape is not.

    A code without a name moves no bill, so it is resolved before anything is reduced.
    """
    known = committees.select(F.col("code").alias("_shaped"), F.lit(True).alias("_known")).distinct()
    shaped = history.withColumn("_shaped", committee_code("refid")).join(known, "_shaped", "left")
    named = shaped.withColumn("_code", F.when(F.col("_known"), F.col("_shaped")))
    return named.withColumn("_unknown", F.col("_shaped").isNotNull() & F.col("_known").isNull()).withColumn("_tally", K.tally_text("action")).drop("_shaped", "_known")


def _position_aggs() -> list[Column]:
    chamber = F.when(F.col("_code").startswith("H"), "House").otherwise("Senate")
    at = F.when(F.col("_code").isNotNull(), F.col("seq"))
    crossed = F.coalesce(F.bool_or(F.col("_code").isNotNull() & (chamber != home_chamber("bill"))), F.lit(False))
    return [F.max_by("_code", at).alias("last_code"), F.max_by(chamber, at).alias("chamber"), crossed.alias("crossed_over")]


def _floor_aggs() -> list[Column]:
    a = F.lower(F.col("action"))

    def side(chamber):
        rank = F.max(F.when(a.rlike(rf"\bpassed {chamber}\b|\bagreed to by {chamber}\b"), 2).when(a.rlike(rf"\bdefeated by {chamber}\b"), 1).otherwise(0))
        return F.when(rank == 2, "passed").when(rank == 1, "defeated").otherwise("")

    return [side("house").alias("floor_house"), side("senate").alias("floor_senate")]


def _vote_agg() -> Column:
    return F.max_by(F.struct("_tally", "date", "_code"), F.when(F.col("_tally") != "", F.col("seq"))).alias("_v")


_VOTE = ("trim(_v._tally) AS vote_tally", "_v.date AS vote_date", "_v._code AS vote_code")


def referrals(history: DataFrame, committees: DataFrame) -> DataFrame:
    """Number of successive distinct known committees a bill was referred to."""
    referred = history.select("bill", "seq", committee_code("refid").alias("code")).filter(is_referral("refid"))
    referred = referred.join(committees.select("code").distinct(), "code", "left_semi")
    # equal or null positions stand in order of their codes, not of arrival
    return scale.run_counts(referred, ["bill"], ["seq", "code"], "code", "referral_count")


def positions(history: DataFrame, committees: DataFrame) -> DataFrame:
    """Last committee, chamber, crossover and number of successive referrals, from refids only."""
    last = _coded(history, committees).filter("_code IS NOT NULL").groupBy("bill").agg(*_position_aggs())
    return last.join(referrals(history, committees), "bill", "left").withColumn("referral_count", F.coalesce("referral_count", F.lit(0)))


def floor_outcomes(history: DataFrame) -> DataFrame:
    """Per chamber: passed, defeated or ''. A passage outranks any defeat."""
    return history.groupBy("bill").agg(*_floor_aggs())


def latest_votes(history: DataFrame, committees: DataFrame) -> DataFrame:
    """Newest action that carries a tally."""
    return _coded(history, committees).filter("_tally <> ''").groupBy("bill").agg(_vote_agg()).selectExpr("bill", *_VOTE)


def history_state(history: DataFrame, committees: DataFrame) -> DataFrame:
    """Everything a record needs from the history but the referral count, in one scan and one shuffle."""
    g = _coded(history, committees).groupBy("bill").agg(
        F.max_by("date", "seq").alias("last_action_date"), F.count(F.lit(1)).alias("actions"), F.count_if("_unknown").alias("unknown_codes"), *_position_aggs(), *_floor_aggs(), _vote_agg())
    return g.selectExpr("bill", "last_action_date", "actions", "unknown_codes", "last_code", "chamber", "crossed_over", "floor_house", "floor_senate", *_VOTE)


def upcoming(docket: DataFrame, today: str) -> DataFrame:
    """Meetings on or after ``today``: how many, and the first."""
    ahead = docket.filter(F.col("day") >= F.lit(today).cast("date"))
    first = F.min_by(F.struct("date", "committee"), F.struct("date", "committee"))
    return ahead.groupBy("bill").agg(F.count(F.lit(1)).alias("upcoming"), first.alias("n")).select(
        "bill", "upcoming", F.col("n.date").alias("next_date"), F.col("n.committee").alias("next_committee"))


def bill_records(universe: DataFrame, history: DataFrame, docket: DataFrame, committees: DataFrame, today: str, count_referrals: bool = True) -> DataFrame:
    """Universe joined with its four reduced sides; one row per bill, whether or not it has a history.

    The referral count is the one side that needs written rows; without it the count is 0 and the plan stays lazy.
    """
    names = committees.select("code", "name")
    out = K.with_outcome(universe)
    none = history.select("bill", F.lit(0).cast("bigint").alias("referral_count")).limit(0)
    for side in (history_state(history, committees), referrals(history, committees) if count_referrals else none, upcoming(docket, today)):
        out = out.join(side, "bill", "left")
    out = out.join(names.select(F.col("code").alias("last_code"), F.col("name").alias("last_committee")), "last_code", "left")
    out = out.join(names.select(F.col("code").alias("vote_code"), F.col("name").alias("vote_place")), "vote_code", "left")
    filled = out.na.fill("", ["last_action_date", "floor_house", "floor_senate", "last_committee", "vote_tally", "vote_date", "next_date", "next_committee"])
    filled = filled.na.fill(0, ["actions", "unknown_codes", "referral_count", "upcoming"]).na.fill(False, ["crossed_over"])
    return filled.select(
        "bill", "title", "status", "outcome", "outcome_origin", "outcome_mismatch", "unverified_terminal", "patron",
        F.coalesce("chamber", home_chamber("bill")).alias("chamber"), "crossed_over", "floor_house", "floor_senate", "last_committee",
        "referral_count", "vote_tally", F.when(F.col("vote_tally") == "", "").otherwise(F.coalesce("vote_place", F.lit("Floor"))).alias("vote_location"),
        "vote_date", "upcoming", "next_date", "next_committee", "last_action_date", "actions", "unknown_codes")


PATRONS = "array<struct<PatronTypeID:int,Name:string,MemberDisplayName:string,MemberNumber:string>>"


def chief_patron(universe: DataFrame, patrons: str = "patrons", surname: str = "patron") -> DataFrame:
    """Adds chief (full name), chief_number and chief_origin from the nested patron list of each bill.

    The chief is the entry of type 1 or so named, else the first entry. Where the list is absent, empty, no list at
    all, or its chief has no name, the surname of the bulk table stands in, and the origin says so. A number of another
    format is never put in the place of a missing one.
    """
    listed = F.from_json(F.col(patrons), PATRONS)
    entries = F.filter(listed, lambda p: p.isNotNull())
    named = F.filter(entries, lambda p: (p["PatronTypeID"] == 1) | (p["Name"] == "Chief Patron"))
    chief = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(entries, F.lit(1)))
    out = universe.withColumn("_chief", chief)
    full, number, fallback = I.blank(F.col("_chief.MemberDisplayName")), I.blank(F.col("_chief.MemberNumber")), I.blank(surname)
    origin = F.when(full != "", "universe").when(fallback != "", "bulk").otherwise("none")
    return out.withColumn("chief", F.when(full != "", full).otherwise(fallback)).withColumn("chief_number", number).withColumn("chief_origin", origin).drop("_chief")


def patron_coverage(patrons: DataFrame) -> DataFrame:
    """How many bills have their chief from each origin, and the share with a full name: a fall says the list changed shape."""
    full = F.count_if(F.col("chief_origin") == "universe")
    one = patrons.agg(F.count(F.lit(1)).alias("bills"), full.alias("from_universe"), F.count_if(F.col("chief_origin") == "bulk").alias("from_bulk"), F.count_if(F.col("chief_origin") == "none").alias("missing"))
    return one.withColumn("full_name_rate", K.safe_rate("from_universe", "bills"))


def completeness(records: DataFrame) -> DataFrame:
    """Counters and rates with their denominators, as one row, in one aggregation."""
    n = F.count(F.lit(1))
    count = lambda c: F.count_if(c)
    full = F.col("outcome").isin("awaiting_governor", "signed", "vetoed") & F.col("bill").rlike(BILL_TYPE)
    both = (F.col("floor_house") == "passed") & (F.col("floor_senate") == "passed")
    flagged, worded = F.col("outcome_origin") == "structural_flag", F.col("outcome_origin") == "keyword_fallback"
    one = records.agg(
        n.alias("records_written"), count(F.col("actions") == 0).alias("prefiled_no_history"), count(flagged).alias("outcome_structural"),
        count(worded).alias("outcome_unverified"), count(F.col("outcome_mismatch")).alias("outcome_keyword_mismatches"),
        count(F.col("unverified_terminal")).alias("outcome_unverified_terminal"), count(F.col("patron") != "").alias("patron_present"),
        count(F.col("patron") == "").alias("patron_missing"), count(F.col("floor_house") == "passed").alias("floor_house"),
        count(F.col("floor_senate") == "passed").alias("floor_senate"), count(full).alias("floor_both_expected"),
        count(full & ~both).alias("floor_both_missing"), count(F.col("crossed_over")).alias("crossed_over"),
        count(F.col("vote_tally") != "").alias("with_vote"), count(F.col("upcoming") > 0).alias("with_upcoming"),
        F.sum("unknown_codes").alias("unknown_codes"), count(F.col("unknown_codes") > 0).alias("bills_with_unknown_codes"))
    return one.select(
        "*", (F.col("outcome_unverified") - F.col("outcome_unverified_terminal")).alias("outcome_unverified_absent"),
        K.safe_rate("outcome_keyword_mismatches", "outcome_structural").alias("outcome_keyword_mismatch_rate"),
        K.safe_rate("outcome_unverified", "records_written").alias("outcome_unverified_rate"),
        K.safe_rate("floor_both_missing", "floor_both_expected").alias("floor_reconcile_rate"))


def completeness_report(counts: DataFrame, universe: DataFrame, history: DataFrame, docket: DataFrame, bulk: DataFrame, patrons: DataFrame, k: int = 10) -> DataFrame:
    """The completeness counters with the coverage of every source around them, as one row.

    ``universe``: raw_bill as listed. ``history``: bill. ``docket``: raw_day as it came. ``bulk``: raw_bill. ``patrons``:
    chief_origin a bill. Bills on one side only are counted both ways, those without a universe row with the first ``k``;
    unreadable rows stand beside the number of rows they come from. Fully passed bills without both floor passages raise
    ``reconcile_alert`` above one in a hundred. Each source is reduced to one row before they meet.
    """
    usable = lambda c: I.clean_bill(c).rlike(BILL_ID)
    rows = F.count(F.lit(1))
    tag = lambda df, c, side: df.select(c.alias("bill"), F.lit(side).alias("_s")).distinct()
    listed = universe.filter(usable("raw_bill"))
    sides = tag(listed, I.clean_bill("raw_bill"), 1).unionByName(tag(history, F.col("bill"), 2)).groupBy("bill").agg(F.sum("_s").alias("s"))
    only = F.col("s") == 2
    gaps = sides.agg(
        F.count_if(F.col("s") != 2).alias("universe_count"),
        F.count_if(F.col("s") != 1).alias("history_bills"),
        F.count_if(F.col("s") == 1).alias("universe_without_history"),
        F.count_if(only).alias("in_history_not_in_universe"),
    )
    sample = scale.global_top_k(sides.filter(only).select("bill"), [F.col("bill")], k).agg(F.array_join(F.sort_array(F.collect_list("bill")), "|").alias("in_history_not_in_universe_sample"))
    day = F.coalesce(F.try_to_timestamp("raw_day", F.lit("M/d/yyyy")), F.try_to_timestamp("raw_day", F.lit("yyyy-MM-dd")))
    sources = [
        gaps,
        sample,
        universe.agg(F.count_if(~F.coalesce(usable("raw_bill"), F.lit(False))).alias("skipped_malformed_universe")),
        docket.agg(F.count_if(day.isNull()).alias("docket_unparseable_dates"), rows.alias("docket_rows_total")),
        bulk.agg(rows.alias("bulk_rows"), F.count_if(I.blank("raw_bill") == "").alias("bulk_skipped_no_bill")),
        patrons.agg(F.count_if(F.col("chief_origin") == "universe").alias("patron_fullname_universe")),
    ]
    out = counts
    for one in sources:
        for c in one.columns:
            out = out.withColumn(c, one.select(c).scalar())
    return out.select(
        "*",
        K.safe_rate("docket_unparseable_dates", "docket_rows_total").alias("docket_unparseable_rate"),
        K.safe_rate("patron_present", "records_written").alias("patron_present_rate"),
        K.safe_rate("patron_fullname_universe", "records_written").alias("patron_fullname_universe_rate"),
        F.coalesce(F.col("floor_both_missing") / F.nullif("floor_both_expected", F.lit(0)) > 0.01, F.lit(False)).alias("reconcile_alert"),
    )


def completeness_samples(records: DataFrame, k: int = 10) -> DataFrame:
    """First k bills per finding, without collecting the findings."""
    tags = F.array_compact(F.array(
        F.when(F.col("outcome_mismatch"), "outcome_mismatch"), F.when(F.col("outcome_origin") == "keyword_fallback", "outcome_unverified"),
        F.when(F.col("unverified_terminal"), "outcome_unverified_terminal")))
    return scale.samples(records.select(F.explode(tags).alias("finding"), "bill"), ["finding"], "bill", k, "sample")


def titled(text: Column) -> Column:
    """First letter of every run of letters in upper case: after a hyphen too, unlike ``initcap``."""
    return F.array_join(F.transform(F.split(text, r"(?<=[^a-z])"), lambda part: F.initcap(part)), "")


def state_machine(history: DataFrame) -> DataFrame:
    """Committee and subcommittee with their resets, sticky flags and the last tally.

    Inside one action the later rule wins; across actions the newest assignment wins. So each action gets
    its final assignment and the bill's state is the newest non-null one: aggregation instead of a fold.
    """
    a = F.lower(F.col("action"))
    senate_side = F.contains(a, F.lit("passed senate")) | F.contains(a, F.lit("agreed to by senate"))
    house_side = F.contains(a, F.lit("passed house")) | F.contains(a, F.lit("agreed to by house"))
    opposite = F.when(F.col("bill").startswith("H"), senate_side).otherwise(house_side)
    target = F.trim(F.substring_index(F.regexp_extract(a, r"referred to\s?([a-z\s&,-]+)", 1), "(", 1))
    referral = a.contains("referred to") & a.rlike(r"referred to\s?[a-z\s&,-]+")
    reset = senate_side | house_side
    leaves_sub = K.contains_any(a, ("reported", "incorporated", "passed by indefinitely", "defeated")) & ~a.contains("recommends")
    sub = F.trim(F.regexp_extract(a, r"(subcommittee[^)]*)", 1))
    named = F.concat(F.when(a.startswith("h "), "House ").otherwise("Senate "), titled(target))
    committee = F.when(reset, "Unassigned").when(referral, named)
    subcommittee = F.when(reset | leaves_sub, "-").when(sub != "", sub).when(referral, "-")
    tally = F.regexp_extract(a, r"\(\s*(\d+-y\s+\d+-n[^)]*?)\s*\)", 1)
    rows = history.select("bill", "seq", committee.alias("c"), subcommittee.alias("s"), F.when(tally != "", tally).alias("t"), opposite.alias("o"),
                          K.contains_any(a, ("conference", "rejected", "insisted")).alias("conf"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("bill").agg(
        F.coalesce(newest("c"), F.lit("Unassigned")).alias("committee"), F.coalesce(newest("s"), F.lit("-")).alias("subcommittee"),
        F.coalesce(newest("t"), F.lit("-")).alias("latest_vote"), F.bool_or("o").alias("passed_opposite"), F.bool_or("conf").alias("in_conference"))


# Phrases of the history scan.
NOISE = ("impact statement", "assigned", "placed on", "referred to", "prefiled", "printed", "reading dispensed", "engrossed", "subcommittee offered",
         "substitute printed")
DEATH = ("passed by indefinitely", "stricken", "left in", "defeated", "failed", "tabled", "incorporated", "recommends passing by indefinitely")
CONTINUED = ("continued to next", "continued to special", "continued to 20", "carried over")
LIFECYCLE_NOISE = ("fiscal", "statement", "printed", "reprint", "docketed", "emergency", "note filed")
SIGNIFICANT = ("reported", "passed", "defeated", "failed", "stricken", "continued", "incorporated", "approved", "enacted", "vetoed", "referred",
               "assigned", "recommended", "read", "agreed", "left", "tabled", "indefinitely", "pbi", "chapter", "signed", "communicated", "enrolled",
               "reconsidered", "taken", "concurred", "reenrolled", "recommendation")


def terminal_scan(history: DataFrame) -> DataFrame:
    """The newest action that is not clerical noise decides: continued, dead, or neither."""
    a = F.lower(F.col("action"))
    newest = history.filter(~K.contains_any(a, NOISE)).groupBy("bill").agg(F.max_by(F.lower("action"), "seq").alias("a"))
    continued = K.contains_any(F.col("a"), CONTINUED)
    return newest.select("bill", continued.alias("continued"), (~continued & K.contains_any(F.col("a"), DEATH)).alias("dead"))


def last_significant(history: DataFrame) -> DataFrame:
    """Newest action with a significant word and without filing noise."""
    a = F.lower(F.col("action"))
    kept = history.filter(K.contains_any(a, SIGNIFICANT) & ~K.contains_any(a, LIFECYCLE_NOISE))
    return kept.groupBy("bill").agg(F.max_by(F.struct("action", "date"), "seq").alias("v")).select(
        "bill", F.col("v.action").alias("last_significant"), F.col("v.date").alias("significant_date"))


def stale_items(records: DataFrame, today: str) -> DataFrame:
    """Days since the last action, where at least 14 in an even year or 7 in an odd one."""
    t = F.lit(today).cast("date")
    threshold = F.when(F.year(t) % 2 == 0, 14).otherwise(7)
    aged = records.withColumn("days", F.datediff(t, F.col("last_action_date").try_cast("date")))
    return aged.filter(F.col("days") >= threshold)


def feed(history: DataFrame, universe: DataFrame) -> DataFrame:
    """Every action with its bill's title. Callers order it: newest first, ties by sequence."""
    return history.join(universe.select("bill", "title"), "bill").select("bill", "title", "action", "date", "seq")


def funnel(records: DataFrame) -> DataFrame:
    """Bills alive, or stranded, per stage and side, and the terminal forks."""
    stage = K.furthest_stage()
    dead, done = F.col("outcome").isin("dead", "carried_over"), F.col("outcome").isin("signed", "vetoed", "awaiting_governor")
    placed = records.select("outcome", stage.alias("stage"), K.stage_side(stage).alias("side"), dead.alias("dead"), done.alias("done"))
    fork = placed.filter("dead OR done").select(F.lit("outcome").alias("part"), "outcome", F.lit("").alias("side"))
    lane = placed.filter("NOT done").select(F.when(F.col("dead"), "stranded").otherwise("alive").alias("part"), F.col("stage").alias("outcome"), "side")
    return fork.unionByName(lane).groupBy("part", F.col("outcome").alias("stage"), "side").agg(F.count(F.lit(1)).alias("n"))


def tally_outcomes(records: DataFrame) -> DataFrame:
    """Every outcome category, zero included."""
    spark = records.sparkSession
    categories = spark.createDataFrame([(o,) for o in K.OUTCOMES], "outcome string")
    return categories.join(records.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), "outcome", "left").na.fill(0, ["n"])


def team_list(watching: DataFrame, involved: DataFrame, master: DataFrame) -> DataFrame:
    """Two lists with a type tag, first entry per bill kept in list order, joined with the master table."""
    both = watching.withColumn("type", F.lit("Watching")).withColumn("_list", F.lit(0)).unionByName(
        involved.withColumn("type", F.lit("Involved")).withColumn("_list", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("bill", I.clean_bill("raw", True)).filter("bill <> ''")
    first = scale.earliest(both.select("bill", "type", "my_title", "_list", "pos"), ["bill"], ["_list", "pos", "my_title"])
    return first.join(master, "bill", "left").na.fill({"my_title": "-", "lifecycle": "In Committee", "topic": "Unassigned / General"})


def two_way_gap(universe: DataFrame, history: DataFrame) -> DataFrame:
    """Bills with a history but no universe entry, and the reverse."""
    known = history.select("bill").distinct()
    orphan = known.join(universe.select("bill"), "bill", "left_anti").withColumn("gap", F.lit("in_history_not_in_universe"))
    silent = universe.select("bill").join(known, "bill", "left_anti").withColumn("gap", F.lit("prefiled_no_history"))
    return orphan.unionByName(silent)


def run_findings(records: DataFrame) -> DataFrame:
    """Rule hits as rows: unrecognised status, unmapped committee, missing topic."""
    hit = lambda cond, kind, detail: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.col(detail).alias("detail")))
    hits = F.array_compact(F.array(
        hit(F.col("lifecycle").contains("unrecognized"), "unrecognized_status", "status"),
        hit((F.col("lifecycle") == "In Committee") & (F.col("committee") == "Unassigned"), "unmapped_committee", "status"),
        hit(F.col("topic") == "Unassigned / General", "missing_topic", "title")))
    return records.select("bill", F.explode(hits).alias("h")).select("bill", "h.kind", "h.detail")


def work_queue(rows: DataFrame, cap: int, order: Sequence[str]) -> DataFrame:
    """First ``cap`` rows of the refresh queue: uncached, then changed, then expired. The rest is counted by the caller.

    The cap is the operator's purpose (a fetch budget); nothing is lost, the overflow stays queued.
    """
    tier = (F.when(F.col("cached").isNull() | ~F.col("cached"), "A").when(F.col("changed"), "B").when(F.col("expired"), "C"))
    queued = rows.filter(~F.coalesce("terminal", F.lit(False))).withColumn("tier", tier).filter("tier IS NOT NULL")
    return scale.global_top_k(queued, [F.col("tier"), *[F.col(c) for c in order]], cap, "place")
