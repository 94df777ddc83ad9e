"""Status, route and class rules as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicmill.functions.ids import NULL_WORDS, blank, col, heal_cell
from civicmill.functions.times import has_real_time

# --- fixed values: published vocabularies ------------------------------------------------------------------
DOCUMENT_TYPES = ("LegislationText", "LegislationFile")
REFERRAL_TYPES = ("Committee", "Subcommittee")
OTHER_TYPES = ("Vote", "Legislation", "Minutes", "Calendar")
CLERICAL_STATUSES = ("Introduced", "Awaiting Signature", "Communicated", "Pending Communciation", "Pending Governor's Communication",
                     "Pending Recommunication", "With Governor", "Awaiting Governor's Action", "Governor's Recommendation",
                     "Governor's Veto", "Gov Recommendation Adopted", "Acts of Assembly Chapter", "Enacted", "Approved",
                     "Enrolled-House", "Enrolled-Senate", "Reenrolled-House", "Reenrolled-Senate", "Committee Referral Pending", "Preview")
SESSION_STATUSES = ("In Committee", "In Subcommittee", "In House", "In Senate", "In Conference", "Reported Out-House",
                    "Reported Out-Senate", "Engrossed", "Engrossed with Amendment", "Reengrossed with Amendment", "Passed House",
                    "Passed Senate", "Passed Both", "Passed", "Failed", "Failed in Conference", "Left In Committee", "Continued To",
                    "Continued From", "Continued to House", "Continued to Senate", "Continued to Conference", "Continued in Conference",
                    "Continued in House", "Continued in Senate", "Conference Report Agreed", "Conference Report Rejected",
                    "Conference Report Adopted", "Conference Requested", "Incorporated")
EXECUTIVE_PREFIXES = ("G72", "G73", "G79")
GOVERNOR_CODES = ("G4000", "G7010", "G7050", "G7210", "G7220", "G7320", "G7321", "G7322", "G7324", "G7900", "G7910", "G9998", "G9999")
SCHEDULE_CLASSES = {"1": "MEETING_EVENT", "2": "FLOOR", "4": "CAUCUS", "5": "COMMISSION", "6": "DOCKET"}
REFID_SHAPES = ("SV#", "VSV#", "HB#", "SB#", "#D_H#", "#A_H#", "#D_H#_H#", "HB#F#", "SB#F#", "HB#ERF#", "SB#ERF#", "HB#EF#", "SB#EF#",
                "HB#H#F#", "SB#H#F#", "HB#S#F#", "SB#S#F#", "HB#EH#F#", "SB#ES#F#", "HB#HC#F#", "SB#HC#F#", "SB#E#F#")
CEREMONIAL_CLASSES = ("Commending Resolution", "Memorial Resolution")
KNOWN_SEVERITIES = ("CRITICAL", "WARN", "INFO")
OUTCOMES = ("signed", "vetoed", "awaiting_governor", "dead", "carried_over", "in_progress")
SETTLED_OUTCOMES = ("signed", "vetoed", "dead", "carried_over", "awaiting_governor")
VOTE_TOKENS = ("Y", "N", "X", "A")
# last-action suffixes that never co-occur with passage of the chamber
DEAD_IN_COMMITTEE = ("94", "90", "40", "93", "92", "97", "98", "81")


def contains_any(c, phrases: Sequence[str]) -> Column:
    """Some phrase occurs. One alternation, so the text is evaluated once however many phrases there are."""
    return col(c).rlike("|".join(re.escape(p) for p in phrases))


def yes(c) -> Column:
    return F.upper(blank(c)) == "Y"


# --- votes -------------------------------------------------------------------------------------------------
def tally_text(c) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)(\d+-Y\s+\d+-N(\s+\d+-A\w*)?)", 1)


def tally_counts(c) -> tuple[Column, Column]:
    text = tally_text(c)
    return F.regexp_extract(text, r"(?i)^(\d+)-Y", 1).try_cast("bigint"), F.regexp_extract(text, r"(?i)(\d+)-N", 1).try_cast("bigint")


# --- outcome -----------------------------------------------------------------------------------------------
def outcome_from_flags() -> Column:
    """Published flags, most terminal first; a chapter number means enacted. Null when no flag is set."""
    return (
        F.when(yes("vetoed"), "vetoed")
        .when(yes("approved") | (blank("chapter_id") != ""), "signed")
        .when(yes("carried_over"), "carried_over")
        .when(yes("failed"), "dead")
        .when(yes("passed"), "awaiting_governor")
    )


def outcome_from_status(c) -> Column:
    """Ordered phrases over the published status; a pass in one chamber is still in progress."""
    s = F.lower(blank(c))
    one_chamber = (s.contains("house") | s.contains("senate")) & ~s.contains("both")
    return (
        F.when(s.contains("veto"), "vetoed")
        .when(contains_any(s, ("approved", "acts of assembly", "chapter")), "signed")
        .when(contains_any(s, ("carried over", "continued")), "carried_over")
        .when(contains_any(s, ("passed by indefinitely", "stricken", "left in", "failed", "tabled", "incorporated", "withdrawn",
                               "no action")), "dead")
        .when(contains_any(s, ("enrolled", "pending governor", "awaiting governor", "communicated to governor", "governor's action")),
              "awaiting_governor")
        .when(s.contains("passed") & ~one_chamber, "awaiting_governor")
        .otherwise("in_progress")
    )


def with_outcome(df):
    """Adds the published outcome, the rung that produced it, and the two trust flags."""
    df = df.withColumn("_flag", outcome_from_flags()).withColumn("_word", outcome_from_status("status"))
    return df.select(
        *[c for c in df.columns if c not in ("_flag", "_word")],
        F.coalesce("_flag", "_word").alias("outcome"),
        F.when(F.col("_flag").isNotNull(), "structural_flag").otherwise("keyword_fallback").alias("outcome_origin"),
        F.coalesce(F.col("_flag") != F.col("_word"), F.lit(False)).alias("outcome_mismatch"),
        (F.col("_flag").isNull() & F.col("_word").isin(*SETTLED_OUTCOMES)).alias("unverified_terminal"),
    )


def lifecycle(status, committee, in_conference, passed_opposite, dead, continued) -> Column:
    """First-generation lifecycle label: history facts override the status text."""
    s, comm = F.lower(blank(status)), blank(committee)
    unassigned = comm.isin("-", "nan", "None", "", "Unassigned")
    waiting = contains_any(s, ("pending governor", "awaiting governor", "awaiting signature", "enrolled", "communicated to governor",
                               "bill text as passed"))
    return (
        F.when(contains_any(s, ("signed by governor", "enacted", "approved", "chapter")), "Signed & Enacted")
        .when(s.contains("vetoed"), "Vetoed")
        .when(col(dead) | col(continued), "Dead / Tabled")
        .when(col(in_conference) & ~waiting & (s.contains("passed") | s.contains("conference")), "In Conference")
        .when(waiting | ((s == "passed") & col(passed_opposite)), "Awaiting Signature")
        .when(contains_any(s, ("passed by indefinitely", "stricken", "left in", "defeated", "failed", "tabled", "incorporated",
                               "no action taken", "withdrawn")), "Dead / Tabled")
        .when(contains_any(s, ("reported", "reading waived", "read second", "read third", "read first")) & ~s.contains("recommends reporting"),
              "Out of Committee")
        .when(s.contains("introduced") & unassigned, "Awaiting Referral")
        .when(contains_any(s, ("passed", "agreed", "engrossed", "communicated", "received from", "in senate", "in house")),
              "Out of Committee")
        .when(~unassigned & (F.length(comm) > 2), "In Committee")
        .when(contains_any(s, ("referred to", "in committee", "prefiled", "recommitted")) & ~s.contains("governor"), "In Committee")
        .otherwise("Out of Committee (unrecognized)")
    )


# --- routing -----------------------------------------------------------------------------------------------
def route_event(ministerial) -> Column:
    """STRUCT(route, reason). ``ministerial`` says whether the event code is never timed and never voted."""
    code, ref = blank("event_code"), blank("reference_type")
    status, actor = blank("status"), F.lower(blank("actor"))

    def verdict(route, reason):
        return F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))

    return (
        F.when(blank("vote_tally") != "", verdict("meeting", "recorded_vote"))
        .when(F.substring(code, 1, 3).isin(*EXECUTIVE_PREFIXES), verdict("executive", "executive_action_required"))
        .when((code != "") & F.coalesce(col(ministerial), F.lit(False)), verdict("admin", "ministerial_eventtype"))
        .when(ref.isin(*DOCUMENT_TYPES), verdict("admin", "document"))
        .when(ref.isin(*REFERRAL_TYPES), verdict("admin", "referral_assignment"))
        .when((actor == "governor") | code.startswith("G"), verdict("admin", "executive"))
        .when(status.isin(*CLERICAL_STATUSES), verdict("admin", "status_clerical"))
        .when(status.isin(*SESSION_STATUSES) | (status == ""), verdict("meeting", "status_in_session"))
        .when(has_real_time("event_date"), verdict("meeting", "status_unknown_timefallback"))
        .otherwise(verdict("admin", "status_unknown_timefallback"))
    )


def refid_class(refid, fanout, in_votes, batch_min: int = 2, healed: bool = False) -> Column:
    """Class of a history refid from its grammar, its same-day fan-out and its membership in the vote keys.
    ``healed`` says that the column went through ``heal_cell`` already.

    Numeric ids of seven digits or more are vote ids; one that joins no vote surfaces as unmatched.
    """
    r = col(refid) if healed else heal_cell(refid)
    numeric = r.rlike(r"^\d+$")
    return (
        F.when(r == "", "EMPTY")
        .when(r.rlike(r"^[HS]\d{1,2}(\d{3})?V\d+$"), "VOTE_COMMITTEE")
        .when(numeric & F.coalesce(col(in_votes), F.lit(False)), "VOTE_FLOOR")
        .when(numeric & (F.length(r) >= 7), "VOTE_UNMATCHED")
        .when(numeric & (F.coalesce(col(fanout), F.lit(0)) >= batch_min), "BATCH_NOTICE")
        .when(numeric, "SINGLETON_DOC")
        .when(r.rlike(r"^[HS]\d{1,2}$"), "COMMITTEE_REF")
        .when(r.rlike(r"^\d+[A-Z]+$"), "DOCUMENT")
        .when(r.rlike(r"^[HS]B\d+[A-EG-Z0-9]*F\d+$"), "DOCUMENT")
        .otherwise("UNKNOWN_REFID")
    )


def schedule_class(type_id) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in SCHEDULE_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, heal_cell(type_id)), F.lit("SCHED_OTHER"))


def action_class(outcome="outcome", route="route", refid="refid_class", schedule="schedule_class") -> Column:
    """Ladder: route, then empty outcome, then refid class, then schedule class; the rest surfaces."""
    r, o = F.lower(blank(route)), F.lower(blank(outcome))
    rc, sc = F.upper(blank(refid)), F.upper(blank(schedule))
    return (
        F.when(r == "meeting", "meeting").when(r == "admin", "administrative").when(r == "executive", "executive")
        .when((o == "") | o.isin(*NULL_WORDS), "administrative")
        .when(rc.isin("BATCH_NOTICE", "COMMITTEE_REF", "SINGLETON_DOC", "DOCUMENT"), "administrative")
        .when(sc.isin("MEETING_EVENT", "FLOOR", "COMMISSION"), "meeting")
        .when(sc.isin("DOCKET", "CAUCUS"), "administrative")
        .otherwise("unconfirmed")
    )


def meeting_kind(c) -> Column:
    pattern = r"(?i)\b(re)?conven(es|e|ed)\b|\badjourn(s|ed)?\b|\brecess(es|ed)?\b"
    return F.when(blank(c).rlike(pattern), "floor").otherwise("committee")


def is_ceremonial(c) -> Column:
    return F.coalesce(blank(c).isin(*CEREMONIAL_CLASSES), F.lit(False))


def status_bucket(c) -> Column:
    s = F.lower(blank(c))
    return (F.when(s.contains("received from"), "1_Inbox")
            .when(contains_any(s, ("passed house", "passed senate", "communicated", "signed by speaker")), "3_Outbox").otherwise("2_Floor"))


# --- positions in the pipeline -----------------------------------------------------------------------------
def furthest_stage() -> Column:
    """Needs bill, floor_house, floor_senate, crossed_over, last_committee."""
    from_senate = F.upper(F.col("bill")).startswith("S")
    first = F.when(from_senate, F.col("floor_senate")).otherwise(F.col("floor_house"))
    second = F.when(from_senate, F.col("floor_house")).otherwise(F.col("floor_senate"))
    return (F.when(second != "", "floor2").when(F.col("crossed_over"), "committee2").when(first != "", "floor1")
            .when(F.col("last_committee") != "", "committee1").otherwise("prefiled"))


def stage_side(stage) -> Column:
    """Chamber whose lane a stage lies in; never the chamber the bill happens to be in now."""
    from_senate = F.upper(F.col("bill")).startswith("S")
    second = col(stage).isin("committee2", "floor2")
    return F.when(second == from_senate, "House").otherwise("Senate")


# --- bands and labels --------------------------------------------------------------------------------------
def bands(value, cuts: Sequence[tuple[float, str]], last: str, missing: str = "unknown", inclusive: bool = False) -> Column:
    """Label of the first band whose upper bound is above (or, inclusive, at) the value; null has its own label."""
    v = col(value)
    chain = F.when(v.isNull(), missing)
    for upper, label in cuts:
        chain = chain.when(v <= upper if inclusive else v < upper, label)
    return chain.otherwise(last)


def band_tone(value, cuts: Sequence[tuple[float, str]]) -> Column:
    """First band with value <= bound; a 'warn' band reads as danger, beyond the last bound too."""
    if not cuts:
        raise ValueError("band_tone needs at least one band")
    ordered = sorted(cuts)
    binary = lambda tone: "danger" if tone == "warn" else tone
    return bands(value, [(u, binary(t)) for u, t in ordered], binary(ordered[-1][1]), inclusive=True)


def similarity_label(score) -> Column:
    s = col(score)
    return (F.when(s >= 0.80, "near-identical").when(s >= 0.50, "substantial overlap").when(s >= 0.15, "partial overlap").otherwise("loose"))


def k_of_n(k, n) -> Column:
    """'k of n' with thousands separators; null where nothing was observed."""
    return F.when(col(n) > 0, F.concat_ws(" of ", F.format_number(col(k), 0), F.format_number(col(n), 0)))


def rate_for_sort(k, n) -> Column:
    """Only for ordering: no observations sort last."""
    return F.when(col(n) > 0, col(k) / col(n)).otherwise(-1.0)


def safe_rate(k, n, places: int = 4) -> Column:
    """Rounded share, 0.0 on an empty denominator."""
    return F.when(col(n) > 0, F.round(col(k) / col(n), places)).otherwise(F.lit(0.0))


# --- messages and metrics ----------------------------------------------------------------------------------
_TAGGED = r"(?s)^\[([A-Z]+):([A-Z_]+)\]\s*(.*)$"


def parse_message(text, status) -> dict[str, Column]:
    """'[SEV:CAT] message': an unknown severity is shown as such, never softened."""
    m = blank(text)
    raw = F.upper(F.when(blank(status) != "", blank(status)).otherwise(F.regexp_extract(m, _TAGGED, 1)))
    category, body = F.upper(F.regexp_extract(m, _TAGGED, 2)), F.trim(F.regexp_extract(m, _TAGGED, 3))
    return {
        "severity": F.when(raw.isin(*KNOWN_SEVERITIES), raw).otherwise("UNKNOWN"),
        "category": F.when(category != "", category).otherwise("UNCATEGORIZED"),
        "message": F.when(m.rlike(_TAGGED), body).otherwise(m),
    }


def metrics_map(cell) -> Column:
    """Numbers and numeric text of a JSON object; anything absent stays absent instead of reading as zero."""
    parsed = F.from_json(col(cell), "map<string,string>")
    numeric = F.map_filter(F.transform_values(parsed, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull() & ~F.isnan(v))
    return F.coalesce(numeric, F.create_map().cast("map<string,double>"))


def condition_stem(message) -> Column:
    """Message with dates and numbers masked, so one recurring condition stays one group. Whole: cut it for display only."""
    # The four patterns that make two messages one condition.
    m = F.trim(F.regexp_replace(col(message), r"(?is)\s*(\(debug:|only-full=\[|only-in-full|only-date=|only-bill=|only-incr=).*", ""))
    m = F.regexp_replace(m, r"\d{4}-\d{2}-\d{2}", "#date")
    m = F.regexp_replace(m, r"[0-9][0-9,.]*", "#")
    return F.lower(F.regexp_replace(m, r"\s+", " "))


def canary_state(metric) -> Column:
    v = col(metric)
    return F.when(v.isNull() | (v < 0), "unknown").when(v == 0, "clean").otherwise("drift")


def survived_committee(last_actid) -> Column:
    return F.when(F.substring(blank(last_actid), -2, 2).isin(*DEAD_IN_COMMITTEE), 0).otherwise(1)
