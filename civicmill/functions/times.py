"""Dates, clock text and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicmill.functions.ids import blank, col

# Text that stands for a missing meeting time.
PLACEHOLDER_TIMES = ("", "nan", "none", "time tba", "tba", "journal entry", "ledger")
NON_CONCRETE_SCHEDULE_TIMES = ("", "none", "nan", "tba", "time tba")
HOUR_MIN, HOUR_MAX = 7, 23
FORWARD_DAYS, INTERIM_DAYS = 14, 45
QUIET_START, QUIET_END = 23, 6


def micros(c) -> Column:
    """Microseconds since the epoch; timestamps without a zone are read in the session zone (UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def parse_date(c) -> Column:
    """First of the accepted date shapes, as a DATE; null when none parses or the day does not exist."""
    s = blank(c)
    slashed = F.regexp_replace(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2")
    short = F.regexp_replace(slashed, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "20$3-$1-$2")
    iso = F.regexp_extract(short, r"^(\d{4}-\d{1,2}-\d{1,2})$", 1)
    # try_cast of an ISO day is strict about the calendar: 31 February is null, not March
    return F.when(iso != "", iso.try_cast("date"))


def clock_minutes(c) -> Column:
    """Minutes past midnight for '7:30 AM', '9:00 a.m.' or '17:42'; null for relative or missing times."""
    s = F.regexp_replace(blank(c), r"^~", "")
    twelve = r"^(\d{1,2}):(\d{2})\s*([AaPp])\.?\s*[Mm]"
    plain = r"^(\d{1,2}):(\d{2})$"
    hour12 = F.regexp_extract(s, twelve, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(s, twelve, 3)) == "p", 12).otherwise(0)
    min12 = F.regexp_extract(s, twelve, 2).try_cast("int")
    hour24, min24 = F.regexp_extract(s, plain, 1).try_cast("int"), F.regexp_extract(s, plain, 2).try_cast("int")
    return F.coalesce(hour12 * 60 + min12, hour24 * 60 + min24)


def sort_minutes(display, fallback) -> Column:
    """Clock of the displayed time, else of the sort key, else past the end of the day."""
    return F.coalesce(clock_minutes(display), clock_minutes(fallback), F.lit(24 * 60 + 1))


def time_rank(c) -> Column:
    """Agenda rank in hours: clock, then 12.5 for 'after adjournment/recess', then 23.9 for unknown."""
    lower = F.lower(blank(c))
    raw_hour, minute = F.regexp_extract(lower, r"(\d{1,2}):(\d{2})", 1).try_cast("int"), F.regexp_extract(lower, r"(\d{1,2}):(\d{2})", 2).try_cast("int")
    hour = (
        F.when(lower.contains("pm") & (raw_hour != 12), raw_hour + 12)
        .when(lower.contains("am") & (raw_hour == 12), F.lit(0))
        .otherwise(raw_hour)
    )
    return (
        F.when((lower == "") | blank(c).contains("TBA"), F.lit(23.9))
        .when(lower.rlike("adjournment|recess"), F.lit(12.5))
        .otherwise(F.coalesce(hour + minute / 60.0, F.lit(23.9)))
    )


def is_concrete_time(c) -> Column:
    t = F.lower(blank(c))
    return ~t.isin(*PLACEHOLDER_TIMES) & ~t.startswith("⏱")


def clean_time(c) -> Column:
    """First line of the time text without trailing link labels."""
    first = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)[\r\n].*", "")
    return F.trim(F.regexp_replace(first, r"(?i)\s*\((?:Agenda|View Meeting|Meeting Materials)\)\s*", ""))


def _clock_part(c) -> Column:
    return F.trim(F.regexp_extract(blank(c), r"^[^T ]*[T ](.*)$", 1))


def has_real_time(c) -> Column:
    """A time of day is present and is not midnight."""
    t = F.substring(_clock_part(c), 1, 8)
    return (t != "") & ~t.isin("00:00:00", "00:00", "0:00:00", "0:00")


def has_meeting_time(c) -> Column:
    """The hour lies in business hours; batch stamps at 00:00, 04:00 or 05:00 do not count."""
    hour = F.substring_index(_clock_part(c), ":", 1).try_cast("int")
    return F.coalesce(hour.between(HOUR_MIN, HOUR_MAX), F.lit(False))


def forward_horizon(scrape_end, session_end, today, live) -> Column:
    """End of the window to look at: +14 days in session (capped at its end), +45 off season, pinned in replays."""
    s, e, t = col(scrape_end), col(session_end), col(today)
    in_session = F.least(F.greatest(s, F.date_add(t, FORWARD_DAYS)), e)
    return F.when(~col(live), s).when(e < t, F.date_add(t, INTERIM_DAYS)).otherwise(in_session)


def quiet_minutes(start, end, offset_hours: int = -5) -> Column:
    """Minutes of [start, end) inside the nightly quiet window, in fixed-offset local time.

    Closed form: quiet time elapsed since the epoch is a step function of local time, so the overlap is a
    difference of two such values; no per-minute expansion.
    """
    night = (24 - QUIET_START + QUIET_END) * 60.0

    def elapsed(ts):
        local = micros(ts) / 60e6 + offset_hours * 60 - QUIET_START * 60
        days = F.floor(local / 1440.0)
        return days * night + F.least(local - days * 1440.0, F.lit(night))

    return F.greatest(elapsed(end) - elapsed(start), F.lit(0.0))


def business_days_since(day, today) -> Column:
    """Weekdays after ``day`` up to and including ``today``."""
    d, t = col(day), col(today)
    weekday_ordinal = lambda x: (F.floor(F.datediff(x, F.lit("1970-01-05").cast("date")) / 7) * 5
                                 + F.least(F.pmod(F.datediff(x, F.lit("1970-01-05").cast("date")), F.lit(7)), F.lit(4)))
    return F.greatest(weekday_ordinal(t) - weekday_ordinal(d), F.lit(0)).cast("bigint")
