"""Calendar rows: meetings, sessions, gates, diagnostics, windows of activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.functions import text as T
from civicmill.functions import times as C
from civicmill.session import cut_lineage

META_ORIGINS = ("system_alert", "system_metrics")
NOT_MEETINGS = ("Ledger Updates", "Governor")
BILL_SHAPE = r"^[HS][BJR]\d+$"


def n(alias: str = "n") -> Column:
    return F.count(F.lit(1)).alias(alias)


def blank_label(c, label: str = "blank") -> Column:
    t = F.lower(I.blank(c))
    return F.when(t == "", label).otherwise(t)


# --- meetings ---------------------------------------------------------------------------------------------------
def meeting_rows(calendar: DataFrame) -> DataFrame:
    kept = calendar.filter(~F.col("origin").isin(*META_ORIGINS) & (I.blank("committee") != "") & ~F.col("committee").isin(*NOT_MEETINGS))
    bill = I.compact_key("bill")
    return kept.withColumn("item", F.when(bill.rlike(BILL_SHAPE), bill)).withColumn("concrete", C.is_concrete_time("time"))


def meetings(calendar: DataFrame) -> DataFrame:
    """One row per (day, committee, time slot). A concrete time beats a placeholder, any unresolved row marks
    the meeting, and a cancelled slot is dropped only when no row records that it was held."""
    rows = meeting_rows(calendar).withColumn("_m", C.sort_minutes("time", "sort_time"))
    shown = F.struct(C.clean_time("time").alias("time"), F.col("_m").alias("minutes"))
    note = F.when(F.col("item").isNull() & (I.blank("bill") != "") & (F.lower(I.blank("bill")) != "no agenda listed."), C.clean_time("bill"))
    first = lambda value, present: F.min_by(value, F.when(present, F.col("event_id")))
    g = rows.groupBy("date", "committee", "sort_time").agg(
        first(shown, F.col("concrete")).alias("clock"), first(F.col("_m"), F.lit(True)).alias("slot"), first(note, note.isNotNull() & (note != "")).alias("note"),
        F.bool_or(F.lower(I.blank("time_class")) == "relative_unresolved").alias("unresolved"),
        F.bool_or(F.lower(I.blank("status")) == "cancelled").alias("cancelled"), F.bool_or(F.lower(I.blank("route")) == "meeting").alias("held"),
        F.count_distinct("item").alias("bills"), F.coalesce(first(F.col("agenda_url"), F.col("agenda_url") != ""), F.lit("")).alias("agenda_url"))
    name = F.col("committee")
    chamber = F.when(name.startswith("House"), "House").when(name.startswith("Senate"), "Senate")
    return g.filter(~(F.col("cancelled") & ~F.col("held"))).select(
        "date", "committee", "sort_time", chamber.alias("chamber"), K.meeting_kind("committee").alias("kind"),
        F.coalesce("clock.time", "note", F.lit("Time TBA")).alias("time"), F.col("clock").isNull().alias("tba"),
        F.coalesce("clock.minutes", "slot").alias("minutes"), "unresolved", "bills", "agenda_url")


def meeting_bills(calendar: DataFrame) -> DataFrame:
    """Distinct bills of every kept meeting with their first action, as rows rather than a nested list."""
    kept = meetings(calendar).select("date", "committee", "sort_time", "time", "tba", "minutes", "unresolved")
    items = meeting_rows(calendar).filter("item IS NOT NULL").groupBy("date", "committee", "sort_time", F.col("item").alias("bill")).agg(
        F.min_by(F.trim("outcome"), "event_id").alias("action"))
    return items.join(kept, ["date", "committee", "sort_time"])


def collapse_floor_sessions(meets: DataFrame) -> DataFrame:
    """One card per day and chamber for floor markers. Flags are unions; links come from the earliest that has one.

    Markers of one chamber and day are its distinct slots, a few dozen at most.
    """
    floor = (F.col("kind") == "floor") & F.col("chamber").isNotNull()
    order = F.struct("minutes", "committee", "sort_time")
    cards = meets.filter(floor).groupBy("date", "chamber").agg(
        F.min_by("committee", order).alias("committee"), F.min_by("time", order).alias("time"), F.min("minutes").alias("minutes"),
        F.bool_and("tba").alias("tba"), F.bool_or("unresolved").alias("unresolved"), F.count(F.lit(1)).alias("markers"),
        F.coalesce(F.min_by("agenda_url", F.when(F.col("agenda_url") != "", order)), F.lit("")).alias("agenda_url"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("minutes", "committee", "sort_time"))), lambda m: m["committee"]), ">").alias("sequence"))
    cards = cards.withColumn("kind", F.lit("floor"))
    rest = meets.filter(~F.coalesce(floor, F.lit(False))).select(
        "date", "chamber", "committee", "time", "minutes", "tba", "unresolved", F.lit(0).cast("bigint").alias("markers"), "agenda_url", F.lit("").alias("sequence"), "kind")
    return cards.unionByName(rest)


def next_meetings(bills: DataFrame, items: DataFrame, today: str) -> DataFrame:
    """Earliest meeting on or after ``today`` that lists the bill; unplaceable ones first inside a day."""
    ahead = items.filter(F.col("date") >= today).join(bills.select("bill"), "bill", "left_semi")
    order = F.struct("date", (~F.col("unresolved")).alias("u"), "minutes", "committee", "sort_time")
    return ahead.groupBy("bill").agg(F.min_by(F.struct("date", "committee", "time"), order).alias("m")).select("bill", "m.date", "m.committee", "m.time")


def action_key(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(I.col(c), F.lit("")), r"\s+", " ")))


def timed_feed(feed: DataFrame, items: DataFrame) -> DataFrame:
    """Feed rows with the clock of their meeting where one is certain."""
    certain = items.filter(~F.col("tba") & ~F.col("unresolved")).groupBy("date", "bill", action_key("action").alias("_k")).agg(
        F.max_by(F.struct("time", "minutes"), F.struct("minutes", "committee", "sort_time")).alias("_t"))
    joined = feed.withColumn("_k", action_key("action")).join(certain, ["date", "bill", "_k"], "left")
    return joined.select(*feed.columns, F.col("_t.time").alias("clock"), F.col("_t.minutes").alias("clock_minutes"))


# --- diagnostics ------------------------------------------------------------------------------------------------
def classed(calendar: DataFrame) -> DataFrame:
    return calendar.withColumn("cls", K.action_class()).withColumn("has_time", C.is_concrete_time("time"))


def class_time_matrix(calendar: DataFrame) -> DataFrame:
    """Class by has-time counts over legislative rows, with totals."""
    rows = classed(calendar.filter(F.upper(I.blank("source")) != "SYSTEM"))
    m = rows.rollup("cls").agg(F.count_if("has_time").alias("with_time"), F.count_if(~F.col("has_time")).alias("without_time"), n("total"))
    return m.select(F.coalesce("cls", F.lit("all")).alias("cls"), "with_time", "without_time", "total")


def tag_counts(rows: DataFrame, column: str, tags: Sequence[str]) -> DataFrame:
    """Rows that contain each tag, one pass."""
    one = rows.agg(*[F.count_if(F.coalesce(F.col(column).contains(t), F.lit(False))).alias(t) for t in tags])
    return one.unpivot([], list(tags), "tag", "n")


def accuracy_gates(calendar: DataFrame, today: str, *, min_resolution: float = 0.70, min_coverage: float = 0.95, max_timeless: int = 0,
                   max_unconfirmed: int = 50, max_derived: int = 50, max_stale_days: int = 3) -> DataFrame:
    """All counts, rates and verdicts in one aggregation. Timeless meetings count only once their date has come."""
    system = F.upper(I.blank("source")) == "SYSTEM"
    rows = classed(calendar).withColumn("leg", ~system)
    leg = F.col("leg")
    timeless = leg & (F.col("cls") == "meeting") & ~F.col("has_time")
    routable = leg & (F.upper(I.blank("source")) == "CSV")
    g = rows.agg(
        F.count_if(leg).alias("rows"), F.count_if(~leg).alias("system_rows"), F.count_if(leg & (F.col("cls") == "meeting")).alias("meetings"),
        F.count_if(timeless & (F.col("date") <= today)).alias("timeless_past"), F.count_if(timeless & (F.col("date") > today)).alias("timeless_future"),
        F.count_if(leg & (F.col("cls") == "unconfirmed")).alias("unconfirmed"), F.count_if(leg & (F.col("cls") == "executive")).alias("executive"),
        F.count_if(leg & (F.col("origin") == "derived_standing")).alias("derived"), F.count_if(routable).alias("routable"),
        F.count_if(routable & (I.blank("route") != "")).alias("routed"), F.max(F.when(leg & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date"))).alias("newest"))
    g = g.withColumn("resolution", K.safe_rate("routed", "routable")).withColumn("coverage", K.safe_rate(F.col("rows") - F.col("unconfirmed"), "rows"))
    g = g.withColumn("stale_days", C.business_days_since(F.col("newest").try_cast("date"), F.lit(today).cast("date")))
    fails = [(F.col("rows") == 0, "empty"), (F.col("timeless_past") > max_timeless, "timeless"), (F.col("unconfirmed") > max_unconfirmed, "unconfirmed"),
             (F.col("derived") > max_derived, "derived"), (F.col("resolution") < min_resolution, "resolution"), (F.col("coverage") < min_coverage, "coverage"),
             (F.coalesce(F.col("stale_days") > max_stale_days, F.lit(True)), "stale")]
    return g.withColumn("failed", F.array_join(F.array_compact(F.array(*[F.when(c, name) for c, name in fails])), ","))


def publish_breaker(calendar: DataFrame, last_good: DataFrame, valid_origins: Sequence[str]) -> DataFrame:
    """Whether an overwrite must be refused: violation rate and count, growth of unsourced meetings, absolute ceiling."""
    violation = ~F.col("origin").isin(*valid_origins) | (F.col("origin").isin("api_schedule", "convene_anchor", "legislation_event") & F.col("time").startswith("⏱"))
    unsourced = (F.col("route") == "meeting") & F.col("origin").isin("journal_default", "floor_miss")
    g = calendar.agg(n("rows"), F.count_if(violation).alias("violations"), F.count_if(unsourced).alias("unsourced"))
    g = g.withColumn("baseline", last_good.select(F.max("unsourced")).scalar())
    rate, delta = F.col("violations") / F.col("rows"), F.col("unsourced") - F.col("baseline")
    why = F.array_compact(F.array(F.when(rate > 0.10, "rate"), F.when(F.col("violations") >= 50, "violations"),
                                  F.when((F.coalesce("baseline", F.lit(0)) > 0) & (delta > 25), "delta"), F.when(F.col("unsourced") > 500, "ceiling")))
    return g.select("rows", "violations", "unsourced", "baseline", F.array_join(why, ",").alias("reasons"), (F.size(why) > 0).alias("refuse"))


TIME_BUCKETS = ("exact_clock", "relative_time", "no_clock_source", "terminal_or_timeless", "source_gap")


def time_bucket(time) -> Column:
    t = F.lower(I.blank(time))
    return (F.when(C.clock_minutes(time).isNotNull(), "exact_clock").when(t.rlike("after|upon"), "relative_time").when(t == "", "no_clock_source")
            .when(t.isin("journal entry", "ledger"), "terminal_or_timeless").otherwise("other"))


def bucket_accounting(rows: DataFrame, source: str) -> DataFrame:
    """Exclusive buckets per source; they must add up to the rows or the drift flag is set."""
    g = rows.withColumn("_b", time_bucket("time")).groupBy(source).agg(
        n("rows"), *[F.count_if(F.col("_b") == b).alias(b) for b in TIME_BUCKETS], F.count_if(~F.col("_b").isin(*TIME_BUCKETS)).alias("unknown_time_bucket"),
        F.count_if(I.compact_key("bill").rlike(BILL_SHAPE)).alias("with_bill"))
    total = sum((F.col(b) for b in TIME_BUCKETS), F.lit(0))
    return g.withColumn("denominator", total).withColumn("drift", (F.col("denominator") != F.col("rows")).cast("int"))


def audit_rollup(accounts: DataFrame) -> DataFrame:
    """Totals over sources and the worst severity of their findings."""
    g = accounts.agg(n("sources"), F.sum("rows").alias("rows"), *[F.sum(b).alias(b) for b in TIME_BUCKETS], F.sum("unknown_time_bucket").alias("unknown_time_bucket"),
                     F.sum("drift").alias("drifting"), F.count_if(F.col("rows") == 0).alias("gaps"))
    status = F.when(F.col("drifting") > 0, "CRITICAL").when((F.col("gaps") > 0) | (F.coalesce("rows", F.lit(0)) == 0), "WARN").otherwise("INFO")
    return g.withColumn("status", status)


def router_cross_check(calendar: DataFrame, text_class: Column) -> DataFrame:
    """Of the rows a text rule flags as timeless meetings, the share per structural verdict; unseen verdicts show as such."""
    flagged = calendar.filter((text_class == "meeting") & ~C.is_concrete_time("time"))
    g = flagged.groupBy(blank_label("route").alias("verdict")).agg(n())
    total = flagged.agg(n("total")).scalar()
    return g.withColumn("total", total).select("verdict", "n", K.safe_rate("n", "total").alias("share"), (~F.col("verdict").isin("admin", "meeting", "blank")).alias("unseen"))


def code_profile(events: DataFrame, route: str = "route") -> tuple[DataFrame, DataFrame]:
    """Per event code: volume, chambers, real times, cross counts; and up to three sample descriptions."""
    code = I.blank("event_code")
    rows = events.filter(code != "").withColumn("code", code)
    main = rows.groupBy("code").agg(
        n(), F.count_if(C.has_real_time("event_date")).alias("real_time"), F.count_if(F.col(route) == "meeting").alias("meeting"),
        F.count_if(F.col(route) == "admin").alias("admin"), F.count_if(F.col(route) == "executive").alias("executive"),
        F.concat_ws("/", F.max(F.when(F.col("chamber") == "H", "H")), F.max(F.when(F.col("chamber") == "S", "S"))).alias("chambers"))
    return main, scale.samples(rows.filter(I.blank("description") != ""), ["code"], "description", 3, "samples")


def verdict_distribution(routed: DataFrame, k: int = 5) -> DataFrame:
    """Volume per (route, reason) with the first k distinct code samples."""
    g = routed.groupBy("route", "reason").agg(n())
    return g.join(scale.samples(routed.withColumn("code", I.blank("event_code")), ["route", "reason"], "code", k, "samples"), ["route", "reason"])


def residual_triage(calendar: DataFrame, tokens: Sequence[str], first: str, last: str) -> DataFrame:
    """Placeholder rows in the ledger bucket: per action prefix, how many, and whether a known verb covers it."""
    rows = classed(calendar.filter(F.col("date").between(first, last) & (F.col("committee") == "Ledger Updates"))).filter(~F.col("has_time"))
    prefix = F.lower(F.array_join(F.slice(T.words("outcome"), 1, 2), " "))
    return rows.groupBy("cls", prefix.alias("prefix")).agg(n()).withColumn("covered", K.contains_any(F.col("prefix"), tokens))


def published_safety(published: DataFrame, resolved: DataFrame) -> DataFrame:
    """Keys with a published clock that resolve to something else. Clocks are distinct rows, never lists."""
    clocks = published.select("date", "name", "minutes").distinct()
    keys = clocks.select("date", "name").distinct()
    hits = resolved.join(clocks, ["date", "name", "minutes"], "left_semi").select("date", "name").distinct().withColumn("_ok", F.lit(1))
    joined = keys.join(resolved.select("date", "name").distinct().withColumn("_seen", F.lit(1)), ["date", "name"], "left").join(hits, ["date", "name"], "left")
    return joined.agg(n("keys"), F.count_if(F.col("_ok").isNull()).alias("violations"), F.count_if(F.col("_seen").isNull()).alias("unresolved"))


# --- alerts, incidents, freshness ----------------------------------------------------------------------------------
def alert_source(origin) -> Column:
    return F.when(I.col(origin).startswith("bill_"), "bill").otherwise("calendar")


def conditions(log: DataFrame, tolerance_minutes: int = 6) -> DataFrame:
    """Recurring alerts as conditions; active while they fired in their own source's latest cycle."""
    src = log.filter(F.col("origin").isin("system_alert", "system_metrics", "bill_system_alert", "bill_system_metrics")).withColumn("source", alert_source("origin"))
    cycle = src.groupBy("source").agg(F.max("ts").alias("cycle_ts"))
    alerts = src.filter(F.col("origin").endswith("_alert"))
    for name, column in K.parse_message("outcome", "status").items():
        alerts = alerts.withColumn(f"_{name}", column)
    g = alerts.groupBy("source", F.col("_severity").alias("severity"), F.col("_category").alias("category"), K.condition_stem("_message").alias("stem")).agg(
        n(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("_message", F.struct("ts", "event_id")).alias("message"))
    g = g.join(cycle, "source", "left")
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARN", 1).when(F.col("severity") == "INFO", 2).otherwise(3)
    return g.withColumn("active", F.col("last_ts") >= F.col("cycle_ts") - F.make_dt_interval(mins=F.lit(tolerance_minutes))).withColumn("severity_rank", rank)


NON_INCIDENT = ("_genesis", "_drill")


def clean_days(incidents: DataFrame, now: str) -> DataFrame:
    """Days since the last incident ended (or an open one began), with the length of the record beside it.

    ``incidents``: start, end (timestamps, end null while open), class. A row with data but no class column is
    malformed and counted.
    """
    cls, at = I.blank("cls"), F.lit(now).cast("timestamp")
    days = lambda ts: F.when(ts.isNotNull(), F.greatest(F.floor((C.micros(at) - C.micros(ts)) / 86400e6), F.lit(0))).cast("bigint")
    real = (cls != "") & ~cls.isin(*NON_INCIDENT)
    g = incidents.agg(
        F.max(F.when(F.col("cls").isNotNull() & (cls != "_drill"), F.coalesce("end", "start"))).alias("latest"), F.min(F.when(cls == "_genesis", F.col("start"))).alias("genesis"),
        F.count_if(real).alias("incidents_ever"), F.count_if(real & F.col("end").isNull()).alias("open_now"), F.max(F.when(cls == "_drill", F.col("start"))).alias("drill"),
        F.count_if(F.col("cls").isNull()).alias("malformed_rows"))
    return g.select(days(F.col("latest")).alias("days_clean"), days(F.col("genesis")).alias("monitoring_days"), "incidents_ever", "open_now",
                    days(F.col("drill")).alias("last_drill_days"), "malformed_rows")


def outages(signals: DataFrame) -> DataFrame:
    """One row per outage of a (cls, detector): from its first failure to the next pass; open ones have no end.

    Each failure belongs to the passes seen before it; the pass that follows closes the group.
    """
    counted = scale.running(signals, ["cls", "detector"], ["ts", "event_id"], sums={"passes": F.when(F.col("ok"), 1).otherwise(0).cast("bigint")})
    groups = counted.groupBy("cls", "detector", "passes").agg(F.min(F.when(~F.col("ok"), F.col("ts"))).alias("start"), F.count_if(~F.col("ok")).alias("failures"),
                                                            F.min(F.when(F.col("ok"), F.col("ts"))).alias("pass_ts"))
    closing = groups.select("cls", "detector", (F.col("passes") - 1).alias("passes"), F.col("pass_ts").alias("end"))
    return groups.filter("start IS NOT NULL").join(closing, ["cls", "detector", "passes"], "left").select("cls", "detector", "start", "end", "failures")


def freshness(log: DataFrame, now: str) -> DataFrame:
    """Age of the newest row per source, in minutes."""
    at = C.micros(F.lit(now).cast("timestamp"))
    g = log.withColumn("source", alert_source("origin")).groupBy("source").agg(F.max("ts").alias("last"), n("rows"))
    return g.select("source", F.round((at - C.micros("last")) / 60e6, 3).alias("age_minutes"), "rows")


# --- cycles and windows of activity --------------------------------------------------------------------------------
def delta_alarm(prior, current, prior_universe, current_universe) -> Column:
    """Growth of the unverified population beyond what the universe explains. No baseline, no alarm."""
    p, c = I.col(prior), I.col(current)
    explained = F.coalesce(F.greatest(I.col(current_universe) - I.col(prior_universe), F.lit(0)), F.lit(0))
    both = I.col(current_universe).isNotNull() & I.col(prior_universe).isNotNull()
    rise = c - p - F.when(both, explained).otherwise(0)
    return F.coalesce((c > p) & (rise > 0) & ((rise >= 25) | (rise >= F.greatest(p, F.lit(10)))), F.lit(False))


def cycle_gaps(runs: DataFrame, keys: Sequence[str], *, warn: float = 360, stale_days: int = 30, offset_hours: int = -5) -> DataFrame:
    """Minutes since the previous cycle with its cause and the overnight quiet part removed."""
    lagged = scale.running(runs, list(keys), ["ts", "event_id"], lags={"prev_ts": F.col("ts")})
    gap = (C.micros("ts") - C.micros("prev_ts")) / 60e6
    quiet = C.quiet_minutes("prev_ts", "ts", offset_hours)
    cause = (F.when(F.col("prev_ts").isNull(), "first_run").when(gap > stale_days * 1440, "stale_cursor").when(gap - quiet > warn, "outage").otherwise("normal"))
    return lagged.withColumn("gap_minutes", gap).withColumn("quiet_minutes", F.when(F.col("prev_ts").isNotNull(), quiet)).withColumn("cause", cause)


def activity_windows(rows: DataFrame, now: str, *, lead: int = 30, tail: int = 120, horizon_hours: int = 36) -> tuple[DataFrame, DataFrame]:
    """Merged [meeting - lead, meeting + tail] spans ahead of ``now``, and the count of every row not used."""
    at = F.lit(now).cast("timestamp")
    minutes = lambda m: F.make_dt_interval(mins=F.lit(m))
    ts = F.concat_ws(" ", "date", "sort_time").try_cast("timestamp")
    spans = rows.select(ts.alias("t")).withColumn("start", F.col("t") - minutes(lead)).withColumn("end", F.col("t") + minutes(tail))
    fate = (F.when(F.col("t").isNull(), "skipped").when(F.col("end") < at, "dropped_past")
            .when(F.col("start") > at + F.make_dt_interval(hours=F.lit(horizon_hours)), "dropped_horizon").otherwise("kept"))
    spans = spans.withColumn("fate", fate)
    counts = spans.groupBy("fate").agg(n())
    return merge_spans(spans.filter("fate = 'kept'").select("start", "end")), counts


def merge_spans(spans: DataFrame) -> DataFrame:
    """Fewest spans covering the same time. Equal spans are folded first; one running maximum, no range join."""
    distinct = spans.groupBy("start").agg(F.max("end").alias("end"))
    seen = scale.running(distinct, [], ["start"], maxima={"reach": F.col("end")})
    marked = seen.withColumn("_new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0).cast("bigint")).drop("reach")
    island = scale.running(marked, [], ["start"], sums={"island": F.col("_new")})
    return island.groupBy("island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def tiers(instants: DataFrame, windows: DataFrame) -> DataFrame:
    """IN_WINDOW, IDLE or EMPTY per instant. Windows meet instants by the hours they cover."""
    hours = windows.select("start", "end", F.explode(F.sequence(F.date_trunc("hour", "start"), F.date_trunc("hour", "end"), F.expr("interval 1 hour"))).alias("_h"))
    inside = instants.withColumn("_h", F.date_trunc("hour", "ts")).join(hours, "_h").filter(F.col("ts").between(F.col("start"), F.col("end"))).select("event_id").distinct().withColumn("_in", F.lit(True))
    last = windows.agg(F.max("end")).scalar()
    tier = F.when(F.col("_in"), "IN_WINDOW").when(last >= F.col("ts"), "IDLE").otherwise("EMPTY")
    return instants.join(inside, "event_id", "left").withColumn("tier", tier).drop("_in")


FLOORS = {"IN_WINDOW": 0, "IDLE": 55, "EMPTY": 175}


def should_run(now, last_run, tier, floors: dict[str, int] = FLOORS) -> Column:
    """Run unless the tier's floor has not elapsed; a missing or future marker always runs."""
    floor = F.try_element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), I.col(tier))
    elapsed = (C.micros(now) - C.micros(last_run)) / 60e6
    return I.col(last_run).isNull() | (elapsed < 0) | (elapsed >= F.coalesce(floor, F.lit(0)))


def metric_series(log: DataFrame, key: str, per: str | None = None) -> DataFrame:
    """Numeric points of one metric, or of a percentage of two; points without a usable value are absent."""
    m = log.withColumn("_m", K.metrics_map("outcome"))
    value = F.try_element_at("_m", F.lit(key))
    if per:
        base = F.try_element_at("_m", F.lit(per))
        value = F.when(base > 0, 100 * value / base)
    return m.select("event_id", "ts", value.alias("value")).filter("value IS NOT NULL")


# --- time resolution ---------------------------------------------------------------------------------------------
def resolution_ladder(rows: DataFrame, rungs: Sequence[tuple[str, DataFrame, Sequence[str]]], default: str | Column) -> DataFrame:
    """First rung that knows a time, with the rung's name as origin. Each rung has one row per key."""
    default = F.lit(default) if isinstance(default, str) else default
    out = rows
    for i, (name, table, keys) in enumerate(rungs):
        out = out.join(table.select(*keys, F.col("time").alias(f"_t{i}")), list(keys), "left")
    found = F.coalesce(*[F.when(F.col(f"_t{i}").isNotNull(), F.struct(F.col(f"_t{i}").alias("time"), F.lit(name).alias("origin")))
                         for i, (name, _, _) in enumerate(rungs)], F.struct(F.lit(None).cast("string").alias("time"), default.alias("origin")))
    return out.withColumn("_f", found).select(*rows.columns, F.col("_f.time").alias("resolved_time"), F.col("_f.origin").alias("resolved_origin"))


def parent_committee(name) -> Column:
    """The committee a subcommittee belongs to; null for a committee."""
    parent = F.trim(F.regexp_extract(name, r"^(.*?)\s+-\s+", 1))
    return F.when(parent != "", parent)


def agenda_hint(text) -> Column:
    """The committee whose agenda a text says the item was placed on; null if it says none."""
    hint = F.trim(F.regexp_extract(text, r"(?i)placed on (.+?) agenda", 1))
    return F.when(hint != "", hint)


def overlapping_names(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """(date, committee, time): names of one date of which one contains the other; the first scheduled name decides.

    Works on the distinct names of a date on both sides, of which there are as many as committees, not as rows.
    """
    asked = rows.select("date", "committee").filter("committee <> ''").distinct()
    named = schedule.select("date", F.col("committee").alias("name"), "time").distinct()
    met = asked.join(named, "date").filter(F.contains("name", "committee") | F.contains("committee", "name"))
    return met.groupBy("date", "committee").agg(F.min_by("time", "name").alias("time"))


def relative_chain(nodes: DataFrame) -> DataFrame:
    """Clock of every (date, name): published, or the anchor's clock plus an offset, through a chain of any length.

    ``nodes``: date, name, minutes (published, or null), anchor, offset. Published clocks never move. A zero
    offset becomes one minute so a chain stays ordered. Missing anchors and cycles stay unresolved. Chains
    are halved each round by pointer doubling, with a written table of the open rows per round, until no more resolve.
    """
    state = nodes.select("date", "name", "minutes", F.when(F.col("minutes").isNull(), F.col("anchor")).alias("anchor"),
                         F.when(F.coalesce("offset", F.lit(0)) == 0, 1).otherwise(F.col("offset")).cast("bigint").alias("offset"))
    is_open = F.col("minutes").isNull() & F.col("anchor").isNotNull()
    state = state.withColumn("minutes", F.col("minutes").cast("bigint"))
    settled, waiting, before = state.filter(~is_open), state.filter(is_open), None
    while True:
        ahead = settled.unionByName(waiting).select("date", F.col("name").alias("anchor"), F.col("minutes").alias("_m"), F.col("anchor").alias("_a"), F.col("offset").alias("_o"))
        moved = cut_lineage(waiting.join(ahead, ["date", "anchor"], "left").select(
            "date", "name", (F.col("_m") + F.col("offset")).cast("bigint").alias("minutes"),
            F.when(F.col("_m").isNull(), F.col("_a")).alias("anchor"), (F.col("offset") + F.coalesce("_o", F.lit(0))).alias("offset")))
        settled, waiting = settled.unionByName(moved.filter(~is_open)), moved.filter(is_open)
        still = waiting.count()
        if still == 0 or still == before:
            break
        before = still
    out = settled.unionByName(waiting)
    return out.select("date", "name", "minutes", F.when(F.col("minutes").isNull(), "relative_unresolved").otherwise("resolved").alias("time_class"))


def standing_pattern(observed: DataFrame, anchors: DataFrame, targets: DataFrame, first_minute: int = 420, last_minute: int = 1380) -> DataFrame:
    """Time assumed from a committee's usual offset to the day's anchor, flagged as derived, inside business hours."""
    offsets = observed.join(anchors, ["date", "chamber"]).groupBy("committee", (F.col("minutes") - F.col("anchor_minutes")).alias("offset")).agg(n())
    usual = offsets.groupBy("committee").agg(F.max_by("offset", F.struct("n", (-F.col("offset")).alias("o"))).alias("offset"))
    out = targets.join(usual, "committee", "left").join(anchors, ["date", "chamber"], "left").withColumn("_m", F.col("anchor_minutes") + F.col("offset"))
    ok = F.col("_m").between(first_minute, last_minute)
    return out.select(*targets.columns, F.when(ok, F.col("_m")).alias("derived_minutes"), F.when(ok, "derived_standing").otherwise("none").alias("derived_origin"))


# --- joins with the schedule ---------------------------------------------------------------------------------------
def join_gaps(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Timeless rows against the schedule by (date, committee key), typed. The last matching rule wins."""
    keyed = schedule.withColumn("key", T.strip_chars_key("owner")).groupBy("date", "key", "schedule_time").agg(F.min("owner").alias("owner"))
    joined = rows.withColumn("key", T.strip_chars_key("committee")).join(keyed, ["date", "key"], "left")
    vague = F.lower(I.blank("schedule_time")).isin(*C.NON_CONCRETE_SCHEDULE_TIMES)
    gap = (F.when(F.col("owner").isNull(), "no_lis_committee_match").when(vague, "lis_time_not_concrete").otherwise("sheet_missing_lis_has_time"))
    return joined.withColumn("gap_type", gap)


def completeness_gaps(required: DataFrame, covered: DataFrame, minimum: int) -> tuple[DataFrame, DataFrame]:
    """Required (code, date) pairs nobody covers, and a verdict that refuses to pass on a thin requirement."""
    need, have = required.select("code", "date").distinct(), covered.select("code", "date").distinct()
    missing = need.join(have, ["code", "date"], "left_anti")
    verdict = need.agg(n("required")).withColumn("gaps", missing.agg(n()).scalar())
    verdict = verdict.select("required", (F.col("required") - F.col("gaps")).alias("covered"), "gaps",
                             F.when(F.col("required") < minimum, "SOURCE_CHANGE").when(F.col("gaps") > 0, "FAIL").otherwise("PASS").alias("verdict"))
    return missing, verdict


def nearest_book(reports: DataFrame, books: DataFrame, tolerance: int = 2) -> DataFrame:
    """MATCH_SAMEDAY, MATCH_NEARBY, MISATTRIB or NO_BOOK per report.

    The date band becomes an equi-join: each book is offered at every offset within tolerance. Offers are
    reduced per report key before they meet the reports.
    """
    offers = books.select("committee", "bill", F.col("day").alias("book_day"), F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("off"))
    offers = offers.withColumn("day", F.date_add("book_day", F.col("off"))).withColumn("off", F.abs("off"))
    near = offers.groupBy("committee", "day").agg(F.min("off").alias("_near"))
    hit = offers.groupBy("committee", "day", "bill").agg(F.min("off").alias("_hit"))
    out = reports.join(near, ["committee", "day"], "left").join(hit, ["committee", "day", "bill"], "left")
    verdict = (F.when(F.col("_near").isNull(), "NO_BOOK").when(F.col("_hit") == 0, "MATCH_SAMEDAY").when(F.col("_hit").isNotNull(), "MATCH_NEARBY").otherwise("MISATTRIB"))
    return out.withColumn("verdict", verdict).withColumn("offset", F.col("_hit")).drop("_near", "_hit")


def linkage(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Best event per row by shared words, and the linkage class.

    ``rows``: row_id, bill, date, outcome, chamber. ``events``: event_id, bill, date, chamber, event_code,
    description, event_date. A blank event chamber fits both. X malformed, D no event, E no code, B would have
    been recovered, C otherwise.

    Rows with the same bill, day, chamber and wording share one comparison, and so do events; a day on which one
    bill collects very many copies costs one row per distinct wording on either side.
    """
    keys = ["bill", "date", "chamber", "outcome"]
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in keys]
    asked = rows.select("row_id", *text)
    distinct = asked.select(*keys).distinct().withColumn("_ok", (I.blank("bill") != "") & F.col("date").try_cast("date").isNotNull())
    kinds = events.groupBy("bill", "date", F.coalesce("chamber", F.lit("")).alias("_ec"), I.blank("event_code").alias("_code"), C.has_real_time("event_date").alias("_real"),
                           F.coalesce("description", F.lit("")).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.min("event_id").alias("_eid"))
    target = distinct.filter("_ok").withColumn("_w", T.subject_tokens("outcome"))
    met = target.join(kinds.withColumn("_ew", T.subject_tokens("_d")), ["bill", "date"]).filter((F.col("_ec") == "") | (F.col("chamber") == "") | (F.col("_ec") == F.col("chamber")))
    shared = F.when(F.col("_real"), F.size(F.array_intersect("_w", "_ew"))).otherwise(0)
    coded = F.when(F.col("_code") != "", F.col("_code"))
    g = met.withColumn("_s", shared).groupBy(*keys).agg(
        F.sum("_n").alias("matched"), F.count_distinct(coded).alias("codes"), F.bool_or("_real").alias("real_time"), F.max("_s").alias("overlap"),
        F.max_by(F.when(F.col("_s") > 0, F.col("_eid")), F.struct("_s", (-F.col("_eid")).alias("e"))).alias("best_event"))
    judged = distinct.join(g, keys, "left").na.fill(0, ["matched", "codes", "overlap"]).na.fill(False, ["real_time"])
    cls = (F.when(~F.col("_ok"), "X").when(F.col("matched") == 0, "D").when(F.col("codes") == 0, "E").when(F.col("real_time") & (F.col("overlap") > 0), "B").otherwise("C"))
    judged = judged.select(*keys, "matched", "codes", "real_time", "overlap", "best_event", cls.alias("linkage"))
    return asked.join(judged, keys).select("row_id", "matched", "codes", "real_time", "overlap", "best_event", "linkage")


def docket_times(names: DataFrame, scraped: DataFrame) -> DataFrame:
    """Time of the first scraped entry of the day that shares a longer word and not the opposite chamber."""
    words = F.array_except(F.array_distinct(T.words(F.regexp_replace(F.lower(F.col("name")), "house|senate|committee", ""))), F.array(*[F.lit(w) for w in ("of", "for", "and", "&", "-")]))
    w = names.select("date", "name", F.explode(F.filter(words, lambda x: F.length(x) > 3)).alias("word"))
    s = scraped.select("date", "place", "label", "time", F.explode(F.array_distinct(F.filter(T.words(F.lower(F.col("label"))), lambda x: F.length(x) > 3))).alias("word"))
    low, lab = F.lower("name"), F.lower("label")
    opposite = (low.contains("house") & lab.contains("senate")) | (low.contains("senate") & lab.contains("house"))
    met = w.join(s, ["date", "word"]).filter(~opposite).groupBy("date", "name").agg(F.min_by("time", F.struct("place", "label")).alias("time"))
    return names.select("date", "name").distinct().join(met, ["date", "name"], "left").withColumn("time", F.coalesce("time", F.lit("Time TBA")))
