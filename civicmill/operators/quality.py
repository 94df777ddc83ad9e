"""Sizing, conservation, discrepancy and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from civicmill.functions import classify as K
from civicmill.functions import ids as I


def n(alias: str = "n"):
    return F.count(F.lit(1)).alias(alias)


def vote_breakdown(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Counts per vote code reduced to a tally; 'aye with reservations' is an aye."""
    count = lambda c: F.count_if(F.col(code) == c)
    g = rows.groupBy(key).agg((count("AYE") + count("AYEWR")).alias("yes"), count("NAY").alias("no"), n())
    return g.withColumn("tally", F.when(F.col("n") > 0, F.format_string("%d-Y %d-N", "yes", "no")).otherwise(""))


def blind_dates(outages: DataFrame, actions: DataFrame, witnessed: DataFrame) -> DataFrame:
    """Dates with recorded actions inside an outage and no evidence in the change feed."""
    days = outages.select(F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("date")).distinct()
    return actions.join(days, "date", "left_semi").join(witnessed.select("date").distinct(), "date", "left_anti")


def conservation(received: DataFrame, written: DataFrame, dropped: dict[str, DataFrame]) -> DataFrame:
    """Rows in, rows out and rows dropped by reason; the residual must be zero."""
    out = received.agg(n("rows_in")).withColumn("rows_written", written.agg(n()).scalar())
    total = F.col("rows_written")
    for name, df in dropped.items():
        out = out.withColumn(name, df.agg(n()).scalar())
        total = total + F.col(name)
    return out.withColumn("residual", F.col("rows_in") - total)


def conserved_write(received: DataFrame, keys: list[str], order: str, drops: dict[str, Column], path: str) -> DataFrame:
    """Writes the first row of each key of what no drop takes, and accounts for every row: one job, one scan.

    A row goes by the first condition of ``drops`` that holds. Each stage counts its rows while it runs, so the figures
    are of the rows that were written and cannot come from a second reading of a source that has changed.
    """
    why = F.lit(None).cast("string")
    for name, condition in reversed(drops.items()):
        why = F.when(condition, name).otherwise(why)
    taken, kept = Observation(), Observation()
    marked = received.withColumn("_why", why)
    seen = marked.observe(taken, n("rows_in"), *[F.count_if(F.col("_why") == name).alias(name) for name in drops])
    rest = [c for c in received.columns if c not in keys]
    first = seen.filter("_why IS NULL").groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"), n("_copies"))
    counted = first.observe(kept, n("rows_written"), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))
    counted.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).write.mode("overwrite").parquet(path)
    figures = taken.get | kept.get
    figures["residual"] = figures["rows_in"] - sum(v for k, v in figures.items() if k != "rows_in")
    return received.sparkSession.createDataFrame([tuple(figures.values())], ", ".join(f"{k} bigint" for k in figures))


def sizing(rows: DataFrame, key: str, gate) -> DataFrame:
    """Rows and keys in scope, share that passes the gate, average per key."""
    per = rows.groupBy(key).agg(n("rows"), F.count_if(gate).alias("gated"))
    g = per.agg(F.sum("rows").alias("rows"), n("keys"), F.sum("gated").alias("gated"), F.count_if(F.col("gated") > 0).alias("keys_gated"))
    return g.withColumn("gated_share", K.safe_rate("gated", "rows")).withColumn("per_key", F.round(F.col("rows") / F.col("keys"), 4))


def key_collisions(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that carry more than one distinct value."""
    d = rows.select(*keys, *values).distinct()
    return d.groupBy(*keys).agg(n("variants")).filter(F.col("variants") > 1)


def archive_overlap(ids: DataFrame, session: str, key: str) -> DataFrame:
    """Identifier overlap of each session with its predecessor. Linear: every id meets itself one session later."""
    d = ids.select(F.col(session).alias("session"), F.col(key).alias("id")).distinct()
    names = d.groupBy("session").agg(n("size"))
    nxt = names.select(F.col("session").alias("later"), F.col("size").alias("later_size")).withColumn("session", F.col("later") - 1)
    both = d.join(d.select((F.col("session") - 1).alias("session"), "id"), ["session", "id"], "left_semi").groupBy("session").agg(n("shared"))
    out = names.join(nxt, "session").join(both, "session", "left").na.fill(0, ["shared"])
    least = F.least("size", "later_size")
    return out.select("session", "later", "size", "later_size", "shared", F.round(F.col("shared") / least, 4).alias("overlap"), ((F.col("shared") == F.col("size")) & (F.col("size") == F.col("later_size"))).alias("duplicate"))


# Phrases of an action taken in a meeting, and clerical ones that override them.
MEETING_PHRASES = ("reported from", "recommends reporting", "recommends continuing", "recommends passing", "recommends laying", "recommends defeating", "recommends striking",
                   "committee amendment offered", "committee substitute offered", "subcommittee substitute offered", "subcommittee amendment offered", "committee offered",
                   "subcommittee offered", "continued to next session", "continued to 2027", "passed by for the day", "passed by indefinitely", "engrossed", "read first time",
                   "read second time", "read third time", "constitutional reading dispensed", "taken up", "laid on the table", "stricken from docket", "block vote", "voice vote",
                   "rules suspended")
CLERICAL_PHRASES = ("placed on ", "assigned ", "referred to", "rereferred", "transmitted to", "enrolled", "approved by", "signed by", "fiscal impact statement",
                    "fiscal impact statement from", "prefiled", "printed for", "committee substitute printed", "incorporates", "communicated", "enrolled bill", "scheduled",
                    "continued to 2027 in")


def is_meeting_action(c) -> Column:
    """A meeting phrase occurs and no clerical one: a filing that mentions an action is no action."""
    text = F.lower(F.coalesce(F.col(c), F.lit("")))
    return K.contains_any(text, MEETING_PHRASES) & ~K.contains_any(text, CLERICAL_PHRASES)


def three_way(sheet: DataFrame, truth: DataFrame, history: DataFrame) -> DataFrame:
    """Findings of published rows against two independent sources, counted per (bill, date) by full outer join.

    ``sheet``: bill, date, outcome, committee, time. ``truth``: bill, date, action. ``history``: bill, date, action.
    """
    verb = is_meeting_action
    ledger = F.col("committee") == "Ledger Updates"
    unmatched = ~ledger & F.col("time").rlike("NO_SCHEDULE_MATCH|NO_CONVENE_ANCHOR")
    real = ~F.lower(I.blank("outcome")).isin("", "none", "scheduled")
    s = sheet.groupBy("bill", "date").agg(
        n("sheet_rows"), F.count_if(ledger & verb("outcome")).alias("meeting_in_ledger"), F.count_if(unmatched & verb("outcome")).alias("no_match_meeting"),
        F.count_if(unmatched & ~verb("outcome")).alias("no_match_admin"), F.count_if(real).alias("real_rows"))
    tr = truth.groupBy("bill", "date").agg(n("truth_rows"), F.count_if(verb("action")).alias("truth_meetings"))
    h = history.groupBy("bill", "date").agg(n("history_rows"), F.count_if(verb("action")).alias("history_meetings"))
    both = s.join(tr, ["bill", "date"], "full").join(h, ["bill", "date"], "full").na.fill(0)
    none = (F.col("truth_rows") == 0) & (F.col("history_rows") == 0)
    return both.withColumn("phantom", F.when(none, F.col("real_rows")).otherwise(0)).withColumn("drift", ((F.col("sheet_rows") == 0) & (F.col("truth_meetings") > 0)).cast("int"))


def three_way_summary(per_day: DataFrame) -> DataFrame:
    by_bill = per_day.groupBy("bill").agg(F.sum("sheet_rows").alias("s"), F.sum("history_rows").alias("h"), F.sum("history_meetings").alias("hm"), *[F.sum(c).alias(c) for c in (
        "meeting_in_ledger", "no_match_meeting", "no_match_admin", "phantom", "drift")])
    return by_bill.agg(F.count_if((F.col("s") == 0) & (F.col("hm") > 0)).alias("missing_bill"), *[F.sum(c).cast("bigint").alias(c) for c in (
        "meeting_in_ledger", "no_match_meeting", "no_match_admin", "phantom", "drift")], F.count_if(F.col("h") > 0).alias("universe"), F.count_if(F.col("s") > 0).alias("sheet_bills"),
        F.count_if((F.col("s") > 0) & (F.col("h") > 0)).alias("overlap"))


def health_findings(counters: DataFrame) -> DataFrame:
    """Findings with count and denominator from one row of counters, and the worst severity."""
    rules = [("CRITICAL", "MALFORMED_BILL_ID", "malformed", "seen"), ("WARN", "UNKNOWN_STRUCTURAL_OUTCOME", "unresolved", "written"), ("WARN", "UNKNOWN_CHAMBER_VALUE", "unknown_chamber", "written"),
             ("WARN", "SOURCE_URL_MISSING_SESSION", "no_session", "written"), ("WARN", "MISSING_ACTION_TEXT", "no_text", "written")]
    hit = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), F.col(c).alias("count"), F.col(d).alias("denominator"))) for sev, code, c, d in rules]))
    worst = F.when(F.exists("f", lambda x: x["severity"] == "CRITICAL"), "CRITICAL").when(F.exists("f", lambda x: x["severity"] == "WARN"), "WARN").otherwise("INFO")
    return counters.withColumn("f", hit).withColumn("status", worst).select("status", F.explode_outer("f").alias("x")).select("status", "x.severity", "x.code", "x.count", "x.denominator")
