"""Logical tables derived from the given tables.

Every definition is one list of expressions that both engines read; the few dialect differences are methods
of ``Dialect``. These are test inputs, not operators, so sharing them keeps the oracle about the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def ymd(self, c):
        return f"date_format({c}, 'yyyy-MM-dd')" if self.spark else f"strftime({c}, '%Y-%m-%d')"

    def mdy(self, c):
        return f"date_format({c}, 'MM/dd/yyyy')" if self.spark else f"strftime({c}, '%m/%d/%Y')"

    def hm(self, c):
        return f"date_format({c}, 'HH:mm')" if self.spark else f"strftime({c}, '%H:%M')"

    def hms(self, c):
        return f"date_format({c}, 'HH:mm:ss')" if self.spark else f"strftime({c}, '%H:%M:%S')"

    def ampm(self, c):
        return f"date_format({c}, 'hh:mm a')" if self.spark else f"strftime({c}, '%I:%M %p')"

    def pick(self, index, *values):
        body = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        if self.spark:
            return f"element_at(array({body}), cast({index} as int) + 1)"
        return f"([{body}])[cast({index} as int) + 1]"

    def div(self, a, b):
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def pad(self, c, n):
        return f"lpad(cast({c} as string), {n}, '0')"

    def rnd(self, c):
        return f"cast(round({c}) as bigint)"

    def head(self, c):
        pattern = r"^[^.;:\\n]+" if self.spark else r"^[^.;:\n]+"
        group = ", 0" if self.spark else ""
        return f"trim(regexp_extract({c}, '{pattern}'{group}))"


SPARK, DUCK = Dialect(True), Dialect(False)

TODAY = "2000-06-01"
NOUNS = ("Agriculture", "Commerce and Labor", "Courts of Justice", "Education", "Finance", "General Laws",
         "Health", "Local Government", "Privileges and Elections", "Public Safety", "Rules", "Transportation")
TITLES = ("Motor vehicle licenses; penalty.", "School boards; report.", "Commending the city library.",
          "Firearm transfers; record check; civil penalty.", "Income tax credit; sunset.",
          "Hospitals; advisory study of nurses.", "Zoning in the County of Ashford; definition of tenant.",
          "Solar energy facilities; local tax exemption, §§ 10.1-2 and § 58.", "Voter registration; technical amendments.",
          "Child custody; court fees; repeal.", "Broadband utility; pilot.", "General provisions of law")
STATUSES = ("Approved by Governor-Chapter 12", "Vetoed by Governor", "Passed by indefinitely", "Continued to next session",
            "Failed to report", "In Committee", "Passed House", "Introduced", "Reported from committee",
            "Prefiled and referred to committee", "Enrolled", "Passed Senate", "Conference report passed",
            "Left in committee", "Awaiting Governor action")


def _committee(d, k):
    return f"concat(case when {k} % 2 = 0 then 'House ' else 'Senate ' end, {d.pick(d.div(k, 2), *NOUNS)})"


def _code(d, k):
    return f"concat(case when {k} % 2 = 0 then 'H' else 'S' end, {d.pad(d.div(k, 2) + ' + 1', 2)})"


def _bill(key):
    return f"concat(case when {key} % 2 = 0 then 'HB' else 'SB' end, cast({key} as string))"


def bills(d):
    combo = "(case o_orderstatus when 'F' then 0 when 'O' then 5 else 10 end + cast(substr(o_orderpriority, 1, 1) as int) - 1)"
    k = "(o_custkey % 24)"
    return "orders", [
        ("num", "o_orderkey"), ("bill", _bill("o_orderkey")),
        ("raw_id", f"concat(' ', lower(substr({_bill('o_orderkey')}, 1, 2)), ' ', {d.pad('o_orderkey', 9)})"),
        ("session", "cast(year(o_orderdate) as string)"), ("year", "cast(year(o_orderdate) as int)"),
        ("intro", d.ymd("o_orderdate")), ("month", "cast(month(o_orderdate) as int)"),
        ("patron_id", "o_custkey"), ("patron", f"concat('P', cast(o_custkey as string))"),
        ("title", d.pick("o_custkey % 12", *TITLES)), ("status", d.pick(combo, *STATUSES)),
        ("committee", _committee(d, k)), ("committee_code", _code(d, k)),
        ("last_actid", f"concat({_code(d, k)}, 'L', {d.pad('o_orderkey % 100', 2)})"),
        ("vetoed", f"case when {combo} = 1 then 'Y' else '' end"),
        ("approved", f"case when {combo} = 0 then ' y ' else 'N' end"),
        ("chapter_id", f"case when {combo} in (0, 10) and o_orderkey % 4 = 0 then 'CH12' else '  ' end"),
        ("carried_over", f"case when {combo} = 3 then 'Y' else '' end"),
        ("failed", f"case when {combo} = 2 or ({combo} = 13 and o_custkey % 2 = 0) then 'Y' else '' end"),
        ("passed", f"case when {combo} in (10, 14) and o_orderkey % 3 = 0 then 'Y' else '' end"),
        ("value", "o_totalprice"),
    ]


def history(d):
    k = "(l_suppkey % 24)"
    ch = "case when l_suppkey % 2 = 0 then 'H ' else 'S ' end"
    seq = (f"concat({d.ymd('l_shipdate')}, '#', cast(l_linenumber as string), '#', {d.pad('l_partkey', 9)}, '#', "
           f"{d.pad('l_suppkey', 9)}, '#', {d.pad(d.rnd('l_quantity'), 3)}, '#', {d.pad(d.rnd('l_extendedprice * 100'), 12)})")
    refid = (
        f"case l_linenumber when 1 then concat({_code(d, k)}, 'V', {d.pad('l_partkey', 7)}) "
        f"when 2 then concat('2611', {d.pad('l_partkey % 10000', 4)}) when 3 then cast(5000 + l_suppkey as string) "
        f"when 4 then case when l_partkey % 40 = 0 then {d.pick('l_suppkey % 2', 'H99', 'S98')} else {_code(d, k)} end when 5 then concat({d.pad('l_partkey', 8)}, 'D') "
        f"when 6 then concat({_bill('l_orderkey')}, 'F122') "
        "else case when l_quantity < 20 then ' nan ' when l_quantity < 30 then concat('SV', cast(l_suppkey as string)) "
        "when l_quantity < 40 then concat(cast(l_suppkey as string), '.0') else 'WEIRD-XYZ' end end")
    tally = f"concat('(', cast({d.rnd('l_quantity')} as string), '-Y ', cast(l_partkey % 20 as string), '-N)')"
    action = (
        f"concat({ch}, case l_linenumber when 1 then concat('Reported from {{n}} '||{tally}) "
        f"when 2 then case l_returnflag when 'A' then concat('Read third time and passed House ', {tally}) "
        f"when 'R' then concat('Passed Senate ', {tally}) else 'Defeated by Senate' end "
        f"when 3 then concat('Referred to Committee on ', {d.pick(d.div(k, 2), *NOUNS)}) "
        "when 4 then concat('Assigned to subcommittee #', cast(l_suppkey % 5 as string)) "
        "when 5 then case l_linestatus when 'F' then 'Printed as engrossed' else 'Conference requested by House' end "
        "when 6 then 'Fiscal impact statement filed' "
        "else case l_returnflag when 'A' then 'Stricken from docket' when 'N' then 'Continued to next session' "
        "else 'Left in committee' end end)").replace("{n}", "committee")
    return "lineitem", [
        ("num", "l_orderkey"), ("bill", _bill("l_orderkey")), ("date", d.ymd("l_shipdate")), ("day", "cast(l_shipdate as date)"),
        ("seq", seq), ("line", "cast(l_linenumber as int)"), ("refid", refid), ("action", action),
        ("committee", _committee(d, k)), ("committee_code", _code(d, k)),
        ("chamber", "case when l_suppkey % 2 = 0 then 'House' else 'Senate' end"),
        ("part", "l_partkey"), ("supp", "l_suppkey"), ("flag", "l_returnflag"), ("lstatus", "l_linestatus"),
        ("qty", "l_quantity"),
    ]


def votes(d):
    return "lineitem", [
        ("vote_id", f"concat({d.pick('l_partkey % 5', '26', 'H14V', 'C12V', 'VSV', 'Q')}, {d.pad('l_partkey', 6)})"),
        ("member", "concat('M', cast(l_suppkey as string))"),
        ("token", "case when l_returnflag = 'R' then 'Y' when l_returnflag = 'A' then 'N' when l_linenumber = 7 then 'P' "
                  "when l_linenumber = 6 then 'A' else 'X' end"),
        ("year", "cast(year(l_shipdate) as int)"), ("date", d.ymd("l_shipdate")), ("bill", _bill("l_orderkey")),
        ("org", "l_suppkey % 24"),
        ("seq", f"concat({d.ymd('l_shipdate')}, '#', cast(l_linenumber as string), '#', {d.pad('l_orderkey', 12)}, '#', "
                f"{d.pad(d.rnd('l_quantity'), 3)}, '#', {d.pad(d.rnd('l_extendedprice * 100'), 12)})"),
    ]


def members(d):
    return "supplier", [
        ("member", "concat('M', cast(s_suppkey as string))"),
        ("name", f"concat({d.pick('s_suppkey % 7', 'Lee', 'Ann', 'R. Lee', 'Bo', 'Cy', 'Dee', 'Eve')}, ' ', "
                 f"{d.pick(d.div('s_suppkey', 3) + ' % 5', 'Ware', 'Bell-Fox', 'Hill', 'Knox', 'Yu')}, "
                 f"translate(cast({d.div('s_suppkey', 3)} as string), '0123456789', 'abcdefghij'), "
                 "case when s_suppkey % 4 = 0 then ', Jr.' else '' end)"),
        ("party", "case when s_nationkey % 7 = 0 then '' when s_nationkey % 2 = 0 then 'D' else 'R' end"),
        ("chamber", "case when s_suppkey % 2 = 0 then 'H' else 'S' end"),
        ("status", "case when s_acctbal > 0 then 'Active' else 'Outgoing' end"),
        ("committee", "s_suppkey % 24"),
        ("role", "case when s_suppkey % 48 < 24 and s_nationkey % 3 = 0 then 'Chair' else 'Member' end"),
        ("nation", "s_nationkey"), ("suppkey", "s_suppkey"),
    ]


def titles(d):
    return "part", [
        ("id", "p_partkey"), ("bill", _bill("p_partkey")), ("title", "concat(p_name, ' ', lower(p_type))"), ("name", "p_name"),
        ("kind", "p_type"), ("brand", "p_brand"), ("size", "cast(p_size as int)"), ("session", "p_brand"),
    ]


def legevents(d):
    return "events", [
        ("event_id", "event_id"), ("ts", "ts"), ("bill", _bill("user_id")), ("user_id", "user_id"),
        ("event_code", "concat(case event_type when 'signup' then "
                       + d.pick("event_id % 6", "G7010", "G7210", "G7900", "G9999", "G7350", "G8100")
                       + " when 'error' then concat('H56', cast(event_id % 7 as string)) when 'view' then concat('H4', cast(event_id % 5 as string))"
                         " when 'purchase' then concat('S5', cast(event_id % 4 as string)) else concat(' H9', cast(event_id % 3 as string), ' ') end)"),
        ("reference_type", d.pick("event_id % 9", "LegislationText", "LegislationFile", "Committee", "Subcommittee", "Vote",
                                  "Minutes", "Hologram", "", "")),
        ("vote_tally", "case when event_type = 'purchase' and event_id % 2 = 0 then "
                       f"concat(cast({d.rnd('value')} as string), '-Y ', cast(event_id % 40 as string), '-N') else '  ' end"),
        ("actor", "case when event_id % 11 = 0 then 'Governor' when event_id % 2 = 0 then 'House' else 'Senate' end"),
        ("status", d.pick("event_id % 7", "", "In House", "Enrolled-House", "With Governor", "Passed Senate", "Mystery Status",
                          "Novel Status")),
        ("event_date", f"concat({d.ymd('ts')}, 'T', case when event_type = 'error' then '00:00:00' else {d.hms('ts')} end)"),
        ("date", d.ymd("ts")), ("chamber", "case when event_id % 13 = 0 then '' when event_id % 2 = 0 then 'H' else 'S' end"),
        ("description", "concat(case when event_id % 2 = 0 then 'H ' else 'S ' end, "
                        + d.pick("event_id % 10", "Read third time and passed House", "Reported from committee on Finance", "Signed by President",
                                 "Enrolled", "Placed on Calendar", "Vetoed by Governor", "Assigned sub: Health",
                                 "Fiscal impact statement", "Amendment agreed to", "Conference report adopted")
                        + ", ' (', cast(event_id % 30 as string), '-Y ', cast(event_id % 9 as string), '-N)')"),
        ("kind", "event_type"), ("value", "value"), ("props", "props"),
    ]


def calendar(d):
    k = "(user_id % 24)"
    return "events", [
        ("event_id", "event_id"), ("ts", "ts"), ("date", d.ymd("ts")),
        ("time", "case event_id % 9 when 0 then 'Time TBA' when 1 then '' when 2 then ' Journal Entry ' "
                 "when 3 then '30 minutes after adjournment of the House' "
                 f"when 4 then {d.hm('ts')} else {d.ampm('ts')} end"),
        ("sort_time", "concat(lpad(cast(hour(ts) as string), 2, '0'), ':00')"),
        ("status", "case when event_id % 10 = 0 then 'Cancelled' else 'Scheduled' end"),
        ("committee", "case event_id % 12 when 0 then 'House Convenes' when 1 then 'Senate Adjourned' when 2 then 'House Recessed' "
                      f"when 3 then 'Ledger Updates' else {_committee(d, k)} end"),
        ("bill", f"case when event_id % 8 = 0 then 'Upon adjournment' else {_bill('user_id')} end"),
        ("outcome", "concat(case when event_id % 6 = 0 then '' else 'Amended ' end, case when event_id % 5 = 0 then '[TIMING_LAG] ' "
                    "when event_id % 7 = 0 then '[Memory Anchor: x] COMMITTEE_DRIFT ' else '' end, "
                    "case when event_id % 6 = 0 then '' else event_type end)"),
        ("route", d.pick("event_id % 5", "meeting", "admin", "", "executive", "")),
        ("refid_class", d.pick("event_id % 4", "BATCH_NOTICE", "VOTE_FLOOR", "", "DOCUMENT")),
        ("schedule_class", d.pick("event_id % 3", "MEETING_EVENT", "DOCKET", "")),
        ("source", d.pick("event_id % 4", "CSV", "api_schedule", "DOCKET", "SYSTEM")),
        ("origin", d.pick("event_id % 7", "api_schedule", "convene_anchor", "legislation_event", "journal_default", "derived_standing",
                          "system_alert", "floor_miss")),
        ("time_class", d.pick("event_id % 6", "concrete", "relative_unresolved", "", "relative_resolved", "", "")),
        ("agenda_url", "case when event_id % 5 = 0 then concat('https://a/', cast(event_id as string)) else '' end"),
        ("kind", "event_type"), ("user_id", "user_id"), ("value", "value"),
    ]


def runlog(d):
    return "events", [
        ("event_id", "event_id"), ("ts", "ts"),
        ("status", d.pick("event_id % 5", "WARN", "CRITICAL", "", "INFO", "LOUD")),
        ("origin", "case event_type when 'error' then 'system_alert' when 'signup' then 'bill_system_alert' when 'view' then 'system_metrics' "
                   "when 'purchase' then 'bill_system_metrics' else 'other' end"),
        ("outcome", "case when event_type in ('view', 'purchase') then concat('{\"rows_final\": ', cast(event_id % 100 as string), "
                    "', \"balance_residual\": \"', cast(event_id % 3 as string), '\", \"gap\": ', case when event_id % 4 = 0 then 'null' else "
                    "cast(event_id % 9 - 1 as string) end, ', \"note\": \"n/a\"}') "
                    f"else concat('[', {d.pick('event_id % 4', 'WARN', 'CRITICAL', 'INFO', 'WARN')}, ':', "
                    f"{d.pick('event_id % 3', 'API_FAILURE', 'DATA_ANOMALY', 'TIMING')}, '] ', cast(event_id % 50 as string), "
                    f"' blank rows on ', {d.ymd('ts')}) end"),
        ("hour", "cast(hour(ts) as int)"), ("date", d.ymd("ts")), ("kind", "event_type"), ("user_id", "user_id"), ("value", "value"),
    ]


def texts(d):
    return "documents", [
        ("doc_id", "doc_id"), ("bill", _bill("doc_id")), ("title", d.head("text")), ("text", "text"), ("session", "lang"),
        ("source", "source"), ("chamber", "case when doc_id % 2 = 0 then 'H' else 'S' end"),
        ("passed", "cast(case when n_chars % 3 = 0 then 1 else 0 end as int)"), ("n_chars", "n_chars"),
    ]


def versions(d):
    return "conversations", [
        ("bill", "concat('HB', cast(conv_id as string))"), ("version", "turn"), ("role", "role"), ("text", "text"),
        ("label", "concat('v', cast(turn as string), '-', role)"),
    ]


VIEWS = {f.__name__: f for f in (bills, history, votes, members, titles, legevents, calendar, runlog, texts, versions)}
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
       "benchmark", "labels", "conversations")


def view_sql(name: str, dialect: Dialect) -> str:
    source, columns = VIEWS[name](dialect)
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns) + f" FROM {source}"


class Tables:
    """Raw and logical tables of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # timestamps of the tables carry no zone
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # HotSpot compiles no larger one, and some views make them

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            source, columns = VIEWS[name](SPARK)
            return getattr(self, source).selectExpr(*[f"{e} AS {n}" for n, e in columns])
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        raise AttributeError(name)
