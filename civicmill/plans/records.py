"""Bill records, feeds and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.functions import text as T
from civicmill.operators import records as R
from civicmill.plans import sqltext as S
from civicmill.plans.registry import query
from civicmill.plans.scalars import TOPIC_RULES, lifecycle_sql
from civicmill.plans.standins import NOUNS, TODAY


def committees(t):
    """The 24 committees of the stand-in tables, as literals: of rows from Python Spark knows no size, and would shuffle the
    whole history by the code, which is null in most rows, to meet them."""
    rows = [f"('{c[0]}{i + 1:02d}', '{c} {n}')" for i, n in enumerate(NOUNS) for c in ("House", "Senate")]
    return t.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS c(code, name)")


def bill_records(t, **how):
    return R.bill_records(t.bills, t.history, t.history, committees(t), TODAY, **how)


_NAMES = "cm AS (SELECT DISTINCT committee_code AS code, committee AS name FROM history UNION SELECT DISTINCT committee_code, committee FROM bills)"
_CODE = f"nullif(regexp_extract(upper({S.heal('refid')}), '^([HS]\\d{{1,2}})((\\d{{3}})?V\\d+)?$', 1), '')"
_ACTS = f"acts AS (SELECT bill, num, seq, {_CODE} AS code, regexp_matches(upper({S.heal('refid')}), '^[HS]\\d{{1,2}}$') AS ref, CASE WHEN substr({_CODE},1,1)='H' THEN 'House' ELSE 'Senate' END AS ch FROM history WHERE {_CODE} IN (SELECT code FROM cm)), unk AS (SELECT bill, count(*) AS unknown_codes FROM history WHERE {_CODE} IS NOT NULL AND {_CODE} NOT IN (SELECT code FROM cm) GROUP BY 1)"
_KNOWN = "cm AS (SELECT DISTINCT committee_code AS code, committee AS name FROM history)"
_POS = f"""{_ACTS}, pos AS (SELECT a.bill, max_by(code, seq) AS last_code, max_by(ch, seq) AS chamber, bool_or(ch <> CASE WHEN a.bill[1]='H' THEN 'House' ELSE 'Senate' END) AS crossed_over,
 coalesce(max(m.k),0) AS referral_count FROM acts a LEFT JOIN (SELECT bill, count(*) FILTER (WHERE p IS NULL OR p<>code) AS k FROM (SELECT bill, code, lag(code) OVER (PARTITION BY bill ORDER BY seq) AS p FROM acts WHERE ref) GROUP BY 1) m USING (bill) GROUP BY a.bill)"""


def _side(c):
    return (f"CASE max(CASE WHEN regexp_matches(lower(action),'\\b(passed|agreed to by) {c}\\b') THEN 2 WHEN contains(lower(action),'defeated by {c}') THEN 1 ELSE 0 END) WHEN 2 THEN 'passed' WHEN 1 THEN 'defeated' ELSE '' END")


_FLOOR = f"flo AS (SELECT bill, {_side('house')} AS floor_house, {_side('senate')} AS floor_senate FROM history GROUP BY 1)"
_TALLY = r"regexp_extract(action,'(?i)(\d+-Y\s+\d+-N(\s+\d+-A\w*)?)',1)"
_VOTE = f"vot AS (SELECT bill, trim(tally) AS vote_tally, date AS vote_date, code AS vote_code FROM (SELECT *, {_TALLY} AS tally, CASE WHEN {_CODE} IN (SELECT code FROM cm) THEN {_CODE} END AS code, row_number() OVER (PARTITION BY bill ORDER BY seq DESC) AS rn FROM history WHERE {_TALLY}<>'') WHERE rn=1)"
_UP = f"upc AS (SELECT bill, n AS upcoming, date AS next_date, committee AS next_committee FROM (SELECT bill, date, committee, count(*) OVER (PARTITION BY bill) AS n, row_number() OVER (PARTITION BY bill ORDER BY date, committee) AS rn FROM history WHERE date >= '{TODAY}') WHERE rn=1)"
RECORD = f"""{_NAMES}, {_POS}, {_FLOOR}, {_VOTE}, {_UP}, ends AS (SELECT bill, max_by(date, seq) AS d, count(*) AS actions FROM history GROUP BY 1), oc AS ({S.OUTCOME}),
 rec AS (SELECT oc.bill, title, status, outcome, CASE WHEN fo IS NOT NULL THEN 'structural_flag' ELSE 'keyword_fallback' END AS outcome_origin, coalesce(fo<>wo,false) AS outcome_mismatch,
 (fo IS NULL AND wo IN {S.lst(K.SETTLED_OUTCOMES)}) AS unverified_terminal, patron, coalesce(chamber, CASE WHEN oc.bill[1]='H' THEN 'House' ELSE 'Senate' END) AS chamber, coalesce(crossed_over,false) AS crossed_over,
 coalesce(floor_house,'') AS floor_house, coalesce(floor_senate,'') AS floor_senate, coalesce(a.name,'') AS last_committee, coalesce(referral_count,0) AS referral_count, coalesce(vote_tally,'') AS vote_tally,
 CASE WHEN vote_tally IS NULL THEN '' ELSE coalesce(b.name,'Floor') END AS vote_location, coalesce(vote_date,'') AS vote_date, coalesce(upcoming,0) AS upcoming, coalesce(next_date,'') AS next_date,
 coalesce(next_committee,'') AS next_committee, coalesce(ends.d,'') AS last_action_date, coalesce(actions,0) AS actions, coalesce(unknown_codes,0) AS unknown_codes
 FROM oc LEFT JOIN pos USING (bill) LEFT JOIN flo USING (bill) LEFT JOIN vot USING (bill) LEFT JOIN upc USING (bill) LEFT JOIN ends USING (bill) LEFT JOIN unk USING (bill) LEFT JOIN cm a ON a.code=last_code LEFT JOIN cm b ON b.code=vote_code)"""


@query("C01_bill_records", "bills history", f"WITH {RECORD} SELECT * FROM rec")
def _(t):
    return bill_records(t)


_CHIEF = """ch AS (SELECT bill, CASE num % 6 WHEN 3 THEN 'Ann '||patron WHEN 4 THEN 'First '||patron ELSE CASE WHEN num % 5 = 0 THEN '' ELSE patron END END AS chief, CASE num % 6 WHEN 3 THEN 'H'||patron_id WHEN 4 THEN '' WHEN 5 THEN 'S'||patron_id ELSE '' END AS chief_number,
 CASE WHEN num % 6 IN (3,4) THEN 'universe' WHEN num % 5 = 0 THEN 'none' ELSE 'bulk' END AS chief_origin FROM bills)"""


def chiefs(t):
    """Bills with a patron list in every shape it may arrive in: absent, no list, empty, chief second, no chief, no name."""
    k, text = F.col("num") % 6, F.format_string
    cell = (F.when(k == 1, F.lit('{"PatronTypeID": 1}')).when(k == 2, F.lit("[]"))
            .when(k == 3, text('[{"PatronTypeID": 2, "MemberDisplayName": "Co"}, {"PatronTypeID": 1, "MemberDisplayName": " Ann %s ", "MemberNumber": "H%d"}]', "patron", "patron_id"))
            .when(k == 4, text('[{"Name": "Patron", "MemberDisplayName": "First %s"}, {"Name": "Patron", "MemberDisplayName": "Second"}]', "patron"))
            .when(k == 5, text('[{"Name": "Chief Patron", "MemberNumber": "S%d"}]', "patron_id")))
    surname = F.when(F.col("num") % 5 == 0, " ").otherwise(F.col("patron"))
    return R.chief_patron(t.bills.select("bill", surname.alias("patron"), cell.alias("patrons")))


@query("C01_chief_patron", "bills", f"WITH {_CHIEF} SELECT * FROM ch")
def _(t):
    return chiefs(t).select("bill", "chief", "chief_number", "chief_origin")


@query("C01_patron_coverage", "bills", f"WITH {_CHIEF} SELECT count(*) AS bills, count(*) FILTER (WHERE chief_origin='universe') AS from_universe, count(*) FILTER (WHERE chief_origin='bulk') AS from_bulk, count(*) FILTER (WHERE chief_origin='none') AS missing, round(count(*) FILTER (WHERE chief_origin='universe')/count(*),4) AS full_name_rate FROM ch")
def _(t):
    return R.patron_coverage(chiefs(t))


@query("C02_team_list", "bills titles", f"""WITH w AS (SELECT bill, 'Watching' AS type, name AS my_title, 0 AS l, id AS pos FROM titles WHERE size <= 25 UNION ALL SELECT bill, 'Involved', NULL, 1, id FROM titles WHERE size >= 20),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill ORDER BY l, pos) AS rn FROM w) WHERE rn=1)
 SELECT f.bill, type, coalesce(my_title,'-') AS my_title, coalesce(b.status,'none') AS status FROM f LEFT JOIN bills b USING (bill)""")
def _(t):
    base = t.titles.select(F.concat(F.lower(F.substring("bill", 1, 2)), F.lit(" 00"), F.expr("substr(bill, 3)")).alias("raw"), F.col("name").alias("my_title"), F.col("id").alias("pos"), "size")
    master = t.bills.select("bill", "status", F.lit(None).cast("string").alias("lifecycle"), F.lit(None).cast("string").alias("topic"))
    team = R.team_list(base.filter("size <= 25").drop("size"), base.filter("size >= 20").drop("size", "my_title"), master)
    return team.select("bill", "type", "my_title", F.coalesce("status", F.lit("none")).alias("status"))


@query("C04_two_way_gap", "bills history", """WITH uni AS (SELECT CASE WHEN year >= 2001 THEN 'X'||bill ELSE bill END AS bill FROM bills) SELECT gap, bill FROM (SELECT DISTINCT 'in_history_not_in_universe' AS gap, bill FROM history WHERE bill NOT IN (SELECT bill FROM uni)
 UNION ALL SELECT 'prefiled_no_history', bill FROM uni WHERE bill NOT IN (SELECT bill FROM history))""")
def _(t):
    return R.two_way_gap(t.bills.withColumn("bill", F.expr("if(year >= 2001, concat('X', bill), bill)")), t.history).select("gap", "bill")


@query("D03_completeness", "bills history", f"""WITH {RECORD}, z AS (SELECT count(*) AS records_written, count(*) FILTER (WHERE actions=0) AS prefiled_no_history, count(*) FILTER (WHERE outcome_origin='structural_flag') AS outcome_structural,
 count(*) FILTER (WHERE outcome_origin='keyword_fallback') AS outcome_unverified, count(*) FILTER (WHERE outcome_mismatch) AS outcome_keyword_mismatches, count(*) FILTER (WHERE unverified_terminal) AS outcome_unverified_terminal,
 count(*) FILTER (WHERE patron<>'') AS patron_present, count(*) FILTER (WHERE patron='') AS patron_missing, count(*) FILTER (WHERE floor_house='passed') AS floor_house, count(*) FILTER (WHERE floor_senate='passed') AS floor_senate,
 count(*) FILTER (WHERE outcome IN ('awaiting_governor','signed','vetoed')) AS floor_both_expected, count(*) FILTER (WHERE outcome IN ('awaiting_governor','signed','vetoed') AND NOT (floor_house='passed' AND floor_senate='passed')) AS floor_both_missing,
 count(*) FILTER (WHERE crossed_over) AS crossed_over, count(*) FILTER (WHERE vote_tally<>'') AS with_vote, count(*) FILTER (WHERE upcoming>0) AS with_upcoming, CAST(sum(unknown_codes) AS BIGINT) AS unknown_codes, count(*) FILTER (WHERE unknown_codes>0) AS bills_with_unknown_codes FROM rec)
 SELECT *, outcome_unverified-outcome_unverified_terminal AS outcome_unverified_absent, round(outcome_keyword_mismatches/outcome_structural,4) AS outcome_keyword_mismatch_rate, round(outcome_unverified/records_written,4) AS outcome_unverified_rate,
 round(floor_both_missing/floor_both_expected,4) AS floor_reconcile_rate FROM z""")
def _(t):
    return R.completeness(bill_records(t, count_referrals=False))


_REPORT = """un AS (SELECT CASE WHEN num % 89 = 0 THEN 'n/a' WHEN num % 53 = 0 THEN 'X'||bill ELSE bill END AS bill, num % 89 = 0 AS bad FROM bills),
 sd AS (SELECT bill, sum(s) AS s FROM (SELECT DISTINCT bill, 1 AS s FROM un WHERE NOT bad UNION ALL SELECT DISTINCT bill, 2 FROM history) GROUP BY 1)"""


@query("D03_report", "bills history", f"""WITH {RECORD}, {_REPORT} SELECT (SELECT count(*) FROM rec) AS records_written, (SELECT count(*) FILTER (WHERE s<>2) FROM sd) AS universe_count, (SELECT count(*) FILTER (WHERE s<>1) FROM sd) AS history_bills,
 (SELECT count(*) FILTER (WHERE s=1) FROM sd) AS universe_without_history, (SELECT count(*) FILTER (WHERE s=2) FROM sd) AS in_history_not_in_universe, (SELECT coalesce(string_agg(bill, '|' ORDER BY bill), '') FROM (SELECT bill FROM sd WHERE s=2 ORDER BY bill LIMIT 10)) AS in_history_not_in_universe_sample,
 (SELECT count(*) FILTER (WHERE bad) FROM un) AS skipped_malformed_universe, (SELECT count(*) FILTER (WHERE line = 6) FROM history) AS docket_unparseable_dates, (SELECT count(*) FROM history) AS docket_rows_total, (SELECT count(*) FROM bills) AS bulk_rows, (SELECT count(*) FILTER (WHERE num % 71 = 0) FROM bills) AS bulk_skipped_no_bill,
 (SELECT count(*) FILTER (WHERE num % 6 IN (3,4)) FROM bills) AS patron_fullname_universe, round((SELECT count(*) FILTER (WHERE line = 6) / count(*) FROM history), 4) AS docket_unparseable_rate, round((SELECT count(*) FILTER (WHERE patron<>'') / count(*) FROM rec), 4) AS patron_present_rate,
 round((SELECT count(*) FILTER (WHERE num % 6 IN (3,4)) FROM bills) / (SELECT count(*) FROM rec), 4) AS patron_fullname_universe_rate, (SELECT count(*) FILTER (WHERE NOT (floor_house='passed' AND floor_senate='passed')) / count(*) > 0.01 FROM rec WHERE outcome IN ('awaiting_governor','signed','vetoed')) AS reconcile_alert""")
def _(t):
    """The coverage part of the report: malformed and missing rows on every side, each with its denominator."""
    raw = F.when(F.col("num") % 89 == 0, "n/a").when(F.col("num") % 53 == 0, F.concat(F.lit("X"), "bill")).otherwise(F.lower("bill"))
    day = F.when(F.col("line") == 6, "soon").when(F.col("line") == 5, F.date_format(F.to_date("date"), "M/d/yyyy")).otherwise(F.col("date"))
    bulk = t.bills.select(F.when(F.col("num") % 71 == 0, " ").otherwise(F.col("bill")).alias("raw_bill"))
    counts = R.completeness(bill_records(t, count_referrals=False))
    out = R.completeness_report(counts, t.bills.select(raw.alias("raw_bill")), t.history.select("bill"), t.history.select(day.alias("raw_day")), bulk, chiefs(t).select("chief_origin"))
    own = ["records_written", *out.columns[len(counts.columns):]]
    return out.select(*own)


@query("D03_completeness_samples", "bills", f"""WITH f AS (SELECT 'outcome_mismatch' AS finding, bill FROM ({S.OUTCOME}) WHERE fo<>wo UNION ALL SELECT 'outcome_unverified', bill FROM ({S.OUTCOME}) WHERE fo IS NULL
 UNION ALL SELECT 'outcome_unverified_terminal', bill FROM ({S.OUTCOME}) WHERE fo IS NULL AND wo IN {S.lst(K.SETTLED_OUTCOMES)})
 SELECT finding, string_agg(bill, '|' ORDER BY bill) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY bill) AS rn FROM f) WHERE rn<=10 GROUP BY 1""")
def _(t):
    return R.completeness_samples(K.with_outcome(t.bills))


@query("E01_position", "history", f"WITH {_KNOWN}, {_POS} SELECT bill, last_code, chamber, crossed_over, referral_count FROM pos")
def _(t):
    return R.positions(t.history, committees(t)).select("bill", "last_code", "chamber", "crossed_over", "referral_count")


@query("E02_floor_outcome", "history", f"WITH {_FLOOR} SELECT * FROM flo")
def _(t):
    return R.floor_outcomes(t.history)


@query("E03_latest_vote", "history", f"WITH {_KNOWN}, {_VOTE} SELECT bill, vote_tally, vote_date, coalesce(vote_code,'Floor') AS vote_code FROM vot")
def _(t):
    return R.latest_votes(t.history, committees(t)).withColumn("vote_code", F.coalesce("vote_code", F.lit("Floor")))


_A = "lower(action)"
_RESET = S.like_any(_A, ("passed house", "passed senate", "agreed to by house", "agreed to by senate"))
_REF = rf"regexp_matches({_A}, 'referred to\s?[a-z\s&,-]+')"
_TARGET = rf"trim(split_part(regexp_extract({_A}, 'referred to\s?([a-z\s&,-]+)', 1),'(',1))"
_EACH = lambda text, cut: f"array_to_string(list_transform(string_split({text},'{cut}'), lambda w: upper(substr(w,1,1))||substr(w,2)),'{cut}')"
_TITLED = _EACH(_EACH(_TARGET, " "), "-")
_SUB = f"trim(regexp_extract({_A}, '(subcommittee[^)]*)', 1))"
_LEAVES = S.like_any(_A, ("reported", "incorporated", "passed by indefinitely", "defeated")) + f" AND NOT contains({_A},'recommends')"
_STATE = rf"""st AS (SELECT bill, seq, CASE WHEN {_RESET} THEN 'Unassigned' WHEN {_REF} THEN CASE WHEN starts_with({_A},'h ') THEN 'House ' ELSE 'Senate ' END||{_TITLED} END AS c,
 CASE WHEN {_RESET} OR ({_LEAVES}) THEN '-' WHEN {_SUB}<>'' THEN {_SUB} WHEN {_REF} THEN '-' END AS s, nullif(regexp_extract({_A}, '\(\s*(\d+-y\s+\d+-n[^)]*?)\s*\)', 1),'') AS t,
 CASE WHEN bill[1]='H' THEN {S.like_any(_A, ("passed senate", "agreed to by senate"))} ELSE {S.like_any(_A, ("passed house", "agreed to by house"))} END AS o,
 {S.like_any(_A, ("conference", "rejected", "insisted"))} AS conf FROM history),
 state AS (SELECT bill, coalesce(max_by(c, seq) FILTER (WHERE c IS NOT NULL),'Unassigned') AS committee, coalesce(max_by(s, seq) FILTER (WHERE s IS NOT NULL),'-') AS subcommittee, coalesce(max_by(t, seq) FILTER (WHERE t IS NOT NULL),'-') AS latest_vote,
 bool_or(o) AS passed_opposite, bool_or(conf) AS in_conference FROM st GROUP BY 1)"""
_TERM = f"""term AS (SELECT bill, cont AS continued, NOT cont AND {S.like_any('a', R.DEATH)} AS dead FROM (SELECT bill, a, {S.like_any('a', R.CONTINUED)} AS cont FROM
 (SELECT bill, max_by({_A}, seq) AS a FROM history WHERE NOT {S.like_any(_A, R.NOISE)} GROUP BY 1)))"""


@query("E04_state_machine", "history", f"WITH {_STATE} SELECT * FROM state")
def _(t):
    return R.state_machine(t.history)


@query("E05_terminal_scan", "history", f"WITH {_TERM} SELECT * FROM term")
def _(t):
    return R.terminal_scan(t.history)


def first_generation(t):
    """Lifecycle, topic and state of every bill, as the first-generation builder published them."""
    b = t.bills.join(R.state_machine(t.history).withColumnRenamed("committee", "current"), "bill", "left").join(R.terminal_scan(t.history), "bill", "left")
    b = b.na.fill(False, ["passed_opposite", "in_conference", "dead", "continued"]).withColumn("committee", F.coalesce("current", F.lit("Unassigned")))
    return b.select("bill", "title", "status", "committee", K.lifecycle("status", "committee", "in_conference", "passed_opposite", "dead", "continued").alias("lifecycle"),
                    T.topic("title", {"Courts": ["court"], "Schools": ["school"], "Tax": ["tax", "fee"], "Crime": ["penalty", "firearm"]}).alias("topic"))


@query("D49_run_findings", "bills history", f"""WITH {_STATE}, {_TERM}, g AS (SELECT b.bill, title, status, coalesce(st2.committee,'Unassigned') AS comm,
 {lifecycle_sql('status', "coalesce(st2.committee,'Unassigned')", 'coalesce(in_conference,false)', 'coalesce(passed_opposite,false)', 'coalesce(dead,false)', 'coalesce(continued,false)')} AS lifecycle,
 regexp_matches(lower(title),'\\b(court|school|tax|fee|penalty|firearm)(es|s)?\\b') AS topical FROM bills b LEFT JOIN state st2 USING (bill) LEFT JOIN term USING (bill))
 SELECT bill, 'unrecognized_status' AS kind, status AS detail FROM g WHERE contains(lifecycle,'unrecognized') UNION ALL SELECT bill, 'unmapped_committee', status FROM g WHERE lifecycle='In Committee' AND comm='Unassigned'
 UNION ALL SELECT bill, 'missing_topic', title FROM g WHERE NOT topical""".replace("\\\\b", "\\b"))
def _(t):
    return R.run_findings(first_generation(t))


@query("E20_stale_items", "history", f"SELECT bill, CAST(DATE '2001-11-20' - CAST(d AS DATE) AS BIGINT) AS days FROM (SELECT bill, max_by(date, seq) AS d FROM history GROUP BY 1) WHERE DATE '2001-11-20' - CAST(d AS DATE) >= 7")
def _(t):
    last = t.history.groupBy("bill").agg(F.max_by("date", "seq").alias("last_action_date"))
    return R.stale_items(last, "2001-11-20").select("bill", F.col("days").cast("bigint").alias("days"))


@query("E21_last_significant", "history", f"""SELECT bill, action AS last_significant, date AS significant_date FROM (SELECT *, row_number() OVER (PARTITION BY bill ORDER BY seq DESC) AS rn FROM history
 WHERE {S.like_any(_A, R.SIGNIFICANT)} AND NOT {S.like_any(_A, R.LIFECYCLE_NOISE)}) WHERE rn=1""")
def _(t):
    return R.last_significant(t.history)


@query("D32_funnel", "bills history", f"""WITH {RECORD}, p AS (SELECT *, CASE WHEN bill[1]='S' THEN floor_senate ELSE floor_house END AS f1, CASE WHEN bill[1]='S' THEN floor_house ELSE floor_senate END AS f2 FROM rec),
 q AS (SELECT *, CASE WHEN f2<>'' THEN 'floor2' WHEN crossed_over THEN 'committee2' WHEN f1<>'' THEN 'floor1' WHEN last_committee<>'' THEN 'committee1' ELSE 'prefiled' END AS st FROM p),
 r AS (SELECT *, CASE WHEN (st IN ('committee2','floor2')) = (bill[1]='S') THEN 'House' ELSE 'Senate' END AS side FROM q)
 SELECT part, stage, side, count(*) AS n FROM (SELECT 'outcome' AS part, outcome AS stage, '' AS side FROM r WHERE outcome<>'in_progress'
 UNION ALL SELECT CASE WHEN outcome IN ('dead','carried_over') THEN 'stranded' ELSE 'alive' END, st, side FROM r WHERE outcome IN ('dead','carried_over','in_progress')) GROUP BY 1,2,3""")
def _(t):
    return R.funnel(bill_records(t))


@query("D33_outcome_tally", "bills", f"WITH k AS (SELECT unnest(['signed','vetoed','awaiting_governor','dead','carried_over','in_progress']) AS outcome), b AS (SELECT outcome FROM ({S.OUTCOME})) SELECT k.outcome, count(b.outcome) AS n FROM k LEFT JOIN b USING (outcome) GROUP BY 1")
def _(t):
    return R.tally_outcomes(K.with_outcome(t.bills))


@query("F01_natural_order", "titles", "SELECT bill, row_number() OVER (ORDER BY substr(bill,1,2), id) AS place FROM titles")
def _(t):
    d = t.titles.select("bill", I.bill_prefix("bill").alias("p"), I.bill_number("bill").alias("k"))
    return scale.row_numbers(d, [], ["p", "k"], "place").select("bill", "place")


@query("F03_feed", "bills history", "SELECT h.bill, b.title, h.action, h.date FROM history h JOIN bills b USING (bill)")
def _(t):
    return R.feed(t.history, t.bills).orderBy(F.desc("date"), F.desc("seq")).select("bill", "title", "action", "date")


@query("F03_feed_days", "history", "SELECT date, count(*) AS actions, count(DISTINCT bill) AS bills FROM history GROUP BY 1")
def _(t):
    per = t.history.groupBy("date", "bill").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("date").agg(F.sum("n").alias("actions"), F.count(F.lit(1)).alias("bills"))


@query("F04_top_report", "history", "SELECT committee, n FROM (SELECT committee, count(*) AS n FROM history GROUP BY 1) ORDER BY n DESC, committee LIMIT 10")
def _(t):
    counts = t.history.groupBy("committee").agg(F.count(F.lit(1)).alias("n"))
    return scale.global_top_k(counts, [F.desc("n"), F.col("committee")], 10).select("committee", "n")


_QUEUE = "SELECT bill, num, CASE WHEN num % 5 = 0 THEN NULL ELSE num % 4 <> 0 END AS cached, num % 3 = 0 AS changed, num % 2 = 0 AS expired, vetoed='Y' AS terminal FROM bills"


@query("F06_work_queue", "bills", f"""WITH q AS (SELECT *, CASE WHEN cached IS NULL OR NOT cached THEN 'A' WHEN changed THEN 'B' WHEN expired THEN 'C' END AS tier FROM ({_QUEUE}) WHERE NOT terminal),
 o AS (SELECT *, row_number() OVER (ORDER BY tier, num) AS place FROM q WHERE tier IS NOT NULL) SELECT bill, tier, place FROM o WHERE place <= 500""")
def _(t):
    return R.work_queue(_queue(t), 500, ["num"]).select("bill", "tier", "place")


def _queue(t):
    n = F.col("num")
    return t.bills.select("bill", "num", F.when(n % 5 == 0, F.lit(None).cast("boolean")).otherwise(n % 4 != 0).alias("cached"), (n % 3 == 0).alias("changed"),
                          (n % 2 == 0).alias("expired"), (F.col("vetoed") == "Y").alias("terminal"))


@query("F06_queue_overflow", "bills", f"""SELECT tier, count(*) AS queued FROM (SELECT CASE WHEN cached IS NULL OR NOT cached THEN 'A' WHEN changed THEN 'B' WHEN expired THEN 'C' ELSE 'fresh' END AS tier FROM ({_QUEUE}) WHERE NOT terminal) GROUP BY 1""")
def _(t):
    tier = F.when(F.col("cached").isNull() | ~F.col("cached"), "A").when(F.col("changed"), "B").when(F.col("expired"), "C").otherwise("fresh")
    return _queue(t).filter("NOT terminal").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("queued"))


@query("F07_sample", "history", "SELECT bill FROM (SELECT DISTINCT bill FROM history) ORDER BY md5(bill||'#20260501'), bill LIMIT 100")
def _(t):
    """Seeded sample of distinct keys; a hash order is the same on every run and cluster."""
    keys = t.history.select("bill").distinct()
    return scale.global_top_k(keys, [F.md5(F.concat("bill", F.lit("#20260501"))), F.col("bill")], 100).select("bill")


@query("F08_soonest_first", "bills history", f"WITH {_UP} SELECT b.bill, coalesce(next_date,'') AS next_date, row_number() OVER (ORDER BY next_date ASC NULLS LAST, substr(b.bill,1,2), b.num) AS place FROM bills b LEFT JOIN upc USING (bill)")
def _(t):
    d = t.bills.select("bill", "num").join(R.upcoming(t.history, TODAY), "bill", "left")
    d = d.select("bill", F.coalesce("next_date", F.lit("9999-12-31")).alias("due"), I.bill_prefix("bill").alias("p"), "num")
    placed = scale.row_numbers(d, [], ["due", "p", "num"], "place")
    return placed.select("bill", F.when(F.col("due") == "9999-12-31", "").otherwise(F.col("due")).alias("next_date"), "place")
