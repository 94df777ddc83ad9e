"""Calendar diagnostics, gates, windows and schedule joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.functions import times as C
from civicmill.operators import calendar as O
from civicmill.operators import routing
from civicmill.plans import sqltext as S
from civicmill.plans.registry import query


def N():
    return F.count(F.lit(1)).alias("n")


def stamp(c):
    """Timestamps leave a query as text."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_CLEAN = lambda c: rf"trim(regexp_replace({c}, '(?i)\s*\((Agenda|View Meeting|Meeting Materials)\)\s*', '', 'g'))"
_MEET = f"""mrow AS (SELECT *, CASE WHEN regexp_matches(upper(replace(bill,' ','')),'^[HS][BJR]\\d+$') THEN upper(replace(bill,' ','')) END AS item, {S.concrete('time')} AS conc, coalesce({S.minutes('time')},{S.minutes('sort_time')},1441) AS m
 FROM calendar WHERE origin NOT IN ('system_alert','system_metrics') AND trim(committee)<>'' AND committee NOT IN ('Ledger Updates','Governor')),
 mg AS (SELECT date, committee, sort_time, min_by({_CLEAN('time')}, event_id) FILTER (WHERE conc) AS ctime, min_by(m, event_id) FILTER (WHERE conc) AS cmin, min_by(m, event_id) AS slot, min_by({_CLEAN('bill')}, event_id) FILTER (WHERE item IS NULL AND trim(bill)<>'' AND {_CLEAN('bill')}<>'') AS note,
 bool_or(time_class='relative_unresolved') AS unresolved, bool_or(lower(status)='cancelled') AS cancelled, bool_or(route='meeting') AS held, count(DISTINCT item) AS bills, coalesce(min_by(agenda_url, event_id) FILTER (WHERE agenda_url<>''),'') AS agenda_url FROM mrow GROUP BY 1,2,3),
 meet AS (SELECT date, committee, sort_time, CASE WHEN starts_with(committee,'House') THEN 'House' WHEN starts_with(committee,'Senate') THEN 'Senate' END AS chamber, CASE WHEN regexp_matches(committee,'(?i)\\b(re)?conven(es|e|ed)\\b|\\badjourn(s|ed)?\\b|\\brecess(es|ed)?\\b') THEN 'floor' ELSE 'committee' END AS kind,
 coalesce(ctime, note, 'Time TBA') AS time, ctime IS NULL AS tba, coalesce(cmin, slot) AS minutes, unresolved, bills, agenda_url FROM mg WHERE NOT (cancelled AND NOT held))"""
_ITEMS = f"{_MEET}, items AS (SELECT i.*, k.time, k.tba, k.minutes, k.unresolved FROM (SELECT date, committee, sort_time, item AS bill, min_by(trim(outcome), event_id) AS action FROM mrow WHERE item IS NOT NULL GROUP BY 1,2,3,4) i JOIN meet k USING (date, committee, sort_time))"


@query("D30_meetings", "calendar", f"WITH {_MEET} SELECT * FROM meet")
def _(t):
    return O.meetings(t.calendar)


@query("D30_meeting_bills", "calendar", f"WITH {_ITEMS} SELECT date, committee, sort_time, bill, action, minutes FROM items")
def _(t):
    return O.meeting_bills(t.calendar).select("date", "committee", "sort_time", "bill", "action", "minutes")


@query("D31_floor_sessions", "calendar", f"""WITH {_MEET}, o AS (SELECT *, row_number() OVER (PARTITION BY date, chamber ORDER BY minutes, committee, sort_time) AS rn FROM meet WHERE kind='floor' AND chamber IS NOT NULL)
 SELECT date, chamber, max(committee) FILTER (WHERE rn=1) AS committee, max(time) FILTER (WHERE rn=1) AS time, min(minutes) AS minutes, bool_and(tba) AS tba, bool_or(unresolved) AS unresolved, count(*) AS markers, coalesce(min_by(agenda_url, rn) FILTER (WHERE agenda_url<>''),'') AS agenda_url,
 string_agg(committee,'>' ORDER BY rn) AS sequence, 'floor' AS kind FROM o GROUP BY 1,2 UNION ALL SELECT date, chamber, committee, time, minutes, tba, unresolved, 0, agenda_url, '', kind FROM meet WHERE NOT (kind='floor' AND chamber IS NOT NULL)""")
def _(t):
    return O.collapse_floor_sessions(O.meetings(t.calendar))


@query("F02_calendar_order", "calendar", f"WITH {_MEET} SELECT date, committee, sort_time, row_number() OVER (PARTITION BY date ORDER BY unresolved DESC, minutes, committee, sort_time) AS place FROM meet")
def _(t):
    m = O.meetings(t.calendar).withColumn("settled", (~F.col("unresolved")).cast("int"))
    return scale.row_numbers(m, ["date"], ["settled", "minutes", "committee", "sort_time"], "place").select("date", "committee", "sort_time", "place")


@query("C17_next_meeting", "calendar", f"WITH {_ITEMS} SELECT bill, date, committee, time FROM (SELECT *, row_number() OVER (PARTITION BY bill ORDER BY date, unresolved DESC, minutes, committee, sort_time) AS rn FROM items WHERE date>='2024-01-15') WHERE rn=1")
def _(t):
    return O.next_meetings(t.calendar.select("bill").distinct(), O.meeting_bills(t.calendar), "2024-01-15")


@query("C18_timed_feed", "calendar", f"""WITH {_ITEMS}, ix AS (SELECT date, bill, lower(trim(regexp_replace(action,'\\s+',' ','g'))) AS k, time, minutes FROM (SELECT *, row_number() OVER (PARTITION BY date, bill, lower(trim(regexp_replace(action,'\\s+',' ','g'))) ORDER BY minutes DESC, committee DESC, sort_time DESC) AS rn FROM items WHERE NOT tba AND NOT unresolved) WHERE rn=1)
 SELECT c.event_id, c.date, c.bill, ix.time AS clock, ix.minutes AS clock_minutes FROM calendar c LEFT JOIN ix ON ix.date=c.date AND ix.bill=c.bill AND ix.k=lower(trim(regexp_replace(c.outcome,'\\s+',' ','g')))""")
def _(t):
    feed = t.calendar.select("event_id", "date", "bill", F.col("outcome").alias("action"))
    return O.timed_feed(feed, O.meeting_bills(t.calendar)).orderBy(F.desc("date"), F.col("clock_minutes").desc_nulls_last(), "event_id").select("event_id", "date", "bill", "clock", "clock_minutes")


@query("D01_counts", "calendar", "SELECT committee, count(*) AS n FROM calendar GROUP BY 1")
def _(t):
    return t.calendar.groupBy("committee").agg(N()).orderBy(F.desc("n"), "committee")


@query("D02_value_counts", "calendar", "SELECT CASE WHEN trim(route)='' THEN 'blank' ELSE lower(trim(route)) END AS route, count(*) AS n, CASE WHEN trim(route)='' THEN false ELSE route NOT IN ('admin','meeting') END AS unseen FROM calendar GROUP BY 1,3")
def _(t):
    return t.calendar.groupBy(O.blank_label("route").alias("route")).agg(N()).withColumn("unseen", ~F.col("route").isin("admin", "meeting", "blank"))


@query("D04_class_time_matrix", "calendar", f"WITH {S.ACTED}, l AS (SELECT * FROM acted WHERE source<>'SYSTEM') SELECT cls, count(*) FILTER (WHERE has_time) AS with_time, count(*) FILTER (WHERE NOT has_time) AS without_time, count(*) AS total FROM l GROUP BY 1 UNION ALL SELECT 'all', count(*) FILTER (WHERE has_time), count(*) FILTER (WHERE NOT has_time), count(*) FROM l")
def _(t):
    return O.class_time_matrix(t.calendar)


@query("D05_ministerial", "legevents", f"SELECT code, n FROM (SELECT trim(event_code) AS code, count(*) AS n, bool_or({S.meeting_time('event_date')}) AS a, bool_or(trim(vote_tally)<>'') AS b FROM legevents GROUP BY 1) WHERE n>=20 AND NOT a AND NOT b AND code<>''")
def _(t):
    return routing.ministerial_codes(t.legevents)


_DK = lambda c: rf"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({c},'^[^A-Za-z0-9]*\[[^\]]*\]\s*',''),'^\s*[HS]\s+',''),'\s*\([^)]*\)\s*$','')),'[^a-z0-9]+',' ','g'))"


@query("D06_all_agree_index", "legevents", f"""WITH ministerial AS ({S.MINISTERIAL}), e AS (SELECT trim(event_code) AS code, {_DK('d')} AS key FROM (SELECT event_code, unnest([description, event_code||' notice', reference_type]) AS d FROM legevents) GROUP BY 1,2)
 SELECT key, count(*) AS codes FROM e WHERE key<>'' AND code<>'' GROUP BY 1 HAVING bool_and(code[1]='G' OR code IN (SELECT code FROM ministerial))""")
def _(t):
    ref = t.legevents.withColumn("d2", F.concat("event_code", F.lit(" notice")))
    return routing.all_agree_index(ref, routing.ministerial_codes(t.legevents), ["description", "d2", "reference_type"])


@query("D08_drift", "legevents", f"""SELECT 'status' AS vocabulary, status AS value, count(*) AS n FROM legevents WHERE status<>'' AND status NOT IN {S.lst(K.CLERICAL_STATUSES + K.SESSION_STATUSES)} GROUP BY 2
 UNION ALL SELECT 'governor', trim(event_code), count(*) FROM legevents WHERE trim(event_code)[1]='G' AND trim(event_code) NOT IN {S.lst(K.GOVERNOR_CODES)} GROUP BY 2
 UNION ALL SELECT 'schedule', (event_id % 8)::VARCHAR, count(*) FROM legevents WHERE event_id % 8 NOT IN (1,2,4,5,6) GROUP BY 2
 UNION ALL SELECT 'reference', reference_type, count(*) FROM legevents WHERE reference_type<>'' AND reference_type NOT IN {S.lst(K.DOCUMENT_TYPES + K.REFERRAL_TYPES + K.OTHER_TYPES)} GROUP BY 2""")
def _(t):
    e = t.legevents
    gov = e.filter(I.blank("event_code").startswith("G"))
    sched = e.withColumn("st", F.concat((F.col("event_id") % 8).cast("string"), F.lit(".0")))
    parts = [("status", routing.unknown_values(e, "status", K.CLERICAL_STATUSES + K.SESSION_STATUSES)), ("governor", routing.unknown_values(gov, "event_code", K.GOVERNOR_CODES)),
             ("schedule", routing.unknown_values(sched, "st", tuple(K.SCHEDULE_CLASSES))), ("reference", routing.unknown_values(e, "reference_type", K.DOCUMENT_TYPES + K.REFERRAL_TYPES + K.OTHER_TYPES))]
    out = None
    for name, df in parts:
        df = df.withColumn("vocabulary", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@query("D10_tag_counts", "calendar", "SELECT tag, count(*) FILTER (WHERE contains(outcome, tag)) AS n FROM calendar, (SELECT unnest(['PARENT_CHILD','TIMING_LAG','COMMITTEE_DRIFT','UNKNOWN_ACTION','Memory Anchor']) AS tag) GROUP BY 1")
def _(t):
    return O.tag_counts(t.calendar, "outcome", ("PARENT_CHILD", "TIMING_LAG", "COMMITTEE_DRIFT", "UNKNOWN_ACTION", "Memory Anchor"))


@query("A09_publish_breaker", "calendar", """SELECT rows, violations, unsourced, 200 AS baseline, concat_ws(',', CASE WHEN violations/rows>0.1 THEN 'rate' END, CASE WHEN violations>=50 THEN 'violations' END, CASE WHEN unsourced-200>25 THEN 'delta' END, CASE WHEN unsourced>500 THEN 'ceiling' END) AS reasons, true AS refuse
 FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE origin NOT IN ('api_schedule','convene_anchor','legislation_event','journal_default','floor_miss','system_alert')) AS violations, count(*) FILTER (WHERE route='meeting' AND origin IN ('journal_default','floor_miss')) AS unsourced FROM calendar)""")
def _(t):
    good = t.spark.createDataFrame([(200,)], "unsourced bigint")
    return O.publish_breaker(t.calendar, good, ("api_schedule", "convene_anchor", "legislation_event", "journal_default", "floor_miss", "system_alert"))


_BUCKET = rf"CASE WHEN {S.minutes('time')} IS NOT NULL THEN 'exact_clock' WHEN regexp_matches(lower(trim(time)),'after|upon') THEN 'relative_time' WHEN trim(time)='' THEN 'no_clock_source' WHEN lower(trim(time)) IN ('journal entry','ledger') THEN 'terminal_or_timeless' ELSE 'other' END"
_ACC = f"""acc AS (SELECT source, count(*) AS rows, {", ".join(f"count(*) FILTER (WHERE b='{b}') AS {b}" for b in O.TIME_BUCKETS)}, count(*) FILTER (WHERE b='other') AS unknown_time_bucket, count(*) FILTER (WHERE regexp_matches(upper(bill),'^[HS][BJR]\\d+$')) AS with_bill FROM (SELECT *, {_BUCKET} AS b FROM calendar) GROUP BY 1),
 acc2 AS (SELECT *, {"+".join(O.TIME_BUCKETS)} AS denominator, ({"+".join(O.TIME_BUCKETS)}<>rows)::INT AS drift FROM acc)"""


@query("D37_time_buckets", "calendar", f"WITH {_ACC} SELECT * FROM acc2")
def _(t):
    return O.bucket_accounting(t.calendar, "source")


@query("D53_audit_rollup", "calendar", f"WITH {_ACC} SELECT count(*) AS sources, CAST(sum(rows) AS BIGINT) AS rows, {', '.join(f'CAST(sum({b}) AS BIGINT) AS {b}' for b in O.TIME_BUCKETS)}, CAST(sum(unknown_time_bucket) AS BIGINT) AS unknown_time_bucket, CAST(sum(drift) AS BIGINT) AS drifting, count(*) FILTER (WHERE rows=0) AS gaps, CASE WHEN sum(drift)>0 THEN 'CRITICAL' ELSE 'INFO' END AS status FROM acc2")
def _(t):
    return O.audit_rollup(O.bucket_accounting(t.calendar, "source"))


@query("D39_accuracy_gates", "calendar", f"""WITH {S.ACTED}, g AS (SELECT count(*) FILTER (WHERE source<>'SYSTEM') AS rows, count(*) FILTER (WHERE source='SYSTEM') AS system_rows, count(*) FILTER (WHERE source<>'SYSTEM' AND cls='meeting') AS meetings,
 count(*) FILTER (WHERE source<>'SYSTEM' AND cls='meeting' AND NOT has_time AND date<='2024-01-20') AS timeless_past, count(*) FILTER (WHERE source<>'SYSTEM' AND cls='meeting' AND NOT has_time AND date>'2024-01-20') AS timeless_future, count(*) FILTER (WHERE source<>'SYSTEM' AND cls='unconfirmed') AS unconfirmed,
 count(*) FILTER (WHERE source<>'SYSTEM' AND cls='executive') AS executive, count(*) FILTER (WHERE source<>'SYSTEM' AND origin='derived_standing') AS derived, count(*) FILTER (WHERE source='CSV') AS routable, count(*) FILTER (WHERE source='CSV' AND route<>'') AS routed, max(date) FILTER (WHERE source<>'SYSTEM' AND date<'2024-01-13') AS newest FROM acted),
 h AS (SELECT *, round(routed/routable,4) AS resolution, round((rows-unconfirmed)/rows,4) AS coverage, (SELECT count(*) FROM range(1,30) r(i) WHERE CAST(newest AS DATE)+CAST(i AS INT)<=DATE '2024-01-20' AND isodow(CAST(newest AS DATE)+CAST(i AS INT))<6) AS stale_days FROM g)
 SELECT rows, system_rows, meetings, timeless_past, timeless_future, unconfirmed, executive, derived, routable, routed, (SELECT max(date) FROM calendar WHERE source<>'SYSTEM') AS newest, resolution, coverage,
 (SELECT count(*) FROM range(1,60) r(i) WHERE CAST((SELECT max(date) FROM calendar WHERE source<>'SYSTEM') AS DATE)+CAST(i AS INT)<=DATE '2024-01-20' AND isodow(CAST((SELECT max(date) FROM calendar WHERE source<>'SYSTEM') AS DATE)+CAST(i AS INT))<6) AS stale_days,
 concat_ws(',', CASE WHEN timeless_past>0 THEN 'timeless' END, CASE WHEN unconfirmed>50 THEN 'unconfirmed' END, CASE WHEN derived>50 THEN 'derived' END, CASE WHEN resolution<0.7 THEN 'resolution' END, CASE WHEN coverage<0.95 THEN 'coverage' END) AS failed FROM h""")
def _(t):
    return O.accuracy_gates(t.calendar, "2024-01-20")


@query("D39_business_days", "bills", """SELECT num, (SELECT count(*) FROM range(1, 400) r(i) WHERE CAST(intro AS DATE)+CAST(i AS INT) <= CAST(intro AS DATE)+CAST(num % 300 AS INT) AND isodow(CAST(intro AS DATE)+CAST(i AS INT))<6) AS days FROM bills""")
def _(t):
    day = F.col("intro").cast("date")
    return t.bills.select("num", C.business_days_since(day, F.date_add(day, (F.col("num") % 300).cast("int"))).alias("days"))


@query("D47_router_cross_check", "calendar", f"WITH f AS (SELECT CASE WHEN route='' THEN 'blank' ELSE route END AS verdict FROM calendar WHERE kind IN ('view','click') AND NOT {S.concrete('time')}) SELECT verdict, count(*) AS n, round(count(*)/(SELECT count(*) FROM f),4) AS share, verdict NOT IN ('admin','meeting','blank') AS unseen FROM f GROUP BY 1")
def _(t):
    return O.router_cross_check(t.calendar, F.when(F.col("kind").isin("view", "click"), "meeting").otherwise("administrative"))


@query("D48_ledger_contamination", "calendar", f"WITH {S.ACTED} SELECT origin, source, count(*) AS n FROM acted WHERE committee='Ledger Updates' AND cls='meeting' GROUP BY 1,2")
def _(t):
    return O.classed(t.calendar).filter((F.col("committee") == "Ledger Updates") & (F.col("cls") == "meeting")).groupBy("origin", "source").agg(N())


@query("D50_code_profile", "legevents", f"""WITH {S.ROUTED}, m AS (SELECT trim(event_code) AS code, count(*) AS n, count(*) FILTER (WHERE {S.real_time('event_date')}) AS real_time, count(*) FILTER (WHERE route='meeting') AS meeting, count(*) FILTER (WHERE route='admin') AS admin, count(*) FILTER (WHERE route='executive') AS executive,
 concat_ws('/', max(CASE WHEN chamber='H' THEN 'H' END), max(CASE WHEN chamber='S' THEN 'S' END)) AS chambers FROM routed GROUP BY 1), s AS (SELECT code, string_agg(d,'|' ORDER BY d) AS samples FROM (SELECT code, d, row_number() OVER (PARTITION BY code ORDER BY d) AS rn FROM (SELECT DISTINCT trim(event_code) AS code, description AS d FROM legevents)) WHERE rn<=3 GROUP BY 1)
 SELECT * FROM m JOIN s USING (code)""")
def _(t):
    main, sample = O.code_profile(routing.route_events(t.legevents))
    return main.join(sample, "code")


@query("D51_verdicts", "legevents", f"""WITH {S.ROUTED} SELECT route, reason, n, samples FROM (SELECT route, reason, count(*) AS n FROM routed GROUP BY 1,2) JOIN (SELECT route, reason, string_agg(c,'|' ORDER BY c) AS samples FROM (SELECT route, reason, c, row_number() OVER (PARTITION BY route, reason ORDER BY c) AS rn FROM (SELECT DISTINCT route, reason, trim(event_code) AS c FROM routed)) WHERE rn<=5 GROUP BY 1,2) USING (route, reason)""")
def _(t):
    return O.verdict_distribution(routing.route_events(t.legevents))


@query("D51_reference_crosstab", "legevents", f"SELECT CASE WHEN reference_type='' THEN 'blank' ELSE lower(reference_type) END AS reference, count(*) AS n, count(*) FILTER (WHERE trim(vote_tally)<>'') AS voted, count(*) FILTER (WHERE {S.real_time('event_date')}) AS timed, count(*) FILTER (WHERE trim(event_code)[1]='G') AS governor FROM legevents GROUP BY 1")
def _(t):
    return t.legevents.groupBy(O.blank_label("reference_type").alias("reference")).agg(
        N(), F.count_if(I.blank("vote_tally") != "").alias("voted"), F.count_if(C.has_real_time("event_date")).alias("timed"), F.count_if(I.blank("event_code").startswith("G")).alias("governor"))


@query("D52_published_safety", "calendar", f"""WITH p AS (SELECT DISTINCT date, committee AS name, {S.minutes('time')} AS minutes FROM calendar WHERE {S.minutes('time')} IS NOT NULL), r AS (SELECT date, committee AS name, min({S.minutes('time')}) + CASE WHEN min(event_id) % 7 = 0 THEN 1441 ELSE 0 END AS minutes FROM calendar WHERE source <> 'DOCKET' AND {S.minutes('time')} IS NOT NULL GROUP BY 1,2)
 SELECT count(*) AS keys, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM r JOIN p USING (date, name, minutes) WHERE r.date=k.date AND r.name=k.name)) AS violations, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.date=k.date AND r.name=k.name)) AS unresolved FROM (SELECT DISTINCT date, name FROM p) k""")
def _(t):
    clocks = t.calendar.withColumn("minutes", C.clock_minutes("time")).filter("minutes IS NOT NULL").withColumnRenamed("committee", "name")
    resolved = clocks.filter("source <> 'DOCKET'").groupBy("date", "name").agg((F.min("minutes") + F.when(F.min("event_id") % 7 == 0, 1441).otherwise(0)).alias("minutes"))
    return O.published_safety(clocks, resolved)


@query("D54_residual_triage", "calendar", rf"""WITH {S.ACTED} SELECT cls, lower(array_to_string(list_filter(regexp_split_to_array(trim(outcome),'\s+'), lambda w: w<>'')[1:2],' ')) AS prefix, count(*) AS n, regexp_matches(lower(array_to_string(list_filter(regexp_split_to_array(trim(outcome),'\s+'), lambda w: w<>'')[1:2],' ')),'amended click|timing') AS covered
 FROM acted WHERE date BETWEEN '2024-01-03' AND '2024-01-28' AND committee='Ledger Updates' AND NOT has_time GROUP BY 1,2,4""")
def _(t):
    return O.residual_triage(t.calendar, ("amended click", "timing"), "2024-01-03", "2024-01-28")


_MSG = r"""al AS (SELECT *, CASE WHEN raw IN ('CRITICAL','WARN','INFO') THEN raw ELSE 'UNKNOWN' END AS severity, regexp_extract(outcome,'^\[([A-Z]+):([A-Z_]+)\]',2) AS category, trim(regexp_extract(outcome,'^\[([A-Z]+):([A-Z_]+)\]\s*(.*)$',3)) AS message FROM
 (SELECT *, CASE WHEN starts_with(origin,'bill_') THEN 'bill' ELSE 'calendar' END AS source, upper(CASE WHEN trim(status)<>'' THEN trim(status) ELSE regexp_extract(outcome,'^\[([A-Z]+):',1) END) AS raw FROM runlog WHERE origin IN ('system_alert','bill_system_alert')))"""


@query("D34_conditions", "runlog", rf"""WITH {_MSG}, cy AS (SELECT CASE WHEN starts_with(origin,'bill_') THEN 'bill' ELSE 'calendar' END AS source, max(ts) AS cts FROM runlog WHERE origin<>'other' GROUP BY 1)
 SELECT al.source, severity, category, lower(regexp_replace(regexp_replace(regexp_replace(message,'\d{{4}}-\d{{2}}-\d{{2}}','#date','g'),'[0-9][0-9,.]*','#','g'),'\s+',' ','g')) AS stem, count(*) AS n, max_by(message, ts) AS message, max(ts) >= any_value(cts) - INTERVAL 6 MINUTE AS active,
 strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_ts FROM al JOIN cy USING (source) GROUP BY 1,2,3,4""")
def _(t):
    c = O.conditions(t.runlog).orderBy("severity_rank", F.desc("last_ts"), "stem")
    return c.select("source", "severity", "category", "stem", "n", "message", "active", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"))


_INC = """inc AS (SELECT ts AS start, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 2 HOUR END AS "end", CASE WHEN event_id = 0 THEN '_genesis' WHEN event_id % 97 = 0 THEN NULL ELSE (['accuracy','parity_gap','degraded','_drill',''])[CAST(event_id % 5 AS INT)+1] END AS cls FROM runlog WHERE kind='error')"""


def incidents(t):
    e = F.col("event_id")
    cls = F.when(e == 0, "_genesis").when(e % 97 == 0, None).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("accuracy", "parity_gap", "degraded", "_drill", "")]), (e % 5 + 1).cast("int")))
    return t.runlog.filter("kind = 'error'").select(F.col("ts").alias("start"), F.when(e % 3 != 0, F.col("ts") + F.expr("interval 2 hours")).alias("end"), cls.alias("cls"))


@query("D35_clean_days", "runlog", f"""WITH {_INC}, g AS (SELECT max(coalesce("end", start)) FILTER (WHERE cls IS NOT NULL AND cls<>'_drill') AS l, min(start) FILTER (WHERE cls='_genesis') AS g, count(*) FILTER (WHERE cls NOT IN ('','_genesis','_drill')) AS incidents_ever, count(*) FILTER (WHERE cls NOT IN ('','_genesis','_drill') AND "end" IS NULL) AS open_now, max(start) FILTER (WHERE cls='_drill') AS d, count(*) FILTER (WHERE cls IS NULL) AS malformed_rows FROM inc)
 SELECT CAST(greatest(floor((epoch(TIMESTAMP '2024-03-01')-epoch(l))/86400),0) AS BIGINT) AS days_clean, CAST(greatest(floor((epoch(TIMESTAMP '2024-03-01')-epoch(g))/86400),0) AS BIGINT) AS monitoring_days, incidents_ever, open_now, CAST(greatest(floor((epoch(TIMESTAMP '2024-03-01')-epoch(d))/86400),0) AS BIGINT) AS last_drill_days, malformed_rows FROM g""")
def _(t):
    return O.clean_days(incidents(t), "2024-03-01 00:00:00")


@query("D36_hour_histogram", "runlog", "SELECT CAST(hour(ts - INTERVAL 5 HOUR) AS BIGINT) AS hour, count(*) AS n, count(*) FILTER (WHERE kind='view') AS added, count(*) FILTER (WHERE kind='click') AS changed FROM runlog GROUP BY 1")
def _(t):
    local = F.hour(F.col("ts") - F.expr("interval 5 hours")).cast("bigint")
    return t.runlog.groupBy(local.alias("hour")).agg(N(), F.count_if(F.col("kind") == "view").alias("added"), F.count_if(F.col("kind") == "click").alias("changed"))


@query("D36_zone_histogram", "runlog", "SELECT CAST(hour(timezone('America/New_York', timezone('UTC', ts))) AS BIGINT) AS hour, count(*) AS n FROM runlog GROUP BY 1")
def _(t):
    local = F.hour(F.from_utc_timestamp("ts", "America/New_York")).cast("bigint")
    return t.runlog.groupBy(local.alias("hour")).agg(N())


@query("D41_vote_breakdown", "legevents", "SELECT user_id, count(*) FILTER (WHERE k='AYE') + count(*) FILTER (WHERE k='AYEWR') AS yes, count(*) FILTER (WHERE k='NAY') AS no, CASE WHEN count(*)>0 THEN (count(*) FILTER (WHERE k='AYE') + count(*) FILTER (WHERE k='AYEWR'))||'-Y '||count(*) FILTER (WHERE k='NAY')||'-N' ELSE '' END AS tally FROM (SELECT user_id, (['AYE','AYEWR','NAY','EXC'])[CAST(event_id % 4 AS INT)+1] AS k FROM legevents) GROUP BY 1")
def _(t):
    from civicmill.operators import quality as Q
    code = F.element_at(F.array(*[F.lit(x) for x in ("AYE", "AYEWR", "NAY", "EXC")]), (F.col("event_id") % 4 + 1).cast("int"))
    return Q.vote_breakdown(t.legevents.select("user_id", code.alias("code")), "user_id", "code").select("user_id", "yes", "no", "tally")


@query("D57_canaries", "runlog", """SELECT event_id, CASE WHEN g IS NULL OR g<0 THEN 'unknown' WHEN g=0 THEN 'clean' ELSE 'drift' END AS state, CAST(CASE WHEN g>0 THEN g ELSE 0 END AS BIGINT) AS novel FROM (SELECT event_id, TRY_CAST(json_extract_string(outcome,'$.gap') AS DOUBLE) AS g FROM runlog WHERE origin='system_metrics')""")
def _(t):
    d = t.runlog.filter("origin = 'system_metrics'").withColumn("g", F.try_element_at(K.metrics_map("outcome"), F.lit("gap")))
    return d.select("event_id", K.canary_state("g").alias("state"), F.when(F.col("g") > 0, F.col("g")).otherwise(0).cast("bigint").alias("novel"))


_RUNS = "runs AS (SELECT date_trunc('hour', ts) AS ts, count(*) FILTER (WHERE kind='error')*9 AS unverified, count(*) FILTER (WHERE kind IN ('error','view'))*7 AS universe, min(event_id) AS event_id FROM runlog GROUP BY 1)"


def runs(t):
    return t.runlog.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(
        (F.count_if(F.col("kind") == "error") * 9).alias("unverified"), (F.count_if(F.col("kind").isin("error", "view")) * 7).alias("universe"), F.min("event_id").alias("event_id"))


@query("E10_delta_guard", "runlog", f"""WITH {_RUNS}, l AS (SELECT *, lag(unverified) OVER (ORDER BY ts) AS p, lag(universe) OVER (ORDER BY ts) AS pu FROM runs), m AS (SELECT *, unverified-p-greatest(universe-pu,0) AS rise FROM l)
 SELECT strftime(ts,'%Y-%m-%d %H:%M:%S') AS ts, coalesce(unverified>p AND rise>0 AND (rise>=25 OR rise>=greatest(p,10)),false) AS alarm FROM m""")
def _(t):
    r = scale.running(runs(t), [], ["ts"], lags={"p": F.col("unverified"), "pu": F.col("universe")})
    return r.select(stamp("ts").alias("ts"), O.delta_alarm("p", "unverified", "pu", "universe").alias("alarm"))


def _quiet(a, b):
    el = lambda x: f"(floor((epoch_us({x})/60e6-300-1380)/1440)*420 + least((epoch_us({x})/60e6-300-1380)-floor((epoch_us({x})/60e6-300-1380)/1440)*1440, 420))"
    return f"greatest({el(b)}-{el(a)}, 0)"


_GAPS = f"""gp AS (SELECT *, (epoch_us(ts)-epoch_us(prev))/60e6 AS gap, CASE WHEN prev IS NOT NULL THEN {_quiet('prev', 'ts')} END AS quiet FROM (SELECT user_id, ts, event_id, date, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM runlog WHERE origin='system_metrics')),
 gaps AS (SELECT *, CASE WHEN prev IS NULL THEN 'first_run' WHEN gap>30*1440 THEN 'stale_cursor' WHEN gap-quiet>360 THEN 'outage' ELSE 'normal' END AS cause FROM gp)"""


def cycle_gaps(t):
    return O.cycle_gaps(t.runlog.filter("origin = 'system_metrics'").select("user_id", "ts", "event_id"), ["user_id"])


@query("E11_cycle_gaps", "runlog", f"WITH {_GAPS} SELECT event_id, round(gap,3) AS gap_minutes, round(quiet,3) AS quiet_minutes, cause FROM gaps")
def _(t):
    return cycle_gaps(t).select("event_id", F.round("gap_minutes", 3).alias("gap_minutes"), F.round("quiet_minutes", 3).alias("quiet_minutes"), "cause")


def window_sql(lead, tail, now, hours):
    return f"""sp AS (SELECT TRY_CAST(date||' '||m AS TIMESTAMP) - INTERVAL {lead} MINUTE AS s, TRY_CAST(date||' '||m AS TIMESTAMP) + INTERVAL {tail} MINUTE AS e FROM (SELECT date, CASE WHEN event_id % 50 = 0 THEN 'soon' ELSE strftime(ts,'%H:%M') END AS m FROM calendar)),
 fate AS (SELECT *, CASE WHEN s IS NULL THEN 'skipped' WHEN e < TIMESTAMP '{now}' THEN 'dropped_past' WHEN s > TIMESTAMP '{now}' + INTERVAL {hours} HOUR THEN 'dropped_horizon' ELSE 'kept' END AS fate FROM sp),
 isl AS (SELECT s, e, sum(nw) OVER (ORDER BY s, e) AS i FROM (SELECT s, e, CASE WHEN max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS nw FROM (SELECT DISTINCT s, e FROM fate WHERE fate='kept'))), win AS (SELECT min(s) AS s, max(e) AS e FROM isl GROUP BY i)"""


_WIN = window_sql(1, 2, "2024-01-05 12:00:00", 480)


def windows(t, lead=1, tail=2, now="2024-01-05 12:00:00", hours=480):
    rows = t.calendar.select("date", F.when(F.col("event_id") % 50 == 0, "soon").otherwise(F.date_format("ts", "HH:mm")).alias("sort_time"))
    return O.activity_windows(rows, now, lead=lead, tail=tail, horizon_hours=hours)


@query("E12_activity_windows", "calendar", f"WITH {_WIN} SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS start, strftime(e,'%Y-%m-%d %H:%M:%S') AS finish FROM win")
def _(t):
    return windows(t)[0].select(stamp("start").alias("start"), stamp("end").alias("finish"))


@query("E12_window_skips", "calendar", f"WITH {_WIN} SELECT fate, count(*) AS n FROM fate GROUP BY 1")
def _(t):
    return windows(t)[1]


_TIER = f"{_WIN}, tr AS (SELECT event_id, ts, CASE WHEN EXISTS (SELECT 1 FROM win WHERE c.ts BETWEEN s AND e) THEN 'IN_WINDOW' WHEN c.ts <= (SELECT max(e) FROM win) THEN 'IDLE' ELSE 'EMPTY' END AS tier FROM calendar c)"


@query("E13_activity_tier", "calendar", f"WITH {_TIER} SELECT event_id, tier FROM tr")
def _(t):
    return O.tiers(t.calendar.select("event_id", "ts"), windows(t)[0]).select("event_id", "tier")


@query("J09_cadence_decision", "calendar", f"WITH {_TIER} SELECT event_id, last IS NULL OR el<0 OR el >= CASE tier WHEN 'IN_WINDOW' THEN 0 WHEN 'IDLE' THEN 55 ELSE 175 END AS run FROM (SELECT *, (epoch_us(ts)-epoch_us(last))/60e6 AS el FROM (SELECT event_id, tier, ts, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ts + INTERVAL 5 MINUTE WHEN 2 THEN ts - INTERVAL 60 MINUTE ELSE ts - INTERVAL 200 MINUTE END AS last FROM tr))")
def _(t):
    tiers = O.tiers(t.calendar.select("event_id", "ts"), windows(t)[0])
    k = F.col("event_id") % 4
    last = F.when(k == 1, F.col("ts") + F.expr("interval 5 minutes")).when(k == 2, F.col("ts") - F.expr("interval 60 minutes")).when(k == 3, F.col("ts") - F.expr("interval 200 minutes"))
    return tiers.select("event_id", O.should_run("ts", last, "tier").alias("run"))


@query("E14_metric_series", "runlog", """SELECT event_id, CAST(event_id % 100 AS DOUBLE) AS value, CASE WHEN event_id % 3 > 0 THEN round(100.0*(event_id % 100)/(event_id % 3),6) END AS share FROM runlog WHERE origin='system_metrics'""")
def _(t):
    log = t.runlog.filter("origin = 'system_metrics'")
    share = O.metric_series(log, "rows_final", "balance_residual").select("event_id", F.round("value", 6).alias("share"))
    return O.metric_series(log, "rows_final").select("event_id", "value").join(share, "event_id", "left")


_SIG = "sig AS (SELECT (['accuracy','degraded'])[CAST(user_id % 2 AS INT)+1] AS cls, 'd'||user_id AS detector, ts, event_id, kind<>'error' AS ok FROM runlog WHERE kind IN ('error','view'))"


def signals(t):
    return t.runlog.filter("kind IN ('error', 'view')").select(F.when(F.col("user_id") % 2 == 0, "accuracy").otherwise("degraded").alias("cls"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("detector"),
                                                              "ts", "event_id", (F.col("kind") != "error").alias("ok"))


@query("J02_outages", "runlog", f"""WITH {_SIG}, p AS (SELECT *, sum(ok::INT) OVER (PARTITION BY cls, detector ORDER BY ts, event_id) AS k FROM sig), g AS (SELECT cls, detector, k, min(ts) FILTER (WHERE NOT ok) AS s, count(*) FILTER (WHERE NOT ok) AS failures, min(ts) FILTER (WHERE ok) AS pt FROM p GROUP BY 1,2,3)
 SELECT a.cls, a.detector, strftime(a.s,'%Y-%m-%d %H:%M:%S') AS start, strftime(b.pt,'%Y-%m-%d %H:%M:%S') AS finish, a.failures FROM g a LEFT JOIN g b ON a.cls=b.cls AND a.detector=b.detector AND b.k=a.k+1 WHERE a.s IS NOT NULL""")
def _(t):
    return O.outages(signals(t)).select("cls", "detector", stamp("start").alias("start"), stamp("end").alias("finish"), "failures")


@query("J04_activity_spans", "calendar", f"WITH {window_sql(2, 5, '2024-01-01 00:00:00', 2000)} SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS start, strftime(e,'%Y-%m-%d %H:%M:%S') AS finish FROM win")
def _(t):
    return windows(t, 2, 5, "2024-01-01 00:00:00", 2000)[0].select(stamp("start").alias("start"), stamp("end").alias("finish"))


@query("J05_hourly_drops", "runlog", "SELECT strftime(date_trunc('hour', ts),'%Y-%m-%d %H:%M:%S') AS hour, kind, count(*) AS n FROM runlog GROUP BY 1,2")
def _(t):
    return t.runlog.groupBy(F.window("ts", "1 hour").start.alias("h"), "kind").agg(N()).select(stamp("h").alias("hour"), "kind", "n")


@query("J07_blind_dates", "runlog calendar", f"""WITH {_GAPS}, d AS (SELECT DISTINCT strftime(unnest(generate_series(date_trunc('day', prev), date_trunc('day', ts), INTERVAL 1 DAY)),'%Y-%m-%d') AS date FROM gaps WHERE cause='outage'),
 a AS (SELECT date, count(*) AS actions FROM calendar WHERE route='meeting' GROUP BY 1), w AS (SELECT DISTINCT date FROM calendar WHERE kind='view' AND value > 150) SELECT a.date, a.actions FROM a JOIN d USING (date) WHERE a.date NOT IN (SELECT date FROM w)""")
def _(t):
    from civicmill.operators import quality as Q
    outages = cycle_gaps(t).filter("cause = 'outage'").select(F.col("prev_ts").alias("start"), F.col("ts").alias("end"))
    actions = t.calendar.filter("route = 'meeting'").groupBy("date").agg(F.count(F.lit(1)).alias("actions"))
    return Q.blind_dates(outages, actions, t.calendar.filter("kind = 'view' AND value > 150").select("date"))


@query("J08_freshness", "runlog", "SELECT CASE WHEN starts_with(origin,'bill_') THEN 'bill' ELSE 'calendar' END AS source, round((epoch_us(TIMESTAMP '2024-02-01')-epoch_us(max(ts)))/60e6,3) AS age_minutes, count(*) AS rows FROM runlog GROUP BY 1")
def _(t):
    return O.freshness(t.runlog, "2024-02-01 00:00:00")


_SK = "lower(%s)"
for _w in ("committee", "on", "for", "the", "of", "and", "&", ",", ".", "-"):
    _SK = f"replace({_SK}, '{_w}', ' ')"
_SK = f"trim(regexp_replace({_SK}, '\\s+', ' ', 'g'))"


@query("C03_join_gaps", "calendar", f"""WITH s AS (SELECT date, {_SK % 'owner'} AS key, schedule_time, min(owner) AS owner FROM (SELECT date, replace(committee,' of ',' ') AS owner, CASE WHEN event_id % 3 = 0 THEN 'TBA' ELSE sort_time END AS schedule_time FROM calendar WHERE kind='view') GROUP BY 1,2,3),
 m AS (SELECT event_id, date, {_SK % 'committee'} AS key FROM calendar WHERE NOT {S.concrete('time')}) SELECT gap_type, count(*) AS n FROM (SELECT CASE WHEN owner IS NULL THEN 'no_lis_committee_match' WHEN lower(trim(schedule_time)) IN ('','none','nan','tba','time tba') THEN 'lis_time_not_concrete' ELSE 'sheet_missing_lis_has_time' END AS gap_type FROM m LEFT JOIN s USING (date, key)) GROUP BY 1""")
def _(t):
    sched = t.calendar.filter("kind = 'view'").select("date", F.replace("committee", F.lit(" of "), F.lit(" ")).alias("owner"),
                                                                          F.when(F.col("event_id") % 3 == 0, "TBA").otherwise(F.col("sort_time")).alias("schedule_time"))
    return O.join_gaps(t.calendar.filter(~C.is_concrete_time("time")), sched).groupBy("gap_type").agg(N())


@query("C05_completeness_check", "history", """WITH need AS (SELECT DISTINCT committee_code AS code, date FROM history WHERE line=1), have AS (SELECT DISTINCT committee_code AS code, date FROM history WHERE line IN (2,3,4,5)), gap AS (SELECT * FROM need EXCEPT SELECT * FROM have)
 SELECT (SELECT count(*) FROM need) AS required, (SELECT count(*) FROM need)-(SELECT count(*) FROM gap) AS covered, (SELECT count(*) FROM gap) AS gaps, 'FAIL' AS verdict""")
def _(t):
    need = t.history.filter("line = 1").select(F.col("committee_code").alias("code"), "date")
    return O.completeness_gaps(need, t.history.filter("line IN (2, 3, 4, 5)").select(F.col("committee_code").alias("code"), "date"), 50)[1]


@query("C07_nearest_book", "history", """WITH r AS (SELECT seq, bill, committee, day FROM history WHERE line=1), b AS (SELECT DISTINCT committee, bill, day + CAST(part % 4 AS INT) AS day FROM history WHERE line=1 AND flag <> 'N'),
 h AS (SELECT r.seq, r.bill, r.committee, r.day, min(abs(datediff('day', b.day, r.day))) FILTER (WHERE b.bill=r.bill) AS hit, count(b.day) AS k FROM r LEFT JOIN b ON b.committee=r.committee AND abs(datediff('day', b.day, r.day))<=2 GROUP BY 1,2,3,4)
 SELECT CASE WHEN k=0 THEN 'NO_BOOK' WHEN hit=0 THEN 'MATCH_SAMEDAY' WHEN hit IS NOT NULL THEN 'MATCH_NEARBY' ELSE 'MISATTRIB' END AS verdict, hit AS "offset", count(*) AS n FROM h GROUP BY 1,2""")
def _(t):
    reports = t.history.filter("line = 1").select("seq", "bill", "committee", "day")
    books = t.history.filter("line = 1 AND flag <> 'N'").select("committee", "bill", F.date_add("day", (F.col("part") % 4).cast("int")).alias("day")).distinct()
    return O.nearest_book(reports, books).groupBy("verdict", "offset").agg(N())


_TOK = S.subject_tokens
_LINK = f"""rw AS (SELECT event_id AS row_id, CASE WHEN event_id % 40 = 0 THEN '' ELSE bill END AS bill, CASE WHEN event_id % 41 = 0 THEN 'soon' ELSE date END AS date, chamber, substr(description,3)||' notice' AS outcome FROM legevents),
 ev AS (SELECT event_id, bill, date, chamber, CASE WHEN event_id % 4 = 0 THEN '' ELSE trim(event_code) END AS code, {S.real_time('event_date')} AS real, {_TOK('description')} AS w FROM legevents WHERE kind IN ('error','purchase')),
 mt AS (SELECT rw.row_id, ev.event_id, ev.code, ev.real, CASE WHEN real THEN len(list_intersect({_TOK('rw.outcome')}, ev.w)) ELSE 0 END AS s FROM rw JOIN ev ON rw.bill=ev.bill AND rw.date=ev.date AND (ev.chamber='' OR rw.chamber='' OR ev.chamber=rw.chamber) WHERE rw.bill<>'' AND TRY_CAST(rw.date AS DATE) IS NOT NULL),
 g AS (SELECT row_id, count(*) AS matched, count(DISTINCT nullif(code,'')) AS codes, bool_or(real) AS real_time, max(s) AS overlap, arg_max(event_id, s*100000000-event_id) FILTER (WHERE s>0) AS best_event FROM mt GROUP BY 1),
 lk AS (SELECT rw.row_id, coalesce(matched,0) AS matched, coalesce(codes,0) AS codes, coalesce(real_time,false) AS real_time, coalesce(overlap,0) AS overlap, best_event, CASE WHEN rw.bill='' OR TRY_CAST(rw.date AS DATE) IS NULL THEN 'X' WHEN matched IS NULL THEN 'D' WHEN codes=0 THEN 'E' WHEN real_time AND overlap>0 THEN 'B' ELSE 'C' END AS linkage FROM rw LEFT JOIN g USING (row_id))"""


def linked(t):
    e = F.col("event_id")
    rows = t.legevents.select(e.alias("row_id"), F.when(e % 40 == 0, "").otherwise(F.col("bill")).alias("bill"), F.when(e % 41 == 0, "soon").otherwise(F.col("date")).alias("date"), "chamber",
                              F.concat(F.expr("substr(description, 3)"), F.lit(" notice")).alias("outcome"))
    events = t.legevents.filter("kind IN ('error', 'purchase')").withColumn("event_code", F.when(e % 4 == 0, "").otherwise(F.col("event_code")))
    return O.linkage(rows, events)


@query("C08_best_overlap", "legevents", f"WITH {_LINK} SELECT row_id, matched, overlap, best_event FROM lk")
def _(t):
    return linked(t).select("row_id", "matched", "overlap", "best_event")


@query("C09_linkage_class", "legevents", f"WITH {_LINK} SELECT linkage, real_time, count(*) AS n, CAST(sum(codes) AS BIGINT) AS codes FROM lk GROUP BY 1,2")
def _(t):
    return linked(t).groupBy("linkage", "real_time").agg(N(), F.sum("codes").alias("codes"))


def _schedule(t):
    """One time per (date, committee) and per (date, chamber), from the schedule rows."""
    s = t.calendar.filter("kind = 'view'").withColumn("m", C.clock_minutes("time")).filter("m IS NOT NULL")
    return s


_FLOOR_NAMES = "('House Convenes','Senate Adjourned','House Recessed')"


@query("C20_resolution_ladder", "calendar legevents", f"""WITH s AS (SELECT *, {S.minutes('time')} AS m FROM calendar WHERE kind='view' AND {S.minutes('time')} IS NOT NULL), r1 AS (SELECT date, committee AS name, min_by(time, event_id) AS time FROM s GROUP BY 1,2),
 rw AS (SELECT event_id, date, bill, committee IN {_FLOOR_NAMES} AS fl, committee[1:6] AS stem, CASE event_id % 7 WHEN 0 THEN committee||' - Sub 1' WHEN 1 THEN 'Docket' WHEN 2 THEN substr(committee, instr(committee,' ')+1) ELSE committee END AS committee, CASE WHEN event_id % 7 = 1 THEN 'Placed on '||committee||' agenda' ELSE outcome END AS outcome FROM calendar WHERE kind<>'view'),
 k AS (SELECT *, nullif(trim(regexp_extract(committee,'^(.*?)\\s+-\\s+',1)),'') AS parent, nullif(trim(regexp_extract(outcome,'(?i)placed on (.+?) agenda',1)),'') AS hint FROM rw),
 sb AS (SELECT date, committee, min_by(time, name) AS time FROM (SELECT DISTINCT date, committee FROM k WHERE committee<>'') JOIN r1 USING (date) WHERE contains(name, committee) OR contains(committee, name) GROUP BY 1,2),
 r5 AS (SELECT date, committee[1:6] AS stem, min_by(time, event_id) AS time FROM s WHERE committee IN {_FLOOR_NAMES} GROUP BY 1,2), r6 AS (SELECT date, bill, max(event_date[12:16]) AS time FROM legevents WHERE kind='purchase' AND {S.real_time('event_date')} GROUP BY 1,2)
 SELECT k.event_id, coalesce(e.time, p.time, h.time, sb.time, r5.time, r6.time) AS resolved_time, CASE WHEN coalesce(e.time, p.time, h.time, sb.time) IS NOT NULL THEN 'api_schedule' WHEN r5.time IS NOT NULL THEN 'convene_anchor' WHEN r6.time IS NOT NULL THEN 'legislation_event' WHEN fl THEN 'floor_miss' ELSE 'journal_default' END AS resolved_origin
 FROM k LEFT JOIN r1 e ON e.date=k.date AND e.name=k.committee LEFT JOIN r1 p ON p.date=k.date AND p.name=k.parent LEFT JOIN r1 h ON h.date=k.date AND h.name=k.hint LEFT JOIN sb ON sb.date=k.date AND sb.committee=k.committee LEFT JOIN r5 ON fl AND r5.date=k.date AND r5.stem=k.stem LEFT JOIN r6 ON NOT fl AND r6.date=k.date AND r6.bill=k.bill""")
def _(t):
    """Some rows name a subcommittee, some only say on whose agenda they were placed, some give part of a name."""
    s, e, committee = _schedule(t), F.col("event_id") % 7, F.col("committee")
    stem = F.substring("committee", 1, 6)
    floor = K.meeting_kind("committee") == "floor"
    named = F.when(e == 0, F.concat("committee", F.lit(" - Sub 1"))).when(e == 1, "Docket").when(e == 2, F.expr("substr(committee, instr(committee, ' ') + 1)")).otherwise(committee)
    said = F.when(e == 1, F.concat(F.lit("Placed on "), "committee", F.lit(" agenda"))).otherwise(F.col("outcome"))
    rows = t.calendar.filter("kind <> 'view'").select("event_id", "date", named.alias("committee"), said.alias("outcome"), F.when(floor, stem).alias("stem"), F.when(~floor, F.col("bill")).alias("bill"), floor.alias("floor"))
    rows = rows.withColumn("parent", O.parent_committee("committee")).withColumn("hint", O.agenda_hint("outcome"))
    exact = s.groupBy("date", "committee").agg(F.min_by("time", "event_id").alias("time"))
    under = lambda name: exact.withColumnRenamed("committee", name)
    convene = s.filter(floor).groupBy("date", stem.alias("stem")).agg(F.min_by("time", "event_id").alias("time"))
    events = t.legevents.filter((F.col("kind") == "purchase") & C.has_real_time("event_date")).groupBy("date", "bill").agg(F.max(F.substring("event_date", 12, 5)).alias("time"))
    rungs = [("api_schedule", exact, ["date", "committee"]), ("api_schedule", under("parent"), ["date", "parent"]), ("api_schedule", under("hint"), ["date", "hint"]),
             ("api_schedule", O.overlapping_names(rows, exact), ["date", "committee"]), ("convene_anchor", convene, ["date", "stem"]), ("legislation_event", events, ["date", "bill"])]
    out = O.resolution_ladder(rows, rungs, F.when(F.col("floor"), "floor_miss").otherwise("journal_default"))
    return out.select("event_id", "resolved_time", "resolved_origin")


def chain_nodes(t):
    """Per day one node per committee; every third anchors to another of that day, some to a missing or circular one."""
    g = t.calendar.groupBy("date", "committee").agg(F.min("event_id").alias("e"), F.min(C.clock_minutes("time")).alias("m"), (F.min("user_id") % 24).alias("k"))
    anchor = F.when(F.col("e") % 3 == 0, F.lit("House Convenes")).when(F.col("e") % 3 == 1, F.lit("Senate Adjourned")).otherwise(F.lit("Nobody"))
    return g.select("date", F.col("committee").alias("name"), F.when((F.col("e") % 4 != 0), F.col("m")).alias("minutes"), anchor.alias("anchor"), (F.col("e") % 5 * 15).alias("offset"))


_NODES = f"nd AS (SELECT date, committee AS name, CASE WHEN min(event_id) % 4 <> 0 THEN min({S.minutes('time')}) END AS minutes, CASE min(event_id) % 3 WHEN 0 THEN 'House Convenes' WHEN 1 THEN 'Senate Adjourned' ELSE 'Nobody' END AS anchor, CASE WHEN min(event_id) % 5 = 0 THEN 1 ELSE min(event_id) % 5 * 15 END AS off FROM calendar GROUP BY 1,2)"


@query("C21_relative_chain", "calendar", f"""WITH RECURSIVE {_NODES}, ch AS (SELECT date, name, anchor AS at, off AS total, 1 AS d FROM nd WHERE minutes IS NULL UNION ALL SELECT ch.date, ch.name, nd.anchor, total+nd.off, d+1 FROM ch JOIN nd ON nd.date=ch.date AND nd.name=ch.at WHERE nd.minutes IS NULL AND d<8),
 rs AS (SELECT ch.date, ch.name, min(nd.minutes+total) AS minutes FROM ch JOIN nd ON nd.date=ch.date AND nd.name=ch.at AND nd.minutes IS NOT NULL GROUP BY 1,2)
 SELECT nd.date, nd.name, coalesce(nd.minutes, rs.minutes) AS minutes, CASE WHEN coalesce(nd.minutes, rs.minutes) IS NULL THEN 'relative_unresolved' ELSE 'resolved' END AS time_class FROM nd LEFT JOIN rs USING (date, name)""")
def _(t):
    return O.relative_chain(chain_nodes(t))


@query("C22_standing_pattern", "calendar", f"""WITH c AS (SELECT event_id, date, committee, committee[1:6] AS chamber, {S.minutes('time')} AS m FROM calendar), an AS (SELECT date, committee[1:6] AS chamber, min({S.minutes('sort_time')}) AS am FROM calendar WHERE committee IN ('House Convenes','Senate Adjourned','House Recessed') GROUP BY 1,2),
 o AS (SELECT committee, m-am AS off, count(*) AS n FROM c JOIN an USING (date, chamber) WHERE m IS NOT NULL GROUP BY 1,2), u AS (SELECT committee, off FROM (SELECT *, row_number() OVER (PARTITION BY committee ORDER BY n DESC, off) AS rn FROM o) WHERE rn=1)
 SELECT event_id, CASE WHEN am+off BETWEEN 420 AND 1380 THEN am+off END AS derived_minutes, CASE WHEN am+off BETWEEN 420 AND 1380 THEN 'derived_standing' ELSE 'none' END AS derived_origin FROM c LEFT JOIN u USING (committee) LEFT JOIN an USING (date, chamber) WHERE m IS NULL""")
def _(t):
    c = t.calendar.select("event_id", "date", "committee", F.substring("committee", 1, 6).alias("chamber"), C.clock_minutes("time").alias("minutes"))
    anchors = t.calendar.filter(K.meeting_kind("committee") == "floor").groupBy("date", F.substring("committee", 1, 6).alias("chamber")).agg(F.min(C.clock_minutes("sort_time")).alias("anchor_minutes"))
    return O.standing_pattern(c.filter("minutes IS NOT NULL"), anchors, c.filter("minutes IS NULL").drop("minutes")).select("event_id", "derived_minutes", "derived_origin")


@query("C24_docket_times", "calendar", r"""WITH nm AS (SELECT DISTINCT date, committee AS name FROM calendar), w AS (SELECT date, name, unnest(list_filter(list_distinct(regexp_split_to_array(trim(regexp_replace(lower(name),'house|senate|committee','','g')),'\s+')), lambda x: length(x)>3 AND x NOT IN ('of','for','and','&','-'))) AS word FROM nm),
 sc AS (SELECT date, event_id AS place, 'Meeting of '||committee AS label, sort_time AS time FROM calendar WHERE kind='view'), s AS (SELECT date, place, label, time, unnest(list_filter(list_distinct(regexp_split_to_array(lower(label),'\s+')), lambda x: length(x)>3)) AS word FROM sc),
 mt AS (SELECT w.date, w.name, min_by(time, place) AS time FROM w JOIN s USING (date, word) WHERE NOT ((contains(lower(name),'house') AND contains(lower(label),'senate')) OR (contains(lower(name),'senate') AND contains(lower(label),'house'))) GROUP BY 1,2) SELECT nm.date, nm.name, coalesce(time,'Time TBA') AS time FROM nm LEFT JOIN mt USING (date, name)""")
def _(t):
    names = t.calendar.select("date", F.col("committee").alias("name")).distinct()
    scraped = t.calendar.filter("kind = 'view'").select("date", F.col("event_id").alias("place"), F.concat(F.lit("Meeting of "), "committee").alias("label"), F.col("sort_time").alias("time"))
    return O.docket_times(names, scraped)
