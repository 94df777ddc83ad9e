"""Scalar functions over whole tables (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.functions import text as T
from civicmill.functions import times as C
from civicmill.operators import routing
from civicmill.plans import sqltext as S
from civicmill.plans.registry import query

TOPIC_RULES = {"Colour goods": ["red", "blue", "green"], "Hardware": ["bolt", "widget", "rod", "ring"], "Thermal": ["hot", "cold"]}


@query("B01_clean_id", "bills", r"""SELECT num, upper(replace(trim(raw_id),' ','')) AS clean,
 regexp_replace(upper(replace(trim(raw_id),' ','')), '^([A-Z]+)0+(\d+)$', '\1\2') AS canonical FROM bills""")
def _(t):
    return t.bills.select("num", I.clean_bill("raw_id").alias("clean"), I.clean_bill("raw_id", True).alias("canonical"))


@query("B02_parse_date", "history", """SELECT shape, count(*) AS n, count(parsed) AS parsed, strftime(min(parsed),'%Y-%m-%d') AS first, strftime(max(parsed),'%Y-%m-%d') AS last FROM (
 SELECT line AS shape, CASE line WHEN 5 THEN NULL WHEN 6 THEN TRY_CAST(substr(date,1,8)||'31' AS DATE) WHEN 7 THEN NULL ELSE CAST(date AS DATE) END AS parsed FROM history) GROUP BY 1""")
def _(t):
    raw = (F.when(F.col("line") <= 2, F.col("date")).when(F.col("line") == 3, F.date_format("day", "MM/dd/yyyy"))
           .when(F.col("line") == 4, F.date_format("day", "M/d/yyyy")).when(F.col("line") == 5, F.lit("TBA"))
           .when(F.col("line") == 6, F.concat(F.substring("date", 1, 8), F.lit("31"))).otherwise(F.lit(None)))
    d = t.history.select(F.col("line").alias("shape"), C.parse_date(raw).alias("d"))
    return d.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("parsed"),
                                  F.date_format(F.min("d"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last"))


@query("B03_session_code", "bills", """SELECT num, CASE num % 3 WHEN 0 THEN '20'||substr(session,3,2)||'1' WHEN 1 THEN session||'1' ELSE 'S'||session END AS code,
 CASE num % 3 WHEN 0 THEN 2000+CAST(substr(session,3,2) AS INT) WHEN 1 THEN CAST(session AS INT) END AS year FROM bills""")
def _(t):
    raw = (F.when(F.col("num") % 3 == 0, F.concat(F.substring("session", 3, 2), F.lit("1")))
           .when(F.col("num") % 3 == 1, F.concat("session", F.lit("1"))).otherwise(F.concat(F.lit("S"), "session")))
    d = t.bills.withColumn("code", I.normalize_session_code(raw))
    return d.select("num", "code", I.session_year("code").alias("year"))


@query("B04_clock_minutes", "calendar", f"SELECT event_id, {S.minutes('time')} AS minutes, coalesce({S.minutes('time')},{S.minutes('sort_time')},1441) AS sort_minutes FROM calendar")
def _(t):
    return t.calendar.select("event_id", C.clock_minutes("time").alias("minutes"), C.sort_minutes("time", "sort_time").alias("sort_minutes"))


@query("B05_concrete_time", "calendar", f"SELECT time, {S.concrete('time')} AS concrete, count(*) AS n FROM calendar GROUP BY 1,2")
def _(t):
    return t.calendar.groupBy("time", C.is_concrete_time("time").alias("concrete")).agg(F.count(F.lit(1)).alias("n"))


@query("B06_business_hours", "legevents", f"SELECT event_id, {S.meeting_time('event_date')} AS business, {S.real_time('event_date')} AS real_time FROM legevents")
def _(t):
    return t.legevents.select("event_id", C.has_meeting_time("event_date").alias("business"), C.has_real_time("event_date").alias("real_time"))


@query("B07_vote_tally", "history", r"""SELECT seq, num, regexp_extract(action,'(?i)(\d+-Y\s+\d+-N(\s+\d+-A\w*)?)',1) AS tally,
 TRY_CAST(regexp_extract(action,'(?i)(\d+)-Y',1) AS BIGINT) AS yes, TRY_CAST(regexp_extract(action,'(?i)(\d+)-N',1) AS BIGINT) AS no FROM history""")
def _(t):
    yes, no = K.tally_counts("action")
    return t.history.select("seq", "num", K.tally_text("action").alias("tally"), yes.alias("yes"), no.alias("no"))


_FILL = r"\b(house|senate|committee|on|for|the|of|and|subcommittee|sub|agenda)\b"
_STRIPPED = "lower(raw)"
for _tok in ("committee", "on", "for", "the", "of", "and", "&", ",", ".", "-"):
    _STRIPPED = f"replace({_STRIPPED}, '{_tok}', ' ')"


@query("B08_committee_keys", "history", rf"""SELECT raw, trim(regexp_replace({_STRIPPED}, '\s+', ' ', 'g')) AS key1,
 trim(regexp_replace(regexp_replace(regexp_replace(split_part(lower(raw),'-',1),'[^a-z0-9 ]',' ','g'),'{_FILL}',' ','g'),'\s+',' ','g')) AS key2,
 regexp_replace(split_part(split_part(regexp_replace(lower(raw),'\b(senate|house|committee|the)\b','','g'),'subcommittee',1),'-',1),'[^a-z]','','g') AS key3, count(*) AS n
 FROM (SELECT committee||' Committee on the '||lstatus||' - Subcommittee #'||line AS raw FROM history) GROUP BY 1,2,3,4""")
def _(t):
    raw = F.concat("committee", F.lit(" Committee on the "), "lstatus", F.lit(" - Subcommittee #"), F.col("line").cast("string"))
    names = t.history.groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return names.select("raw", T.strip_chars_key("raw").alias("key1"), T.committee_core("raw").alias("key2"), T.committee_letters("raw").alias("key3"), "n")


@query("B09_heal_cells", "history", f"SELECT {S.heal('refid')} AS refid, count(*) AS n, count(*) FILTER (WHERE lower(trim(refid)) IN {S.NULLS}) AS healed FROM history GROUP BY 1")
def _(t):
    return t.history.groupBy(I.heal_cell("refid").alias("refid")).agg(F.count(F.lit(1)).alias("n"), F.count_if(I.was_healed("refid")).alias("healed"))


@query("B10_shape_signature", "history", f"SELECT regexp_replace({S.heal('refid')}, '\\d+', '#', 'g') AS shape, count(*) AS n FROM history GROUP BY 1")
def _(t):
    return t.history.groupBy(I.shape_signature("refid").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("B11_description_key", "legevents", r"""SELECT trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(d,'^[^A-Za-z0-9]*\[[^\]]*\]\s*',''),'^\s*[HS]\s+',''),'\s*\([^)]*\)\s*$','')),'[^a-z0-9]+',' ','g')) AS key, count(*) AS n
 FROM (SELECT '[Memory Anchor: admin] '||description AS d FROM legevents) GROUP BY 1""")
def _(t):
    raw = F.concat(F.lit("[Memory Anchor: admin] "), "description")
    return t.legevents.groupBy(T.description_key(raw).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("B12_topic", "titles", r"""SELECT id, CASE WHEN kind='PROMO' AND NOT contains(title,'hot') THEN 'Promotions'
 WHEN regexp_matches(title,'\b(red|blue|green)(es|s)?\b') THEN 'Colour goods' WHEN regexp_matches(title,'\b(bolt|widget|rod|ring)(es|s)?\b') THEN 'Hardware'
 WHEN regexp_matches(title,'\b(hot|cold)(es|s)?\b') THEN 'Thermal' ELSE 'Unassigned / General' END AS topic FROM titles""")
def _(t):
    override = (F.col("kind") == "PROMO") & ~F.col("title").contains("hot")
    return t.titles.select("id", F.when(override, "Promotions").otherwise(T.topic("title", TOPIC_RULES)).alias("topic"))


@query("B13_include_exclude", "bills", """SELECT num, ((contains(lower(title),'child') OR contains(lower(title),'school')) AND NOT (contains(lower(title),'nurse') OR contains(lower(title),'fees'))) AS flagged FROM bills""")
def _(t):
    return t.bills.select("num", T.flag_words("title", ("child", "school"), ("nurse", "fees")).alias("flagged"))


_CLAUSE = " ".join(f"WHEN regexp_matches(last, '{p}') THEN '{lab}'" for p, lab in T.CLAUSE_CLASSES)


@query("B14_closing_clause", "bills", rf"""WITH s AS (SELECT title, list_filter(list_transform(string_split(title,';'), lambda x: trim(x)), lambda x: x<>'') AS p, count(*) AS n FROM bills GROUP BY 1),
 q AS (SELECT *, lower(p[-1]) AS last FROM s) SELECT title, CASE WHEN len(p)<2 THEN 'none' {_CLAUSE} ELSE 'other' END AS clause, CAST(len(p) AS BIGINT) AS segments,
 CAST(len(regexp_extract_all(title,'(?i)\b(County|City|Town) of\b')) AS BIGINT) AS localities, CAST(len(regexp_extract_all(title,'§+\s*[\d.:\-]+')) AS BIGINT) AS citations, n FROM q""")
def _(t):
    d = t.bills.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return d.select("title", T.closing_clause("title").alias("clause"), F.size(T.segments("title")).cast("bigint").alias("segments"),
                    T.locality_count("title").cast("bigint").alias("localities"), T.citation_count("title").cast("bigint").alias("citations"), "n")


def lifecycle_sql(status, comm, conf, opp, dead, cont):
    s = f"lower(trim({status}))"
    vip = S.like_any(s, ("pending governor", "awaiting governor", "awaiting signature", "enrolled", "communicated to governor", "bill text as passed"))
    un = f"trim({comm}) IN ('-','nan','None','','Unassigned')"
    return f"""CASE WHEN {S.like_any(s, ('signed by governor', 'enacted', 'approved', 'chapter'))} THEN 'Signed & Enacted' WHEN contains({s},'vetoed') THEN 'Vetoed'
 WHEN {dead} OR {cont} THEN 'Dead / Tabled' WHEN {conf} AND NOT {vip} AND (contains({s},'passed') OR contains({s},'conference')) THEN 'In Conference'
 WHEN {vip} OR ({s}='passed' AND {opp}) THEN 'Awaiting Signature'
 WHEN {S.like_any(s, ('passed by indefinitely', 'stricken', 'left in', 'defeated', 'failed', 'tabled', 'incorporated', 'no action taken', 'withdrawn'))} THEN 'Dead / Tabled'
 WHEN {S.like_any(s, ('reported', 'reading waived', 'read second', 'read third', 'read first'))} AND NOT contains({s},'recommends reporting') THEN 'Out of Committee'
 WHEN contains({s},'introduced') AND {un} THEN 'Awaiting Referral'
 WHEN {S.like_any(s, ('passed', 'agreed', 'engrossed', 'communicated', 'received from', 'in senate', 'in house'))} THEN 'Out of Committee'
 WHEN NOT {un} AND length(trim({comm}))>2 THEN 'In Committee'
 WHEN {S.like_any(s, ('referred to', 'in committee', 'prefiled', 'recommitted'))} AND NOT contains({s},'governor') THEN 'In Committee'
 ELSE 'Out of Committee (unrecognized)' END"""


@query("B15_lifecycle", "bills", f"SELECT num, {lifecycle_sql('status', 'comm', '(num % 5 = 0)', '(num % 2 = 0)', '(num % 7 = 0)', '(num % 11 = 0)')} AS lifecycle FROM (SELECT *, CASE WHEN num % 3 = 0 THEN '-' ELSE committee END AS comm FROM bills)")
def _(t):
    n = F.col("num")
    comm = F.when(n % 3 == 0, "-").otherwise(F.col("committee"))
    return t.bills.select("num", K.lifecycle("status", comm, n % 5 == 0, n % 2 == 0, n % 7 == 0, n % 11 == 0).alias("lifecycle"))


@query("B16_outcome_flags", "bills", f"SELECT num, {S.FLAG_OUTCOME} AS outcome FROM bills")
def _(t):
    return t.bills.select("num", K.outcome_from_flags().alias("outcome"))


@query("B17_outcome_words", "bills", f"SELECT status, {S.WORD_OUTCOME} AS outcome, count(*) AS n FROM bills GROUP BY 1,2")
def _(t):
    return t.bills.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", K.outcome_from_status("status"))


@query("B18_outcome_provenance", "bills", f"""SELECT num, outcome, CASE WHEN fo IS NOT NULL THEN 'structural_flag' ELSE 'keyword_fallback' END AS outcome_origin, coalesce(fo<>wo,false) AS outcome_mismatch,
 (fo IS NULL AND wo IN {S.lst(K.SETTLED_OUTCOMES)}) AS unverified_terminal FROM ({S.OUTCOME})""")
def _(t):
    return K.with_outcome(t.bills).select("num", "outcome", "outcome_origin", "outcome_mismatch", "unverified_terminal")


@query("B19_event_route", "legevents", f"WITH {S.ROUTED} SELECT event_id, route, reason FROM routed")
def _(t):
    return routing.route_events(t.legevents).select("event_id", "route", "reason")


@query("B20_refid_class", "history", f"WITH {S.REFID_PREP} SELECT num, seq, fanout, in_votes, cls AS refid_class FROM refids")
def _(t):
    return routing.classify_refids(t.history, vote_keys(t)).select("num", "seq", "fanout", "in_votes", "refid_class")


def vote_keys(t):
    """Stand-in for the key column of the roll-call file."""
    return t.part.filter("p_size > 25").select(F.concat(F.lit("2611"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")).alias("refid"))


@query("B21_schedule_class", "calendar", """SELECT raw, coalesce(CASE regexp_replace(trim(raw),'^(\\d+)\\.0$','\\1') WHEN '1' THEN 'MEETING_EVENT' WHEN '2' THEN 'FLOOR' WHEN '4' THEN 'CAUCUS' WHEN '5' THEN 'COMMISSION' WHEN '6' THEN 'DOCKET' END,'SCHED_OTHER') AS cls, count(*) AS n
 FROM (SELECT CASE WHEN event_id % 2 = 0 THEN (event_id % 8)::VARCHAR||'.0' ELSE ' '||(event_id % 8)::VARCHAR END AS raw FROM calendar) GROUP BY 1,2""".replace("\\\\", "\\"))
def _(t):
    digit = (F.col("event_id") % 8).cast("string")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(digit, F.lit(".0"))).otherwise(F.concat(F.lit(" "), digit))
    return t.calendar.groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn("cls", K.schedule_class("raw"))


@query("B22_action_class", "calendar", f"WITH {S.ACTED} SELECT event_id, cls FROM acted")
def _(t):
    return t.calendar.select("event_id", K.action_class().alias("cls"))


@query("B23_kind_and_class", "calendar", r"""SELECT committee, CASE WHEN regexp_matches(committee,'(?i)\b(re)?conven(es|e|ed)\b|\badjourn(s|ed)?\b|\brecess(es|ed)?\b') THEN 'floor' ELSE 'committee' END AS kind,
 count(*) AS n, count(*) FILTER (WHERE event_id % 6 = 1) AS ceremonial FROM calendar GROUP BY 1,2""")
def _(t):
    legislation = F.when(F.col("event_id") % 6 == 1, " Commending Resolution ").when(F.col("event_id") % 6 == 2, "Legislation")
    return t.calendar.groupBy("committee").agg(F.count(F.lit(1)).alias("n"), F.count_if(K.is_ceremonial(legislation)).alias("ceremonial")).withColumn("kind", K.meeting_kind("committee"))


@query("B24_faceted_search", "bills", f"""SELECT bill, outcome, title FROM ({S.OUTCOME}) WHERE substr(bill,1,1)='H' AND outcome IN ('dead','in_progress') AND contains(lower(bill||' '||title||' '||patron||' '||committee),'penalty')
 ORDER BY substr(bill,1,2), num LIMIT 50 OFFSET 50""")
def _(t):
    found = routing.search(K.with_outcome(t.bills), needle="Penalty ", origin="H", outcomes=("dead", "in_progress"), haystack=("bill", "title", "patron", "committee"))
    return routing.page(found, [I.bill_prefix("bill"), I.bill_number("bill")], 2, 50).select("bill", "outcome", "title")


@query("B25_window_scope", "calendar", """SELECT event_id, date, bill FROM calendar WHERE date BETWEEN '2024-01-08' AND '2024-01-21' AND bill IN (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'HB' ELSE 'SB' END||c_custkey FROM customer WHERE c_acctbal > 5000)""")
def _(t):
    key = F.col("c_custkey")
    tracked = t.customer.filter("c_acctbal > 5000").select(F.concat(F.when(key % 2 == 0, "HB").otherwise("SB"), key.cast("string")).alias("bill"))
    return routing.in_scope(t.calendar, tracked, "2024-01-08", "2024-01-21").select("event_id", "date", "bill")


@query("B26_forward_horizon", "bills", """SELECT num, strftime(CASE WHEN NOT live THEN s WHEN e < t THEN t + INTERVAL 45 DAY ELSE least(greatest(s, t + INTERVAL 14 DAY), e) END,'%Y-%m-%d') AS horizon
 FROM (SELECT num, CAST(intro AS DATE) AS s, CAST(intro AS DATE) + INTERVAL 60 DAY AS e, DATE '1998-06-01' AS t, (num % 4 <> 0) AS live FROM bills)""")
def _(t):
    s = F.col("intro").cast("date")
    return t.bills.select("num", F.date_format(C.forward_horizon(s, F.date_add(s, 60), F.lit("1998-06-01").cast("date"), F.col("num") % 4 != 0), "yyyy-MM-dd").alias("horizon"))


@query("B27_normalize_text", "texts", f"SELECT doc_id, md5({S.normal('text')}) AS digest, CAST(length({S.normal('text')}) AS BIGINT) AS chars FROM texts")
def _(t):
    return t.texts.select("doc_id", T.normalize_text("text").alias("n")).select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("bigint").alias("chars"))


@query("B27_normalize_unicode")
def _(t):
    """With the NFKC step, which has no SQL form."""
    return t.texts.select("doc_id", T.normalize_text("text").alias("n")).select("doc_id", F.md5("n").alias("digest"))


@query("B28_tagged_message", "runlog", r"""SELECT event_id, CASE WHEN raw IN ('CRITICAL','WARN','INFO') THEN raw ELSE 'UNKNOWN' END AS severity, CASE WHEN cat<>'' THEN cat ELSE 'UNCATEGORIZED' END AS category,
 CASE WHEN ok THEN trim(body) ELSE trim(outcome) END AS message FROM (SELECT *, upper(CASE WHEN trim(status)<>'' THEN trim(status) ELSE regexp_extract(outcome,'^\[([A-Z]+):([A-Z_]+)\]',1) END) AS raw,
 regexp_extract(outcome,'^\[([A-Z]+):([A-Z_]+)\]',2) AS cat, regexp_extract(outcome,'^\[([A-Z]+):([A-Z_]+)\]\s*(.*)$',3) AS body, regexp_matches(outcome,'^\[([A-Z]+):([A-Z_]+)\]') AS ok FROM runlog)""")
def _(t):
    parts = K.parse_message("outcome", "status")
    return t.runlog.select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("B29_metrics_map", "runlog", """SELECT event_id, TRY_CAST(json_extract_string(outcome,'$.rows_final') AS DOUBLE) AS rows_final, TRY_CAST(json_extract_string(outcome,'$.balance_residual') AS DOUBLE) AS residual,
 TRY_CAST(json_extract_string(outcome,'$.gap') AS DOUBLE) AS gap, CAST(2 + CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS metrics FROM runlog WHERE origin IN ('system_metrics','bill_system_metrics')""")
def _(t):
    d = t.runlog.filter(F.col("origin").isin("system_metrics", "bill_system_metrics")).select("event_id", K.metrics_map("outcome").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return d.select("event_id", get("rows_final").alias("rows_final"), get("balance_residual").alias("residual"), get("gap").alias("gap"), F.size("m").cast("bigint").alias("metrics"))


@query("B30_name_tokens", "members", r"""SELECT member, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(replace(name,', Jr.',''),'[^A-Za-z-]',' ','g')),'\s+'), lambda w: trim(w,'-')), lambda w: w<>''),' ') AS tokens,
 array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract(replace(name,', Jr.',''),'\S+$'),'[^A-Za-z-]',' ','g')||' '||regexp_replace(regexp_replace(replace(name,', Jr.',''),'\s\S+$',''),'[^A-Za-z-]',' ','g')),'\s+'), lambda w: w<>''),' ') AS reversed FROM members""")
def _(t):
    """A surname-first spelling of each name must give the same tokens turned round."""
    plain = F.replace("name", F.lit(", Jr."), F.lit(""))
    surname_first = F.concat(F.regexp_extract(plain, r"(\S+)$", 1), F.lit(", "), F.regexp_replace(plain, r"\s\S+$", ""))
    given_first = F.array_join(I.name_tokens("name"), " ")
    turned = I.name_tokens(surname_first)
    back = F.array_join(F.concat(F.slice(turned, F.size(turned), F.lit(1)), F.slice(turned, F.lit(1), F.size(turned) - 1)), " ")
    return t.members.select("member", given_first.alias("tokens"), back.alias("reversed"))


@query("B31_feature_bands", "bills history", """SELECT CASE WHEN n IS NULL THEN 'unknown' WHEN n<=1 THEN '1' WHEN n<=3 THEN '2-3' WHEN n<=9 THEN '4-9' ELSE '10+' END AS band,
 CASE WHEN r IS NULL THEN 'unknown' WHEN r<0.4 THEN '<40%' WHEN r<0.7 THEN '40-70%' ELSE '70%+' END AS rate_band, count(*) AS n FROM
 (SELECT b.num, h.n, h.r FROM bills b LEFT JOIN (SELECT num, count(*) AS n, avg(CASE WHEN flag='A' THEN 1.0 ELSE 0.0 END) AS r FROM history GROUP BY 1) h USING (num)) GROUP BY 1,2""")
def _(t):
    h = t.history.groupBy("num").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("flag") == "A").cast("double")).alias("r"))
    d = t.bills.select("num").join(h, "num", "left")
    return d.groupBy(K.bands("n", [(1, "1"), (3, "2-3"), (9, "4-9")], "10+", inclusive=True).alias("band"),
                     K.bands("r", [(0.4, "<40%"), (0.7, "40-70%")], "70%+").alias("rate_band")).agg(F.count(F.lit(1)).alias("n"))


@query("B32_band_tone", "runlog", "SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value<=20 THEN 'good' ELSE 'danger' END AS tone FROM runlog")
def _(t):
    return t.runlog.select("event_id", K.band_tone("value", [(200, "danger"), (20, "good"), (80, "warn")]).alias("tone"))


@query("B33_similarity_label", "history", "SELECT CASE WHEN s>=0.8 THEN 'near-identical' WHEN s>=0.5 THEN 'substantial overlap' WHEN s>=0.15 THEN 'partial overlap' ELSE 'loose' END AS label, count(*) AS n FROM (SELECT qty/50.0 AS s FROM history) GROUP BY 1")
def _(t):
    return t.history.groupBy(K.similarity_label(F.col("qty") / 50.0).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("B34_vote_id_shape", "votes", r"""SELECT CASE WHEN regexp_matches(vote_id,'^C\d+V\d+$') THEN 'committee_id_only' WHEN regexp_matches(vote_id,'^[HS]\d+V\d+$') THEN 'chamber_committee' WHEN regexp_matches(vote_id,'^\d{8}$') THEN 'floor'
 WHEN starts_with(vote_id,'VSV') THEN 'voice_or_standing' ELSE 'other' END AS shape, count(*) AS n, count(DISTINCT vote_id) AS roll_calls FROM votes GROUP BY 1""")
def _(t):
    per_id = t.votes.groupBy("vote_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy(I.vote_id_shape("vote_id").alias("shape")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roll_calls"))


@query("B35_k_of_n", "bills history", """SELECT num, k, n, CASE WHEN n>0 THEN format('{:,}', k)||' of '||format('{:,}', n) END AS shown, CASE WHEN n>0 THEN format('{:,}', greatest(n-k,0))||' of '||format('{:,}', n) END AS against,
 round(CASE WHEN n>0 THEN k/n ELSE -1.0 END, 6) AS sort_rate FROM (SELECT b.num, CAST(coalesce(h.k,0) AS BIGINT) AS k, CAST(coalesce(h.n,0) AS BIGINT) AS n FROM bills b LEFT JOIN
 (SELECT num, count(*) FILTER (WHERE flag='A')*500 AS k, count(*)*500 AS n FROM history GROUP BY 1) h USING (num))""")
def _(t):
    h = t.history.groupBy("num").agg((F.count_if(F.col("flag") == "A") * 500).alias("k"), (F.count(F.lit(1)) * 500).alias("n"))
    d = t.bills.select("num").join(h, "num", "left").na.fill(0, ["k", "n"])
    return d.select("num", "k", "n", K.k_of_n("k", "n").alias("shown"), K.k_of_n(F.greatest(F.col("n") - F.col("k"), F.lit(0)), "n").alias("against"),
                    F.round(K.rate_for_sort("k", "n"), 6).alias("sort_rate"))


@query("B36_status_bucket", "bills", """SELECT status, CASE WHEN contains(lower(status),'received from') THEN '1_Inbox' WHEN contains(lower(status),'passed house') OR contains(lower(status),'passed senate') OR contains(lower(status),'communicated') OR contains(lower(status),'signed by speaker') THEN '3_Outbox' ELSE '2_Floor' END AS bucket,
 CASE WHEN substr(bill,1,1)='H' THEN 'House' ELSE 'Senate' END AS badge, count(*) AS n FROM bills GROUP BY 1,2,3""")
def _(t):
    badge = F.when(F.col("bill").startswith("H"), "House").otherwise("Senate")
    return t.bills.groupBy("status", badge.alias("badge")).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", K.status_bucket("status"))


_PSTOP = "[" + ",".join(f"'{w}'" for w in T.PROCEDURE_STOP_WORDS) + "]"


@query("B37_tokenize", "texts", f"""WITH raw AS (SELECT doc_id, regexp_extract_all(lower(text),'[a-z0-9]+') AS r FROM texts),
 u AS (SELECT doc_id, list_filter(r, lambda w: length(w)>=3 AND NOT list_contains({_PSTOP}, w)) AS one, list_filter(list_zip(r[:-2], r[2:]), lambda p: length(p[1])>=2 AND length(p[2])>=2) AS two FROM raw)
 SELECT doc_id, CAST(len(one) AS BIGINT) AS unigrams, CAST(len(two) AS BIGINT) AS bigrams, md5(array_to_string(one,' ')) AS uni_digest FROM u""")
def _(t):
    d = t.texts.select("doc_id", T.procedure_tokens("text").alias("one"), T.procedure_tokens("text", True).alias("all"))
    return d.select("doc_id", F.size("one").cast("bigint").alias("unigrams"), (F.size("all") - F.size("one")).cast("bigint").alias("bigrams"), F.md5(F.array_join("one", " ")).alias("uni_digest"))


@query("B38_reviewer_text", "legevents", r"""SELECT event_id, substr(r,1,80) AS shown, r AS whole FROM (SELECT event_id, regexp_replace(regexp_replace('[T] '||description,'^[^A-Za-z0-9]*\[[^\]]*\]\s*',''),'^\s*[HS]\s+','') AS r FROM legevents)""")
def _(t):
    tagged = F.concat(F.lit("[T] "), "description")
    return t.legevents.select("event_id", T.reviewer_text(tagged).alias("shown"), T.reviewer_text(tagged, None).alias("whole"))
