"""Fragments shared by the oracle texts."""

from __future__ import annotations

from civicmill.functions import classify as K


def lst(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def like_any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


NULLS = "('nan','none','na','<na>','null')"
PLACEHOLDERS = "('','nan','none','time tba','tba','journal entry','ledger')"


def heal(c):
    return (f"CASE WHEN lower(trim(coalesce({c},''))) IN {NULLS} THEN '' "
            f"ELSE regexp_replace(trim(coalesce({c},'')), '^(\\d+)\\.0$', '\\1') END")


def minutes(c):
    t = f"regexp_replace(trim(coalesce({c},'')), '^~', '')"
    p12 = r"'^(\d{1,2}):(\d{2})\s*([AaPp])\.?\s*[Mm]'"
    p24 = r"'^(\d{1,2}):(\d{2})$'"
    return (f"coalesce((TRY_CAST(regexp_extract({t},{p12},1) AS INT) % 12 + CASE WHEN lower(regexp_extract({t},{p12},3))='p' THEN 12 ELSE 0 END)*60"
            f" + TRY_CAST(regexp_extract({t},{p12},2) AS INT), TRY_CAST(regexp_extract({t},{p24},1) AS INT)*60 + TRY_CAST(regexp_extract({t},{p24},2) AS INT))")


def concrete(c):
    return f"(lower(trim({c})) NOT IN {PLACEHOLDERS} AND NOT starts_with(lower(trim({c})), '⏱'))"


def clock(c):
    return f"trim(regexp_extract(trim({c}), '^[^T ]*[T ](.*)$', 1))"


def meeting_time(c):
    return f"coalesce(TRY_CAST(split_part({clock(c)}, ':', 1) AS INT) BETWEEN 7 AND 23, false)"


def real_time(c):
    return f"(substr({clock(c)},1,8) NOT IN ('','00:00:00','00:00','0:00:00','0:00'))"


FLAG_OUTCOME = """CASE WHEN upper(trim(vetoed))='Y' THEN 'vetoed' WHEN upper(trim(approved))='Y' OR trim(chapter_id)<>'' THEN 'signed'
 WHEN upper(trim(carried_over))='Y' THEN 'carried_over' WHEN upper(trim(failed))='Y' THEN 'dead' WHEN upper(trim(passed))='Y' THEN 'awaiting_governor' END"""

WORD_OUTCOME = f"""CASE WHEN contains(lower(status),'veto') THEN 'vetoed'
 WHEN {like_any('lower(status)', ('approved', 'acts of assembly', 'chapter'))} THEN 'signed'
 WHEN {like_any('lower(status)', ('carried over', 'continued'))} THEN 'carried_over'
 WHEN {like_any('lower(status)', ('passed by indefinitely', 'stricken', 'left in', 'failed', 'tabled', 'incorporated', 'withdrawn', 'no action'))} THEN 'dead'
 WHEN {like_any('lower(status)', ('enrolled', 'pending governor', 'awaiting governor', 'communicated to governor', "governor's action"))} THEN 'awaiting_governor'
 WHEN contains(lower(status),'passed') AND NOT ((contains(lower(status),'house') OR contains(lower(status),'senate')) AND NOT contains(lower(status),'both')) THEN 'awaiting_governor'
 ELSE 'in_progress' END"""

OUTCOME = f"SELECT *, {FLAG_OUTCOME} AS fo, {WORD_OUTCOME} AS wo, coalesce({FLAG_OUTCOME}, {WORD_OUTCOME}) AS outcome FROM bills"

MINISTERIAL = f"""SELECT trim(event_code) AS code FROM legevents WHERE trim(event_code)<>'' GROUP BY 1
 HAVING count(*)>=20 AND NOT bool_or({meeting_time('event_date')}) AND NOT bool_or(trim(vote_tally)<>'')"""

ROUTE = f"""CASE WHEN trim(vote_tally)<>'' THEN 'meeting/recorded_vote'
 WHEN substr(trim(event_code),1,3) IN {lst(K.EXECUTIVE_PREFIXES)} THEN 'executive/executive_action_required'
 WHEN trim(event_code)<>'' AND trim(event_code) IN (SELECT code FROM ministerial) THEN 'admin/ministerial_eventtype'
 WHEN reference_type IN {lst(K.DOCUMENT_TYPES)} THEN 'admin/document'
 WHEN reference_type IN {lst(K.REFERRAL_TYPES)} THEN 'admin/referral_assignment'
 WHEN lower(actor)='governor' OR substr(trim(event_code),1,1)='G' THEN 'admin/executive'
 WHEN status IN {lst(K.CLERICAL_STATUSES)} THEN 'admin/status_clerical'
 WHEN status IN {lst(K.SESSION_STATUSES)} OR status='' THEN 'meeting/status_in_session'
 WHEN {real_time('event_date')} THEN 'meeting/status_unknown_timefallback' ELSE 'admin/status_unknown_timefallback' END"""

ROUTED = f"ministerial AS ({MINISTERIAL}), routed AS (SELECT *, split_part(rr,'/',1) AS route, split_part(rr,'/',2) AS reason FROM (SELECT *, {ROUTE} AS rr FROM legevents))"

REFID_PREP = f"""vote_keys AS (SELECT DISTINCT concat('2611', lpad(cast(p_partkey % 10000 AS string),4,'0')) AS refid FROM part WHERE p_size > 25),
 h0 AS (SELECT *, upper({heal('refid')}) AS r FROM history),
 fan AS (SELECT r, date, count(DISTINCT bill) AS fanout FROM h0 WHERE r<>'' GROUP BY 1,2),
 h1 AS (SELECT h0.*, coalesce(fan.fanout,0) AS fanout, (vote_keys.refid IS NOT NULL) AS in_votes FROM h0 LEFT JOIN fan ON h0.r=fan.r AND h0.date=fan.date LEFT JOIN vote_keys ON h0.r=vote_keys.refid),
 refids AS (SELECT *, CASE WHEN r='' THEN 'EMPTY' WHEN regexp_matches(r,'^[HS]\\d{{1,2}}(\\d{{3}})?V\\d+$') THEN 'VOTE_COMMITTEE'
 WHEN regexp_matches(r,'^\\d+$') AND in_votes THEN 'VOTE_FLOOR' WHEN regexp_matches(r,'^\\d+$') AND length(r)>=7 THEN 'VOTE_UNMATCHED'
 WHEN regexp_matches(r,'^\\d+$') AND fanout>=2 THEN 'BATCH_NOTICE' WHEN regexp_matches(r,'^\\d+$') THEN 'SINGLETON_DOC'
 WHEN regexp_matches(r,'^[HS]\\d{{1,2}}$') THEN 'COMMITTEE_REF' WHEN regexp_matches(r,'^\\d+[A-Z]+$') THEN 'DOCUMENT'
 WHEN regexp_matches(r,'^[HS]B\\d+[A-EG-Z0-9]*F\\d+$') THEN 'DOCUMENT' ELSE 'UNKNOWN_REFID' END AS cls FROM h1)"""

ACTION_CLASS = f"""CASE lower(trim(route)) WHEN 'meeting' THEN 'meeting' WHEN 'admin' THEN 'administrative' WHEN 'executive' THEN 'executive' ELSE
 CASE WHEN lower(trim(outcome)) IN ('','nan','none','na','<na>','null') THEN 'administrative'
 WHEN refid_class IN ('BATCH_NOTICE','COMMITTEE_REF','SINGLETON_DOC','DOCUMENT') THEN 'administrative'
 WHEN schedule_class IN ('MEETING_EVENT','FLOOR','COMMISSION') THEN 'meeting' WHEN schedule_class IN ('DOCKET','CAUCUS') THEN 'administrative'
 ELSE 'unconfirmed' END END"""

ACTED = f"acted AS (SELECT *, {ACTION_CLASS} AS cls, {concrete('time')} AS has_time FROM calendar)"

SUBJECT_STOP = "['the','of','and','for','to','in','a','an','or','by','on','with','certain','relating','act','other','generally']"


def subject_tokens(c):
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z]{{3,}}')), lambda w: NOT list_contains({SUBJECT_STOP}, w))"


def spelling(c):
    return f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def head(c):
    return f"trim(regexp_replace(regexp_replace(lower(regexp_extract(trim({c}), '^[^;:.]*')), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def normal(c):
    t = c
    for e, ch in {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#160;": " ", "&#38;": "&"}.items():
        t = f"replace({t}, '{e}', '{ch}')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?m)^\\s*\\d{{1,4}}\\s', ' ', 'g')"
    t = f"regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s§]', ' ', 'g')"
    t = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    t = f"regexp_replace({t}, '^\\s*be it enacted by the general assembly of virginia[,:]?\\s*', '')"
    return f"trim(regexp_replace({t}, '^\\s*a bill to\\s+', ''))"
