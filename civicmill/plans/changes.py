"""Snapshot differences, conservation, sizing and discrepancy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.functions import times as C
from civicmill.operators import diffs as G
from civicmill.operators import merkle, names
from civicmill.operators import quality as Q
from civicmill.operators import routing
from civicmill.operators.recompute import RESULTS, recompute
from civicmill.plans import sqltext as S
from civicmill.plans.registry import query
from civicmill.plans.scalars import vote_keys
from civicmill.session import scratch_path
from civicmill.sources.store import Store


def N():
    return F.count(F.lit(1)).alias("n")
CUT0, CUT1 = "1996-03-01", "2000-12-31"


def snapshots(t):
    """Two overlapping states of the history; tallies of some parts are corrected in the second."""
    h = t.history.withColumn("refid", I.heal_cell("refid"))
    fixed = F.when(F.col("part") % 10 == 0, F.replace("action", F.lit("-N)"), F.lit("-N 1-A)"))).otherwise(F.col("action"))
    return h.filter(F.col("date") <= CUT1), h.filter(F.col("date") >= CUT0).withColumn("action", fixed)


_IX = lambda name, cond, act: f"{name} AS (SELECT bill, date, CASE WHEN r<>'' THEN 'refid' ELSE 'action' END AS by_, CASE WHEN r<>'' THEN r ELSE a END AS ident, max_by(a, seq) AS a FROM (SELECT *, {S.heal('refid')} AS r, trim({act}) AS a FROM history WHERE {cond}) GROUP BY 1,2,3,4)"
_DIFF = f"{_IX('p', f'''date <= '{CUT1}' ''', 'action')}, {_IX('c', f'''date >= '{CUT0}' ''', '''CASE WHEN part % 10 = 0 THEN replace(action,'-N)','-N 1-A)') ELSE action END''')}"


@query("G01_union_repair", "bills titles", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE note='-') AS filled FROM (SELECT 'bill' AS kind, bill, status AS note FROM bills UNION ALL SELECT 'title', bill, '-' FROM titles) GROUP BY 1")
def _(t):
    u = G.union_repaired(t.bills.select("bill", F.col("status").alias("note"), F.lit("bill").alias("kind")), t.titles.select("bill", F.lit("title").alias("kind")), {"note": "-"})
    return u.groupBy("kind").agg(N(), F.count_if(F.col("note") == "-").alias("filled"))


@query("G02_key_sets", "history bills", "WITH a AS (SELECT DISTINCT bill FROM history), b AS (SELECT DISTINCT CASE WHEN year >= 2001 THEN 'X'||bill ELSE bill END AS bill FROM bills) SELECT (SELECT count(*) FROM a) AS \"left\", (SELECT count(*) FROM b) AS \"right\", (SELECT count(*) FROM a JOIN b USING (bill)) AS both, (SELECT count(*) FROM a WHERE bill NOT IN (SELECT bill FROM b)) AS only_left, (SELECT count(*) FROM b WHERE bill NOT IN (SELECT bill FROM a)) AS only_right")
def _(t):
    return G.key_set_summary(t.history, t.bills.withColumn("bill", F.expr("if(year >= 2001, concat('X', bill), bill)")), ["bill"])


@query("G03_history_diff", "history", f"WITH {_DIFF} SELECT CASE WHEN p.a IS NULL THEN 'history_added' WHEN c.a IS NULL THEN 'history_removed' ELSE 'history_edited' END AS kind, coalesce(p.bill,c.bill) AS bill, coalesce(p.date,c.date) AS date, CASE WHEN coalesce(p.by_,c.by_)='refid' THEN coalesce(p.ident,c.ident) ELSE '' END AS refid, coalesce(p.a,'') AS old, coalesce(c.a,'') AS new FROM p FULL JOIN c ON p.bill=c.bill AND p.date=c.date AND p.by_=c.by_ AND p.ident=c.ident WHERE p.a IS DISTINCT FROM c.a")
def _(t):
    return G.diff_history(*snapshots(t))


def meeting_snapshots(t):
    c = t.calendar
    return c.filter("kind IN ('view', 'click', 'error')"), c.filter("kind IN ('click', 'error', 'purchase', 'signup')")


_MS = lambda name, kinds: f"{name} AS (SELECT date, committee, max_by(trim(time), event_id) AS tm, upper(max_by(trim(status), event_id)) AS st FROM calendar WHERE kind IN ({kinds}) GROUP BY 1,2)"
_SNAP = f"{_MS('p', '''\'view\',\'click\',\'error\'''')}, {_MS('c', '''\'click\',\'error\',\'purchase\',\'signup\'''')}"


@query("G04_schedule_diff", "calendar", f"WITH {_SNAP} SELECT kind, date, committee, old, CASE WHEN kind='schedule_cancelled' THEN '' ELSE new END AS new FROM (SELECT CASE WHEN c.st='CANCELLED' AND p.st<>'CANCELLED' THEN 'schedule_cancelled' WHEN p.tm<>c.tm THEN 'schedule_time_moved' END AS kind, date, committee, p.tm AS old, c.tm AS new FROM p JOIN c USING (date, committee)) WHERE kind IS NOT NULL")
def _(t):
    return G.diff_schedule(*meeting_snapshots(t))


@query("G05_docket_diff", "calendar", "WITH p AS (SELECT DISTINCT date, committee, bill FROM calendar WHERE kind IN ('view','click','error')), c AS (SELECT DISTINCT date, committee, bill FROM calendar WHERE kind IN ('click','error','purchase','signup')) SELECT 'docket_added' AS kind, * FROM (SELECT * FROM c EXCEPT SELECT * FROM p) UNION ALL SELECT 'docket_removed', * FROM (SELECT * FROM p EXCEPT SELECT * FROM c)")
def _(t):
    return G.diff_docket(*meeting_snapshots(t))


def witness_state(df, filled):
    loc = F.when(F.lit(filled) | (F.col("user_id") % 2 == 0), F.concat(F.lit("Room "), F.col("user_id").cast("string"))).otherwise("")
    return df.groupBy("date", "committee").agg(F.max_by(F.struct("time", "sort_time", "status", loc.alias("location")), "event_id").alias("v")).select("date", "committee", "v.*")


@query("G06_change_feed", "calendar", """WITH p AS (SELECT date, committee, max_by(time,event_id) AS tm, max_by(sort_time,event_id) AS so, max_by(status,event_id) AS st, max_by(CASE WHEN user_id % 2 = 0 THEN 'Room '||user_id ELSE '' END,event_id) AS lo FROM calendar WHERE kind IN ('view','click','error') GROUP BY 1,2), c AS (SELECT date, committee, max_by(time,event_id) AS tm, max_by(sort_time,event_id) AS so, max_by(status,event_id) AS st, max_by('Room '||user_id,event_id) AS lo FROM calendar WHERE kind IN ('click','error','purchase','signup') GROUP BY 1,2),
 j AS (SELECT c.date, CASE WHEN p.date IS NULL THEN 'ADDED' WHEN c.tm=p.tm AND c.so=p.so AND c.st=p.st AND c.lo<>p.lo AND p.lo='' THEN 'BACKFILL' WHEN c.tm<>p.tm OR c.so<>p.so OR c.st<>p.st OR c.lo<>p.lo THEN 'CHANGED' END AS event_type FROM c LEFT JOIN p USING (date, committee)) SELECT date, event_type, count(*) AS n FROM j WHERE event_type IS NOT NULL GROUP BY 1,2""")
def _(t):
    a, b = meeting_snapshots(t)
    return G.change_feed(witness_state(a, False), witness_state(b, True)).groupBy("date", "event_type").agg(N())


@query("G07_unannounced", "bills", "SELECT bill, status FROM bills WHERE (bill, status) NOT IN (SELECT bill, CASE WHEN patron_id % 3 = 0 THEN 'Introduced' ELSE status END FROM bills WHERE year < 2000)")
def _(t):
    seen = t.bills.filter("year < 2000").select("bill", F.when(F.col("patron_id") % 3 == 0, "Introduced").otherwise(F.col("status")).alias("status"))
    return G.unannounced(t.bills.select("bill", "status"), seen)


_URL = r"regexp_extract(url,'^https?://[^/]+([^?#]*)',1)"


@query("G08_route_triage", "", f"""WITH r AS (SELECT lower({_URL}) AS route, count(*) AS n FROM pages GROUP BY 1), c AS (SELECT DISTINCT lower({_URL}) AS route FROM pages WHERE contains(url,'://m.')), p AS (SELECT DISTINCT lower({_URL}) AS route FROM pages WHERE contains(url,'://blog.'))
 SELECT route, n, CASE WHEN route IN (SELECT route FROM c) THEN 'consumed' WHEN starts_with(route,'/es/') THEN 'non_public' WHEN contains(route,'/6') OR contains(route,'/7') THEN 'non_public' WHEN ends_with(route,'.html') THEN 'reference' WHEN route IN (SELECT route FROM p) THEN 'parked' ELSE 'new' END AS bucket FROM r""")
def _(t):
    routes = t.pages.select("url", F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("route"))
    return G.triage_routes(routes, routes.filter(F.contains("url", F.lit("://m."))), routes.filter(F.contains("url", F.lit("://blog."))), closed_areas=("es",), write_words=("/6", "/7"), reference_suffixes=(".html",))


@query("C06_membership_flag", "history", "SELECT in_parts, count(*) AS n FROM (SELECT part IN (SELECT p_partkey FROM part WHERE p_size>25) AS in_parts FROM history) GROUP BY 1")
def _(t):
    keys = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("part"))
    return routing.with_membership(t.history, keys, "part", "in_parts").groupBy("in_parts").agg(N())


@query("D07_fan_out", "history", f"WITH {S.REFID_PREP} SELECT r, date, fanout FROM fan")
def _(t):
    return routing.fan_out(t.history).select(F.col("_r").alias("r"), "date", "fanout")


@query("D09_novel_shapes", "history", f"WITH {S.REFID_PREP} SELECT regexp_replace({S.heal('refid')},'\\d+','#','g') AS shape, count(*) AS n FROM refids WHERE cls='UNKNOWN_REFID' AND regexp_replace({S.heal('refid')},'\\d+','#','g') NOT IN {S.lst(K.REFID_SHAPES)} GROUP BY 1 HAVING count(*)>=25".replace("\\\\d", "\\d"))
def _(t):
    return routing.novel_shapes(routing.classify_refids(t.history, vote_keys(t)))


@query("C19_crosswalk", "bills", "SELECT count(*) FILTER (WHERE m IN (SELECT session FROM bills WHERE year<2000)) AS matched, count(*) FILTER (WHERE m IS NOT NULL AND m NOT IN (SELECT session FROM bills WHERE year<2000)) AS unmatched, count(*) FILTER (WHERE m IS NULL) AS unmappable, count(*) AS rows FROM (SELECT CASE WHEN num % 6 <> 0 THEN session END AS m FROM bills)")
def _(t):
    rows = t.bills.withColumn("code", F.concat("session", F.when(F.col("num") % 6 == 0, "2").otherwise("1")))
    mapped = F.when(F.col("code").rlike(r"^\d{4}1$"), F.substring("code", 1, 4))
    return G.crosswalk_report(G.crosswalk(rows, mapped, t.bills.filter("year < 2000").select("session")))


_DICT = tuple(f"{c} {n}" for n in ("Agriculture", "Commerce and Labor", "Courts of Justice", "Privileges and Elections") for c in ("House", "Senate"))
_BEST = "SELECT n0.name, n0.n, d.e, 1 - levenshtein(lower(n0.name), lower(d.e))/greatest(length(n0.name), length(d.e), 1) AS ratio FROM n0, (SELECT unnest([" + ",".join(f"'{d}'" for d in _DICT) + "]) AS e) d"


@query("C23_fuzzy_names", "history", f"WITH n0 AS (SELECT CASE WHEN line=3 THEN committee||'s' WHEN line=4 THEN upper(committee) WHEN line=5 THEN committee||' Panel' ELSE committee END AS name, count(*) AS n FROM history GROUP BY 1), b AS ({_BEST}), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, e DESC) AS rn FROM b) SELECT name, n, CASE WHEN ratio>=0.95 THEN e ELSE name END AS matched, round(ratio,6) AS ratio FROM r WHERE rn=1")
def _(t):
    raw = F.when(F.col("line") == 3, F.concat("committee", F.lit("s"))).when(F.col("line") == 4, F.upper("committee")).when(F.col("line") == 5, F.concat("committee", F.lit(" Panel"))).otherwise(F.col("committee"))
    return G.fuzzy_names(t.history.select(raw.alias("raw")), "raw", _DICT)


_RATIO = f"""n0 AS (SELECT CASE WHEN line=3 THEN committee||'s' WHEN line=4 THEN upper(committee) WHEN line=5 THEN committee||' Panel' WHEN line=6 THEN replace(committee,'and','adn') ELSE committee END AS name, count(*) AS n FROM history GROUP BY 1),
 d AS (SELECT unnest({[x for x in _DICT]}) AS e, unnest(range({len(_DICT)})) AS place),
 r AS (SELECT name, e, place, lower(name) AS a, lower(e) AS b, 0 AS a0, length(name) AS a1, 0 AS b0, length(e) AS b1, 0 AS k FROM n0, d
  UNION ALL SELECT name, e, place, a, b, CASE WHEN side=0 THEN a0 ELSE m.i+m.k END, CASE WHEN side=0 THEN m.i ELSE a1 END, CASE WHEN side=0 THEN b0 ELSE m.j+m.k END, CASE WHEN side=0 THEN m.j ELSE b1 END, CASE WHEN side=0 THEN m.k ELSE 0 END
  FROM (SELECT *, list_max(list_transform(list_filter(flatten(list_transform(range(a0, a1), lambda i: list_transform(range(1, least(a1 - i, b1 - b0) + 1), lambda l: {{'k': l, 'i': -i, 'j': -instr(substr(b, b0 + 1, b1 - b0), substr(a, i + 1, l))}}))), lambda x: x.j < 0), lambda x: x)) AS x FROM r WHERE a0 < a1 AND b0 < b1) q,
   LATERAL (SELECT {{'k': q.x.k, 'i': -q.x.i, 'j': -q.x.j - 1 + q.b0}} AS m) z, (VALUES (0), (1)) s(side) WHERE q.x IS NOT NULL),
 t AS (SELECT name, e, place, 2.0 * sum(k) / any_value(length(a) + length(b)) AS ratio FROM r GROUP BY 1, 2, 3), best AS (SELECT name, arg_max(e, (ratio, -place)) AS e, max(ratio) AS ratio FROM t GROUP BY 1)"""


@query("C23_block_ratio", "history", f"""WITH RECURSIVE {_RATIO} SELECT name, n, CASE WHEN ratio >= 0.95 THEN e ELSE name END AS matched, CASE WHEN ratio >= 0.95 THEN round(ratio, 6) END AS ratio FROM n0 JOIN best USING (name)""")
def _(t):
    c = F.col("committee")
    raw = F.when(F.col("line") == 3, F.concat(c, F.lit("s"))).when(F.col("line") == 4, F.upper(c)).when(F.col("line") == 5, F.concat(c, F.lit(" Panel"))).when(F.col("line") == 6, F.replace(c, F.lit("and"), F.lit("adn"))).otherwise(c)
    return names.matched_names(t.history.select(raw.alias("raw")), "raw", _DICT)


@query("D38_conserved_write", "history", "SELECT count(*) AS rows_in, count(*) FILTER (WHERE NOT inside) AS out_of_window, count(*) FILTER (WHERE inside AND blank) AS no_refid, count(DISTINCT (bill, date, action)) FILTER (WHERE inside AND NOT blank) AS rows_written, count(*) FILTER (WHERE inside AND NOT blank) - count(DISTINCT (bill, date, action)) FILTER (WHERE inside AND NOT blank) AS duplicates, 0 AS residual FROM (SELECT bill, date, trim(action) AS action, date BETWEEN '1996-01-01' AND '2000-12-31' AS inside, trim(refid) = '' AS blank FROM history)")
def _(t):
    h = t.history.select("bill", "date", F.trim("action").alias("action"), "seq", "refid")
    drops = {"out_of_window": ~F.col("date").between("1996-01-01", "2000-12-31"), "no_refid": F.trim("refid") == ""}
    return Q.conserved_write(h, ["bill", "date", "action"], "seq", drops, scratch_path(t.spark, "conserved"))


@query("D38_conservation", "history", "SELECT count(*) AS rows_in, count(DISTINCT bill||date||trim(action)) FILTER (WHERE date BETWEEN '1996-01-01' AND '2000-12-31') AS rows_written, count(*) FILTER (WHERE date BETWEEN '1996-01-01' AND '2000-12-31') - count(DISTINCT bill||date||trim(action)) FILTER (WHERE date BETWEEN '1996-01-01' AND '2000-12-31') AS duplicates, count(*) FILTER (WHERE date NOT BETWEEN '1996-01-01' AND '2000-12-31') AS out_of_window, 0 AS residual FROM history")
def _(t):
    h = t.history.select("bill", "date", F.trim("action").alias("action"), "seq")
    inside = F.col("date").between("1996-01-01", "2000-12-31")
    first = h.filter(inside).groupBy("bill", "date", "action").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("copies"))
    extra = first.filter("copies > 1").select(F.explode(F.sequence(F.lit(2), F.col("copies"))).alias("i"))
    return Q.conservation(h, first, {"duplicates": extra, "out_of_window": h.filter(~inside)})


@query("D40_health_findings", "bills", """WITH c AS (SELECT count(*) AS seen, count(*) FILTER (WHERE num % 97 = 0) AS malformed, count(*) FILTER (WHERE num % 97 <> 0) AS written, count(*) FILTER (WHERE num % 97 <> 0 AND fo IS NULL) AS unresolved, count(*) FILTER (WHERE num % 97 <> 0 AND chamber NOT IN ('House','Senate')) AS unknown_chamber, count(*) FILTER (WHERE num % 97 <> 0 AND num % 50 = 1) AS no_session, count(*) FILTER (WHERE num % 97 <> 0 AND trim(action)='') AS no_text FROM (SELECT *, CASE WHEN num % 83 = 0 THEN 'Joint' ELSE string_split(committee,' ')[1] END AS chamber, CASE WHEN num % 61 = 0 THEN ' ' ELSE status END AS action, """ + S.FLAG_OUTCOME + """ AS fo FROM bills))
 SELECT 'CRITICAL' AS status, u.* FROM c, LATERAL (SELECT 'CRITICAL' AS severity, 'MALFORMED_BILL_ID' AS code, malformed AS count, seen AS denominator UNION ALL SELECT 'WARN','UNKNOWN_STRUCTURAL_OUTCOME',unresolved,written UNION ALL SELECT 'WARN','UNKNOWN_CHAMBER_VALUE',unknown_chamber,written UNION ALL SELECT 'WARN','SOURCE_URL_MISSING_SESSION',no_session,written UNION ALL SELECT 'WARN','MISSING_ACTION_TEXT',no_text,written) u WHERE u.count>0""")
def _(t):
    ok = F.col("num") % 97 != 0
    chamber = F.when(F.col("num") % 83 == 0, "Joint").otherwise(F.substring_index("committee", " ", 1))
    action = F.when(F.col("num") % 61 == 0, " ").otherwise(F.col("status"))
    counters = t.bills.withColumn("fo", K.outcome_from_flags()).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(~ok).alias("malformed"), F.count_if(ok).alias("written"), F.count_if(ok & F.col("fo").isNull()).alias("unresolved"),
        F.count_if(ok & ~chamber.isin("House", "Senate")).alias("unknown_chamber"), F.count_if(ok & (F.col("num") % 50 == 1)).alias("no_session"), F.count_if(ok & (F.trim(action) == "")).alias("no_text"))
    return Q.health_findings(counters)


_SEP = "chr(31)"


_NET = lambda c: f"length({c})||':'||{c}"
_HASH = f"sha256({_NET('date')}||{_NET('action')}||{_NET('refid')})"


def _leaves(name, rows):
    """Leaves of every bill's hash tree, named by the first digit of a row's hash."""
    return f"""{name} AS (SELECT bill, substr(h,1,1) AS p, CAST(sum(k) AS BIGINT) AS n, sha256(string_agg(h||'*'||k, ',' ORDER BY h)) AS d
 FROM (SELECT bill, {_HASH} AS h, count(*) AS k FROM {rows} GROUP BY 1, 2) GROUP BY 1, 2)"""


@query("D42_group_digest", "history", f"""WITH {_leaves('l', 'history')}
 SELECT bill, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(p||'='||d, ',' ORDER BY p)) AS digest FROM l GROUP BY 1""")
def _(t):
    return merkle.roots(t.history, ["bill"], ["date", "action", "refid"], depth=1)


_TWO = f"""o AS (SELECT * FROM history WHERE date <= '{CUT1}'),
 c AS (SELECT bill, date, CASE WHEN part % 10 = 0 THEN replace(action,'-N)','-N 1-A)') ELSE action END AS action, refid FROM history WHERE date >= '{CUT0}'), {_leaves('lo', 'o')}, {_leaves('lc', 'c')}"""


@query("D42_changed_leaves", "history", f"""WITH {_TWO}
 SELECT bill, p AS prefix, coalesce(lo.n, 0) AS rows_before, coalesce(lc.n, 0) AS rows_after FROM lo FULL JOIN lc USING (bill, p) WHERE lo.d IS DISTINCT FROM lc.d""")
def _(t):
    """Where two states of the history differ: from the roots of the bills' trees down."""
    h = t.history
    fixed = F.when(F.col("part") % 10 == 0, F.replace("action", F.lit("-N)"), F.lit("-N 1-A)"))).otherwise(F.col("action"))
    old, new = (merkle.tree(s, ["bill"], ["date", "action", "refid"], 1) for s in (h.filter(F.col("date") <= CUT1), h.filter(F.col("date") >= CUT0).withColumn("action", fixed)))
    return merkle.differing_leaves(old, new, ["bill"])


@query("D43_sizing", "history", "WITH p AS (SELECT bill, count(*) AS n, count(*) FILTER (WHERE line<=2) AS g FROM history GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(g) AS BIGINT) AS gated, count(*) FILTER (WHERE g>0) AS keys_gated, round(sum(g)/sum(n),4) AS gated_share, round(sum(n)/count(*),4) AS per_key FROM p")
def _(t):
    return Q.sizing(t.history, "bill", F.col("line") <= 2)


_THREE = f"""sh AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'HB' ELSE 'SB' END||user_id AS bill, date, CASE WHEN event_id % 3 = 0 THEN 'Reported from x' WHEN event_id % 3 = 1 THEN '' ELSE 'Printed' END AS outcome, committee, CASE WHEN event_id % 4 = 0 THEN '⏱️ [NO_SCHEDULE_MATCH]' ELSE time END AS time FROM calendar WHERE kind IN ('view','click')),
 tr AS (SELECT bill, date, description AS action FROM legevents WHERE kind IN ('error','view')), hi AS (SELECT bill, date, description AS action FROM legevents WHERE kind IN ('error','purchase') AND user_id % 3 <> 0)"""
_V = lambda c: f"({S.like_any(f'lower({c})', Q.MEETING_PHRASES)} AND NOT {S.like_any(f'lower({c})', Q.CLERICAL_PHRASES)})"
_TW = f"""{_THREE}, s AS (SELECT bill, date, count(*) AS sheet_rows, count(*) FILTER (WHERE committee='Ledger Updates' AND {_V('outcome')}) AS meeting_in_ledger, count(*) FILTER (WHERE committee<>'Ledger Updates' AND contains(time,'NO_SCHEDULE') AND {_V('outcome')}) AS no_match_meeting, count(*) FILTER (WHERE committee<>'Ledger Updates' AND contains(time,'NO_SCHEDULE') AND NOT {_V('outcome')}) AS no_match_admin, count(*) FILTER (WHERE outcome<>'') AS real_rows FROM sh GROUP BY 1,2),
 q AS (SELECT bill, date, count(*) AS truth_rows, count(*) FILTER (WHERE {_V('action')}) AS truth_meetings FROM tr GROUP BY 1,2), h AS (SELECT bill, date, count(*) AS history_rows, count(*) FILTER (WHERE {_V('action')}) AS history_meetings FROM hi GROUP BY 1,2),
 k AS (SELECT bill, date FROM s UNION SELECT bill, date FROM q UNION SELECT bill, date FROM h), f AS (SELECT k.bill, k.date, coalesce(sheet_rows,0) AS sheet_rows, coalesce(meeting_in_ledger,0) AS meeting_in_ledger, coalesce(no_match_meeting,0) AS no_match_meeting, coalesce(no_match_admin,0) AS no_match_admin, coalesce(history_rows,0) AS history_rows, coalesce(history_meetings,0) AS history_meetings,
 CASE WHEN truth_rows IS NULL AND history_rows IS NULL THEN coalesce(real_rows,0) ELSE 0 END AS phantom, CASE WHEN sheet_rows IS NULL AND coalesce(truth_meetings,0)>0 THEN 1 ELSE 0 END AS drift FROM k LEFT JOIN s USING (bill, date) LEFT JOIN q USING (bill, date) LEFT JOIN h USING (bill, date)),
 b AS (SELECT bill, sum(sheet_rows) AS s, sum(history_rows) AS h, sum(history_meetings) AS hm, sum(meeting_in_ledger) AS a1, sum(no_match_meeting) AS a2, sum(no_match_admin) AS a3, sum(phantom) AS a4, sum(drift) AS a5 FROM f GROUP BY 1)"""


@query("D44_three_sources", "calendar legevents", f"WITH {_TW} SELECT count(*) FILTER (WHERE s=0 AND hm>0) AS missing_bill, CAST(sum(a1) AS BIGINT) AS meeting_in_ledger, CAST(sum(a2) AS BIGINT) AS no_match_meeting, CAST(sum(a3) AS BIGINT) AS no_match_admin, CAST(sum(a4) AS BIGINT) AS phantom, CAST(sum(a5) AS BIGINT) AS drift, count(*) FILTER (WHERE h>0) AS universe, count(*) FILTER (WHERE s>0) AS sheet_bills, count(*) FILTER (WHERE s>0 AND h>0) AS overlap FROM b")
def _(t):
    e = F.col("event_id")
    sheet = t.calendar.filter("kind IN ('view', 'click')").select(
        F.concat(F.when(F.col("user_id") % 2 == 0, "HB").otherwise("SB"), F.col("user_id").cast("string")).alias("bill"), "date",
        F.when(e % 3 == 0, "Reported from x").when(e % 3 == 1, "").otherwise("Printed").alias("outcome"), "committee", F.when(e % 4 == 0, "⏱️ [NO_SCHEDULE_MATCH]").otherwise(F.col("time")).alias("time"))
    ev = t.legevents.select("bill", "date", F.col("description").alias("action"), "kind", "user_id")
    return Q.three_way_summary(Q.three_way(sheet, ev.filter("kind IN ('error', 'view')"), ev.filter("kind IN ('error', 'purchase') AND user_id % 3 <> 0")))


@query("D45_key_collisions", "history", "SELECT num, line, count(*) AS variants FROM (SELECT DISTINCT num, line, action, date FROM history) GROUP BY 1,2 HAVING count(*)>1")
def _(t):
    return Q.key_collisions(t.history, ["num", "line"], ["action", "date"])


@query("D55_committee_stage", "bills", f"SELECT substr(bill,1,1) AS chamber, CASE WHEN right(last_actid,2) IN {S.lst(K.DEAD_IN_COMMITTEE)} THEN 0 ELSE 1 END AS survived, count(*) AS n, count(*) FILTER (WHERE upper(trim(passed))='Y') AS passed FROM bills GROUP BY 1,2")
def _(t):
    return t.bills.groupBy(F.substring("bill", 1, 1).alias("chamber"), K.survived_committee("last_actid").alias("survived")).agg(N(), F.count_if(K.yes("passed")).alias("passed"))


@query("D56_archive_overlap", "bills", "WITH d AS (SELECT DISTINCT year AS session, patron_id AS id FROM bills), z AS (SELECT session, count(*) AS size FROM d GROUP BY 1) SELECT a.session, a.session+1 AS later, a.size, b.size AS later_size, (SELECT count(*) FROM d x JOIN d y ON x.id=y.id AND y.session=x.session+1 WHERE x.session=a.session) AS shared, round((SELECT count(*) FROM d x JOIN d y ON x.id=y.id AND y.session=x.session+1 WHERE x.session=a.session)/least(a.size,b.size),4) AS overlap, (SELECT count(*) FROM d x JOIN d y ON x.id=y.id AND y.session=x.session+1 WHERE x.session=a.session)=a.size AND a.size=b.size AS duplicate FROM z a JOIN z b ON b.session=a.session+1")
def _(t):
    return Q.archive_overlap(t.bills, "year", "patron_id")


@query("J06_incremental", "history", f"""SELECT bill, count(*) AS n, max_by(a, seq) AS last FROM (SELECT *, CASE WHEN part % 10 = 0 THEN replace(action,'-N)','-N 1-A)') ELSE action END AS a FROM history WHERE date >= '{CUT0}') GROUP BY 1""")
def _(t):
    """Two runs on two states: the second reads the first one's version from the store and computes changed bills only."""
    prev, now = snapshots(t)
    compute = lambda h: h.groupBy("bill").agg(N(), F.max_by("action", "seq").alias("last"))
    store = Store(t.spark, scratch_path(t.spark, "results"))
    for state in (prev, now):
        run = recompute(store, state.select("bill", "seq", "action", "refid"), "bill", ["seq", "action", "refid"], compute, buckets=16)
    assert run.full == "", run
    return store.read(RESULTS).drop("part")
