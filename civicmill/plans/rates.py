"""Outcome rates, feature scores and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill.functions import classify as K
from civicmill.functions import text as T
from civicmill.operators import features, permutation
from civicmill.operators import rates as R
from civicmill.plans import sqltext as S
from civicmill.plans.registry import query


def N():
    return F.count(F.lit(1)).alias("n")
FEATURES = ("chamber", "committee", "clause", "volume", "season")


def rows(t):
    b = t.bills.withColumn("y", K.survived_committee("last_actid"))
    vol = t.bills.groupBy("patron_id").agg(F.count(F.lit(1)).alias("v"))
    b = b.join(vol, "patron_id")
    return b.select("num", "bill", "year", "patron_id", "title", "intro", "y", F.substring("bill", 1, 1).alias("chamber"), "committee", T.closing_clause("title").alias("clause"),
                    K.bands("v", [(5, "1-5"), (10, "6-10"), (15, "11-15")], "16+", inclusive=True).alias("volume"), F.when(F.col("month") >= 11, "prefiled").otherwise("in-session").alias("season"),
                    F.when((F.col("patron_id") % 2 == 0) == (F.col("year") % 2 == 0), "majority").otherwise("minority").alias("standing"))


_CL = " ".join(f"WHEN regexp_matches(last, '{p}') THEN '{lab}'" for p, lab in T.CLAUSE_CLASSES)
ROWS = rf"""b0 AS (SELECT *, list_filter(list_transform(string_split(title,';'), lambda x: trim(x)), lambda x: x<>'') AS p FROM bills), b1 AS (SELECT *, lower(p[-1]) AS last, count(*) OVER (PARTITION BY patron_id) AS v FROM b0),
 rw AS (SELECT num, bill, year, patron_id, title, intro, CASE WHEN right(last_actid,2) IN {S.lst(K.DEAD_IN_COMMITTEE)} THEN 0 ELSE 1 END AS y, bill[1] AS chamber, committee, CASE WHEN len(p)<2 THEN 'none' {_CL} ELSE 'other' END AS clause,
 CASE WHEN v<=5 THEN '1-5' WHEN v<=10 THEN '6-10' WHEN v<=15 THEN '11-15' ELSE '16+' END AS volume, CASE WHEN month>=11 THEN 'prefiled' ELSE 'in-session' END AS season, CASE WHEN (patron_id % 2 = 0) = (year % 2 = 0) THEN 'majority' ELSE 'minority' END AS standing FROM b1)"""


@query("D20_prior_rates", "bills", f"WITH {ROWS} SELECT patron_id, committee, CAST(sum(y) AS BIGINT) AS k, count(*) AS n, round(sum(y)/count(*),6) AS rate FROM rw GROUP BY 1,2 HAVING count(*)>=3")
def _(t):
    return R.prior_rates(rows(t), ["patron_id", "committee"], "y", 3)


@query("D21_standing_penalty", "bills", f"WITH {ROWS}, g AS (SELECT title, count(*) FILTER (WHERE standing='majority') AS maj_n, count(*) FILTER (WHERE standing='majority' AND y=1) AS maj_k, count(*) FILTER (WHERE standing='minority') AS min_n, count(*) FILTER (WHERE standing='minority' AND y=1) AS min_k FROM rw GROUP BY 1) SELECT *, CASE WHEN maj_n>=600 AND min_n>=600 THEN round(maj_k/maj_n-min_k/min_n,6) END AS gap, CASE WHEN maj_n>=600 AND min_n>=600 THEN 'rate' WHEN maj_n>0 AND min_n>=15 THEN 'directional' ELSE 'thin' END AS tier FROM g")
def _(t):
    return R.standing_penalty(rows(t), "title", 600, 15)


@query("D22_coverage_bias", "texts", """WITH d AS (SELECT t.*, l.doc_id IS NOT NULL AS lab FROM texts t LEFT JOIN labels l ON l.doc_id=t.doc_id), u AS (SELECT 'passed' AS property, avg(CASE WHEN passed=1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE lab) AS a, avg(CASE WHEN passed=1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT lab) AS b FROM d
 UNION ALL SELECT 'house', avg(CASE WHEN chamber='H' THEN 1.0 ELSE 0.0 END) FILTER (WHERE lab), avg(CASE WHEN chamber='H' THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT lab) FROM d UNION ALL SELECT 'long', avg(CASE WHEN n_chars>2000 THEN 1.0 ELSE 0.0 END) FILTER (WHERE lab), avg(CASE WHEN n_chars>2000 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT lab) FROM d)
 SELECT property, round(a,6) AS labelled, round(b,6) AS unlabelled, round(abs(a-b),6) AS gap FROM u""")
def _(t):
    d = t.texts.join(t.labels.select("doc_id", F.lit(True).alias("_l")), "doc_id", "left").withColumn("lab", F.coalesce("_l", F.lit(False)))
    return R.composition_bias(d, "lab", {"passed": F.col("passed") == 1, "house": F.col("chamber") == "H", "long": F.col("n_chars") > 2000})


@query("D22_session_coverage", "texts", "SELECT session, count(*) AS n, count(l.doc_id) AS labelled, round(count(l.doc_id)/count(*),4) AS share FROM texts t LEFT JOIN labels l ON l.doc_id=t.doc_id GROUP BY 1")
def _(t):
    d = t.texts.join(t.labels.select("doc_id", F.lit(1).alias("_l")), "doc_id", "left")
    return d.groupBy("session").agg(N(), F.count("_l").alias("labelled")).withColumn("share", K.safe_rate("labelled", "n"))


@query("D23_owner_aggregates", "bills", "WITH p AS (SELECT patron_id, committee, count(*) AS n FROM bills GROUP BY 1,2), u AS (SELECT patron_id, committee, row_number() OVER (PARTITION BY patron_id ORDER BY n DESC, committee DESC) AS rn FROM p) SELECT b.patron_id, count(*) AS volume, count(DISTINCT b.committee) AS places, any_value(u.committee) AS usual_place, count(DISTINCT title) AS subjects FROM bills b JOIN u ON u.patron_id=b.patron_id AND rn=1 GROUP BY 1")
def _(t):
    return R.owner_aggregates(t.bills, "patron_id", "committee", "title")


@query("D23_usual_place", "bills", "WITH p AS (SELECT title, committee, count(*) AS n FROM bills GROUP BY 1,2), r AS (SELECT *, sum(n) OVER (PARTITION BY title) AS total, row_number() OVER (PARTITION BY title ORDER BY n DESC, committee) AS rn FROM p) SELECT title, CAST(total AS BIGINT) AS total, committee AS usual FROM r WHERE rn=1 AND total>=5")
def _(t):
    return R.usual_place(t.bills, "title", "committee")


@query("E06_rank_in_owner", "bills", "SELECT bill, patron_id, row_number() OVER (PARTITION BY patron_id ORDER BY num) AS nth FROM bills")
def _(t):
    return R.rank_in_owner(t.bills.select("bill", "patron_id", "num"), "patron_id", "num").select("bill", "patron_id", "nth")


@query("E07_same_day_batch", "bills", "SELECT patron_id, intro, count(*) AS batch FROM bills GROUP BY 1,2")
def _(t):
    return R.same_day_batch(t.bills, "patron_id", "intro")


@query("E07_late_cutoff", "bills", "SELECT intro AS cutoff FROM (SELECT intro, row_number() OVER (ORDER BY intro) AS rn FROM bills) WHERE rn = CAST(floor((SELECT count(*) FROM bills)*0.9) AS BIGINT)+1")
def _(t):
    return R.late_cutoff(t.bills, "intro", 0.90)


def score_sql(train, test, features, corrected=False, minimum=5, prefix=""):
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, {e} AS bucket, y, {{}} FROM rw" for f, e in features)
    null = "tb" if corrected else "rb"
    rate = "least(greatest(k/n + tb - rb, 0), 1)" if corrected else "k/n"
    union = parts.replace("{}", f"{train} AS tr, {test} AS te")
    return f"""lf AS ({union}), tr AS (SELECT feature, bucket, count(*) AS n, sum(y) AS k FROM lf WHERE tr GROUP BY 1,2), bs AS (SELECT (SELECT avg(y) FROM rw WHERE {train}) AS rb, (SELECT avg(y) FROM rw WHERE {test}) AS tb),
 sc AS (SELECT lf.feature, lf.y, CASE WHEN n>={minimum} THEN {rate} ELSE {null} END AS p, {null} AS q, coalesce(n>={minimum},false) AS seen FROM lf CROSS JOIN bs LEFT JOIN tr ON tr.feature=lf.feature AND tr.bucket=lf.bucket WHERE te),
 fin AS (SELECT feature, round((sum(abs(q-y))-sum(abs(p-y)))/sum(abs(q-y))*100,4) AS gain_pct, (SELECT count(*) FROM tr WHERE tr.feature=sc.feature AND n>={minimum}) AS buckets, round(count(*) FILTER (WHERE NOT seen)/count(*),6) AS unseen_share, round(sum(abs(p-y))/count(*),6) AS mae FROM sc GROUP BY 1)"""


_ONE = [(f, f) for f in FEATURES]
_TWO = [(f"{a}*{b}", f"{a}||'|'||{b}") for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
_DEEP = [(f"depth_{d}", "||'|'||".join(FEATURES[:d])) for d in range(1, len(FEATURES) + 1)]


def periods(t):
    r = rows(t)
    return r.filter("year < 1998"), r.filter("year >= 1998")


@query("I07_feature_scores", "bills", f"WITH {ROWS}, {score_sql('year<1998', 'year>=1998', _ONE)} SELECT * FROM fin")
def _(t):
    return R.score_features(*periods(t), FEATURES)


@query("I08_corrected_scores", "bills", f"WITH {ROWS}, {score_sql('year<1998', 'year>=1998', _ONE, True)} SELECT * FROM fin")
def _(t):
    return R.score_features(*periods(t), FEATURES, corrected=True)


@query("I08_pair_sweep", "bills", f"WITH {ROWS}, {score_sql('year<1998', 'year>=1998', _TWO, True)} SELECT * FROM fin")
def _(t):
    crossed, names = R.feature_pairs(rows(t), FEATURES)
    return R.score_features(crossed.filter("year < 1998"), crossed.filter("year >= 1998"), names, corrected=True)


@query("I20_interaction_ladder", "bills", f"WITH {ROWS}, {score_sql('year<1998', 'year>=1998', _DEEP, True)} SELECT * FROM fin")
def _(t):
    crossed, names = R.ladder(rows(t), FEATURES)
    return R.score_features(crossed.filter("year < 1998"), crossed.filter("year >= 1998"), names, corrected=True)


@query("I21_temporal_split", "bills", f"WITH {ROWS.replace('rw AS (', 'rw0 AS (')}, rw AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY num) <= count(*) OVER (PARTITION BY year)*0.5 AS learn FROM rw0), {score_sql('learn', 'NOT learn', _ONE)} SELECT * FROM fin")
def _(t):
    s = R.temporal_split(rows(t), "year", "num")
    return R.score_features(s.filter("learn"), s.filter("NOT learn"), FEATURES)


@query("I22_group_persistence", "bills", f"WITH {ROWS}, g AS (SELECT committee, avg(y) FILTER (WHERE year=1997) AS a, avg(y) FILTER (WHERE year=1998) AS b, count(*) FILTER (WHERE year=1997) AS na, count(*) FILTER (WHERE year=1998) AS nb FROM rw GROUP BY 1) SELECT round(corr(a,b),6) AS r, count(*) AS groups FROM g WHERE na>=5 AND nb>=5")
def _(t):
    return R.group_persistence(rows(t), "committee", "year", 1997, 1998)


@query("I09_finding_gate", "bills", f"WITH {ROWS}, b AS (SELECT committee, standing, sum(y) AS k, count(*) AS n FROM rw GROUP BY 1,2), g AS (SELECT committee, CAST(sum(k) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE n>=25) AS buckets, max(k/n) FILTER (WHERE n>=25) AS hi, min(k/n) FILTER (WHERE n>=25) AS lo FROM b GROUP BY 1) SELECT committee, rows, pos, buckets, round(CASE WHEN buckets>=2 THEN hi-lo ELSE 0 END,6) AS spread, concat_ws(',', CASE WHEN least(pos,rows-pos)<50 THEN 'UNDERPOWERED' END, CASE WHEN buckets<2 THEN 'NOT_COMPARABLE' END, CASE WHEN buckets>=2 AND hi-lo>=0.02 THEN 'SUSPICIOUS_SEPARATION' END, CASE WHEN buckets>=2 AND abs(pos/rows-(SELECT avg(y) FROM rw))>=0.01 THEN 'SELECTED_POOL' END) AS warnings FROM g")
def _(t):
    return R.finding_gate(rows(t), "committee", "standing", minority=50, separation=0.02, selection=0.01)


@query("I10_permutation_null")
def _(t):
    return R.permutation_null(rows(t), "committee", "standing")


_MEMBERS = 60
_FB = f"""fb AS (SELECT year AS session, bill, num, bill[1] AS chamber, CASE WHEN num % 17 = 0 THEN '' ELSE 'M'||(patron_id % {_MEMBERS}) END AS chief, committee, CASE WHEN num % 13 = 0 THEN '' ELSE title END AS subject, num % 6 AS versions,
  CASE WHEN right(last_actid,2) IN {S.lst(K.DEAD_IN_COMMITTEE)} THEN 0 ELSE 1 END AS y FROM bills),
 ms AS (SELECT session, i, 'M'||i AS member, CASE WHEN i % 2 = 0 THEN 'H' ELSE 'S' END AS chamber, CASE i % 5 WHEN 0 THEN NULL WHEN 1 THEN 'D' WHEN 2 THEN 'D' ELSE 'R' END AS party, CASE WHEN i % 7 = 0 THEN NULL ELSE i * 2 END AS district,
  CASE WHEN i % 9 <> 0 THEN (i % 10) / 10 + 0.05 END AS loyalty, (i % 8) / 8 AS win_rate FROM (SELECT DISTINCT session FROM fb), range({_MEMBERS}) r(i)),
 mj AS (SELECT session, chamber, party AS majority FROM (SELECT session, chamber, party, row_number() OVER (PARTITION BY session, chamber ORDER BY count(*) DESC, party) AS rn FROM ms WHERE party IS NOT NULL GROUP BY 1,2,3) WHERE rn=1),
 sp AS (SELECT fb.session, fb.bill, fb.chief, fb.committee, fb.chamber, 'M'||(supp % {_MEMBERS}) AS member, (supp % {_MEMBERS}) AS i, line = 2 AS pair, line FROM history JOIN fb USING (bill) WHERE 'M'||(supp % {_MEMBERS}) <> fb.chief),
 co AS (SELECT sp.session, sp.bill, count(*) FILTER (WHERE pair) AS pairs, min_by(coalesce(ms.party,''), (line, sp.member)) FILTER (WHERE pair) AS pp, count(DISTINCT ms.district) AS districts, count(ms.party) AS known, count(*) FILTER (WHERE ms.party = mj.majority) AS inm,
  bool_or((sp.i + length(sp.committee)) % 5 = 0) AS seated FROM sp LEFT JOIN ms ON ms.session=sp.session AND ms.member=sp.member LEFT JOIN mj ON mj.session=sp.session AND mj.chamber=sp.chamber GROUP BY 1,2),
 ge AS (SELECT session, member, count(*) AS generosity, count(DISTINCT chief) FILTER (WHERE chief<>'') AS network FROM sp GROUP BY 1,2), ld AS (SELECT session, committee, count(*) AS load FROM fb GROUP BY 1,2),
 us AS (SELECT session, subject, committee AS usual FROM (SELECT session, subject, committee, sum(count(*)) OVER (PARTITION BY session, subject) AS total, row_number() OVER (PARTITION BY session, subject ORDER BY count(*) DESC, committee) AS rn FROM fb WHERE subject<>'' GROUP BY 1,2,3) WHERE rn=1 AND total>=5),
 nt AS (SELECT session, bill, row_number() OVER (PARTITION BY session, chief ORDER BY num, bill) AS nth FROM fb WHERE chief<>''), pr AS (SELECT session+1 AS session, chief, subject, avg(y) AS prior FROM fb WHERE chief<>'' AND subject<>'' GROUP BY 1,2,3 HAVING count(*)>=3)"""


@query("B31_feature_table", "bills history", f"""WITH {_FB} SELECT fb.session, fb.bill, fb.y, CASE WHEN coalesce(pairs,0)=0 THEN 'no chief co-patron' WHEN pp<>'' AND c.party IS NOT NULL AND pp<>c.party THEN 'cross-party' ELSE 'same-party' END AS bipartisan_chief_pair,
 CASE WHEN c.district IS NULL THEN 'unknown' WHEN c.district<=25 THEN '1-25' WHEN c.district<=50 THEN '26-50' WHEN c.district<=75 THEN '51-75' ELSE '76+' END AS patron_district_band,
 CASE WHEN coalesce(districts,0)=0 THEN 'none' WHEN districts<=2 THEN '1-2' WHEN districts<=9 THEN '3-9' ELSE '10+' END AS copatron_district_spread, CASE WHEN coalesce(known,0)=0 THEN 'none' WHEN inm=known THEN 'all-majority' WHEN inm>0 THEN 'mixed' ELSE 'none-majority' END AS majority_copatron_share,
 CASE WHEN seated THEN 'Y' ELSE 'N' END AS cmte_member_copatrons, CASE WHEN coalesce(generosity,0)=0 THEN '0' WHEN generosity<=20 THEN '1-20' WHEN generosity<=60 THEN '21-60' ELSE '61+' END AS patron_generosity, CASE WHEN coalesce(network,0)<=5 THEN '0-5' WHEN network<=20 THEN '6-20' ELSE '21+' END AS patron_network_breadth,
 CASE WHEN c.loyalty IS NULL THEN 'unknown' WHEN c.loyalty<0.8 THEN '<80%' WHEN c.loyalty<0.92 THEN '80-92%' ELSE '92%+' END AS patron_party_loyalty, CASE WHEN c.win_rate IS NULL THEN 'unknown' WHEN c.win_rate<0.6 THEN '<60%' WHEN c.win_rate<0.8 THEN '60-80%' ELSE '80%+' END AS patron_floor_win_rate,
 CASE WHEN usual IS NULL THEN 'unknown' WHEN usual=fb.committee THEN 'usual' ELSE 'unusual' END AS subject_cmte_match, CASE WHEN load<=60 THEN 'light' WHEN load<=140 THEN 'medium' ELSE 'heavy' END AS cmte_load, CASE WHEN coalesce(nth,99)<=3 THEN '1-3' WHEN coalesce(nth,99)<=10 THEN '4-10' WHEN coalesce(nth,99)<=25 THEN '11-25' ELSE '26+' END AS patron_bill_rank,
 CAST(least(versions,4) AS VARCHAR) AS text_versions, CASE WHEN prior IS NULL THEN 'unknown' WHEN prior<0.5 THEN 'poor' ELSE 'good' END AS patron_prior_on_this_subject
 FROM fb LEFT JOIN co USING (session, bill) LEFT JOIN ms c ON c.session=fb.session AND c.member=fb.chief LEFT JOIN ge ON ge.session=fb.session AND ge.member=fb.chief LEFT JOIN ld ON ld.session=fb.session AND ld.committee=fb.committee
 LEFT JOIN us ON us.session=fb.session AND us.subject=fb.subject LEFT JOIN nt ON nt.session=fb.session AND nt.bill=fb.bill LEFT JOIN pr ON pr.session=fb.session AND pr.chief=fb.chief AND pr.subject=fb.subject""")
def _(t):
    """The whole feature table, outcomes of the session before only."""
    num, name = F.col("num"), lambda c: F.concat(F.lit("M"), (c % _MEMBERS).cast("string"))
    b = t.bills.withColumn("y", K.survived_committee("last_actid")).select(
        F.col("year").alias("session"), "bill", "num", F.substring("bill", 1, 1).alias("chamber"), F.when(num % 17 == 0, "").otherwise(name(F.col("patron_id"))).alias("chief"), "committee",
        F.when(num % 13 == 0, "").otherwise(F.col("title")).alias("subject"), (num % 6).cast("int").alias("versions"), "y")
    s = t.history.select("bill", name(F.col("supp")).alias("member"), (F.col("line") == 2).alias("chief_pair"), F.col("line").alias("place"))
    s = s.join(b.select("session", "bill", "chief"), "bill").filter("member <> chief").drop("chief")
    i = F.col("i")
    m = b.select("session").distinct().select("session", F.explode(F.sequence(F.lit(0), F.lit(_MEMBERS - 1))).alias("i")).select(
        "session", "i", F.concat(F.lit("M"), i.cast("string")).alias("member"), F.when(i % 2 == 0, "H").otherwise("S").alias("chamber"), F.when(i % 5 == 0, "").when(i % 5 <= 2, "D").otherwise("R").alias("party"),
        F.when(i % 7 == 0, "x").otherwise((i * 2).cast("string")).alias("district"), F.when(i % 9 != 0, (i % 10) / 10 + 0.05).alias("loyalty"), ((i % 8) / 8).alias("win_rate"))
    seats = b.select("session", "committee").distinct().join(m.select("session", "i", "member"), "session").filter((i + F.length("committee")) % 5 == 0)
    return features.assemble(b, s, m, seats, m)


@query("I10_permutation_spread", "bills", f"""WITH {ROWS}, b AS (SELECT committee, standing, sum(y) AS k, count(*) AS n FROM rw WHERE y IS NOT NULL GROUP BY 1,2)
 SELECT committee, CAST(sum(n) AS BIGINT) AS cases, CAST(sum(k) AS BIGINT) AS hits, count(*) FILTER (WHERE n>=25) AS buckets, CASE WHEN count(*) FILTER (WHERE n>=25) >= 2 THEN round(max(k/n) FILTER (WHERE n>=25) - min(k/n) FILTER (WHERE n>=25), 6) ELSE 0 END AS spread FROM b GROUP BY 1""")
def _(t):
    """What the permutation test observes; the shares of shuffles that reach it are in the query beside."""
    return permutation.permutation_spread(rows(t), "committee", "standing").select("committee", "cases", "hits", "buckets", "spread")


@query("I10_permutation_tree")
def _(t):
    return permutation.permutation_spread(rows(t), "committee", "standing")


@query("I11_base_drift", "bills", f"WITH {ROWS} SELECT round((SELECT avg(y) FROM rw WHERE year<1998),6) AS before, round((SELECT avg(y) FROM rw WHERE year>=1998),6) AS after, abs(round((SELECT avg(y) FROM rw WHERE year<1998),6)-round((SELECT avg(y) FROM rw WHERE year>=1998),6))>=0.05 AS drifted")
def _(t):
    return R.base_drift(*periods(t))
