"""Roll calls, rosters and member behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill import scale
from civicmill.operators import votes as V
from civicmill.plans.registry import query
from civicmill.session import scratch_path

# roll-call lines with complete, half and unknown pairs, one line per vote row
_LINE = ("concat_ws(',', vote_id, case when token = 'A' then '' else member end, case when token = 'P' then '' else token end, "
         "case when org % 5 = 0 then 'M900' end, case when org % 5 = 0 then 'Y' end, case when org % 7 = 0 then 'M901' end)")
_BARE = f"case when org % 11 = 0 then vote_id else {_LINE} end"


def roll_call_text(t):
    """Lines written as text and read back."""
    path = scratch_path(t.spark, "rollcall")
    t.votes.selectExpr(f"{_BARE} AS value").write.mode("overwrite").text(path)
    return t.spark.read.text(path)


_CELLS = f"ln AS (SELECT string_split({_BARE}, ',') AS c FROM votes), pr AS (SELECT row_number() OVER () AS rid, c[1] AS vote_id, len(c) AS width, c FROM ln)"
_PAIRS = f"{_CELLS}, px AS (SELECT rid, vote_id, i, c[i] AS member, coalesce(c[i+1],'') AS token FROM pr, unnest(range(2, width+1, 2)) AS u(i))"


@query("A02_roll_calls", "votes", f"WITH {_PAIRS} SELECT token, count(*) AS n FROM (SELECT vote_id, member, max(token) AS t1, count(*) AS k, max_by(token, token) AS token FROM px WHERE member<>'' AND token<>'' GROUP BY 1,2) GROUP BY 1".replace("max_by(token, token) AS token", "max_by(token, i*1000 + ascii(token)) AS token"))
def _(t):
    return V.parse_roll_calls(roll_call_text(t)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_SHAPE = r"CASE WHEN regexp_matches(vote_id,'^C\d+V\d+$') THEN 'committee_id_only' WHEN regexp_matches(vote_id,'^[HS]\d+V\d+$') THEN 'chamber_committee' WHEN regexp_matches(vote_id,'^\d{8}$') THEN 'floor' WHEN starts_with(vote_id,'VSV') THEN 'voice_or_standing' ELSE 'other' END"
_MISS = ", ".join(f"count(*) FILTER (WHERE good=0 AND shape='{s}') AS no_detail_{s}" for s in ("committee_id_only", "chamber_committee", "floor", "voice_or_standing", "other"))


@query("D13_parse_health", "votes", f"""WITH {_PAIRS}, agg AS (SELECT rid, count(*) FILTER (WHERE member<>'' AND token<>'') AS good, count(*) FILTER (WHERE (member<>'')<>(token<>'')) AS half,
 count(*) FILTER (WHERE member<>'' AND token<>'' AND token NOT IN ('Y','N','X','A')) AS unk FROM px GROUP BY 1), r AS (SELECT pr.rid, width, {_SHAPE} AS shape, coalesce(good,0) AS good, coalesce(half,0) AS half, coalesce(unk,0) AS unk FROM pr LEFT JOIN agg USING (rid))
 SELECT count(*) AS rows, count(*) FILTER (WHERE good>0) AS rows_with_members, count(*) FILTER (WHERE good=0) AS rows_without_detail, CAST(sum(good) AS BIGINT) AS member_votes, CAST(sum(unk) AS BIGINT) AS unknown_tokens,
 CAST(sum(half) AS BIGINT) AS unpaired_cells, count(DISTINCT width) AS distinct_widths, {_MISS} FROM r""")
def _(t):
    return V.parse_health(roll_call_text(t))


@query("D11_token_record", "votes", "SELECT member, count(*) FILTER (WHERE token='Y') AS y, count(*) FILTER (WHERE token='N') AS n, count(*) FILTER (WHERE token='X') AS x, count(*) FILTER (WHERE token='A') AS a, count(*) FILTER (WHERE token NOT IN ('Y','N','X','A')) AS other, count(*) AS votes FROM votes WHERE vote_id IN (SELECT vote_id FROM votes WHERE org < 12) GROUP BY 1")
def _(t):
    subset = t.votes.filter("org < 12").select("vote_id").distinct()
    v = t.votes.join(subset, "vote_id", "left_semi")
    return V.token_record(v)


@query("D12_position_agreement", "votes", "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vote_id, member ORDER BY seq) AS rn FROM votes) WHERE rn=1), p AS (SELECT vote_id, CASE WHEN min(org) % 2 = 0 THEN 'Y' ELSE 'N' END AS wanted FROM votes GROUP BY 1 HAVING min(org) < 3) SELECT member, count(*) FILTER (WHERE token=wanted) AS k, count(*) AS n FROM f JOIN p USING (vote_id) WHERE token IN ('Y','N') GROUP BY 1")
def _(t):
    pos = t.votes.groupBy("vote_id").agg(F.min("org").alias("o")).filter("o < 3").select("vote_id", F.when(F.col("o") % 2 == 0, "Y").otherwise("N").alias("wanted"))
    return V.agreement_with_positions(V.first_votes(t.votes), pos)


DIR = """dir AS (SELECT d.*, m.party, m.chamber, m.committee, token='Y' AS yes FROM (SELECT *, row_number() OVER (PARTITION BY vote_id, member ORDER BY seq) AS rn FROM votes WHERE token IN ('Y','N')) d LEFT JOIN members m USING (member) WHERE rn=1),
 summ AS (SELECT vote_id, count(*) FILTER (WHERE yes) AS yes_n, count(*) FILTER (WHERE NOT yes) AS no_n FROM dir GROUP BY 1), summ2 AS (SELECT *, abs(yes_n-no_n) AS margin, CASE WHEN yes_n>no_n THEN 'Y' ELSE 'N' END AS winner, yes_n+no_n AS n FROM summ),
 pm AS (SELECT vote_id, party, count(*) FILTER (WHERE yes) AS y, count(*) FILTER (WHERE NOT yes) AS x FROM dir WHERE party<>'' GROUP BY 1,2),
 flagged AS (SELECT dir.*, margin, winner, coalesce(token <> CASE WHEN y>x THEN 'Y' WHEN y<x THEN 'N' END, false) AS defect, token=winner AS with_winner, pm.y, pm.x FROM dir JOIN summ2 USING (vote_id) LEFT JOIN pm ON pm.vote_id=dir.vote_id AND pm.party=dir.party)"""


def directional(t):
    return V.directional(t.votes).join(t.members.select("member", "party", "chamber", "committee"), "member", "left")


def flagged(t):
    return V.with_defection(directional(t))


@query("D14_roll_call_summary", "votes members", f"WITH {DIR} SELECT s.vote_id, yes_n, no_n, margin, winner, n, coalesce(max(CASE WHEN party='D' THEN CASE WHEN y>x THEN 'Y' WHEN y<x THEN 'N' END END),'none') AS d_side, coalesce(max(CASE WHEN party='R' THEN CASE WHEN y>x THEN 'Y' WHEN y<x THEN 'N' END END),'none') AS r_side FROM summ2 s LEFT JOIN pm USING (vote_id) GROUP BY 1,2,3,4,5,6")
def _(t):
    v = directional(t)
    side = V.party_majorities(v).groupBy("vote_id").agg(*[F.coalesce(F.max(F.when(F.col("party") == p, F.col("party_side"))), F.lit("none")).alias(f"{p.lower()}_side") for p in ("D", "R")])
    return V.roll_call_summary(v).join(side, "vote_id", "left").na.fill("none", ["d_side", "r_side"])


@query("D15_defection", "votes members", f"WITH {DIR} SELECT member, count(*) AS votes, count(*) FILTER (WHERE defect) AS defections, count(*) FILTER (WHERE with_winner) AS wins FROM flagged GROUP BY 1")
def _(t):
    return V.defection_rates(flagged(t))


@query("D16_pivotality", "votes members", f"WITH {DIR} SELECT member, count(*) AS n, count(*) FILTER (WHERE margin<=2) AS close, count(*) FILTER (WHERE margin<=2 AND with_winner) AS pivotal, round(count(*) FILTER (WHERE margin<=2)/count(*),4) AS close_share FROM flagged GROUP BY 1")
def _(t):
    return V.pivotality(flagged(t), 2)


_INFER = f"""{DIR}, met AS (SELECT d.member, c.party AS caucus, CASE WHEN d.yes THEN c.y ELSE c.x END - (d.party=c.party)::INT AS k, c.y+c.x-(d.party=c.party)::INT AS n, d.party AS known FROM dir d JOIN pm c USING (vote_id)),
 per AS (SELECT member, caucus, sum(k)/sum(n) AS rate, max(known) AS known FROM met GROUP BY 1,2 HAVING sum(n)>=200), two AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY rate DESC, caucus DESC) AS rn FROM per),
 inf AS (SELECT a.member, a.known, a.caucus AS inferred, a.rate-b.rate AS gap FROM two a JOIN two b ON a.member=b.member AND a.rn=1 AND b.rn=2 WHERE a.rate-b.rate>=0.01)"""


@query("D17_party_inference", "votes members", f"WITH {_INFER} SELECT member, known, inferred, round(gap,6) AS gap FROM inf")
def _(t):
    return V.infer_parties(directional(t), 200, 0.01).withColumn("gap", F.round("gap", 6))


@query("D17_inference_holdout", "votes members", f"WITH {_INFER} SELECT count(*) AS n, count(*) FILTER (WHERE known=inferred) AS hits FROM inf WHERE known<>''")
def _(t):
    return V.inference_holdout(V.infer_parties(directional(t), 200, 0.01))


def composition_sql(seats, keys):
    k = ", ".join(keys)
    return f"""cnt AS (SELECT {k}, CASE WHEN trim(coalesce(party,''))='' THEN '?' ELSE party END AS p, count(*) AS n, min(CASE WHEN role='Chair' THEN member END) AS chair FROM {seats} GROUP BY ALL),
 comp AS (SELECT {k}, string_agg(p||':'||n, ',' ORDER BY p||':'||n) AS party_split, CASE WHEN max(n) FILTER (WHERE p<>'?')*2 > sum(n) THEN max_by(p, n) FILTER (WHERE p<>'?') END AS majority_party, max(n) FILTER (WHERE p<>'?') AS majority_seats, CAST(sum(n) AS BIGINT) AS seats_total, min(chair) AS chair FROM cnt GROUP BY {k})"""


@query("D18_committee_composition", "members", f"WITH {composition_sql('members', ['committee'])} SELECT * FROM comp")
def _(t):
    return V.composition(t.members, ["committee"])


@query("D18_chamber_composition", "members", f"WITH seated AS (SELECT * FROM members WHERE status='Active'), {composition_sql('seated', ['chamber'])} SELECT comp.chamber, party_split, majority_party, seats_total, o.served_not_seated FROM comp JOIN (SELECT chamber, count(*) FILTER (WHERE status<>'Active') AS served_not_seated FROM members GROUP BY 1) o USING (chamber)")
def _(t):
    out = t.members.groupBy("chamber").agg(F.count_if(F.col("status") != "Active").alias("served_not_seated"))
    return V.composition(t.members.filter("status = 'Active'"), ["chamber"]).select("chamber", "party_split", "majority_party", "seats_total").join(out, "chamber")


@query("D19_chairs", "members", "SELECT committee, min(member) FILTER (WHERE role='Chair') AS chair FROM members GROUP BY 1")
def _(t):
    return t.members.groupBy("committee").agg(F.min(F.when(F.col("role") == "Chair", F.col("member"))).alias("chair"))


@query("D24_absence", "votes", "SELECT member, count(*) AS votes, round(count(*) FILTER (WHERE token IN ('X','A'))/count(*),6) AS absence FROM votes GROUP BY 1 HAVING count(*)>=20")
def _(t):
    return V.absence_share(V.token_record(t.votes), 20)


@query("D58_concentration", "votes members", f"WITH {DIR}, d AS (SELECT member, count(*) FILTER (WHERE defect) AS n FROM flagged GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, member) AS rn FROM d) SELECT CAST(sum(n) AS BIGINT) AS total, round(sum(n) FILTER (WHERE rn<=20)/sum(n),4) AS share_20, round(sum(n) FILTER (WHERE rn<=30)/sum(n),4) AS share_30 FROM o")
def _(t):
    return V.concentration(V.defection_rates(flagged(t)))


@query("E19_first_vote", "votes", "SELECT vote_id, member, token FROM (SELECT *, row_number() OVER (PARTITION BY vote_id, member ORDER BY seq) AS rn FROM votes) WHERE rn=1")
def _(t):
    return V.first_votes(t.votes).select("vote_id", "member", "token")


@query("E19_collisions", "votes", "SELECT count(*) FILTER (WHERE n>1) AS collisions, CAST(sum(n-1) AS BIGINT) AS extra_rows, count(*) AS pairs FROM (SELECT count(*) AS n FROM votes GROUP BY vote_id, member)")
def _(t):
    return V.vote_collisions(t.votes)


_NAMES = """nm AS (SELECT member, chamber, CASE suppkey % 5 WHEN 0 THEN name WHEN 1 THEN regexp_extract(replace(name,', Jr.',''),'\\S+$') WHEN 2 THEN substr(name,1,1)||'. '||regexp_extract(replace(name,', Jr.',''),'\\S+$') WHEN 3 THEN 'Q. '||replace(name,', Jr.','') ELSE 'Zed Unknown' END AS name FROM members)"""


def _tokens(c):
    return f"list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(replace({c},', Jr.',''),'[^A-Za-z-]',' ','g')),'\\s+'), lambda w: trim(w,'-')), lambda w: w<>'')"


_RESOLVE = f"""{_NAMES}, ro AS (SELECT member AS person, chamber, t[-1] AS sur, t[1] AS giv, t[1][1] AS ini FROM (SELECT *, {_tokens('name')} AS t FROM members)),
 g1 AS (SELECT sur, giv, min(person) AS p FROM ro GROUP BY 1,2 HAVING count(DISTINCT person)=1), g3 AS (SELECT sur, ini, min(person) AS p FROM ro GROUP BY 1,2 HAVING count(DISTINCT person)=1),
 g4 AS (SELECT sur, min(person) AS p FROM ro GROUP BY 1 HAVING count(DISTINCT person)=1), g5 AS (SELECT sur, chamber, min(person) AS p FROM ro GROUP BY 1,2 HAVING count(DISTINCT person)=1),
 n0 AS (SELECT DISTINCT name, chamber FROM nm), n1 AS (SELECT *, {_tokens('name')} AS t FROM n0),
 res AS (SELECT n1.name, n1.chamber, a.p AS p1, b.p AS p2, c.p AS p3, d.p AS p4, e.p AS p5, t[-1] AS sur FROM n1 LEFT JOIN g1 a ON a.sur=t[-1] AND len(t)>=2 AND a.giv=t[1] LEFT JOIN g1 b ON b.sur=t[-1] AND len(t)>=3 AND length(t[1])=1 AND b.giv=t[2]
 LEFT JOIN g3 c ON c.sur=t[-1] AND len(t)>=2 AND c.ini=t[1][1] LEFT JOIN g4 d ON d.sur=t[-1] LEFT JOIN g5 e ON e.sur=t[-1] AND e.chamber=n1.chamber)"""


@query("C13_identity", "members", f"WITH {_RESOLVE} SELECT name, chamber, coalesce(p1,p2,p3,p4,p5) AS person, CASE WHEN p1 IS NOT NULL THEN 'given' WHEN p2 IS NOT NULL THEN 'second' WHEN p3 IS NOT NULL THEN 'initial' WHEN p4 IS NOT NULL THEN 'surname' WHEN p5 IS NOT NULL THEN 'chamber' ELSE 'unresolved' END AS tier, '~'||sur||'|'||chamber AS stand_in FROM res")
def _(t):
    plain = F.replace("name", F.lit(", Jr."), F.lit(""))
    sur, k = F.regexp_extract(plain, r"(\S+)$", 1), F.col("suppkey") % 5
    spelled = (F.when(k == 0, F.col("name")).when(k == 1, sur).when(k == 2, F.concat(F.substring("name", 1, 1), F.lit(". "), sur))
               .when(k == 3, F.concat(F.lit("Q. "), plain)).otherwise("Zed Unknown"))
    names = t.members.select(spelled.alias("name"), "chamber")
    return V.resolve_identities(names, t.members.select(F.col("member").alias("person"), "name", "chamber"))


def organisations(t):
    """Committees under nations under regions; one region hangs in a cycle without a class."""
    sup = t.supplier.selectExpr("concat('S', s_suppkey) AS id", "concat('N', s_nationkey) AS parent", "cast(null as string) AS value")
    nat = t.nation.selectExpr("concat('N', n_nationkey) AS id", "concat('R', n_regionkey) AS parent", "case when n_nationkey % 6 = 0 then 'S' end AS value")
    reg = t.region.selectExpr("concat('R', r_regionkey) AS id", "case when r_regionkey = 4 then 'N4' end AS parent", "case when r_regionkey < 4 then case when r_regionkey % 2 = 0 then 'H' else 'S' end end AS value")
    return sup.unionByName(nat).unionByName(reg)


_ORGS = """orgs AS (SELECT 'S'||s_suppkey AS id, 'N'||s_nationkey AS parent, NULL AS value FROM supplier UNION ALL SELECT 'N'||n_nationkey, 'R'||n_regionkey, CASE WHEN n_nationkey % 6 = 0 THEN 'S' END FROM nation
 UNION ALL SELECT 'R'||r_regionkey, CASE WHEN r_regionkey=4 THEN 'N4' END, CASE WHEN r_regionkey<4 THEN CASE WHEN r_regionkey % 2 = 0 THEN 'H' ELSE 'S' END END FROM region)"""
_CLIMB = f"{_ORGS}, up AS (SELECT id, id AS cur, 0 AS d FROM orgs UNION ALL SELECT up.id, o.parent, d+1 FROM up JOIN orgs o ON o.id=up.cur WHERE o.value IS NULL AND o.parent IS NOT NULL AND d<12), top AS (SELECT up.id, max(o.value) AS value FROM up JOIN orgs o ON o.id=up.cur GROUP BY 1)"


@query("C14_hierarchy_climb", "", f"WITH RECURSIVE {_CLIMB} SELECT id, value FROM top")
def _(t):
    return V.climb(organisations(t))


@query("C14_root", "", f"""WITH RECURSIVE {_ORGS}, up AS (SELECT id, id AS cur, 0 AS d FROM orgs UNION ALL SELECT up.id, o.parent, d+1 FROM up JOIN orgs o ON o.id=up.cur WHERE o.parent IS NOT NULL AND d<12)
 SELECT up.id, max(CASE WHEN o.parent IS NULL THEN up.cur END) AS root FROM up LEFT JOIN orgs o ON o.id=up.cur GROUP BY 1""")
def _(t):
    """Topmost ancestor of each organisation; null in the cycle."""
    return V.root_of(organisations(t).select("id", "parent"))


@query("C15_vote_facts", "votes members", f"WITH {_ORGS}, up AS (SELECT o.id, coalesce(o.value, n.value, r.value) AS value FROM orgs o LEFT JOIN orgs n ON o.parent=n.id AND o.value IS NULL LEFT JOIN orgs r ON n.parent=r.id AND n.value IS NULL), ev AS (SELECT CASE WHEN year >= 2001 THEN 'X'||vote_id ELSE vote_id END AS vote_id, 'S'||min(org) AS org_id FROM votes GROUP BY 1), f AS (SELECT v.*, ev.org_id, up.value AS venue, m.member AS mm FROM votes v LEFT JOIN ev USING (vote_id) LEFT JOIN up ON up.id=ev.org_id LEFT JOIN (SELECT member FROM members WHERE status='Active') m ON m.member=v.member) SELECT CASE WHEN org_id IS NULL THEN 'no_event' WHEN venue IS NULL THEN 'no_venue' WHEN mm IS NULL THEN 'no_member' ELSE 'matched' END AS match, coalesce(venue,'?') AS venue, count(*) AS n FROM f GROUP BY 1,2")
def _(t):
    events = t.votes.groupBy(F.expr("if(year >= 2001, concat('X', vote_id), vote_id)").alias("vote_id")).agg(F.concat(F.lit("S"), F.min("org").cast("string")).alias("org_id"))
    facts = V.vote_facts(t.votes, events, V.climb(organisations(t)), t.members.filter("status = 'Active'"))
    return facts.groupBy("match", F.coalesce("venue", F.lit("?")).alias("venue")).agg(F.count(F.lit(1)).alias("n"))


@query("C16_peer_agreement", "votes members", f"""WITH {DIR}, con AS (SELECT vote_id FROM summ WHERE yes_n>=3 AND no_n>=3), c AS (SELECT vote_id, member, yes, CAST(substr(member,2) AS BIGINT)//16 AS grp FROM dir WHERE vote_id IN (SELECT vote_id FROM con)),
 p AS (SELECT a.grp, a.member, b.member AS peer, count(*) AS shared, count(*) FILTER (WHERE a.yes=b.yes) AS same FROM c a JOIN c b ON a.vote_id=b.vote_id AND a.grp=b.grp AND a.member<>b.member GROUP BY 1,2,3 HAVING count(*)>=10)
 SELECT grp, member, round(avg(same/shared),6) AS agreement, count(*) AS peers FROM p GROUP BY 1,2""")
def _(t):
    return V.peer_agreement(directional(t), t.members.select("member", F.expr("suppkey div 16").alias("grp")))


_SEASON = f"""{DIR}, s AS (SELECT member, party, chamber, year, CASE WHEN party = CASE WHEN (year + (chamber='H')::INT) % 2 = 0 THEN 'D' ELSE 'R' END THEN 'maj' ELSE 'min' END AS standing, count(*) AS n, count(*) FILTER (WHERE defect) AS d FROM flagged WHERE party<>'' GROUP BY ALL HAVING count(*)>=20),
 st AS (SELECT chamber, year, standing, avg(d/n) AS mu, stddev_pop(d/n) AS sd, count(*) AS size FROM s GROUP BY 1,2,3 HAVING count(*)>=8 AND stddev_pop(d/n)>1e-12), z AS (SELECT s.*, (d/n-mu)/sd AS z FROM s JOIN st USING (chamber, year, standing))"""


def seasons(t):
    v = flagged(t)
    odd = (F.col("year") + F.when(F.col("chamber") == "H", 1).otherwise(0)) % 2
    control = v.select("year", "chamber").distinct().withColumn("majority", F.when(odd == 0, "D").otherwise("R"))
    return V.season_scores(v, control, 20, 8)


@query("E08_persuadability", "votes members", f"WITH {_SEASON} SELECT member, chamber, party, standing, round(avg(z),6) AS score, round(sum(d)/sum(n),6) AS defect_rate, CAST(sum(n) AS BIGINT) AS votes FROM z WHERE year IN (1998,1999,2000) GROUP BY 1,2,3,4 HAVING sum(n)>=40")
def _(t):
    return V.persuadability(seasons(t), (1998, 1999, 2000), 40)


@query("E09_trait_stability", "votes members", f"WITH {_SEASON}, y AS (SELECT member, year, avg(z) AS z FROM z GROUP BY 1,2) SELECT round(corr(a.z,b.z),6) AS r, count(*) AS pairs FROM y a JOIN y b ON a.member=b.member AND b.year=a.year+1")
def _(t):
    return V.trait_stability(seasons(t))


def _compositions(t):
    seats = t.votes.select("org", "year", "member").distinct().join(t.members.select("member", "party", "suppkey"), "member")
    moved = seats.withColumn("role", F.when((F.col("suppkey") + F.col("year")) % 5 == 0, "Chair").otherwise("Member"))
    return V.composition(moved, ["org", "year"])


_SEATS = "seats AS (SELECT DISTINCT v.org, v.year, m.member, m.party, CASE WHEN (m.suppkey+v.year) % 5 = 0 THEN 'Chair' ELSE 'Member' END AS role FROM votes v JOIN members m USING (member))"
_BREAKS = f"{_SEATS}, {composition_sql('seats', ['org', 'year'])}, lg AS (SELECT *, lag(year) OVER w AS py, lag(chair) OVER w AS pc, lag(majority_party) OVER w AS pmj FROM comp WINDOW w AS (PARTITION BY org ORDER BY year)), brk AS (SELECT org, py AS from_session, year AS to_session, chair IS DISTINCT FROM pc AS chair_changed, majority_party IS DISTINCT FROM pmj AS majority_changed FROM lg WHERE py IS NOT NULL)"


@query("E15_composition_breaks", "votes members", f"WITH {_BREAKS} SELECT * FROM brk WHERE chair_changed OR majority_changed")
def _(t):
    return V.composition_breaks(_compositions(t), "org", "year")


@query("E15_pooling_safety", "votes members", f"WITH {_BREAKS} SELECT c.org, count(b.org) AS breaks, count(b.org)=0 AS safe FROM (SELECT DISTINCT org FROM comp) c LEFT JOIN (SELECT * FROM brk WHERE chair_changed OR majority_changed) b USING (org) GROUP BY 1")
def _(t):
    c = _compositions(t)
    return V.pooling_safety(c, V.composition_breaks(c, "org", "year"), "org")


@query("E18_first_seen", "votes", "SELECT member, count(*) AS n, min(first_year) AS first_year, max(year-first_year) AS seniority FROM (SELECT *, min(year) OVER (PARTITION BY member) AS first_year FROM votes) GROUP BY 1")
def _(t):
    per = t.votes.groupBy("member", "year").agg(F.count(F.lit(1)).alias("n"))
    return per.join(V.first_seen(per), "member").groupBy("member").agg(F.sum("n").alias("n"), F.min("first_year").alias("first_year"), F.max(F.col("year") - F.col("first_year")).alias("seniority"))


@query("D46_coverage", "votes", """SELECT member, count(*) AS sessions, CASE WHEN min(y) IS NULL THEN NULL WHEN min(y)=max(y) THEN '('||min(y)||')' ELSE '('||min(y)||'–'||max(y)||')' END AS label, count(*) FILTER (WHERE c NOT IN ('19971','19981')) AS unauthorized, count(*) FILTER (WHERE y IS NULL) AS unreadable,
 count(*) FILTER (WHERE c IN ('19971','19981'))=2 AS complete FROM (SELECT DISTINCT member, CASE WHEN year=1995 THEN 'S95' ELSE year||'1' END AS c, CASE WHEN year<>1995 THEN year END AS y FROM votes) GROUP BY 1""")
def _(t):
    rows = t.votes.select("member", F.when(F.col("year") == 1995, "S95").otherwise(F.concat(F.col("year").cast("string"), F.lit("1"))).alias("code"))
    return V.coverage(rows, "member", "code", ("19971", "19981"))
