"""The second state's records from nested JSON: documents built from the bills, in every shape a container may have."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill.operators import quality as Q
from civicmill.operators import state_b as B
from civicmill.plans.registry import query


def documents(t):
    """A JSON text per bill: containers as lists, as objects with lists or with objects, or missing; odd values in between."""
    num = F.col("num")
    q = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    obj = lambda **kv: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in kv.items()]), F.lit("}"))
    own = F.when(num % 2 == 0, "Assembly").otherwise(" sen ")
    first = obj(date=q(F.col("intro")), sequenceNo=F.lit("1"), chamber=q(own), text=q(F.when(num % 61 == 0, "").otherwise("INTRODUCED")))
    second = obj(date=q(F.col("intro")), sequenceNo=F.lit("2"), chamber=q(F.when(num % 6 == 0, "SENATE").when(num % 83 == 0, "Joint").otherwise(own)), text=q(F.col("status")))
    k = num % 4
    actions = F.when(k == 0, F.concat(F.lit("["), second, F.lit(","), first, F.lit("]"))).when(k == 1, F.concat(F.lit('{"size":2,"items":['), second, F.lit(","), first, F.lit("]}"))).when(k == 2, F.concat(F.lit('{"items":{"1":'), second, F.lit(',"2":'), first, F.lit("}}"))).otherwise("null")
    place = lambda name, day: obj(name=q(name), chamber=q(own), referenceDate=q(F.lit(day)))
    past = F.concat(F.lit('{"items":['), place(F.col("committee"), "2026-02-01"), F.lit(","), place(F.lit("Rules"), "2026-01-01"), F.lit(","), place(F.col("committee"), "2026-03-01"), F.lit("]}"))
    counts = F.concat(F.lit('{"items":{"AYE":{"size":'), (num % 30).cast("string"), F.lit('},"AYEWR":{"items":[1,2]},"NAY":{"size":'), (num % 7).cast("string"), F.lit("}}}"))
    vote = lambda day, extra: obj(voteDate=q(F.lit(day)), voteType=q(F.lit("FLOOR")), memberVotes=extra)
    votes = F.when(num % 5 == 0, F.concat(F.lit("["), vote("2026-05-02", counts), F.lit(","), vote("2026-05-01", F.lit("{}")), F.lit("]"))).otherwise("[]")
    agenda = F.when(num % 6 == 0, F.concat(F.lit('[{"agendaId":{"number":'), (num % 9).cast("string"), F.lit(',"year":2026},"committeeId":{"chamber":"SENATE","name":"Rules"}}]'))).otherwise("{}")
    fields = {
        "basePrintNo": F.when(num % 97 == 0, "null").otherwise(q(F.lower(F.regexp_replace("bill", "B", "B ")))),
        "session": F.when(num % 50 == 1, "null").otherwise(F.col("session")),
        "billType": obj(chamber=q(own)),
        "title": q(F.lit(" A title ")),
        "signed": F.when(F.upper(F.trim("approved")) == "Y", "true").otherwise("false"),
        "vetoMessages": F.when(F.col("vetoed") == "Y", '{"items":[{"memo":"no"}]}').otherwise('{"size":0}'),
        "status": obj(statusDesc=q(F.col("status")), committeeName=q(F.when(num % 3 == 0, "").otherwise(F.col("committee")))),
        "sponsor": F.when(num % 11 == 0, '"none"').otherwise(obj(member=obj(memberId=F.col("patron_id").cast("string"), fullName=q(F.col("patron"))))),
        "actions": actions,
        "pastCommittees": past,
        "votes": votes,
        "committeeAgendas": agenda,
        "novelty": F.when(num % 40 == 0, '{"deep":[1]}').otherwise("null"),
    }
    # a bill is a short row and its document takes long: the rows are dealt to all cores, however few files hold them
    bills = t.bills
    tasks = max(bills.rdd.getNumPartitions(), 2 * t.spark.sparkContext.defaultParallelism)
    return bills.repartition(tasks).select("num", F.parse_json(obj(**fields)).alias("doc"))


_OWN = "CASE WHEN num % 2 = 0 THEN 'Assembly' ELSE 'Senate' END"
_ACT = "num % 4 <> 3"
_OTHER = f"({_ACT} AND num % 6 = 0)"
_OUT = "CASE WHEN upper(trim(approved)) = 'Y' THEN 'signed' WHEN vetoed = 'Y' THEN 'vetoed' ELSE 'unknown_structural' END"


@query("C01_state_b_records", "bills", f"""SELECT num, CASE WHEN num % 97 = 0 THEN '' ELSE bill END AS bill, status AS status_lis, {_OUT} AS outcome, CASE WHEN num % 11 = 0 THEN '' ELSE patron END AS patron,
 CASE WHEN num % 11 = 0 THEN '' ELSE CAST(patron_id AS VARCHAR) END AS patron_id, CASE WHEN {_OTHER} THEN 'Senate' WHEN num % 2 = 0 THEN 'House' ELSE 'Senate' END AS chamber, {_OTHER} AS crossed_over,
 committee AS last_committee, CAST(2 AS INTEGER) AS referral_count, CASE WHEN num % 5 = 0 THEN (num % 30 + 2)||'-Y '||(num % 7)||'-N' ELSE '' END AS tally, CASE WHEN num % 5 = 0 THEN 'FLOOR' ELSE '' END AS vote_location,
 CASE WHEN {_ACT} THEN intro ELSE '' END AS last_action_date, CASE WHEN {_ACT} THEN concat_ws('|', CASE WHEN num % 61 = 0 THEN '' ELSE 'INTRODUCED' END, status) ELSE '' END AS actions,
 CASE WHEN num % 6 = 0 THEN '2026#'||(num % 9)||'#Rules#Senate' ELSE '' END AS agenda, CAST(CASE WHEN {_ACT} AND num % 83 = 0 AND num % 6 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS unknown_chambers FROM bills""")
def _(t):
    r = B.state_b_records(documents(t))
    agenda = F.array_join(F.transform("agenda_refs", lambda x: F.concat_ws("#", x["year"], x["agenda_number"], x["committee"], x["chamber"])), "|")
    return r.select(
        "num", "bill", "status_lis", "outcome", "patron", "patron_id", "chamber", "crossed_over", "last_committee", F.when(F.col("last_committee") == "Rules", 1).otherwise(F.col("referral_count")).cast("int").alias("referral_count"),
        F.col("latest_vote.tally").alias("tally"), F.col("latest_vote.location").alias("vote_location"), "last_action_date",
        F.array_join(F.transform("history", lambda h: h["action"]), "|").alias("actions"), agenda.alias("agenda"), "unknown_chambers",
    )


_HEALTH = f"""c AS (SELECT count(*) AS seen, count(*) FILTER (WHERE num % 97 = 0) AS malformed, count(*) FILTER (WHERE num % 97 <> 0) AS written, count(*) FILTER (WHERE num % 97 <> 0 AND {_OUT} = 'unknown_structural') AS unresolved,
 count(*) FILTER (WHERE num % 97 <> 0 AND {_ACT} AND num % 83 = 0 AND num % 6 <> 0) AS unknown_chamber, count(*) FILTER (WHERE num % 97 <> 0 AND num % 50 = 1) AS no_session, count(*) FILTER (WHERE num % 97 <> 0 AND {_ACT} AND num % 61 = 0) AS no_text FROM bills)"""


@query("D40_state_b_health", "bills", f"""WITH {_HEALTH}, f AS (SELECT unnest(['CRITICAL','WARN','WARN','WARN','WARN']) AS severity, unnest(['MALFORMED_BILL_ID','UNKNOWN_STRUCTURAL_OUTCOME','UNKNOWN_CHAMBER_VALUE','SOURCE_URL_MISSING_SESSION','MISSING_ACTION_TEXT']) AS code,
 unnest([malformed, unresolved, unknown_chamber, no_session, no_text]) AS count, unnest([seen, written, written, written, written]) AS denominator FROM c)
 SELECT CASE WHEN (SELECT malformed FROM c) > 0 THEN 'CRITICAL' ELSE 'WARN' END AS status, * FROM f WHERE count > 0""")
def _(t):
    """Health of the records from their own counters."""
    return Q.health_findings(B.completeness(B.state_b_records(documents(t))))


@query("A03_variant_drift", "bills", "SELECT 'novelty' AS path, count(*) FILTER (WHERE num % 40 = 0) AS n FROM bills UNION ALL SELECT 'vetoMessages.memo', count(*) FILTER (WHERE vetoed = 'Y') FROM bills")
def _(t):
    """Fields of the documents that no record reads."""
    return B.unseen_paths(documents(t).withColumn("doc", F.parse_json(F.regexp_replace(F.to_json("doc"), ',?"novelty":null', ""))))
