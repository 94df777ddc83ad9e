"""Second state's records from documents of every shape."""

import json

import pytest
from pyspark.sql import functions as F

from civicmill.operators import state_b as B

FULL = {
    "basePrintNo": "s 1234", "session": 2025, "billType": {"chamber": "SENATE"}, "title": " Clean water ", "signed": False, "summary": "A program.",
    "status": {"statusType": "IN_COMM", "actionDate": "2025-06-01", "committeeName": ""},
    "sponsor": {"member": {"memberId": 42, "shortName": "SPONSOR"}},
    "actions": {"size": 3, "items": [
        {"date": "2025-01-10", "sequenceNo": 2, "chamber": "SENATE", "text": "REFERRED"},
        {"date": "2025-01-10", "sequenceNo": 1, "chamber": "SENATE", "text": "INTRODUCED"},
        {"date": "2025-06-01", "sequenceNo": "x", "chamber": "ASSEMBLY", "text": " "}]},
    "pastCommittees": {"items": {"2": {"chamber": "ASM", "name": "Water", "referenceDate": "2025-06-01"}, "1": {"chamber": "SENATE", "name": "Finance", "referenceDate": "2025-01-10"}}},
    "votes": [{"voteType": "COMMITTEE", "voteDate": "2025-05-01", "committee": {"chamber": "SENATE", "name": "Finance"},
               "memberVotes": {"items": {"AYE": {"items": [1, 2, 3], "size": 3}, "NAY": {"items": [4]}, "AYEWR": {"size": 2}, "EXC": {"size": 9}}}},
              {"voteType": "FLOOR", "voteDate": "2025-04-01", "memberVotes": {"items": {"AYE": {"size": 50}}}}],
    "committeeAgendas": {"items": [{"agendaId": {"number": 12, "year": 2025}, "committeeId": {"chamber": "WHAT", "name": "Finance"}}]},
}


@pytest.fixture(scope="module")
def records(spark):
    odd = [FULL, {}, {"printNo": "a1", "signed": True, "vetoMessages": {"size": 1}, "actions": None, "votes": "none", "status": "text"},
           {"basePrintNo": "A9", "vetoMessages": [{}], "actions": [1, "x", {"text": ""}], "billType": {"chamber": "Joint"}, "sponsor": []}]
    rows = [(i, json.dumps(o)) for i, o in enumerate(odd)] + [(9, None), (10, "[]"), (11, "7")]
    docs = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("doc"))
    return docs, {r["i"]: r for r in B.state_b_records(docs).collect()}


def test_full_record(records):
    r = records[1][0]
    assert (r["bill"], r["title"], r["status_lis"], r["patron"], r["patron_id"]) == ("S1234", "Clean water", "IN_COMM", "SPONSOR", "42")
    assert [(h["date"], h["action"]) for h in r["history"]] == [("2025-01-10", "INTRODUCED"), ("2025-01-10", "REFERRED"), ("2025-06-01", "")]
    assert (r["chamber"], r["crossed_over"], r["last_committee"], r["referral_count"]) == ("House", True, "Water", 2)
    assert r["latest_vote"]["tally"] == "5-Y 1-N" and r["latest_vote"]["location"] == "Senate Finance" and r["latest_vote"]["breakdown"]["EXC"] == 9
    assert r["agenda_refs"][0].asDict() == {"year": "2025", "agenda_number": "12", "committee": "Finance", "chamber": "", "chamber_raw": "WHAT"}
    assert (r["outcome"], r["missing_action_text"], r["unknown_chambers"], r["source_path"]) == ("unknown_structural", 1, 1, "bills/2025/S1234")


def test_odd_documents(records):
    rows = records[1]
    assert all(rows[i]["bill"] == "" and rows[i]["history"] == [] and rows[i]["outcome"] == "unknown_structural" for i in (1, 9, 10, 11))
    assert (rows[2]["bill"], rows[2]["outcome"], rows[2]["has_votes"], rows[2]["no_session"]) == ("A1", "signed", False, True)
    assert (rows[3]["outcome"], rows[3]["unknown_chambers"], len(rows[3]["history"]), rows[3]["patron"]) == ("vetoed", 1, 1, "")


def test_completeness_counts_and_refuses_nothing(records):
    docs, _ = records
    c = B.completeness(B.state_b_records(docs)).first()
    assert (c["seen"], c["malformed"], c["written"], c["has_actions"], c["has_votes_rate"], c["summary_present"]) == (7, 4, 3, 2, 0.3333, 1)
    with pytest.raises(Exception, match="refusing to overwrite"):
        B.completeness(B.state_b_records(docs.filter("i = 1"))).collect()


def test_unseen_paths_are_counted(spark):
    docs = [FULL, {**FULL, "novel": {"x": [1]}}, {"votes": {"items": [{"odd": 1}, {"odd": 2}]}}, {"actions": {"items": {"1": {"odd": 1}}}}, {"votes": [{"memberVotes": {"items": {"NEW": {"size": 1}}}}]}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(F.parse_json("j").alias("doc"))
    assert {(r["path"], r["n"]) for r in B.unseen_paths(df).collect()} == {("novel", 1), ("votes.odd", 1), ("actions.odd", 1)}
    assert B.unseen_paths(df.limit(1)).collect() == [] and B.unseen_paths(df.filter("false")).collect() == []
