"""Documents are costly to build: a survey of them that takes several passes builds each of them once."""

import json

from pyspark.sql import functions as F

from civicmill.operators import state_b as B


def test_survey_builds_each_document_once(spark):
    built = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        built.add(1)
        votes = [{"novel": 1}] if i % 2 else {"items": {"a": {"voteDate": "x"}}}  # disagreeing types take passes of their own
        return json.dumps({"printNo": "S1", "votes": votes, "sponsor": "none" if i % 3 else {"member": {"extra": i}}, "new": 1})

    out = B.unseen_paths(spark.range(12).select(F.parse_json(text("id")).alias("doc")))
    assert {tuple(r) for r in out.collect()} == {("new", 12), ("votes.novel", 6), ("sponsor.member.extra", 4)}
    assert built.value == 12
