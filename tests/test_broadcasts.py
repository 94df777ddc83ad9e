"""Sides that are exploded, or hold texts beside a join, are not broadcast: all of a broadcast passes through the driver."""

import re
from itertools import takewhile

import pytest
from pyspark.sql import functions as F

from civicmill.operators import labels as L
from civicmill.operators import similarity as Sim
from tests.test_plans import formatted


def broadcast_of_exploded(df) -> list[str]:
    """Broadcasts of exploded rows that no aggregate has reduced, from the plan's tree with one indent a level."""
    lines = formatted(df).split("\n\n")[0].splitlines()
    depth = [re.search(r"[A-Z(*]", x).start() if re.search(r"[A-Z(*]", x) else 0 for x in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found += [line for x in takewhile(lambda x: "Aggregate" not in x, lines[i + 1 : below]) if "Generate" in x]
    return found


@pytest.fixture
def records(spark, tmp_path):
    """Heads of 40 words, as a file: what an estimate of sizes sees is its compressed length."""
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("word"), ((F.col("id") * 7 + i) % 50).cast("string")))
    rows = spark.range(200).select(F.col("id").alias("key"), F.array_join(words, " ").alias("h"), F.when(F.col("id") % 3 == 0, "good").otherwise("poor").alias("label"))
    rows.write.parquet(str(tmp_path / "records"))
    return spark.read.parquet(str(tmp_path / "records"))


def test_words_of_heads(records):
    out = L.naive_bayes(records.filter("key > 100").select("h"), records.filter("key < 100").select("h", "label"))
    assert broadcast_of_exploded(out) == []
    assert out.count() == records.filter("key > 100").select("h").distinct().count()


def test_word_runs_of_titles(records):
    taxonomy = records.select(F.substring_index("h", " ", 2).alias("name"), "label")
    out = L.lexical_match(records.filter("key > 100").select(F.col("h").alias("nt")), taxonomy, 3)
    assert broadcast_of_exploded(out) == []
    assert {r.conf for r in out.collect()} == {0.89}


def test_tokens_of_texts(records):
    out = Sim.rarest_tokens(records, "key", "h", 12)
    assert broadcast_of_exploded(out) == []


def test_prefixes_of_token_sets(records):
    tokens = records.select("key", F.explode(F.slice(F.split(F.translate("h", "0123456789", "abcdefghij"), " "), 1, 12)).alias("tok"))
    out = Sim.nearest(tokens.filter("key > 150"), tokens.withColumnRenamed("key", "item"))
    assert broadcast_of_exploded(out) == []


def test_label_with_most_routes(spark):
    votes = spark.createDataFrame([(1, "b", "head", 0.5), (1, "a", "near", 0.25), (1, "b", "lex", 1.0), (2, "b", "head", 0.5), (2, "a", "cmte", 0.5), (None, "a", "head", 1.0)], "key long, label string, route string, conf double")
    out = L.decide(votes)
    assert "Join" not in formatted(out)
    assert sorted(map(tuple, out.collect())) == [(1, "b", 3.75, 2, "head+lex+near"), (2, "a", 2.0, 1, "head+cmte")]
