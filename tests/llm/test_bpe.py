"""Segment-tree BPE against the tokenizers library, on texts of every kind."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civicmill.llm import bpe, queries
from tests.conftest import DATA

TEXTS = [
    "",
    " \t\n\x0b ",
    "a",
    "Don't I'LL we've 's'S it’s",
    "<|endoftext|>Hi <|startoftext|>x<|x|> <|END",
    "ΑΣ ΟΔΟΣ. Σ İstanbul ẞ ﬁ é é",
    "한국어 한 日本語 \U0001f600\U0001f44d\U0001f3fd ²½ \x00\x1c\x1f a​b",
    "a" * 3000,
    "ab" * 5000 + " " + "word " * 20_000,
    "don’t \xa0\x85 \xb5 \xaa",
]


def library(name):
    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(3)
    draw = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x11000)]))
    return TEXTS + ["".join(draw() for _ in range(rng.randrange(40))) for _ in range(500)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_texts_equal_the_library(spark, name):
    texts, path, known = odd_texts(), queries.tokenizer_path(name), library(name)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = bpe.encode_documents(df, path, with_text=True).withColumn("again", bpe.decoded(F.col("ids"), path)).collect()
    assert all(r["again"] == r["decoded"] for r in out)
    assert {r["row_id"]: r["ids"] for r in out} == {i: known.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["row_id"]: r["decoded"] for r in out} == {r["row_id"]: known.decode(r["ids"], skip_special_tokens=False) for r in out}


def test_the_root_is_the_leftmost_pair_of_the_lowest_rank():
    """Both forms of the tree against a plain search for the lowest rank, at lengths around every power of two."""
    known = bpe.Vocabulary(queries.tokenizer_path())
    rng = random.Random(5)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 200, 300]:
        piece = bytes(rng.choice(b"aaabnething") for _ in range(n))
        ids = [int(known.first[b]) for b in piece[:-1]] + [int(known.last[piece[-1]])]
        while True:
            ranks = [known.rank.get(a * known.size + b, 1 << 40) for a, b in zip(ids, ids[1:], strict=False)]
            if not ranks or min(ranks) == 1 << 40:
                break
            i = ranks.index(min(ranks))
            ids[i : i + 2] = [int(known.merged[ranks[i]])]
        width = max(1 << (n - 1).bit_length(), 1)
        want = b"".join(i.to_bytes(4, "little") for i in ids)
        assert bpe.merge_alone(known, piece) == want
        assert bpe.merge_side_by_side(known, [piece, piece[:1], piece], width)[::2] == [want, want]


def test_odd_rows_and_ids(spark):
    path = queries.tokenizer_path()
    rows = [(1, None, "x", 1.5), (1, "one two", "y", None), (None, "one two", None, None), (1, "one two", "y", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, row_id double")
    out = sorted((r["row_id"] or 0, r["ids"]) for r in bpe.encode_documents(df, path).collect())
    assert [i for i, _ in out] == [0, 1, 1, 1] and out[1][1] == [] and out[0][1] == out[2][1] == out[3][1] != []
    assert bpe.encode_documents(df.filter("false"), path).collect() == []
    lists = spark.createDataFrame([(1, [320, -1, None, 10**9]), (2, []), (3, None)], "i int, ids array<int>")
    got = {r["i"]: r["t"] for r in lists.select("i", bpe.decoded(F.col("ids"), path).alias("t")).collect()}
    assert got == {1: library("word_bpe_49k.json").decode([320], skip_special_tokens=False), 2: "", 3: None}


def test_query_equals_the_library_on_the_given_documents(spark):
    known = library("word_bpe_49k.json")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in queries.table(spark, DATA, "documents").select("doc_id", "text").collect():
        ids = known.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), sha(" ".join(map(str, ids))), sha(known.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_bpe(spark, DATA).collect()}
    assert got == want
