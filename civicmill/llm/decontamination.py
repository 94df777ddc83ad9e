"""Benchmark decontamination by MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import checked_broadcast
from civicmill.session import cut_lineage

WORDS = r"[^\p{L}\p{N}]+"  # between words; words are lower-cased


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: w != "")


def shingles_of(words: str, width: Column | int) -> Column:
    """All runs of ``width`` words, joined by spaces; none if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    many = F.size(words) - width + 1
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.array_join(F.slice(F.col(words), i, width), " "))).otherwise(F.array().cast("array<string>"))


def sketch_size(n: Column, containment: float) -> Column:
    """Shingles to keep so that a document with the wanted share of all ``n`` must have one of those kept."""
    return n - F.ceil(n * F.lit(containment) - 1e-9) + 1


def contained_items(docs: DataFrame, items: DataFrame, containment: float = 0.8, width: int = 5, text: str = "text", row_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Pairs (text_hash, item_id, n_shingles, n_found, containment) of a document's text and an item found in it.

    The MinHash sketch of an item is its shingles with the smallest hashes. Items are partitioned by size: the sketch
    length follows from the item's own number of shingles, n - ceil(containment * n) + 1, so that any document with
    the wanted containment holds at least one sketched shingle, however long it is; whole-document sketches would lose
    a short item in a long text. Documents meet the sketches by hash; only candidate pairs are then verified, by
    counting the item's distinct shingles that the whole text holds. So the result is exact.

    An item of fewer than ``width`` words is one shingle, its whole word sequence. Items without words contain
    nothing to find. Items with the same set of shingles are one class and appear under the smallest id; use
    ``item_classes`` for membership. Null texts have no words. Equal texts share one text_hash (MD5 of the text), and
    the pairs are distinct, so repeated rows and copies cost one count each. Other columns are ignored.
    """
    classes, table = item_shingles(items, width, item_text, item_id)
    sketch = table.withColumn("_keep", sketch_size(F.col("n"), containment)).filter("place <= _keep").select("hash", "set_hash")
    n_sketch = sketch.count()
    widths = sorted(r[0] for r in table.select("width").distinct().collect())  # at most ``width`` values
    texts = docs.select(text).withColumn("words", words_of(F.col(text)))
    found = texts.select(F.md5(F.col(text)).alias("text_hash"), F.explode(_hashes("words", widths)).alias("hash"))
    candidates = found.join(checked_broadcast(sketch, n_sketch), "hash").select("text_hash", "set_hash").distinct()
    candidates = cut_lineage(candidates)
    # only texts with a candidate are read as shingles again, and only shingles of a candidate item go on
    n_texts = candidates.select("text_hash").distinct().count()
    wanted = checked_broadcast(candidates.select("text_hash").distinct(), n_texts)
    again = docs.select(text).withColumn("text_hash", F.md5(F.col(text))).join(wanted, "text_hash", "left_semi")
    again = again.withColumn("words", words_of(F.col(text))).select("text_hash", F.explode(_strings("words", widths)).alias("shingle"))
    n_table = table.count()
    hits = again.join(checked_broadcast(table.select("shingle", "set_hash", "item", "n"), n_table), "shingle").distinct()
    counted = hits.groupBy("text_hash", "set_hash", "item", "n").agg(F.count(F.lit(1)).alias("n_found"))
    verified = counted.filter(F.col("n_found") >= F.ceil(F.col("n") * F.lit(containment) - 1e-9))
    verified = verified.join(candidates, ["text_hash", "set_hash"], "left_semi")
    return verified.select("text_hash", F.col("item").alias("item_id"), F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))


def item_shingles(items: DataFrame, width: int = 5, text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(classes: item_id, item), (table: set_hash, item, n, width, shingle, hash, place): classes of equal shingle sets."""
    worded = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).filter("size(words) > 0")
    worded = worded.withColumn("width", F.least(F.size("words"), F.lit(width)))
    sets = worded.withColumn("set", F.array_sort(F.array_distinct(shingles_of("words", F.col("width"))))).withColumn("set_hash", F.md5(F.array_join("set", "\n")))
    sets = cut_lineage(sets.select("item_id", "width", "set", "set_hash"))
    named = sets.groupBy("set_hash").agg(F.min("item_id").alias("item"))
    classes = sets.select("item_id", "set_hash").join(named, "set_hash").select("item_id", "item")
    one = sets.join(named, "set_hash").filter(F.col("item_id").eqNullSafe(F.col("item"))).dropDuplicates(["set_hash"])
    # an item is a short text: its own shingles are ordered inside its row
    ordered = F.array_sort(F.transform("set", lambda s: F.struct(F.xxhash64(s).alias("hash"), s.alias("shingle"))))
    table = one.select("set_hash", "item", "width", F.size("set").alias("n"), F.posexplode(ordered).alias("place", "s"))
    return classes, cut_lineage(table.select("set_hash", "item", "n", "width", "s.shingle", "s.hash", (F.col("place") + 1).alias("place")))


def _strings(words: str, widths: list[int]) -> Column:
    if not widths:
        return F.array().cast("array<string>")
    return F.concat(*[shingles_of(words, w) for w in widths])


def _hashes(words: str, widths: list[int]) -> Column:
    return F.transform(_strings(words, widths), lambda s: F.xxhash64(s))


def contaminated_documents(docs: DataFrame, items: DataFrame, containment: float = 0.8, width: int = 5, text: str = "text", row_id: str = "doc_id", **names: str) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each row and each class of items found in its text.

    The ids of rows with equal texts meet their text's pairs by hash. See ``contained_items`` for the cases.
    """
    pairs = cut_lineage(contained_items(docs, items, containment, width, text, row_id, **names))
    rows = docs.select(F.col(row_id).alias("doc_id"), F.md5(F.col(text)).alias("text_hash"))
    return rows.join(pairs, "text_hash").select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def without_contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, width: int = 5, text: str = "text", row_id: str = "doc_id", **names: str) -> DataFrame:
    """``docs`` without the rows whose text contains an item. Rows with a null text stay."""
    found = cut_lineage(contained_items(docs, items, containment, width, text, row_id, **names).select("text_hash").distinct())
    bad = checked_broadcast(found, found.count())
    return docs.join(bad, F.md5(docs[text]) == bad["text_hash"], "left_anti")


def shingles_needed(n: int, containment: float = 0.8) -> int:
    return math.ceil(n * containment - 1e-9)
