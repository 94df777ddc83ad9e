"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import ranked
from civicmill.session import cut_lineage

SOURCE_BUCKETS = 12  # bits of the shuffle key that cut a source into buckets
ORDER_BUCKETS = 16_384  # parts of the fractional rank


def interleaved_shards(docs: DataFrame, n_shards: int, stratum: str = "source", row_id: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """Every row's shard and slot, so that each shard has the mixture of ``stratum`` that the whole table has.

    Rows of a source are put in seeded random order; row i of n has the fractional rank (i + 1/2) / n. All rows are
    sorted by it and cut into ``n_shards`` runs whose lengths differ by one at most (law ``rows``), so a source with
    n rows has n / n_shards rows, give or take one or two, in every shard. Both rankings count rows per bucket and add the counts of earlier buckets: no
    task sees a whole source, nor the whole order.

    A null source is a source of its own. A null text has no bytes and the checksum of the empty string. Repeated
    rows and ids are rows of their own, as often as they occur; ties in the order are broken by every column used, so
    only rows alike in all of them could change places. An empty table gives an empty result. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(row_id).alias("row_id"),
        F.when(F.col(stratum).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(stratum).cast("string"))).alias("stratum"),
        (F.octet_length(body) + 16).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("shuffled", F.xxhash64(F.lit(seed), "row_id", "text_crc32"))
    rows = cut_lineage(rows)  # a few dozen bytes a row: texts take part in no shuffle
    order = ["shuffled", "row_id", "text_crc32", "size"]
    within = ranked(rows, ["stratum"], F.shiftright("shuffled", 64 - SOURCE_BUCKETS), order, "source_rank", "source_rows")
    within = cut_lineage(within.withColumn("fraction", (F.col("source_rank") + 0.5) / F.col("source_rows")))
    slots = ranked(within, [], F.floor(F.col("fraction") * ORDER_BUCKETS), ["fraction", "stratum", *order], "position", "all_rows")
    first = F.expr(f"(shard * all_rows + {n_shards - 1}) div {n_shards}")
    return (
        slots.withColumn("shard", F.expr(f"(position * {n_shards}) div all_rows"))
        .withColumn("slot", F.col("position") - first)
        .select("row_id", "stratum", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))
    )
