"""Guarded, versioned and keyed writes.

A published table is a folder of complete versions; readers take the newest version whose write finished. A
failed or lost job leaves the last good version in place, and nothing is deleted to publish.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import ids as I
from civicmill.session import cut_lineage


class PublishRefused(RuntimeError):
    """A guard failed; the previous version stays current."""


def _finished(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def current_version(spark: SparkSession, path: str) -> DataFrame | None:
    versions = _finished(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/version={versions[-1]}") if versions else None


def publish(df: DataFrame, path: str, guards: Mapping[str, Column], partitions: Sequence[str] = ()) -> int:
    """Write a new version unless the table is empty or a guard (an aggregate condition that must hold) fails.

    All guards are one aggregation. The frame is read twice; callers with an expensive plan pass a checkpoint.
    """
    spark = df.sparkSession
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(c, F.lit(False)).alias(name) for name, c in guards.items()]).first()
    failed = (["empty"] if row["_n"] == 0 else []) + [name for name in guards if not row[name]]
    if failed:
        raise PublishRefused(f"refused to overwrite {path}: {', '.join(failed)} ({row['_n']} rows)")
    version = (_finished(spark, path) or [0])[-1] + 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{path.rstrip('/')}/version={version}")
    return version


def append_metrics(log_path: str, alerts: DataFrame, heartbeat: DataFrame) -> None:
    """Append this cycle's alerts and its heartbeat, partitioned by day. The heartbeat is written even with no alert."""
    rows = heartbeat.unionByName(alerts, allowMissingColumns=True).withColumn("day", F.to_date("ts"))
    rows.write.mode("append").partitionBy("day").parquet(log_path)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], clock: str) -> DataFrame:
    """Newest row per key; on equal clocks the update wins. An aggregation, so hot keys combine early."""
    both = target.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)), allowMissingColumns=True)
    return scale.latest(both, keys, [clock, "_u"]).drop("_u")


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds the names of the violated rules; '' means valid. A rule that yields null is violated."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("violations", F.array_join(broken, ","))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    return checked.filter("violations = ''").drop("violations"), checked.filter("violations <> ''")


def readable(stamp: str) -> Column:
    """The timestamp of a log's stamp, or null: full precision, or a bare date."""
    text = I.blank(stamp)
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def is_blank(stamp: str) -> Column:
    return (I.blank(stamp) == "") | I.is_null_word(stamp)


def prune_plan(log: DataFrame, order: str, stamp: str, now: str, days: int) -> DataFrame:
    """Where the expired prefix of the log ends. A blank cell or a live row stops it; an unreadable stamp inside it aborts.

    One aggregation: the prefix is everything before the first stopping row.
    """
    ts, empty = readable(stamp), is_blank(stamp)
    live = ts >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    stop = empty | F.coalesce(live, F.lit(False))
    unreadable = ~empty & ts.isNull()
    return log.agg(F.min(F.when(stop, F.col(order))).alias("keep_from"), F.min(F.when(unreadable, F.col(order))).alias("first_unreadable"), F.max(order).alias("last"), F.count(F.lit(1)).alias("rows"))


def prune(log: DataFrame, order: str, stamp: str, now: str, days: int) -> DataFrame:
    """Survivors of the retention prune. Raises on schema drift instead of deleting."""
    plan = prune_plan(log, order, stamp, now, days).first()
    if plan["first_unreadable"] is not None and (plan["keep_from"] is None or plan["first_unreadable"] < plan["keep_from"]):
        raise PublishRefused(f"unreadable timestamp in the expired prefix at {plan['first_unreadable']}; nothing pruned")
    if plan["keep_from"] is None:
        return log.limit(0)
    return log.filter(F.col(order) >= F.lit(plan["keep_from"]))


def archive_sessions(df: DataFrame, root: str, session: str) -> DataFrame:
    """Copy every session in one write, read it back, compare rows and content; only then is it fit for the registry.

    Returns session, location, rows and columns. One grouped digest on either side compares all sessions at once.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c != session]
    df.write.mode("overwrite").partitionBy(session).parquet(root)
    back = spark.read.schema(df.schema).parquet(root)
    digest = lambda x: x.groupBy(session).agg(*scale.multiset_digest(*sorted(columns)))
    ours, theirs = digest(df), digest(back).select(F.col(session).alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("rows", "digest_lo", "digest_hi")])
    same = F.lit(True)
    for c in ("rows", "digest_lo", "digest_hi"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    compared = cut_lineage(ours.join(theirs, F.col(session).eqNullSafe(F.col("_s")), "full").withColumn("same", same))
    wrong = [r[0] for r in compared.filter("not same").select(F.coalesce(session, "_s")).limit(5).collect()]
    if wrong:
        raise PublishRefused(f"archive does not match its source, first in sessions {wrong}")
    place = F.concat(F.lit(f"{root.rstrip('/')}/{session}="), F.col(session))
    return compared.select(F.col(session), place.alias("location"), "rows", F.lit(len(columns)).cast("bigint").alias("columns"))


def resolve_active(registry: DataFrame) -> DataFrame:
    """Newest archive per jurisdiction, by time then session code."""
    return registry.groupBy("jurisdiction").agg(F.max_by("location", F.struct("archived_at", "session")).alias("location"))


def new_versions(incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("session", "bill")) -> DataFrame:
    """Incoming texts whose digest the store does not hold yet for that key; copies inside the batch count once."""
    fresh = incoming.withColumn("digest", F.sha2("text", 256)).join(stored.select(*keys, "digest").distinct(), [*keys, "digest"], "left_anti")
    return scale.earliest(fresh, [*keys, "digest"], ["version"])
