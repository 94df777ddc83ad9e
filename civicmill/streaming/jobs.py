"""Structured Streaming forms. Sources are files or any stream with the same columns; sinks are parquet folders.

All queries run with ``availableNow`` so that a scheduled run and a long-lived one share the code. Progress and
state live in the checkpoint folder, so a lost executor or driver resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from civicmill import scale
from civicmill.operators.diffs import WITNESS_FIELDS
from civicmill.session import cut_lineage

# Keyed state lies on executors' disks, its changes in the checkpoint folder. Timers of processing time would ask for
# batches without data for ever, so a drain would not end: they are looked at when the next data come.
KEEPING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A parquet table of ``folder`` as a stream."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into ``out`` and return it."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


# --- operators with keyed state ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Keyed:
    """An operator on ordered rows of a key, in two halves.

    ``reduce`` works on a micro-batch as on any table: events inside the batch, and one summary row a key of what the
    key's state must learn. ``Processor`` meets the summaries one key at a time and holds the state. So a hot key's rows
    are split like any others, and the state sees one row a key and batch.
    """

    keys: tuple[str, ...]
    summary: str
    events: str
    reduce: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    processor: type[StatefulProcessor]


def run_keyed(stream: DataFrame, job: Keyed, at: str, idle_ms: int | None = None) -> DataFrame:
    """Drain a stream through a keyed operator under the folder ``at``; returns all events found so far.

    First every micro-batch is reduced; what it gives are tables of the batch's number, which a batch that runs again
    after a failure replaces. Then the summaries, in order of their batches, go through the state, which Spark keeps in
    its state store: a batch reads and writes the keys it touches and no others. With ``idle_ms`` a key that no batch
    has touched for so long is removed by a timer.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        events, summaries = job.reduce(cut_lineage(batch))
        events.select(*_names(job.events)).write.mode("overwrite").parquet(f"{at}/inside/batch={number}")
        summaries.select(*_names(job.summary)).write.mode("overwrite").parquet(f"{at}/summaries/batch={number}")

    first = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{at}/reducing").trigger(availableNow=True)
    first.start().awaitTermination()
    inside = spark.read.schema(job.events).parquet(f"{at}/inside/batch=*")
    summaries = spark.readStream.schema(f"{job.summary}, batch int").parquet(f"{at}/summaries")
    # Spark's Python side turns keys and events into rows by keyword, where a column may not be called "cls"
    aside = {k: f"key_{k}" for k in job.keys}
    output = StructType([StructField(aside.get(f.name, f.name), f.dataType) for f in StructType.fromDDL(job.events)])
    grouped = summaries.withColumnsRenamed(aside).groupBy(*aside.values())
    crossing = grouped.transformWithState(job.processor(job, idle_ms), output, "Append", "ProcessingTime")
    before = {name: spark.conf.get(name) for name in KEEPING}
    for name, value in KEEPING.items():  # read when the query starts
        spark.conf.set(name, value)
    try:
        q = crossing.writeStream.format("parquet").option("path", f"{at}/crossing").option("checkpointLocation", f"{at}/keeping").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    q.awaitTermination()
    found = spark.read.schema(output).parquet(f"{at}/crossing")
    return inside.unionByName(found.withColumnsRenamed({v: k for k, v in aside.items()}))


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


class KeyedProcessor(StatefulProcessor):
    """Summaries of a key, in order of their batches, against its state."""

    state: str

    def __init__(self, job: Keyed, idle_ms: int | None):
        self.keys, self.idle_ms = [f"key_{k}" for k in job.keys], idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get() if self.held.exists() else None
        before = held
        for row in sorted(rows, key=lambda r: r["batch"]):
            found, held = self.step(dict(zip(self.keys, key, strict=True)), row, held)
            yield from (Row(**e) for e in found)
        if held is not None:
            self.held.update(held)
        elif before is not None:
            self.held.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass

    def step(self, key: dict, row: Row, held: tuple | None) -> tuple[list[dict], tuple | None]:
        raise NotImplementedError


# a meeting's polls
_FIELDS = ("time", "sort_time", "status", "location")  # the fields of a change, the location last
assert _FIELDS == tuple(WITNESS_FIELDS)
_typed = lambda prefix: ", ".join(f"{prefix}{f} string" for f in _FIELDS)


def reduce_polls(polls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes between polls of one batch, and each meeting's first and last poll."""
    keys, fields = ["date", "committee"], list(_FIELDS)
    rows = polls.select(*keys, "seen", *fields)
    steps = scale.running(rows, keys, ["seen", *fields], lags={"_p": F.struct(*fields)})
    differs = [~F.col(f).eqNullSafe(F.col(f"_p.{f}")) for f in fields]
    others, moved = reduce(lambda a, b: a | b, differs[:-1]), differs[-1]
    backfill = ~others & moved & (F.coalesce("_p.location", F.lit("")) == "") & (F.coalesce("location", F.lit("")) != "")
    kind = F.when(F.col("_p").isNull(), None).when(backfill, "BACKFILL").when(others | moved, "CHANGED")
    events = steps.withColumn("event_type", kind).filter("event_type IS NOT NULL")
    row, order = F.struct("seen", *fields), F.struct("seen", *fields)
    ends = rows.groupBy(*keys).agg(F.min_by(row, order).alias("a"), F.max_by(row, order).alias("z"))
    flat = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("a", "first"), ("z", "last")) for c in ("seen", *fields)]
    return events, ends.select(*keys, *flat)


class PollState(KeyedProcessor):
    state = f"seen bigint, {_typed('')}"

    def step(self, key, row, held):
        new = [row[f"first_{f}"] for f in _FIELDS]
        kind = "ADDED"
        if held is not None:
            old = list(held[1:])
            kind = None if old == new else "CHANGED"
            if old[:-1] == new[:-1] and not old[-1] and new[-1]:
                kind = "BACKFILL"
        found = [{**key, "seen": row["first_seen"], "event_type": kind, **dict(zip(_FIELDS, new, strict=True))}] if kind else []
        last = (row["last_seen"], *(row[f"last_{f}"] for f in _FIELDS))
        return found, last if held is None or last[0] >= held[0] else tuple(held)


#: ADDED / CHANGED / BACKFILL of each poll (date, committee, seen, time, sort_time, status, location) against the one
#: before it of the same meeting. A location that was merely empty before is a backfill. Polls of a batch are taken in
#: order of ``seen``; the first of them is compared with the newest poll of earlier batches, which stays the state.
CHANGE_FEED = Keyed(
    ("date", "committee"),
    f"date string, committee string, first_seen bigint, {_typed('first_')}, last_seen bigint, {_typed('last_')}",
    f"date string, committee string, seen bigint, event_type string, {_typed('')}",
    reduce_polls,
    PollState,
)


# a detector's signals
def reduce_signals(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outages opened and closed inside one batch; and a detector's failures before its first pass, that pass, and those after its last."""
    keys = ["cls", "detector"]
    rows = signals.select(*keys, "ts", "event_id", "ok")
    counted = scale.running(rows, keys, ["ts", "event_id"], sums={"passes": F.when(F.col("ok"), 1).otherwise(0).cast("bigint")})
    failed = F.when(~F.col("ok"), F.struct("ts", "event_id"))
    groups = cut_lineage(counted.groupBy(*keys, "passes").agg(F.min(failed)["ts"].alias("start"), F.count(failed).alias("failures"), F.min(F.when(F.col("ok"), F.col("ts"))).alias("pass_ts")))
    ends = groups.groupBy(*keys).agg(
        F.max("passes").alias("_last"),
        F.min(F.when(F.col("passes") == 0, F.col("start"))).alias("head_start"),
        F.sum(F.when(F.col("passes") == 0, F.col("failures")).otherwise(0)).alias("head_failures"),
        F.min(F.when(F.col("passes") == 1, F.col("pass_ts"))).alias("pass_ts"),
        F.max_by("start", "passes").alias("tail_start"),
        F.max_by("failures", "passes").alias("tail_failures"),
    )
    tail = F.col("_last") > 0
    summaries = ends.select(*keys, "head_start", "head_failures", "pass_ts", F.when(tail, F.col("tail_start")).alias("tail_start"), F.when(tail, F.col("tail_failures")).otherwise(0).alias("tail_failures"))
    closing = groups.select(*keys, (F.col("passes") - 1).alias("passes"), F.col("pass_ts").alias("end")).filter("end IS NOT NULL")
    closed = groups.filter("passes > 0 AND start IS NOT NULL").join(closing, [*keys, "passes"])
    return closed.select(*keys, "start", "end", "failures"), summaries


class OutageState(KeyedProcessor):
    state = "start timestamp, failures bigint"

    def step(self, key, row, held):
        if row["head_failures"]:
            start, failures = held if held is not None else (row["head_start"], 0)
            held = (start, failures + row["head_failures"])
        found = []
        if row["pass_ts"] is not None:
            if held is not None:
                found = [{**key, "start": held[0], "end": row["pass_ts"], "failures": held[1]}]
            held = (row["tail_start"], row["tail_failures"]) if row["tail_failures"] else None
        return found, held


#: Closed outages of each (cls, detector) with their failures, from signals (cls, detector, ts, event_id, ok). The state
#: holds open outages only: a detector that works has none.
OUTAGES = Keyed(
    ("cls", "detector"),
    "cls string, detector string, head_start timestamp, head_failures bigint, pass_ts timestamp, tail_start timestamp, tail_failures bigint",
    "cls string, detector string, start timestamp, end timestamp, failures bigint",
    reduce_signals,
    OutageState,
)


# --- windows -------------------------------------------------------------------------------------------------------
def dedupe_alerts(alerts: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First alert per key inside the watermark; later ones are the same alert."""
    return alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def activity_windows(meetings: DataFrame, key: str, *, lead: int = 30, tail: int = 120, delay: str = "1 day") -> DataFrame:
    """Merged [meeting - lead, meeting + tail] spans per key. Spans touch exactly when meetings are at most lead + tail
    apart, so a session window with that gap is the merge."""
    w = meetings.withWatermark("ts", delay).groupBy(key, F.session_window("ts", f"{lead + tail} minutes").alias("w")).agg(F.count(F.lit(1)).alias("meetings"))
    shift = F.make_dt_interval(mins=F.lit(lead))
    return w.select(key, (F.col("w.start") - shift).alias("start"), (F.col("w.end") - shift).alias("end"), "meetings")


def hourly_counts(events: DataFrame, kind: str, delay: str = "2 hours") -> DataFrame:
    """Events per hour and kind; an hour is emitted once the watermark has passed it."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("hour"), kind, "n")


def late_share(events: DataFrame, arrival: str, delay_minutes: int) -> DataFrame:
    """Rows that arrive later than the watermark allows, as a batch metric."""
    late = F.col(arrival) > F.col("ts") + F.make_dt_interval(mins=F.lit(delay_minutes))
    return events.agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"))
