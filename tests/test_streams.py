"""Streams with keyed state: the same rows in one batch and in five give the same events; state holds touched keys only."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from civicmill.streaming import jobs as J


def piece(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, schema, folder):
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(spark, rows, schema, job, tmp_path, many, prepare=lambda df: df):
    at, size = str(tmp_path / f"n{many}"), -(-len(rows) // many)
    for i in range(many):
        piece(spark, rows[i * size : (i + 1) * size], schema, f"{at}/in", f"{i:03d}")
    return sorted(tuple(r) for r in J.run_keyed(prepare(stream(spark, schema, f"{at}/in")), job, f"{at}/out").collect())


POLL = "date string, committee string, seen bigint, time string, sort_time string, status string, location string"


@pytest.mark.parametrize("many", [1, 5])
def test_change_feed_does_not_depend_on_batches(spark, tmp_path, many):
    rng = random.Random(1)
    rows = [("2026-01-01", rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.choice(["9:00", "10:00"]), "1", "ok", rng.choice(["", "Room 1"])) for i in range(300)]
    got = run(spark, rows, POLL, J.CHANGE_FEED, tmp_path, many)
    last, want = {}, []
    for date, committee, seen, *fields in rows:
        before = last.get(committee)
        if before is None:
            want.append((date, committee, seen, "ADDED", *fields))
        elif before != fields:
            kind = "BACKFILL" if before[:3] == fields[:3] and before[3] == "" else "CHANGED"
            want.append((date, committee, seen, kind, *fields))
        last[committee] = fields
    assert got == sorted(want)


@pytest.mark.parametrize("many", [1, 5])
def test_outages_do_not_depend_on_batches(spark, tmp_path, many):
    rng = random.Random(2)
    rows = [("c", rng.choice(["hot", "hot", "x"]), i, rng.random() < 0.3) for i in range(300)]
    got = run(spark, rows, "cls string, detector string, event_id bigint, ok boolean", J.OUTAGES, tmp_path, many, lambda df: df.withColumn("ts", F.timestamp_seconds("event_id")))
    want, open_at = [], {}
    for _, d, i, ok in rows:
        if not ok:
            start, n = open_at.get(d, (i, 0))
            open_at[d] = (start, n + 1)
        elif d in open_at:
            want.append((d, *open_at.pop(d), i))
    assert [(d, s.timestamp(), n, e.timestamp()) for _, d, s, e, n in got] == sorted(want)


def test_state_is_touched_by_key_and_idle_keys_go(spark, tmp_path, monkeypatch):
    """Each call drains one batch; figures come from the state operator's own progress."""
    figures = []

    class Listen(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            figures.extend((o.numRowsUpdated, o.numRowsTotal) for o in event.progress.stateOperators)

        def onQueryTerminated(self, event):
            pass

    listener = Listen()
    spark.streams.addListener(listener)
    poll = lambda c, i, t="9:00": ("2026-01-01", c, i, t, "1", "ok", "")
    at = str(tmp_path)
    try:
        piece(spark, [poll(f"m{i}", i) for i in range(40)], POLL, f"{at}/in", "0")
        assert J.run_keyed(stream(spark, POLL, f"{at}/in"), J.CHANGE_FEED, f"{at}/out", idle_ms=1000).count() == 40
        time.sleep(2)
        piece(spark, [poll("m1", 101, "10:00"), poll("m2", 102)], POLL, f"{at}/in", "1")
        out = J.run_keyed(stream(spark, POLL, f"{at}/in"), J.CHANGE_FEED, f"{at}/out", idle_ms=1000)
        changed = {(r["committee"], r["event_type"]) for r in out.filter("seen > 100").collect()}
        assert changed == {("m1", "CHANGED")}  # a key that comes back in time has kept its state
        time.sleep(2)
        piece(spark, [poll("m3", 201, "11:00")], POLL, f"{at}/in", "2")
        out = J.run_keyed(stream(spark, POLL, f"{at}/in"), J.CHANGE_FEED, f"{at}/out", idle_ms=1000)
        assert {(r["committee"], r["event_type"]) for r in out.filter("seen > 200").collect()} == {("m3", "ADDED")}  # its timer had removed it
        deadline = time.time() + 20
        while len(figures) < 3 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [updated for updated, _ in figures] == [40, 2, 1]  # the keys of each batch
    assert figures[0][1] > figures[-1][1]
