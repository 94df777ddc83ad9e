"""The stateful operators run as streams over the same files."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill.plans.registry import query
from civicmill.plans.standins import SPARK, VIEWS
from civicmill.session import scratch_path
from civicmill.streaming import jobs as J


def N():
    return F.count(F.lit(1)).alias("n")


def stream(t, view):
    """A stand-in table as a stream, its timestamps with a zone."""
    source, columns = VIEWS[view](SPARK)
    raw = J.file_stream(t.spark, t.sf_dir, source)
    return raw.selectExpr(*[f"{e} AS {n}" for n, e in columns]).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(t, df, label):
    """Few state partitions: the given tables are small. A cluster run keeps its own setting."""
    return J.run(df, scratch_path(t.spark, label), scratch_path(t.spark, f"{label}-progress"))


def keyed(t, df, job, label):
    return J.run_keyed(df, job, scratch_path(t.spark, label))


@query("J01_stream_change_feed", "calendar", """WITH p AS (SELECT date, committee, event_id AS seen, time, sort_time, status, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Room '||user_id END AS location FROM calendar), l AS (SELECT *, lag(seen) OVER w AS pe, lag(time) OVER w AS pt, lag(sort_time) OVER w AS ps, lag(status) OVER w AS pst, lag(location) OVER w AS pl FROM p WINDOW w AS (PARTITION BY date, committee ORDER BY seen))
 SELECT * FROM (SELECT date, committee, seen, CASE WHEN pe IS NULL THEN 'ADDED' WHEN time=pt AND sort_time=ps AND status=pst AND location<>pl AND pl='' THEN 'BACKFILL' WHEN time<>pt OR sort_time<>ps OR status<>pst OR location<>pl THEN 'CHANGED' END AS event_type, time, sort_time, status, location FROM l) WHERE event_type IS NOT NULL""")
def _(t):
    polls = stream(t, "calendar").select("date", "committee", F.col("event_id").alias("seen"), "time", "sort_time", "status", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("Room "), F.col("user_id").cast("string"))).alias("location"))
    return keyed(t, polls, J.CHANGE_FEED, "feed")


@query("J02_stream_outages", "runlog", """WITH s AS (SELECT user_id, ts, event_id, kind<>'error' AS ok FROM runlog WHERE kind IN ('error','view')), p AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s), g AS (SELECT user_id, k, count(*) FILTER (WHERE NOT ok) AS f, min(ts) FILTER (WHERE NOT ok) AS st, min(ts) FILTER (WHERE ok) AS ps FROM p GROUP BY 1,2)
 SELECT 'd'||a.user_id AS detector, strftime(a.st,'%Y-%m-%d %H:%M:%S') AS start, strftime(b.ps,'%Y-%m-%d %H:%M:%S') AS finish, a.f AS failures FROM g a JOIN g b ON a.user_id=b.user_id AND b.k=a.k+1 WHERE a.f>0""")
def _(t):
    s = stream(t, "runlog").filter("kind IN ('error', 'view')")
    signals = s.select(F.lit("accuracy").alias("cls"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("detector"), "ts", "event_id", (F.col("kind") != "error").alias("ok"))
    stamp = lambda c, out: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(out)
    return keyed(t, signals, J.OUTAGES, "outages").select("detector", stamp("start", "start"), stamp("end", "finish"), "failures")


@query("J03_stream_alert_dedupe", "runlog", "SELECT concat_ws('::', origin, user_id) AS dedup_key, count(*) AS n FROM (SELECT DISTINCT origin, user_id FROM runlog WHERE kind='error') GROUP BY 1")
def _(t):
    """One batch holds all files, so the watermark has not moved yet and each key is announced once."""
    alerts = stream(t, "runlog").filter("kind = 'error'").select("ts", F.concat_ws("::", "origin", F.col("user_id").cast("string")).alias("dedup_key"), "outcome")
    return drained(t, J.dedupe_alerts(alerts, ["dedup_key"]), "alerts").groupBy("dedup_key").agg(N())


_ISL = "SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 150 MINUTE THEN 0 ELSE 1 END AS nw FROM calendar)"


@query("J04_stream_windows", "calendar", f"SELECT user_id, strftime(min(ts) - INTERVAL 30 MINUTE,'%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 120 MINUTE,'%Y-%m-%d %H:%M:%S') AS finish, count(*) AS meetings FROM ({_ISL}) GROUP BY user_id, i HAVING max(ts) + INTERVAL 150 MINUTE <= (SELECT max(ts) FROM calendar) - INTERVAL 1 DAY")
def _(t):
    """Windows the watermark has not passed stay open and are emitted by a later run."""
    w = drained(t, J.activity_windows(stream(t, "calendar").select("user_id", "ts"), "user_id"), "windows")
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("finish"), "meetings")


@query("J05_stream_hours", "runlog", "SELECT strftime(date_trunc('hour', ts),'%Y-%m-%d %H:%M:%S') AS hour, kind, count(*) AS n FROM runlog WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM runlog) - INTERVAL 2 HOUR GROUP BY 1,2")
def _(t):
    h = drained(t, J.hourly_counts(stream(t, "runlog").select("ts", "kind"), "kind"), "hours")
    return h.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "kind", "n")
