"""Sources and sinks exercised on projections of the given tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from civicmill.functions import ids as I
from civicmill.plans.registry import query
from civicmill.session import cut_lineage, scratch_path
from civicmill.sources import readers as Rd
from civicmill.sources import store as St
from civicmill.sources import writers as Wr


def N():
    return F.count(F.lit(1)).alias("n")


def bulk_file(t):
    """A Latin-1 file with odd headers, quoted commas and some over-long lines."""
    path = scratch_path(t.spark, "bulk")
    good = t.bills.filter("num % 50 <> 0").select(F.col("bill").alias("Bill Number"), F.concat(F.lit("Régime, "), "title").alias("Description"), F.concat(F.lit("00"), F.col("patron_id").cast("string")).alias("PATRON ID"), F.col("session").alias("Session"))
    good.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    bad = t.bills.filter("num % 50 = 0").select(F.concat_ws(",", "bill", F.lit("x"), F.lit("y"), F.lit("z"), F.lit("surplus")).alias("value"))
    bad.mapInPandas(_headed, "value string").write.mode("append").text(path)
    return path


def _headed(batches):
    """A file's first line is its header, so every part carries one."""
    yield pd.DataFrame({"value": ["Bill Number,Description,PATRON ID,Session"]})
    yield from batches


@query("A01_bulk_csv", "bills", "SELECT bill, 'Régime, '||title AS title, '00'||patron_id AS patron_id, CAST(NULL AS VARCHAR) AS chapter FROM bills WHERE num % 50 <> 0")
def _(t):
    aliases = {"bill": ("bill_id", "bill_number", "bill_no"), "title": ("title", "description"), "patron_id": ("patron_id",), "chapter": ("chapter_id",)}
    rows = Rd.read_bulk_csv(t.spark, bulk_file(t), aliases, required=("bill",))
    return rows


@query("A03_json_items", "legevents", """SELECT event_id, CAST(CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END AS BIGINT) AS items, CASE WHEN event_id % 4 = 3 THEN '' ELSE event_code||'|'||kind END AS texts, CAST(CASE event_id % 4 WHEN 1 THEN 7 WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS size FROM legevents""")
def _(t):
    two = F.concat(F.lit('{"text":"'), "event_code", F.lit('"}'))
    kind = F.concat(F.lit('{"text":"'), "kind", F.lit('"}'))
    k = F.col("event_id") % 4
    cell = (F.when(k == 0, F.concat(F.lit("["), two, F.lit(","), kind, F.lit("]"))).when(k == 1, F.concat(F.lit('{"size":7,"items":['), two, F.lit(","), kind, F.lit("]}")))
            .when(k == 2, F.concat(F.lit('{"items":{"1":'), two, F.lit(',"2":'), kind, F.lit("}}"))).otherwise(F.lit(None).cast("string")))
    d = t.legevents.select("event_id", cell.alias("cell")).withColumn("i", Rd.json_items("cell", "struct<text:string>"))
    return d.select("event_id", F.size("i").cast("bigint").alias("items"), F.array_join(F.transform("i", lambda x: x["text"]), "|").alias("texts"), Rd.json_size("cell", "struct<text:string>").cast("bigint").alias("size"))


@query("A04_session_archives", "bills", "SELECT session, count(*) AS n, count(CASE WHEN year >= 1998 THEN status END) AS with_status FROM bills WHERE session <> '1996' GROUP BY 1")
def _(t):
    root = scratch_path(t.spark, "sessions")
    old, new = t.bills.filter("year < 1998"), t.bills.filter("year >= 1998")
    old.select("session", "bill", "title").write.mode("overwrite").option("header", True).partitionBy("session").csv(root)
    new.select("session", "bill", "title", "status").write.mode("append").option("header", True).partitionBy("session").csv(root)
    return Rd.read_sessions(t.spark, root, skip=("1996",)).groupBy("session").agg(N(), F.count("status").alias("with_status"))


_HREF = r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>'


_AGENDA = f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html,'{_HREF}',1)) AS href FROM pages), k AS (SELECT page_id, CASE WHEN regexp_extract(href,'[?&]page=([^&#]*)',1)<>'' THEN regexp_extract(href,'[?&]page=([^&#]*)',1) ELSE lower(href) END AS item, href FROM a)
 SELECT page_id, item, min(href) AS href, count(*) AS copies, CASE WHEN contains(min(href),'?') THEN 'relative_time' ELSE 'no_clock_source' END AS time_bucket FROM k GROUP BY 1,2"""


@query("A05_page_links", "", _AGENDA)
def _(t):
    links = t.pages.select("page_id", F.explode(Rd.anchors("html")).alias("a")).select("page_id", "a.href", "a.label")
    return Rd.agenda_rows(links, "page")


@query("A05_parsed_links", "", _AGENDA)
def _(t):
    """The same rows through a real HTML parser, which also sees anchors with markup inside; the given pages have none."""
    return Rd.agenda_rows(Rd.page_links(t.pages), "page")


def _link_rows(t):
    k = F.col("event_id") % 7
    label = (F.when(k == 0, "(Agenda)").when(k == 1, "(View Meeting)").when(k == 2, "(Agenda and View Meeting)").when(k == 3, "Subommittee Info").when(k == 4, "(Registration)").when(k == 5, "(Hologram Briefing)").otherwise("Meeting Materials"))
    html = F.concat("committee", F.lit(' <a href="https://a/'), F.col("event_id").cast("string"), F.lit('">'), label, F.lit('</a> <a href="https://v/1">'), F.when(F.col("event_id") % 2 == 0, "(View Meeting)").otherwise("Committee Info"), F.lit("</a>"))
    return t.calendar.select("event_id", html.alias("html"))


@query("A06_labelled_links", "calendar", "SELECT event_id, CASE WHEN event_id % 7 IN (0,2) THEN 'https://a/'||event_id ELSE '' END AS agenda, CASE WHEN event_id % 7 IN (1,2) THEN 'https://a/'||event_id WHEN event_id % 2 = 0 THEN 'https://v/1' ELSE '' END AS meeting FROM calendar")
def _(t):
    return Rd.labelled_links(_link_rows(t), "html", "event_id")[0]


@query("A06_label_drift", "calendar", "SELECT 'hologram briefing' AS label, count(*) AS n FROM calendar WHERE event_id % 7 = 5")
def _(t):
    return Rd.labelled_links(_link_rows(t), "html", "event_id")[1]


@query("A07_file_manifest", "texts", """SELECT u.scenario, u.state, (SELECT count(*) FROM texts) AS lines FROM (VALUES ('same','ok'), ('tampered','changed'), ('new','unlisted'), ('lost','missing')) u(scenario, state)""")
def _(t):
    """The files against their own manifest, a tampered one, an empty one, and with all files gone: states found in each."""
    path = scratch_path(t.spark, "files")
    t.texts.select(F.regexp_replace("text", r"[\r\n]", " ").alias("value")).write.mode("overwrite").text(path)
    files = cut_lineage(Rd.file_manifest(t.spark, path))
    lines = t.spark.read.text(path).agg(N()).scalar()
    tampered = files.withColumn("sha256", F.sha2("sha256", 256))
    cases = (("same", files, files), ("tampered", files, tampered), ("new", files, files.limit(0)), ("lost", files.limit(0), files))
    states = [Rd.verify_manifest(current, manifest).select(F.lit(name).alias("scenario"), "state").distinct() for name, current, manifest in cases]
    return reduce(lambda x, y: x.unionByName(y), states).withColumn("lines", lines)


@query("A08_guarded_publish", "bills", "SELECT status, count(*) AS n FROM bills GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "published")
    guards = {"ids": F.count_if(I.blank("bill") == "") == 0, "status": F.count_if(F.col("status").isNull()) == 0}
    Wr.publish(t.bills.select("bill", "status"), path, guards)
    try:
        Wr.publish(t.bills.select("bill", F.lit(None).cast("string").alias("status")), path, guards)
    except Wr.PublishRefused:
        pass
    return Wr.current_version(t.spark, path).groupBy("status").agg(N())


@query("A10_append_log", "runlog", "SELECT date AS day, count(*) + 1 AS n, count(*) AS alerts FROM runlog WHERE kind='error' GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "metrics")
    alerts = t.runlog.filter("kind = 'error'").select("ts", F.lit("alert").alias("origin"), "outcome")
    beats = t.runlog.filter("kind = 'error'").groupBy("date").agg(F.min("ts").alias("ts"), N()).select("ts", F.lit("heartbeat").alias("origin"), F.format_string('{"n":%d}', "n").alias("outcome"))
    Wr.append_metrics(path, alerts, beats)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(N(), F.count_if(F.col("origin") == "alert").alias("alerts"))


@query("A11_upsert", "runlog", "SELECT user_id, value, kind FROM (SELECT user_id, kind, CASE WHEN kind='click' THEN value+1 ELSE value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM runlog WHERE kind IN ('view','click')) WHERE rn=1")
def _(t):
    """Two upserts into one store: the second rewrites the buckets that its keys fall into."""
    store = St.Store(t.spark, scratch_path(t.spark, "profiles"))
    log = t.runlog.select("user_id", (F.col("value") + (F.col("kind") == "click").cast("int")).alias("value"), "kind", "ts")
    for kind in ("view", "click"):
        St.upsert(store, "profiles", log.filter(F.col("kind") == kind), ["user_id"], "ts", buckets=16)
    return store.read("profiles").select("user_id", "value", "kind")


@query("A12_constraints", "bills", "SELECT num, concat_ws(',', CASE WHEN status NOT IN ('Introduced','In Committee','Enrolled') THEN 'status' END, CASE WHEN NOT regexp_matches(substr(bill,1,2),'^[A-Z]{2}$') THEN 'prefix' END, CASE WHEN num % 9 = 0 THEN 'day' END) AS violations FROM bills")
def _(t):
    d = t.bills.withColumn("day", F.when(F.col("num") % 9 == 0, F.lit("1/2/99")).otherwise(F.col("intro")))
    rules = {"status": F.col("status").isin("Introduced", "In Committee", "Enrolled"), "prefix": F.substring("bill", 1, 2).rlike(r"^[A-Z]{2}$"), "day": F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$")}
    return Wr.validate(d, rules).select("num", "violations")


@query("A13_retention", "runlog", "SELECT date, count(*) AS n FROM runlog WHERE event_id >= (SELECT min(event_id) FROM runlog WHERE date >= '2024-01-13' OR event_id = 4000) GROUP BY 1")
def _(t):
    """Parts of 1,000 rows with their zone figures; expired parts go without being opened."""
    log = t.runlog.select("event_id", "date", F.when(F.col("event_id") == 4000, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("stamp"))
    store = St.Store(t.spark, scratch_path(t.spark, "log"))
    part = F.format_string("p%09d", F.floor(F.col("event_id") / 1000))
    store.commit({"log": log.withColumn("part", part)}, zones=St.log_zones("event_id", "stamp"))
    St.prune(store, "log", "event_id", "stamp", "2024-01-31", 18)
    return store.read("log").groupBy("date").agg(N())


@query("A14_session_registry", "bills", "SELECT 'VA' AS jurisdiction, session, count(*) AS rows, 3 AS columns, session = (SELECT max(session) FROM bills) AS active FROM bills GROUP BY 2")
def _(t):
    root = scratch_path(t.spark, "archive")
    entries = Wr.archive_sessions(t.bills.select("session", "bill", "title", "status"), root, "session")
    registry = entries.withColumn("jurisdiction", F.lit("VA")).withColumn("archived_at", F.lit(0))
    active = Wr.resolve_active(registry).withColumnRenamed("location", "_l")
    return registry.join(active, "jurisdiction").select("jurisdiction", "session", "rows", "columns", (F.col("location") == F.col("_l")).alias("active"))


@query("A15_text_store", "versions", "WITH s AS (SELECT DISTINCT bill, sha256(text) AS digest FROM versions WHERE role = 'user') SELECT bill, sha256(text) AS digest, min(version) AS version FROM versions WHERE (bill, sha256(text)) NOT IN (SELECT bill, digest FROM s) GROUP BY 1,2")
def _(t):
    v = t.versions.withColumn("session", F.lit("2026"))
    stored = v.filter("role = 'user'").select("session", "bill", F.sha2("text", 256).alias("digest"))
    return Wr.new_versions(v, stored).select("bill", "digest", "version")
