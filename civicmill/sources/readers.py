"""Tolerant readers: bulk CSV, wrapped JSON, session archives, pages, checksummed files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad_line"


def normal_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def read_raw_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Every cell as text, headers lower-cased with underscores. Lines with too many cells keep their text in
    ``_bad_line``; short lines are padded with nulls. No type inference: leading zeros survive."""
    header = spark.read.option("encoding", encoding).csv(path, header=True).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header] + [T.StructField(BAD, T.StringType())])
    raw = spark.read.option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("columnPruning", False).csv(path, header=True, schema=schema)
    cells = F.size(F.split(F.regexp_replace(F.col(BAD), r'"[^"]*"', ""), ",", -1))
    bad = F.when(cells > len(header), F.col(BAD))
    return raw.select(*[F.col(f"`{c}`").alias(normal_header(c)) for c in header], bad.alias(BAD))


def with_aliases(raw: DataFrame, aliases: Mapping[str, Sequence[str]], required: Iterable[str] = ()) -> DataFrame:
    """First alias that exists becomes the column; an absent optional column is null, an absent required one is an error."""
    found = {name: next((a for a in names if a in raw.columns), None) for name, names in aliases.items()}
    missing = [name for name in required if found[name] is None]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the file has {[c for c in raw.columns if c != BAD]}")
    return raw.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()])


def read_bulk_csv(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], required: Iterable[str] = ()) -> DataFrame:
    """Good lines of a bulk file under their canonical names."""
    raw = read_raw_csv(spark, path)
    return with_aliases(raw.filter(F.col(BAD).isNull()), aliases, required)


def csv_health(spark: SparkSession, path: str) -> DataFrame:
    """Lines read and lines set aside."""
    bad = F.col(BAD).isNotNull()
    raw = read_raw_csv(spark, path)
    return raw.agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("bad_lines"), F.count_if(~bad & F.col(raw.columns[0]).isNotNull()).alias("good_lines"))


def json_items(cell, element: str) -> Column:
    """Items of a JSON container: a bare list, or under ``items`` as a list or as an object. Never null."""
    c = F.col(cell) if isinstance(cell, str) else cell
    inner = F.get_json_object(c, "$.items")
    as_list = lambda x: F.when(F.trim(x).startswith("["), F.from_json(x, f"array<{element}>"))
    as_map = F.when(F.trim(inner).startswith("{"), F.map_values(F.from_json(inner, f"map<string,{element}>")))
    return F.coalesce(as_list(c), as_list(inner), as_map, F.from_json(F.lit("[]"), f"array<{element}>"))


def json_size(cell, element: str) -> Column:
    """Declared size where there is one, else the number of items."""
    return F.coalesce(F.get_json_object(cell, "$.size").try_cast("int"), F.size(json_items(cell, element)))


def session_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the ``session=`` folders; listed through the cluster's file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/session=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().getName() for s in found or [])


def read_sessions(spark: SparkSession, root: str, skip: Sequence[str] = ()) -> DataFrame:
    """One table from many session archives. Columns may differ between sessions; skipped ones are duplicates."""
    out = None
    for folder in session_folders(spark, root):
        code = folder.split("=", 1)[1]
        if code in skip:
            continue
        df = read_raw_csv(spark, f"{root}/{folder}").drop(BAD).withColumn("session", F.lit(code))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no session archive under {root}")
    return out


# --- pages ------------------------------------------------------------------------------------------------------------
_ANCHOR = r"<a\s[^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)</a>"


def anchors(html) -> Column:
    """ARRAY<STRUCT(href, label)> of the anchors whose label is plain text."""
    c = F.col(html) if isinstance(html, str) else html
    hrefs = F.regexp_extract_all(c, F.lit(_ANCHOR), F.lit(1))
    labels = F.regexp_extract_all(c, F.lit(_ANCHOR), F.lit(2))
    return F.zip_with(hrefs, labels, lambda h, t: F.struct(h.alias("href"), F.trim(t).alias("label")))


def query_parameter(url, name: str) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(c, rf"[?&]{name}=([^&#]*)", 1)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self._open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self._open.append((dict(attrs).get("href") or "", []))

    def handle_data(self, data):
        if self._open and data.strip():
            self._open[-1][1].append(" ".join(data.split()))

    def handle_endtag(self, tag):
        if tag == "a" and self._open:
            href, text = self._open.pop()
            self.found.append((href, " ".join(text)))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of each page with a real HTML parser, page by page inside the tasks: page_id, href, label, query."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"]):
                parser = _Links()
                parser.feed(html or "")
                rows.extend((page_id, h, t, "&".join(f"{k}={v}" for k, v in sorted(parse_qsl(urlsplit(h).query)))) for h, t in parser.found)
            yield pd.DataFrame(rows, columns=["page_id", "href", "label", "query"])

    return pages.select("page_id", "html").mapInPandas(parse, "page_id bigint, href string, label string, query string")


def agenda_rows(links: DataFrame, key: str) -> DataFrame:
    """First link per key of each page, tagged by what kind of time its source can give."""
    k = query_parameter("href", key)
    found = links.withColumn("item", F.when(k != "", k).otherwise(F.lower("href")))
    first = found.groupBy("page_id", "item").agg(F.min("href").alias("href"), F.count(F.lit(1)).alias("copies"))
    return first.withColumn("time_bucket", F.when(F.col("href").contains("?"), "relative_time").otherwise("no_clock_source"))


# Supporting links that are neither agenda nor meeting.
BENIGN_LABELS = ("committee info", "subcommittee info", "subommittee info", "registration", "meeting materials")


def labelled_links(rows: DataFrame, html: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Agenda and meeting link per row decided by the label alone; and the labels nobody knows, with volume."""
    a = rows.select(key, F.posexplode(anchors(html)).alias("pos", "a"))
    label = F.trim(F.regexp_replace(F.lower("a.label"), r"[()]", ""))
    a = a.select(key, "pos", "a.href", label.alias("label"))
    agenda, meeting = F.col("label").contains("agenda"), F.col("label").contains("view meeting")
    links = a.groupBy(key).agg(F.coalesce(F.min_by("href", F.when(agenda, F.col("pos"))), F.lit("")).alias("agenda"), F.coalesce(F.min_by("href", F.when(meeting, F.col("pos"))), F.lit("")).alias("meeting"))
    links = rows.select(key).join(links, key, "left").na.fill("", ["agenda", "meeting"])
    drift = a.filter(~agenda & ~meeting & ~F.col("label").isin(*BENIGN_LABELS)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return links, drift


# --- files ------------------------------------------------------------------------------------------------------------
def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and SHA-256 of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """ok, changed, missing or unlisted per file."""
    m = manifest.select("file", F.col("sha256").alias("_s"), F.col("bytes").alias("_b"))
    j = current.join(m, "file", "full")
    state = F.when(F.col("_s").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when((F.col("sha256") == F.col("_s")) & (F.col("bytes") == F.col("_b")), "ok").otherwise("changed")
    return j.select("file", state.alias("state"))
