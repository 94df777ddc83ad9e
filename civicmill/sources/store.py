"""Numbered snapshots of tables that share their unchanged parts.

A snapshot's rows lie in parts: hash buckets of the key, days, ranges of an order. Folders are never changed once they
are written. A commit names, for every table and part, the folder that holds it, so a run rewrites only the parts it
touches, and dropping a part is a commit without it. Commit files appear whole: they are written aside and renamed,
which must be atomic in the file system of the store. A run that ends before its commit leaves the last version as it
was, and what it wrote is listed nowhere.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civicmill.sources import writers
from civicmill.sources.writers import PublishRefused, is_blank, readable

PART = "part"  # the column that names a row's part
PLAIN = re.compile(r"[A-Za-z0-9_.-]+\Z")


@dataclass(frozen=True)
class Snapshot:
    """What one commit says: ``tables[table]`` has the schema and, per part, folder and zone figures."""

    version: int
    tables: Mapping[str, dict] = field(default_factory=dict)
    notes: Mapping[str, object] = field(default_factory=dict)

    def parts(self, table: str) -> dict[str, dict]:
        return self.tables.get(table, {}).get("parts", {})


def hash_part(keys: Iterable[str], buckets: int) -> Column:
    """The hash bucket of a key as a part's name. Null keys are keys."""
    return F.format_string("b%05d", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- reading
    def _numbers(self) -> list[int]:
        found = self._files.globStatus(self._at(f"{self.path}/commits/*.json"))
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in found or [])

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """The newest committed version, or the one named; None before the first commit."""
        numbers = self._numbers()
        if not numbers or (version is not None and version not in numbers):
            return None
        named = numbers[-1] if version is None else version
        said = json.loads(self.spark.read.text(f"{self.path}/commits/{named:08d}.json", wholetext=True).first()[0])
        return Snapshot(named, said["tables"], said["notes"])

    def read(self, table: str, parts: Iterable[str] | None = None, at: Snapshot | None = None) -> DataFrame | None:
        """Rows of a table, or of some of its parts only: other parts' files are not opened. None if it was never written."""
        at = at or self.snapshot()
        if at is None or table not in at.tables:
            return None
        schema = StructType.fromJson(at.tables[table]["schema"])
        held = at.parts(table)
        chosen = sorted(held if parts is None else set(parts) & set(held))
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{held[p]['folder']}/_part={p}" for p in chosen])

    # --- writing
    def commit(
        self,
        tables: Mapping[str, DataFrame],
        touched: Iterable[str] | None = None,
        *,
        based_on: Snapshot | None = None,
        zones: Mapping[str, Column] | None = None,
        notes: Mapping[str, object] | None = None,
    ) -> int:
        """A new version: ``touched`` parts hold the rows given (or no rows any more), the others stay as they were.

        Without ``touched`` the tables are replaced whole. Rows name their part in the column ``part``; a row outside
        ``touched`` raises. ``zones`` are aggregates kept beside each part, such as the least and greatest stamp, with
        the row count. A large part is written by several tasks. If another run has committed since ``based_on``, this
        one raises and leaves that run's version.
        """
        last = based_on or self.snapshot() or Snapshot(0)
        number, run = last.version + 1, uuid.uuid4().hex
        allowed = None if touched is None else set(touched)
        said = {name: dict(t) for name, t in last.tables.items()}
        for name, rows in tables.items():
            folder = f"{name}/v{number:08d}-{run}"
            spread = rows.withColumn("_part", F.col(PART)).hint("rebalance", "_part")
            spread.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
            written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
            figures = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (zones or {}).items()]]
            found = {r[PART]: r.asDict() for r in written.groupBy(PART).agg(*figures).collect()}
            wrong = [p for p in found if p is None or not PLAIN.match(p) or (allowed is not None and p not in allowed)]
            if wrong:
                raise PublishRefused(f"{self.path}: rows of {name} in parts {sorted(map(str, wrong))[:5]}, which this commit may not write")
            kept = {} if allowed is None else {p: v for p, v in last.parts(name).items() if p not in allowed}
            new = {p: {"folder": folder, "zone": {k: v for k, v in z.items() if k != PART}} for p, z in found.items()}
            said[name] = {"schema": json.loads(rows.schema.json()), "parts": kept | new}
        self._publish(number, run, json.dumps({"version": number, "tables": said, "notes": dict(notes or {})}, sort_keys=True, default=str))
        return number

    def drop_parts(self, table: str, parts: Iterable[str], at: Snapshot, notes: Mapping[str, object] | None = None) -> int:
        """A new version without these parts; no file of the table is opened."""
        gone = set(parts)
        said = {n: {**t, "parts": {p: v for p, v in t["parts"].items() if n != table or p not in gone}} for n, t in at.tables.items()}
        body = json.dumps({"version": at.version + 1, "tables": said, "notes": dict(notes or {})}, sort_keys=True, default=str)
        self._publish(at.version + 1, uuid.uuid4().hex, body)
        return at.version + 1

    def _publish(self, number: int, run: str, body: str) -> None:
        aside, final = self._at(f"{self.path}/commits/.{number:08d}-{run}"), self._at(f"{self.path}/commits/{number:08d}.json")
        out = self._files.create(aside, False)
        out.write(bytearray(body.encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(final), options)
        except Exception as e:  # the name is taken, as Java says it
            if self._files.exists(final):
                raise PublishRefused(f"{self.path}: another run has committed version {number}") from e
            raise

    # --- retention
    def expire(self, keep: int) -> list[str]:
        """Forgets all but the newest ``keep`` versions, and removes folders of parts that no version left lists.

        Folders of ended runs that never committed go too, once a later run has committed their number.
        """
        numbers = self._numbers()
        left = [self.snapshot(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            self._files.delete(self._at(f"{self.path}/commits/{n:08d}.json"), False)
        listed = {f"{v['folder']}/_part={p}" for s in left for t in s.tables for p, v in s.parts(t).items()}
        gone = []
        for at in self._files.globStatus(self._at(f"{self.path}/*/v*/_part=*")) or []:
            folder = "/".join(at.getPath().toUri().getPath().rsplit("/", 3)[1:])
            if folder not in listed and int(folder.split("/")[1][1:9]) <= numbers[-1]:
                self._files.delete(at.getPath(), True)
                gone.append(folder)
        return sorted(gone)


# --- operators on a store
def upsert(store: Store, table: str, updates: DataFrame, keys: list[str], clock: str, buckets: int = 256) -> int:
    """Newest row per key, on equal clocks the update; only buckets that hold a key of ``updates`` are read and written.

    The first call lays the table out in ``buckets``, which later calls keep. ``updates`` is read twice.
    """
    at = store.snapshot()
    many = int(at.notes["buckets"]) if at else buckets
    new = updates.withColumn(PART, hash_part(keys, many))
    touched = [r[0] for r in new.select(PART).distinct().collect()]  # at most one a bucket
    held = store.read(table, touched, at)
    latest = writers.upsert(new.limit(0) if held is None else held, new, keys, clock)
    return store.commit({table: latest}, touched, based_on=at, notes={"buckets": many})


def log_zones(order: str, stamp: str) -> dict[str, Column]:
    """What a part of a log must tell so that a prune need not open it; none depends on the time of the prune."""
    blank, ts = is_blank(stamp), readable(stamp)
    return {
        "first": F.min(order),
        "last": F.max(order),
        "first_blank": F.min(F.when(blank, F.col(order))),
        "first_unreadable": F.min(F.when(~blank & ts.isNull(), F.col(order))),
        "latest": F.unix_micros(F.max(ts)),
        "earliest": F.unix_micros(F.min(ts)),
    }


def prune(store: Store, table: str, order: str, stamp: str, now: str, days: int) -> dict[str, object]:
    """Drops the leading expired rows of a log. A blank cell or a live row ends the prefix; an unreadable stamp in it aborts.

    Zone figures decide: parts that end before the first row to keep are left out of the new version without being
    opened; only parts that may hold that row are read, and only a part cut by it is written again. Returns the version,
    the first order kept, and the parts dropped, read and rewritten. If nothing expired no version is made.
    """
    at = store.snapshot()
    parts = {p: v["zone"] for p, v in at.parts(table).items()} if at else {}
    limit = store.spark.sql(f"SELECT unix_micros(timestamp '{now}' - make_dt_interval({int(days)}))").first()[0]
    live = {p: z for p, z in parts.items() if z["latest"] is not None and z["latest"] >= limit}
    blanks = [z["first_blank"] for z in parts.values() if z["first_blank"] is not None]
    # a part that holds a live row stops the prefix at its end at the latest; only parts that begin before can stop it sooner
    bound = min([z["last"] for z in live.values()] + blanks, default=None)
    begun = [p for p, z in live.items() if z["first"] <= bound]
    # where every stamp is live and readable, the first row is the first live one: its zone says so already
    whole = [p for p in begun if parts[p]["earliest"] >= limit and parts[p]["first_blank"] is None and parts[p]["first_unreadable"] is None]
    opened = [p for p in begun if p not in whole]
    firsts = blanks + [parts[p]["first"] for p in whole]
    if opened:
        alive = F.unix_micros(readable(stamp)) >= limit
        found = store.read(table, opened, at).filter(~is_blank(stamp)).agg(F.min(F.when(alive, F.col(order)))).first()[0]
        firsts += [] if found is None else [found]
    keep_from = min(firsts, default=None)
    unreadable = min((z["first_unreadable"] for z in parts.values() if z["first_unreadable"] is not None), default=None)
    if unreadable is not None and (keep_from is None or unreadable < keep_from):
        raise PublishRefused(f"unreadable timestamp in the expired prefix at {unreadable}; nothing pruned")
    dropped = [p for p, z in parts.items() if keep_from is None or z["last"] < keep_from]
    cut = [p for p, z in parts.items() if keep_from is not None and z["first"] < keep_from <= z["last"]]
    version = at.version if at else None
    if cut:
        rest = store.read(table, cut, at).filter(F.col(order) >= keep_from)
        version = store.commit({table: rest}, [*cut, *dropped], based_on=at, zones=log_zones(order, stamp), notes=at.notes)
    elif dropped:
        version = store.drop_parts(table, dropped, at, at.notes)
    return {"version": version, "keep_from": keep_from, "dropped": sorted(dropped), "read": sorted({*opened, *cut}), "rewritten": sorted(cut)}
