"""Records of the second state from nested JSON, read by path from VARIANT columns.

A container may be a bare list, an object with ``items`` as a list or as an object, or missing; a field may be absent or
of another type. All of it is read by path in one narrow pass: no field has to be declared, and one that nobody reads
yet is counted as drift instead of being lost.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, VariantType

from civicmill.session import cut_lineage

# The source's chamber codes, and the names the product gives its chambers.
CHAMBERS = {"SENATE": "Senate", "SEN": "Senate", "ASSEMBLY": "Assembly", "ASM": "Assembly", "ASSEM": "Assembly"}
PRODUCT = {"Assembly": "House", "Senate": "Senate"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(""))


def text(v: Column, path: str) -> Column:
    """A text or number at a path, trimmed; '' for anything else."""
    return F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def chamber_of(raw: Column) -> Column:
    return _lookup(CHAMBERS, F.upper(F.trim(raw)))


def items(v: Column, path: str = "$") -> Column:
    """The entries of a container at a path, whichever of its shapes it has. Never null."""
    inner = f"{path}.items"
    listed = [F.try_variant_get(v, p, "array<variant>") for p in (path, inner)]
    return F.coalesce(*listed, F.map_values(F.try_variant_get(v, inner, "map<string,variant>")), F.array().cast("array<variant>"))


def objects(v: Column, path: str = "$") -> Column:
    """The entries that are objects."""
    return F.filter(items(v, path), lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())


def size_of(v: Column, path: str = "$") -> Column:
    """The size a container declares, else the number of its entries."""
    return F.coalesce(F.try_variant_get(v, f"{path}.size", "int"), F.size(items(v, path)))


def _ordered(entries: Column, *keys) -> Column:
    """Entries by the given keys; equal ones keep their order."""
    placed = F.transform(entries, lambda x, i: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i")))
    return F.transform(F.array_sort(placed), lambda p: F.get(entries, p["i"]))


def _last(entries: Column, test) -> Column:
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(entries, test)), -1)


def history(v: Column) -> Column:
    """Actions by date and sequence number, with what their chamber said where the code is unknown."""
    number = lambda x: F.coalesce(F.try_variant_get(x, "$.sequenceNo", "int"), F.lit(0))
    ordered = _ordered(objects(v, "$.actions"), lambda x: text(x, "$.date"), number)

    def entry(x: Column) -> Column:
        raw = text(x, "$.chamber")
        known = chamber_of(raw)
        return F.struct(text(x, "$.text").alias("action"), text(x, "$.date").alias("date"), known.alias("chamber"), F.when((raw != "") & (known == ""), raw).alias("chamber_raw"))

    return F.transform(ordered, entry)


def agenda_refs(v: Column) -> Column:
    def ref(x: Column) -> Column:
        raw = text(x, "$.committeeId.chamber")
        known = chamber_of(raw)
        return F.struct(
            text(x, "$.agendaId.year").alias("year"),
            text(x, "$.agendaId.number").alias("agenda_number"),
            text(x, "$.committeeId.name").alias("committee"),
            known.alias("chamber"),
            F.when((raw != "") & (known == ""), raw).alias("chamber_raw"),
        )

    return F.transform(objects(v, "$.committeeAgendas"), ref)


def latest_vote(v: Column) -> Column:
    """The newest vote by date: its tally (an aye with reservations is an aye), place, date and counts by code."""
    last = F.element_at(F.concat(F.array(F.lit(None).cast("variant")), _ordered(objects(v, "$.votes"), lambda x: text(x, "$.voteDate"))), -1)
    counts = F.transform_values(F.try_variant_get(last, "$.memberVotes.items", "map<string,variant>"), lambda _, b: size_of(b))
    n = lambda code: F.coalesce(F.try_element_at(counts, F.lit(code)), F.lit(0))
    name, where = text(last, "$.committee.name"), text(last, "$.committee.chamber")
    place = F.when((name != "") & (where != ""), F.trim(F.concat_ws(" ", chamber_of(where), name))).when(name != "", name).otherwise(text(last, "$.voteType"))
    return F.struct(
        F.when(F.size(counts) > 0, F.format_string("%d-Y %d-N", n("AYE") + n("AYEWR"), n("NAY"))).otherwise("").alias("tally"),
        place.alias("location"),
        text(last, "$.voteDate").alias("date"),
        counts.alias("breakdown"),
    )


def state_b_records(documents: DataFrame, column: str = "doc") -> DataFrame:
    """One record per document (a VARIANT), with the counters of its health; documents without a bill number are kept, with an empty one.

    The outcome comes from the signed flag or from veto messages and from nothing else. The position is the origin, then
    the chamber of the latest past committee that has one, then that of the latest action that has one.
    """
    d = documents.withColumn("history", history(F.col(column))).withColumn("agenda_refs", agenda_refs(F.col(column))).withColumn("latest_vote", latest_vote(F.col(column)))
    v = F.col(column)
    past = F.transform(_ordered(objects(v, "$.pastCommittees"), lambda x: text(x, "$.referenceDate")), lambda x: F.struct(text(x, "$.name").alias("name"), text(x, "$.chamber").alias("raw"), chamber_of(text(x, "$.chamber")).alias("chamber")))
    d = d.withColumn("past", past)
    name, number = text(v, "$.basePrintNo"), text(v, "$.printNo")
    origin_raw = text(v, "$.billType.chamber")
    origin = chamber_of(origin_raw)
    known = lambda entries: _last(F.transform(entries, lambda x: x["chamber"]), lambda c: c.isin("Senate", "Assembly"))
    now = F.coalesce(known(F.col("history")), known(F.col("past")), origin)
    other = F.when(origin == "Senate", "Assembly").when(origin == "Assembly", "Senate")
    crossed = F.coalesce(F.exists("history", lambda h: h["chamber"] == other), F.lit(False))
    held = text(v, "$.status.committeeName")
    last_past = F.coalesce(F.get(F.col("past"), F.size("past") - 1)["name"], F.lit(""))
    places = F.transform(F.filter("past", lambda p: p["name"] != ""), lambda p: F.struct(F.when(p["chamber"] != "", p["chamber"]).otherwise(p["raw"]), p["name"]))
    moves = F.filter(F.transform(places, lambda p, i: (i == 0) | (p != F.get(places, i - 1))), lambda new: new)
    signed = F.coalesce(F.try_variant_get(v, "$.signed", "boolean"), text(v, "$.signed") != "")
    outcome = F.when(signed, "signed").when(size_of(v, "$.vetoMessages") > 0, "vetoed").otherwise("unknown_structural")
    source = F.when(signed, "signed_boolean").when(outcome == "vetoed", "veto_messages").otherwise("unresolved_structural")
    bill = F.upper(F.regexp_replace(F.when(name != "", name).otherwise(number), " ", ""))
    session = text(v, "$.session")
    dated = F.coalesce(F.get(F.col("history"), F.size("history") - 1)["date"], text(v, "$.status.actionDate"))
    full, short = text(v, "$.sponsor.member.fullName"), text(v, "$.sponsor.member.shortName")
    describe, kind = text(v, "$.status.statusDesc"), text(v, "$.status.statusType")
    count = lambda c, test: F.size(F.filter(c, test))
    return d.select(
        *[c for c in documents.columns if c != column],
        bill.alias("bill"),
        text(v, "$.title").alias("title"),
        text(v, "$.summary").alias("summary"),
        F.when(describe != "", describe).otherwise(kind).alias("status_lis"),
        outcome.alias("outcome"),
        source.alias("outcome_source"),
        F.when(full != "", full).otherwise(short).alias("patron"),
        text(v, "$.sponsor.member.memberId").alias("patron_id"),
        _lookup(PRODUCT, now).alias("chamber"),
        crossed.alias("crossed_over"),
        F.when(held != "", held).otherwise(last_past).alias("last_committee"),
        F.size(moves).alias("referral_count"),
        "latest_vote",
        dated.alias("last_action_date"),
        "history",
        "agenda_refs",
        F.when((bill != "") & (session != ""), F.concat_ws("/", F.lit("bills"), session, bill)).otherwise("").alias("source_path"),
        count("history", lambda h: h["action"] == "").alias("missing_action_text"),
        (
            ((origin_raw != "") & (origin == "")).cast("int")
            + count("history", lambda h: h["chamber_raw"].isNotNull())
            + count("agenda_refs", lambda r: r["chamber_raw"].isNotNull())
            + count("past", lambda p: (p["raw"] != "") & (p["chamber"] == ""))
        ).alias("unknown_chambers"),
        (size_of(v, "$.votes") > 0).alias("has_votes"),
        ((bill != "") & (session == "")).alias("no_session"),
    )


def completeness(records: DataFrame) -> DataFrame:
    """One row of counts and rates over the records, as the health rules read them. No record at all is an error."""
    ok = F.col("bill") != ""
    sum_of = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    out = records.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~ok).alias("malformed"),
        F.count_if(ok).alias("written"),
        F.count_if(ok & (F.size("history") > 0)).alias("has_actions"),
        F.count_if(ok & F.col("has_votes")).alias("has_votes"),
        F.count_if(ok & (F.col("patron") != "")).alias("patron_present"),
        F.count_if(ok & (F.col("summary") != "")).alias("summary_present"),
        sum_of(F.size("agenda_refs")).alias("agenda_refs"),
        F.count_if(ok & (F.col("outcome_source") == "unresolved_structural")).alias("unresolved"),
        sum_of(F.col("unknown_chambers")).alias("unknown_chamber"),
        F.count_if(ok & F.col("no_session")).alias("no_session"),
        sum_of(F.col("missing_action_text")).alias("no_text"),
    )
    some = F.assert_true(F.col("written") > 0, F.lit("the universe came back empty: refusing to overwrite"))
    rate = lambda c: F.round(F.col(c) / F.col("written"), 4).alias(f"{c}_rate")
    return out.withColumn("_g", some).filter("_g IS NULL").drop("_g").select("*", *[rate(c) for c in ("has_actions", "has_votes", "patron_present", "summary_present")])


# --- drift
#: Paths the records read; ``*`` stands for any key of a container that is an object.
READ = (
    "actions", "actions.chamber", "actions.date", "actions.sequenceNo", "actions.text", "basePrintNo", "billType", "billType.chamber",
    "committeeAgendas", "committeeAgendas.agendaId", "committeeAgendas.agendaId.number", "committeeAgendas.agendaId.year",
    "committeeAgendas.committeeId", "committeeAgendas.committeeId.chamber", "committeeAgendas.committeeId.name", "pastCommittees",
    "pastCommittees.chamber", "pastCommittees.name", "pastCommittees.referenceDate", "printNo", "session", "signed", "sponsor", "sponsor.member",
    "sponsor.member.fullName", "sponsor.member.memberId", "sponsor.member.shortName", "status", "status.actionDate", "status.committeeName",
    "status.statusDesc", "status.statusType", "summary", "title", "vetoMessages", "votes", "votes.committee", "votes.committee.chamber", "votes.committee.name",
    "votes.memberVotes", "votes.memberVotes.*", "votes.voteDate", "votes.voteType",
)


def _paths(kind: DataType, at: tuple[str, ...] = ()) -> tuple[set[tuple[str, ...]], set[tuple[str, ...]]]:
    """Paths that a schema shows, and those of them where documents disagree about the type."""
    if isinstance(kind, ArrayType):
        return _paths(kind.elementType, at)
    if isinstance(kind, VariantType):
        return set(), {at}
    seen, mixed = set(), set()
    for f in kind.fields if isinstance(kind, StructType) else ():
        below = _paths(f.dataType, (*at, f.name))
        seen |= {(*at, f.name)} | below[0]
        mixed |= below[1]
    return seen, mixed


def _general(path: Sequence[str], maps: Sequence[str]) -> str:
    """A path with containers' wrappers left out and the keys of objects in them as ``*``."""
    out: list[str] = []
    for step, name in enumerate(path):
        if name in ("items", "size") and step:
            continue
        keyed = step and path[step - 1] == "items" and (name.isdigit() or ".".join(out) in maps)
        if keyed and ".".join(out) not in maps:
            continue  # a list written as an object
        out.append("*" if keyed else name)
    return ".".join(out)


def values_at(v: Column, path: Sequence[str]) -> Column:
    """All values at a general path, entries of containers on the way included."""

    def below(found: Column, name: str) -> Column:
        if name == "*":
            return F.flatten(F.transform(found, lambda x: items(x)))
        opened = F.flatten(F.transform(found, lambda x: F.concat(F.array(x), items(x))))
        return F.transform(opened, lambda x: F.try_variant_get(x, f"$['{name}']", "variant"))

    return reduce(lambda now, name: F.filter(below(now, name), lambda x: x.isNotNull()), path, F.array(v))


def _all_paths(documents: DataFrame, column: str, maps: Sequence[str], at: tuple[str, ...] = ()) -> set[str]:
    """General paths of all documents. Where types disagree, the entries found there are surveyed by themselves."""
    said = documents.agg(F.schema_of_variant_agg(column)).first()[0] or "VOID"
    kind = StructType.fromDDL("root " + re.sub(r"\bOBJECT<>", "VOID", said).replace("OBJECT<", "STRUCT<"))["root"].dataType
    seen, mixed = _paths(kind)
    out = {_general((*at, *p), maps) for p in seen}
    for path in {_general((*at, *p), maps) for p in mixed} - {".".join(at)}:
        inner = tuple(path.split("."))[len(at) :]
        found = values_at(F.col(column), inner)
        listed = F.flatten(F.transform(found, lambda x: F.when(F.try_variant_get(x, "$.items", "variant").isNull(), F.array(x)).otherwise(items(x))))
        entries = F.flatten(F.transform(listed, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))
        below = documents.select(F.explode(F.filter(entries, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())).alias(column))
        out |= _all_paths(below, column, maps, (*at, *inner))
    return out


def unseen_paths(documents: DataFrame, column: str = "doc", known: Sequence[str] = READ, maps: Sequence[str] = ("votes.memberVotes",)) -> DataFrame:
    """(path, n): paths in the documents that nobody reads, with the number of documents that hold them.

    One aggregate finds the schema of all documents, one more each place where types disagree, and a last one counts the
    paths found; all combine before the shuffle. What lies below an unseen path is part of it. All of them read the
    documents as one written table, so these are built and parsed once.
    """
    documents = cut_lineage(documents.select(column))
    odd: list[str] = []
    for general in sorted(_all_paths(documents, column, maps) - set(known)):
        if general and not any(general.startswith(f"{o}.") for o in odd):
            odd.append(general)
    if not odd:
        return documents.sparkSession.createDataFrame([], "path string, n bigint")
    counts = documents.agg(*[F.count_if(F.size(values_at(F.col(column), p.split("."))) > 0).alias(f"n{i}") for i, p in enumerate(odd)])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"n{i}").alias("n")) for i, p in enumerate(odd)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
