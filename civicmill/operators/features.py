"""The feature table of the rate jobs: one row per bill, every feature a labelled band.

Features come from the bill's own session as filed, and from outcomes of the session before it alone, so that nothing
known only after a decision enters. Each side is reduced to one row per bill, member, committee or subject before it is
joined; hot patrons and committees combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill import scale

UNKNOWN = "unknown"


def band(value: Column, *steps: tuple[float, str], above: str, missing: str = UNKNOWN) -> Column:
    """The label of the first step whose limit the value does not exceed; ``missing`` for null."""
    out = F.when(value.isNull(), missing)
    for limit, label in steps:
        out = out.when(value <= limit, label)
    return out.otherwise(above)


def below(value: Column, *steps: tuple[float, str], above: str, missing: str = UNKNOWN) -> Column:
    """The same with limits that the value must stay below."""
    out = F.when(value.isNull(), missing)
    for limit, label in steps:
        out = out.when(value < limit, label)
    return out.otherwise(above)


def _most_common(df: DataFrame, keys: Sequence[str], value: str, out: str, least: int = 1) -> DataFrame:
    """The value that most rows of a key have, ties to the smallest, where the key has at least ``least`` rows."""
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    top = per.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.max("_n").alias("_n"))
    kept = per.join(top.filter(F.col("_all") >= least).select(*keys, "_n"), [*keys, "_n"])
    return kept.groupBy(*keys).agg(F.min(value).alias(out))


def assemble(bills: DataFrame, sponsors: DataFrame, members: DataFrame, seats: DataFrame, behaviour: DataFrame | None = None, *, prior_least: int = 3) -> DataFrame:
    """Features of each bill, with session, bill and y.

    ``bills``: session (int), bill, num, chamber, chief, committee, subject, versions, y (the outcome, 0 or 1). A bill
    may lack any of chief, committee and subject. ``sponsors``: session, bill, member, chief_pair (true for a chief
    co-patron), place (the order of listing), without the chief. ``members``: session, member, chamber, party, district.
    ``seats``: session, committee, member. ``behaviour``: session, member, loyalty and win_rate from roll calls, shares
    or null. One row per bill and per member of a session is expected of bills and members.
    """
    who = members.select("session", "member", F.nullif("party", F.lit("")).alias("party"), F.col("district").try_cast("int").alias("district"))
    major = _most_common(members.filter("party <> ''"), ["session", "chamber"], "party", "majority")
    chiefs = who.select("session", F.col("member").alias("chief"), F.col("party").alias("chief_party"), F.col("district").alias("chief_district"))
    b = bills.join(chiefs, ["session", "chief"], "left").join(major, ["session", "chamber"], "left")

    # co-patrons, one row a bill
    listed = sponsors.join(bills.select("session", "bill", "chief", "committee", "chamber"), ["session", "bill"])
    listed = listed.join(who, ["session", "member"], "left").join(major, ["session", "chamber"], "left")
    listed = listed.join(seats.select("session", "committee", "member", F.lit(True).alias("seated")).distinct(), ["session", "committee", "member"], "left")
    pair = F.col("chief_pair")
    co = listed.groupBy("session", "bill").agg(
        F.min_by(F.struct("party"), F.when(pair, F.struct("place", "member"))).alias("pair"),
        F.count_distinct("district").alias("districts"),
        F.count("party").alias("known"),
        F.count_if(F.col("party") == F.col("majority")).alias("in_majority"),
        F.coalesce(F.bool_or("seated"), F.lit(False)).alias("on_committee"),
    )
    # the chief's habits, a committee's load, a subject's usual committee
    member = [F.col("session"), F.col("member").alias("chief")]
    generous = listed.groupBy(*member).agg(F.count(F.lit(1)).alias("generosity"), F.count_distinct(F.when(F.col("chief") != "", F.col("chief"))).alias("network"))
    load = bills.filter("committee <> ''").groupBy("session", "committee").agg(F.count(F.lit(1)).alias("load"))
    usual = _most_common(bills.filter("subject <> ''"), ["session", "subject"], "committee", "usual", 5)
    nth = scale.row_numbers(bills.filter("chief <> ''").select("session", "chief", "bill", "num"), ["session", "chief"], ["num", "bill"], "nth")
    before = bills.filter("chief <> '' AND subject <> ''").groupBy((F.col("session") + 1).alias("session"), "chief", "subject").agg(F.avg("y").alias("prior"), F.count(F.lit(1)).alias("_n"))
    for side, on in (
        (co, ["session", "bill"]),
        (generous, ["session", "chief"]),
        (load, ["session", "committee"]),
        (usual, ["session", "subject"]),
        (nth.select("session", "bill", "nth"), ["session", "bill"]),
        (before.filter(F.col("_n") >= prior_least).drop("_n"), ["session", "chief", "subject"]),
    ):
        b = b.join(side, on, "left")
    if behaviour is not None:
        b = b.join(behaviour.select("session", F.col("member").alias("chief"), "loyalty", "win_rate"), ["session", "chief"], "left")
    else:
        b = b.withColumn("loyalty", F.lit(None).cast("double")).withColumn("win_rate", F.lit(None).cast("double"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cross = (F.col("pair.party") != F.col("chief_party")) & F.col("pair.party").isNotNull()
    return b.select(
        "session",
        "bill",
        "y",
        F.when(F.col("pair").isNull(), "no chief co-patron").when(cross, "cross-party").otherwise("same-party").alias("bipartisan_chief_pair"),
        band(F.col("chief_district"), (25, "1-25"), (50, "26-50"), (75, "51-75"), above="76+").alias("patron_district_band"),
        band(zero("districts"), (0, "none"), (2, "1-2"), (9, "3-9"), above="10+").alias("copatron_district_spread"),
        F.when(zero("known") == 0, "none").when(F.col("in_majority") == F.col("known"), "all-majority").when(F.col("in_majority") > 0, "mixed").otherwise("none-majority").alias("majority_copatron_share"),
        F.when(F.col("on_committee"), "Y").otherwise("N").alias("cmte_member_copatrons"),
        band(zero("generosity"), (0, "0"), (20, "1-20"), (60, "21-60"), above="61+").alias("patron_generosity"),
        band(zero("network"), (5, "0-5"), (20, "6-20"), above="21+").alias("patron_network_breadth"),
        below(F.col("loyalty"), (0.8, "<80%"), (0.92, "80-92%"), above="92%+").alias("patron_party_loyalty"),
        below(F.col("win_rate"), (0.6, "<60%"), (0.8, "60-80%"), above="80%+").alias("patron_floor_win_rate"),
        F.when(F.col("usual").isNull(), UNKNOWN).when(F.col("usual").eqNullSafe(F.col("committee")), "usual").otherwise("unusual").alias("subject_cmte_match"),
        band(zero("load"), (60, "light"), (140, "medium"), above="heavy").alias("cmte_load"),
        band(F.coalesce("nth", F.lit(99)), (3, "1-3"), (10, "4-10"), (25, "11-25"), above="26+").alias("patron_bill_rank"),
        F.least(zero("versions"), F.lit(4)).cast("string").alias("text_versions"),
        below(F.col("prior"), (0.5, "poor"), above="good").alias("patron_prior_on_this_subject"),
    )
