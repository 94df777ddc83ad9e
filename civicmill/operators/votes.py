"""Roll calls, members, identity, party behaviour.

Member and committee tables are rosters; roll calls and votes are the large side. Nothing here pairs members
inside a roll call: per-roll-call party counts, minus the member's own vote, replace that loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.session import cut_lineage


# --- ragged roll-call lines -------------------------------------------------------------------------------------
def roll_call_lines(lines: DataFrame) -> DataFrame:
    """One row per line: id, cell count, complete (member, token) pairs and the number of half pairs."""
    cells = F.transform(F.split("value", ",", -1), lambda x: F.trim(x))
    rows = lines.select(cells.alias("cells")).filter(F.try_element_at("cells", F.lit(1)) != "")
    n = F.size("cells")
    pairs = F.transform(
        F.when(n >= 2, F.sequence(F.lit(2), n, F.lit(2))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.element_at("cells", i).alias("member"), F.coalesce(F.get("cells", i), F.lit("")).alias("token")))
    rows = rows.select(F.element_at("cells", 1).alias("vote_id"), n.alias("width"), pairs.alias("pairs"))
    full = F.filter("pairs", lambda p: (p["member"] != "") & (p["token"] != ""))
    half = F.filter("pairs", lambda p: (p["member"] != "") != (p["token"] != ""))
    return rows.select("vote_id", "width", full.alias("pairs"), F.size(half).alias("half_pairs"))


def parse_roll_calls(lines: DataFrame) -> DataFrame:
    """Long form (vote_id, member, token). Inside a line the last token of a member wins."""
    rows = roll_call_lines(lines).select("vote_id", F.posexplode("pairs").alias("pos", "p"))
    rows = rows.select("vote_id", "pos", F.col("p.member").alias("member"), F.col("p.token").alias("token"))
    return rows.groupBy("vote_id", "member").agg(F.max_by("token", F.struct("pos", "token")).alias("token"))


def parse_health(lines: DataFrame) -> DataFrame:
    """Every denominator of a parse, one row, one aggregation."""
    rows = roll_call_lines(lines).withColumn("shape", I.vote_id_shape("vote_id")).withColumn("has", F.size("pairs") > 0)
    unknown = F.size(F.filter("pairs", lambda p: ~p["token"].isin(*K.VOTE_TOKENS)))
    miss = lambda shape: F.count_if(~F.col("has") & (F.col("shape") == shape)).alias(f"no_detail_{shape}")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("has").alias("rows_with_members"), F.count_if(~F.col("has")).alias("rows_without_detail"),
        F.sum(F.size("pairs")).cast("bigint").alias("member_votes"), F.sum(unknown).cast("bigint").alias("unknown_tokens"),
        F.sum("half_pairs").cast("bigint").alias("unpaired_cells"), F.count_distinct("width").alias("distinct_widths"),
        *[miss(s) for s in ("committee_id_only", "chamber_committee", "floor", "voice_or_standing", "other")])


# --- records of members -----------------------------------------------------------------------------------------
def first_votes(votes: DataFrame) -> DataFrame:
    """One vote per (roll call, member): the earliest by sequence."""
    return scale.earliest(votes, ["vote_id", "member"], ["seq"])


def vote_collisions(votes: DataFrame) -> DataFrame:
    """Roll calls where one member appears more than once: identity is breaking."""
    per = votes.groupBy("vote_id", "member").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("collisions"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).cast("bigint").alias("extra_rows"),
                   F.count(F.lit(1)).alias("pairs"))


def token_record(votes: DataFrame) -> DataFrame:
    """Y/N/X/A counts per member; other tokens are counted, not dropped."""
    known = [F.count_if(F.col("token") == t).alias(t.lower()) for t in K.VOTE_TOKENS]
    return votes.groupBy("member").agg(*known, F.count_if(~F.col("token").isin(*K.VOTE_TOKENS)).alias("other"), F.count(F.lit(1)).alias("votes"))


def absence_share(record: DataFrame, min_votes: int = 20) -> DataFrame:
    return record.filter(F.col("votes") >= min_votes).select("member", "votes", F.round((F.col("x") + F.col("a")) / F.col("votes"), 6).alias("absence"))


def agreement_with_positions(votes: DataFrame, positions: DataFrame) -> DataFrame:
    """k of n per member, over votes they cast on roll calls we took a side on."""
    cast = votes.filter(F.col("token").isin("Y", "N")).join(positions.select("vote_id", "wanted"), "vote_id")
    return cast.groupBy("member").agg(F.count_if(F.col("token") == F.col("wanted")).alias("k"), F.count(F.lit(1)).alias("n"))


# --- roll calls -------------------------------------------------------------------------------------------------
def directional(votes: DataFrame) -> DataFrame:
    """Yes/no votes only, one per member and roll call."""
    return first_votes(votes.filter(F.col("token").isin("Y", "N"))).withColumn("yes", F.col("token") == "Y")


def roll_call_summary(votes: DataFrame) -> DataFrame:
    """Yes, no, margin, winner and size per roll call. A tie is won by no."""
    s = votes.groupBy("vote_id").agg(F.count_if("yes").alias("yes_n"), F.count_if(~F.col("yes")).alias("no_n"))
    return s.select("vote_id", "yes_n", "no_n", F.abs(F.col("yes_n") - F.col("no_n")).alias("margin"),
                    F.when(F.col("yes_n") > F.col("no_n"), "Y").otherwise("N").alias("winner"), (F.col("yes_n") + F.col("no_n")).alias("n"))


def party_majorities(votes: DataFrame) -> DataFrame:
    """Side of each party in each roll call; none on a tie or for members without a party."""
    s = votes.filter(F.coalesce("party", F.lit("")) != "").groupBy("vote_id", "party").agg(F.count_if("yes").alias("y"), F.count_if(~F.col("yes")).alias("x"))
    return s.select("vote_id", "party", "y", "x", F.when(F.col("y") > F.col("x"), "Y").when(F.col("y") < F.col("x"), "N").alias("party_side"))


def with_defection(votes: DataFrame) -> DataFrame:
    """Adds defect and with_winner, margin and size. Votes need vote_id, member, party, yes, token.

    One aggregation per (roll call, party) gives the party sides; the roll-call totals are sums of those rows.
    """
    per = votes.groupBy("vote_id", F.coalesce("party", F.lit("")).alias("_p")).agg(F.count_if("yes").alias("y"), F.count_if(~F.col("yes")).alias("x"))
    totals = per.groupBy("vote_id").agg(F.sum("y").alias("_y"), F.sum("x").alias("_x"))
    side = F.when(F.col("_p") == "", None).when(F.col("y") > F.col("x"), "Y").when(F.col("y") < F.col("x"), "N")
    rolls = per.join(totals, "vote_id").select("vote_id", "_p", side.alias("party_side"), F.when(F.col("_y") > F.col("_x"), "Y").otherwise("N").alias("winner"),
                                               F.abs(F.col("_y") - F.col("_x")).alias("margin"), (F.col("_y") + F.col("_x")).alias("roll_size"))
    joined = votes.withColumn("_p", F.coalesce("party", F.lit(""))).join(rolls, ["vote_id", "_p"]).drop("_p")
    return joined.withColumn("defect", F.coalesce(F.col("token") != F.col("party_side"), F.lit(False))).withColumn("with_winner", F.col("token") == F.col("winner"))


def defection_rates(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("member").agg(F.count(F.lit(1)).alias("votes"), F.count_if("defect").alias("defections"), F.count_if("with_winner").alias("wins"))


def pivotality(flagged: DataFrame, margin: int) -> DataFrame:
    """Votes on the winning side of close roll calls, and the share of close roll calls among a member's votes."""
    close = F.col("margin") <= margin
    g = flagged.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.count_if(close).alias("close"), F.count_if(close & F.col("with_winner")).alias("pivotal"))
    return g.select("member", "n", "close", "pivotal", K.safe_rate("close", "n").alias("close_share"))


def concentration(rates: DataFrame, tops: tuple[int, ...] = (20, 30)) -> DataFrame:
    """Share of all defections held by the top members. Only the top rows are ever ordered."""
    total = rates.agg(F.sum("defections")).scalar()
    top = scale.global_top_k(rates, [F.desc("defections"), F.col("member")], max(tops))
    shares = top.agg(*[F.sum(F.when(F.col("rank") <= k, F.col("defections"))).alias(f"top_{k}") for k in tops]).withColumn("total", total)
    return shares.select("total", *[F.round(F.col(f"top_{k}") / F.col("total"), 4).alias(f"share_{k}") for k in tops])


def infer_parties(votes: DataFrame, min_votes: int = 200, min_gap: float = 0.10) -> DataFrame:
    """Party each member votes with: agreement with every caucus, own vote excluded.

    Linear in votes: each vote meets one row per party of its roll call.
    """
    counts = party_majorities(votes).select("vote_id", F.col("party").alias("caucus"), "y", "x")
    met = votes.join(counts, "vote_id")
    own = F.when(F.col("party") == F.col("caucus"), 1).otherwise(0)
    agree, total = F.when(F.col("yes"), F.col("y")).otherwise(F.col("x")) - own, F.col("y") + F.col("x") - own
    per = met.groupBy("member", "caucus").agg(F.sum(agree).alias("k"), F.sum(total).alias("n"), F.max("party").alias("known"))
    per = per.filter(F.col("n") >= min_votes).withColumn("rate", F.col("k") / F.col("n"))
    # rates are few per member (one per party): pick best and runner-up by aggregation
    best = per.groupBy("member").agg(F.count(F.lit(1)).alias("caucuses"), F.max("known").alias("known"),
                                     F.max_by(F.struct("caucus", "rate"), F.struct("rate", "caucus")).alias("b"))
    rest = per.join(best.select("member", F.col("b.caucus").alias("_top")), "member").filter(F.col("caucus") != F.col("_top")).groupBy("member").agg(F.max("rate").alias("second"))
    out = best.join(rest, "member").select("member", "known", F.col("b.caucus").alias("inferred"), (F.col("b.rate") - F.col("second")).alias("gap"))
    return out.filter(F.col("gap") >= min_gap)


def inference_holdout(inferred: DataFrame) -> DataFrame:
    """How often the inferred party equals the known one."""
    known = inferred.filter(F.coalesce("known", F.lit("")) != "")
    return known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known") == F.col("inferred")).alias("hits"))


def peer_agreement(votes: DataFrame, groups: DataFrame, min_shared: int = 10, min_side: int = 3, seats: int = 200) -> DataFrame:
    """Mean agreement of each member with the others of their group, over contested roll calls.

    Roll calls are packed 62 to a word, so the member pairs of one group meet once per 62 roll calls and
    are compared with bit operations. Groups are committees or caucuses: their size is a number of seats, at most
    ``seats`` by contract; a larger one is refused, since its pairs would grow with the square of its size.
    """
    largest = groups.groupBy("grp").agg(F.count_distinct("member").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > seats:
        raise ValueError(f"a group of {largest} members exceeds {seats} seats")
    d = votes.select("vote_id", "member", "yes")
    contested = d.groupBy("vote_id").agg(F.count_if("yes").alias("y"), F.count_if(~F.col("yes")).alias("x")).filter((F.col("y") >= min_side) & (F.col("x") >= min_side))
    numbered = scale.row_numbers(contested.select("vote_id"), [], ["vote_id"], "i")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("i") % 62).cast("int"))
    words = (d.join(numbered, "vote_id").groupBy("member", F.floor(F.col("i") / 62).alias("block"))
             .agg(F.coalesce(F.bit_or(F.when(F.col("yes"), bit)), F.lit(0).cast("bigint")).alias("y"),
                  F.coalesce(F.bit_or(F.when(~F.col("yes"), bit)), F.lit(0).cast("bigint")).alias("x")))
    seated = words.join(groups.select("member", "grp"), "member")
    other = seated.select("grp", "block", F.col("member").alias("peer"), F.col("y").alias("py"), F.col("x").alias("px"))
    met = seated.join(other, ["grp", "block"]).filter(F.col("member") != F.col("peer"))
    both = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.col(b)))
    pairs = met.groupBy("grp", "member", "peer").agg(
        F.sum(both("y", "py") + both("x", "px")).alias("same"),
        F.sum(F.bit_count(F.col("y").bitwiseOR(F.col("x")).bitwiseAND(F.col("py").bitwiseOR(F.col("px"))))).alias("shared")).filter(F.col("shared") >= min_shared)
    return pairs.groupBy("grp", "member").agg(F.round(F.avg(F.col("same") / F.col("shared")), 6).alias("agreement"), F.count(F.lit(1)).alias("peers"))


# --- identity ---------------------------------------------------------------------------------------------------
def resolve_identities(names: DataFrame, roster: DataFrame) -> DataFrame:
    """Canonical person for every spelling, accepted only where exactly one candidate remains.

    ``names``: name, chamber. ``roster``: person, name, chamber. Tiers: surname and given name, second token
    of an initial-first name, surname and initial, surname alone, surname within the chamber. An ambiguous
    name stays null. Each tier joins a table with one row per key, so no name can multiply.
    """
    def parts(df):
        return df.withColumn("_t", I.name_tokens("name")).withColumn("_n", F.size("_t")).withColumn(
            "_sur", F.try_element_at("_t", F.lit(-1))).withColumn("_giv", F.try_element_at("_t", F.lit(1)))

    people = parts(roster)
    people = people.select("person", "chamber", "_sur", "_giv", F.substring("_giv", 1, 1).alias("_ini"))

    def unique(keys, out):
        return people.groupBy(*keys).agg(F.count_distinct("person").alias("_c"), F.min("person").alias(out)).filter("_c = 1").drop("_c")

    n = parts(names.select("name", "chamber").distinct())
    several = F.col("_n") >= 2
    n = (n.withColumn("_k1", F.when(several, F.col("_giv")))
         .withColumn("_k2", F.when((F.col("_n") >= 3) & (F.length("_giv") == 1), F.try_element_at("_t", F.lit(2))))
         .withColumn("_k3", F.when(several, F.substring("_giv", 1, 1))))
    by_given = unique(["_sur", "_giv"], "_p")
    n = n.join(by_given.select("_sur", F.col("_giv").alias("_k1"), F.col("_p").alias("p1")), ["_sur", "_k1"], "left")
    n = n.join(by_given.select("_sur", F.col("_giv").alias("_k2"), F.col("_p").alias("p2")), ["_sur", "_k2"], "left")
    n = n.join(unique(["_sur", "_ini"], "p3").withColumnRenamed("_ini", "_k3"), ["_sur", "_k3"], "left")
    n = n.join(unique(["_sur"], "p4"), "_sur", "left").join(unique(["_sur", "chamber"], "p5"), ["_sur", "chamber"], "left")
    tier = F.when(F.col("p1").isNotNull(), "given").when(F.col("p2").isNotNull(), "second").when(F.col("p3").isNotNull(), "initial").when(
        F.col("p4").isNotNull(), "surname").when(F.col("p5").isNotNull(), "chamber").otherwise("unresolved")
    synthetic = F.when(F.col("_sur").isNotNull(), F.concat(F.lit("~"), "_sur", F.lit("|"), F.coalesce("chamber", F.lit("?"))))
    return n.select("name", "chamber", F.coalesce("p1", "p2", "p3", "p4", "p5").alias("person"), tier.alias("tier"), synthetic.alias("stand_in"))


def climb(nodes: DataFrame) -> DataFrame:
    """Value of the nearest ancestor (or self) that has one, at any depth. ``nodes``: id, parent, value.

    Pointer doubling: round r resolves chains of 2^r links, so the rounds grow with the logarithm of the depth. Only
    open rows are rewritten, as a table per round; settled ones are read where an open row points to them. Ends when
    no row is open or their number no longer falls: what is left then runs into a cycle and stays null.
    """
    state = nodes.select("id", F.when(F.col("value").isNull(), F.col("parent")).alias("next"), "value")
    is_open = F.col("value").isNull() & F.col("next").isNotNull()
    settled, open_rows, before = state.filter(~is_open), state.filter(is_open), None
    while True:
        ahead = settled.unionByName(open_rows).select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("value").alias("_value"))
        moved = cut_lineage(open_rows.join(ahead, "next", "left").select("id", F.when(F.col("_value").isNull(), F.col("_next")).alias("next"), F.col("_value").alias("value")))
        settled, open_rows = settled.unionByName(moved.filter(~is_open)), moved.filter(is_open)
        still = open_rows.count()
        if still == 0 or still == before:
            return settled.unionByName(open_rows).select("id", "value")
        before = still


def root_of(nodes: DataFrame) -> DataFrame:
    """Topmost ancestor of each node, a root being its own. ``nodes``: id, parent. Null on a cycle.

    A parent without a row of its own is a root.
    """
    named = nodes.select("id").unionByName(nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("id"))).distinct()
    parents = named.join(nodes.filter("parent IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent")), "id", "left")
    return climb(parents.withColumn("value", F.when(F.col("parent").isNull(), F.col("id")))).withColumnRenamed("value", "root")


def vote_facts(votes: DataFrame, events: DataFrame, org_chambers: DataFrame, roster: DataFrame) -> DataFrame:
    """Votes with their event, the chamber of its organisation and the member's party. Every branch that
    fails to match is kept and named."""
    facts = votes.join(events, "vote_id", "left").join(org_chambers.select(F.col("id").alias("org_id"), F.col("value").alias("venue")), "org_id", "left")
    facts = facts.join(roster.select("member", "party", F.lit(True).alias("_seated")), "member", "left")
    problem = (F.when(F.col("org_id").isNull(), "no_event").when(F.col("venue").isNull(), "no_venue").when(F.col("_seated").isNull(), "no_member").otherwise("matched"))
    return facts.withColumn("match", problem).drop("_seated")


# --- composition ------------------------------------------------------------------------------------------------
def composition(seats: DataFrame, keys: list[str]) -> DataFrame:
    """Seats per party, strict majority and chair. Unknown parties count in the total, never as a side."""
    party = F.when(I.blank("party") == "", "?").otherwise(F.col("party"))
    counts = seats.groupBy(*keys, party.alias("party")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("role") == "Chair", F.col("member"))).alias("chair"))
    known = F.when(F.col("party") != "?", F.struct("n", "party"))
    g = counts.groupBy(*keys).agg(F.sum("n").alias("seats_total"), F.max(known).alias("lead"), F.min("chair").alias("chair"),
                                  F.sort_array(F.collect_list(F.concat_ws(":", "party", "n"))).alias("split"))
    holds = F.col("lead.n") * 2 > F.col("seats_total")
    return g.select(*keys, F.array_join("split", ",").alias("party_split"), F.when(holds, F.col("lead.party")).alias("majority_party"),
                    F.col("lead.n").alias("majority_seats"), "seats_total", "chair")


def composition_breaks(compositions: DataFrame, key: str, session: str) -> DataFrame:
    """Changes of chair or majority between consecutive sessions; null-safe, so absent to absent is no change."""
    w = Window.partitionBy(key).orderBy(session)  # a committee has one row per session
    prev = compositions.withColumn("from_session", F.lag(session).over(w)).withColumn("_pc", F.lag("chair").over(w)).withColumn("_pm", F.lag("majority_party").over(w))
    out = prev.filter("from_session IS NOT NULL").select(
        key, "from_session", F.col(session).alias("to_session"), (~F.col("chair").eqNullSafe(F.col("_pc"))).alias("chair_changed"),
        (~F.col("majority_party").eqNullSafe(F.col("_pm"))).alias("majority_changed"))
    return out.filter("chair_changed OR majority_changed")


def pooling_safety(compositions: DataFrame, breaks: DataFrame, key: str) -> DataFrame:
    """True where no break was found in the scanned sessions."""
    broken = breaks.groupBy(key).agg(F.count(F.lit(1)).alias("breaks"))
    return compositions.select(key).distinct().join(broken, key, "left").na.fill(0, ["breaks"]).withColumn("safe", F.col("breaks") == 0)


# --- behaviour across seasons -----------------------------------------------------------------------------------
def season_scores(flagged: DataFrame, control: DataFrame, min_season: int = 100, min_cohort: int = 8) -> DataFrame:
    """Defection rate of a member's season as a z-score inside chamber, year and standing.

    Population deviation; a small or flat cohort gives no score. Cohort figures come from a second
    aggregation joined back, so no cohort is gathered.
    """
    v = flagged.filter((I.blank("party") != "") & (I.blank("chamber") != "")).join(control, ["year", "chamber"])
    v = v.withColumn("standing", F.when(F.col("party") == F.col("majority"), "maj").otherwise("min"))
    cohort = ["chamber", "year", "standing"]
    season = v.groupBy("member", "party", *cohort).agg(F.count(F.lit(1)).alias("n"), F.count_if("defect").alias("d")).filter(F.col("n") >= min_season)
    # one row per member and season, read twice: written once
    season = cut_lineage(season.withColumn("rate", F.col("d") / F.col("n")))
    stats = season.groupBy(*cohort).agg(F.avg("rate").alias("mu"), F.stddev_pop("rate").alias("sd"), F.count(F.lit(1)).alias("size"))
    stats = stats.filter((F.col("size") >= min_cohort) & (F.col("sd") > 1e-12))
    return season.join(stats, cohort).withColumn("z", (F.col("rate") - F.col("mu")) / F.col("sd"))


def persuadability(seasons: DataFrame, years: tuple[int, ...], min_votes: int = 300) -> DataFrame:
    """Plain mean of season scores and vote-weighted rate per member and position."""
    g = seasons.filter(F.col("year").isin(*years)).groupBy("member", "chamber", "party", "standing").agg(
        F.avg("z").alias("score"), F.sum("d").alias("d"), F.sum("n").alias("votes")).filter(F.col("votes") >= min_votes)
    return g.select("member", "chamber", "party", "standing", F.round("score", 6).alias("score"), F.round(F.col("d") / F.col("votes"), 6).alias("defect_rate"), "votes")


def trait_stability(seasons: DataFrame) -> DataFrame:
    """Correlation of a member's score with their score one year later."""
    yearly = seasons.groupBy("member", "year").agg(F.avg("z").alias("z"))
    nxt = yearly.select("member", (F.col("year") - 1).alias("year"), F.col("z").alias("z_next"))
    return yearly.join(nxt, ["member", "year"]).agg(F.round(F.corr("z", "z_next"), 6).alias("r"), F.count(F.lit(1)).alias("pairs"))


def first_seen(votes: DataFrame, who: str = "member", when: str = "year") -> DataFrame:
    return votes.groupBy(who).agg(F.min(when).alias("first_year"))


def coverage(rows: DataFrame, key: str, code: str, authorized: tuple[str, ...]) -> DataFrame:
    """Sessions that contributed to a figure: span label, unauthorised and unreadable codes. Sessions are few."""
    seen = rows.select(key, I.blank(code).alias("c")).filter("c <> ''").distinct().withColumn("y", I.session_year("c"))
    g = seen.groupBy(key).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("sessions"),
                              F.count_if(~F.col("c").isin(*authorized)).alias("unauthorized"), F.count_if(F.col("y").isNull()).alias("unreadable"),
                              F.count_if(F.col("c").isin(*authorized)).alias("_auth"))
    label = F.when(F.col("lo").isNull(), None).when(F.col("lo") == F.col("hi"), F.format_string("(%d)", "lo")).otherwise(F.format_string("(%d–%d)", "lo", "hi"))
    return g.select(key, "sessions", label.alias("label"), "unauthorized", "unreadable", (F.col("_auth") == len(authorized)).alias("complete"))
