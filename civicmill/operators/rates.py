"""Outcome rates, feature scores and the gates a finding must pass.

Rows carry features as columns and a 0/1 outcome y. All scores are functions of bucket counts, so each job is
one aggregation over the rows and small joins after it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill import scale
from civicmill.functions import classify as K


def n(alias: str = "n") -> Column:
    return F.count(F.lit(1)).alias(alias)


def prior_rates(rows: DataFrame, keys: Sequence[str], outcome: str, minimum: int) -> DataFrame:
    """Rate per key where at least ``minimum`` cases exist."""
    g = rows.groupBy(*keys).agg(F.sum(outcome).cast("bigint").alias("k"), n()).filter(F.col("n") >= minimum)
    return g.withColumn("rate", F.round(F.col("k") / F.col("n"), 6))


def standing_penalty(rows: DataFrame, label: str, minimum: int = 40, thin: int = 15) -> DataFrame:
    """Pass rates of majority and minority per label. Thin pools carry counts and no gap."""
    g = rows.groupBy(label).agg(F.count_if(F.col("standing") == "majority").alias("maj_n"), F.count_if((F.col("standing") == "majority") & (F.col("y") == 1)).alias("maj_k"),
                                F.count_if(F.col("standing") == "minority").alias("min_n"), F.count_if((F.col("standing") == "minority") & (F.col("y") == 1)).alias("min_k"))
    full = (F.col("maj_n") >= minimum) & (F.col("min_n") >= minimum)
    gap = F.when(full, F.round(F.col("maj_k") / F.col("maj_n") - F.col("min_k") / F.col("min_n"), 6))
    return g.withColumn("gap", gap).withColumn("tier", F.when(full, "rate").when((F.col("maj_n") > 0) & (F.col("min_n") >= thin), "directional").otherwise("thin"))


def composition_bias(rows: DataFrame, flag: str, tests: dict[str, Column]) -> DataFrame:
    """Share of each property among flagged and other rows, and the gap."""
    one = rows.agg(*[F.struct(F.avg(F.when(F.col(flag), t.cast("double"))).alias("a"), F.avg(F.when(~F.col(flag), t.cast("double"))).alias("b"), F.lit(name).alias("name")).alias(f"t{i}") for i, (name, t) in enumerate(tests.items())])
    long = one.select(F.explode(F.array(*[f"t{i}" for i in range(len(tests))])).alias("x"))
    a, b = F.coalesce("x.a", F.lit(0.0)), F.coalesce("x.b", F.lit(0.0))
    return long.select(F.col("x.name").alias("property"), F.round(a, 6).alias("labelled"), F.round(b, 6).alias("unlabelled"), F.round(F.abs(a - b), 6).alias("gap"))


def owner_aggregates(rows: DataFrame, owner: str, place: str, subject: str) -> DataFrame:
    """Volume, distinct places and usual place per owner. Distinct pairs first, so a prolific owner combines early."""
    per = rows.groupBy(owner, place).agg(n())
    g = per.groupBy(owner).agg(F.sum("n").alias("volume"), n("places"), F.max_by(place, F.struct("n", F.col(place))).alias("usual_place"))
    subjects = rows.select(owner, subject).distinct().groupBy(owner).agg(n("subjects"))
    return g.join(subjects, owner)


def usual_place(rows: DataFrame, subject: str, place: str, minimum: int = 5) -> DataFrame:
    """Place that handles a subject most often, ties alphabetical, where it has enough cases."""
    per = rows.groupBy(subject, place).agg(n())
    g = per.groupBy(subject).agg(F.sum("n").alias("total"), F.max("n").alias("n")).filter(F.col("total") >= minimum)
    return per.join(g, [subject, "n"]).groupBy(subject, "total").agg(F.min(place).alias("usual"))


def rank_in_owner(rows: DataFrame, owner: str, order: str) -> DataFrame:
    """nth filing of its owner; a hot owner is numbered in buckets."""
    return scale.row_numbers(rows, [owner], [order], "nth")


def late_cutoff(rows: DataFrame, day: str, share: float = 0.90) -> DataFrame:
    """Day at position floor(n * share) of the sorted days. Works on counts per day, of which there are few."""
    days = rows.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(n())
    at = days.agg(F.floor(F.sum("n") * share + 1e-9)).scalar()
    run = scale.running(days, [], ["day"], sums={"upto": F.col("n")})
    return run.filter(F.col("upto") > at).agg(F.min("day").alias("cutoff"))


def same_day_batch(rows: DataFrame, owner: str, day: str) -> DataFrame:
    return rows.groupBy(owner, day).agg(n("batch"))


# --- feature scores ---------------------------------------------------------------------------------------------------
def long_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, bucket, y) of all features at once."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("bucket")) for f in features])
    return rows.select("y", F.explode(pairs).alias("p")).select("p.feature", "p.bucket", "y")


def feature_pairs(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds every unordered pair of features as a crossed feature. The list of names is a constant."""
    out, names = rows, []
    for i, a in enumerate(features):
        for b in features[i + 1:]:
            out = out.withColumn(f"{a}*{b}", F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string")))
            names.append(f"{a}*{b}")
    return out, names


def ladder(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Crossed features of growing depth: the first, the first two, ..."""
    out, names = rows, []
    for d in range(1, len(features) + 1):
        name = f"depth_{d}"
        out = out.withColumn(name, F.concat_ws("|", *[F.col(f).cast("string") for f in features[:d]]))
        names.append(name)
    return out, names


def score_features(train: DataFrame, test: DataFrame, features: Sequence[str], *, minimum: int = 5, corrected: bool = False) -> DataFrame:
    """Error reduction of bucket rates over the base rate, usable buckets, share of unseen test rows.

    ``corrected``: score against the test period's base rate and shift learned rates by the drift. Both samples
    are reduced to counts per (feature, bucket) before they meet.
    """
    count = lambda df, p: long_features(df, features).groupBy("feature", "bucket").agg(n(f"{p}_n"), F.sum("y").cast("bigint").alias(f"{p}_k"))
    base = lambda df: df.agg(F.avg(F.col("y").cast("double"))).scalar()
    tr, te = count(train, "tr"), count(test, "te")
    both = te.join(tr, ["feature", "bucket"], "left").withColumn("train_base", base(train)).withColumn("test_base", base(test))
    seen = F.coalesce(F.col("tr_n") >= minimum, F.lit(False))
    null = F.col("test_base") if corrected else F.col("train_base")
    rate = F.col("tr_k") / F.col("tr_n") + (F.col("test_base") - F.col("train_base") if corrected else F.lit(0.0))
    p = F.when(seen, F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0)) if corrected else rate).otherwise(null)
    miss = lambda q: F.col("te_k") * (1 - q) + (F.col("te_n") - F.col("te_k")) * q
    # usable buckets of the training sample are counted there: a bucket may be absent from the test sample
    usable = tr.filter(F.col("tr_n") >= minimum).groupBy("feature").agg(n("buckets"))
    g = both.groupBy("feature").agg(F.sum(miss(p)).alias("err"), F.sum(miss(null)).alias("err0"), F.sum("te_n").alias("tests"), F.sum(F.when(~seen, F.col("te_n")).otherwise(0)).alias("unseen"))
    g = g.join(usable, "feature", "left").na.fill(0, ["buckets"])
    return g.select("feature", F.round((F.col("err0") - F.col("err")) / F.col("err0") * 100, 4).alias("gain_pct"), "buckets", F.round(F.col("unseen") / F.col("tests"), 6).alias("unseen_share"),
                    F.round(F.col("err") / F.col("tests"), 6).alias("mae"))


def temporal_split(rows: DataFrame, period: str, order: str, share: float = 0.5) -> DataFrame:
    """First filed part of each period learns, the rest tests. Cut by the exact position in the period."""
    numbered = scale.row_numbers(rows, [period], [order], "_i")
    size = rows.groupBy(period).agg(n("_n"))
    return numbered.join(size, period).withColumn("learn", F.col("_i") <= F.col("_n") * share).drop("_i", "_n")


def group_persistence(rows: DataFrame, group: str, period: str, first, second, minimum: int = 5) -> DataFrame:
    """Correlation of group rates between two periods and the number of groups."""
    g = rows.groupBy(group).agg(*[F.struct(F.count_if(F.col(period) == p).alias("n"), F.avg(F.when(F.col(period) == p, F.col("y").cast("double"))).alias("r")).alias(a) for p, a in ((first, "a"), (second, "b"))])
    ok = g.filter((F.col("a.n") >= minimum) & (F.col("b.n") >= minimum))
    return ok.agg(F.round(F.corr("a.r", "b.r"), 6).alias("r"), n("groups"))


# --- gates ---------------------------------------------------------------------------------------------------------------
def finding_gate(rows: DataFrame, pool: str, key: str, *, minimum: int = 25, minority: int = 30, separation: float = 0.90, selection: float = 0.10) -> DataFrame:
    """Mechanical warnings per pool: thin class, too few buckets, suspicious separation, selected pool."""
    b = rows.groupBy(pool, key).agg(F.sum("y").cast("bigint").alias("_hits"), n("_cases"))
    usable = F.col("_cases") >= minimum
    rate = F.when(usable, F.col("_hits") / F.col("_cases"))
    g = b.groupBy(pool).agg(F.sum("_hits").alias("pos"), F.sum("_cases").alias("rows"), F.count_if(usable).alias("buckets"), F.max(rate).alias("hi"), F.min(rate).alias("lo"))
    parent = rows.agg(F.avg(F.col("y").cast("double"))).scalar()
    g = g.withColumn("parent", parent).withColumn("spread", F.when(F.col("buckets") >= 2, F.col("hi") - F.col("lo")).otherwise(0.0))
    warn = F.array_compact(F.array(
        F.when(F.least(F.col("pos"), F.col("rows") - F.col("pos")) < minority, "UNDERPOWERED"), F.when(F.col("buckets") < 2, "NOT_COMPARABLE"),
        F.when((F.col("buckets") >= 2) & (F.col("spread") >= separation), "SUSPICIOUS_SEPARATION"),
        F.when((F.col("buckets") >= 2) & (F.abs(F.col("pos") / F.col("rows") - F.col("parent")) >= selection), "SELECTED_POOL")))
    return g.select(pool, "rows", "pos", "buckets", F.round("spread", 6).alias("spread"), F.array_join(warn, ",").alias("warnings"))


def permutation_null(rows: DataFrame, pool: str, key: str, *, minimum: int = 25, rounds: int = 200, seed: int = 17) -> DataFrame:
    """Share of outcome shuffles whose spread of bucket rates reaches the observed one, per pool.

    Shuffling outcomes only matters through how many positives land in each bucket, and those counts follow a
    multivariate hypergeometric law given bucket sizes. So rows are reduced to bucket counts and the law is drawn
    from; no row is copied per round. A task holds one pool's bucket counts (the feature's vocabulary).
    """
    b = rows.groupBy(pool, key).agg(F.sum("y").cast("bigint").alias("_hits"), n("_cases"))
    usable = F.col("_cases") >= minimum
    # buckets too small to state a rate only matter as one remainder
    rest = F.when(usable, F.col(key).cast("string")).otherwise(F.lit(None))
    small = b.groupBy(pool, rest.alias("bucket")).agg(F.sum("_hits").alias("_hits"), F.sum("_cases").alias("_cases"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", na_position="last")
        sizes, hits = pdf["_cases"].to_numpy(), pdf["_hits"].to_numpy()
        ok = pdf["bucket"].notna().to_numpy()
        observed = np.ptp(hits[ok] / sizes[ok]) if ok.sum() >= 2 else 0.0
        beat = rounds
        if ok.sum() >= 2:
            got = np.random.default_rng(seed).multivariate_hypergeometric(sizes, int(hits.sum()), size=rounds, method="marginals")
            rates = got[:, ok] / sizes[ok]
            beat = int(((rates.max(axis=1) - rates.min(axis=1)) >= observed - 1e-12).sum())
        return pd.DataFrame({pool: [pdf[pool].iloc[0]], "spread": [float(round(observed, 6))], "p": [beat / rounds]})

    kind = rows.schema[pool].dataType.simpleString()
    out = small.groupBy(pool).applyInPandas(draw, f"`{pool}` {kind}, spread double, p double")
    return out.withColumn("fails", F.col("p") > 0.05)


def base_drift(train: DataFrame, test: DataFrame, limit: float = 0.05) -> DataFrame:
    mean = F.avg(F.col("y").cast("double"))
    j = train.agg(mean.alias("before")).withColumn("after", test.agg(mean).scalar())
    return j.select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), (F.abs(F.col("before") - F.col("after")) >= limit).alias("drifted"))


def survived(df: DataFrame) -> DataFrame:
    return df.withColumn("y", K.survived_committee("last_actid"))
