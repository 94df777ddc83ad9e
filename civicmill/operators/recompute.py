"""Results of a new state from the last published ones: only keys whose rows or shared inputs changed are computed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.session import cut_lineage
from civicmill.sources.store import PART, Snapshot, Store, hash_part

RESULTS, DIGESTS = "results", "digests"


@dataclass(frozen=True)
class Run:
    version: int | None  # None: nothing changed, the last version stands
    full: str  # why all keys were computed; empty if they were not
    changed: int  # keys computed or gone
    parts: list[str]  # parts written


def key_digests(rows: DataFrame, key: str, content: Sequence[str], shared: DataFrame | None = None) -> DataFrame:
    """(key, rows, digest) over a key's rows and over the rows of ``shared`` with that key, in any order.

    Sums of the halves of two independent 64-bit hashes of each row: they combine before the only shuffle. A digest is the
    128-bit hash of the sums, in 24 letters. Where rows differ inside a key is what ``merkle`` tells.
    """

    def summed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        told = [x for c in columns for x in (F.col(c), F.col(c).isNull())]  # a hash passes over nulls
        hashed = df.select(key, *[F.xxhash64(F.lit(seed), *told).alias(f"_h{seed}") for seed in (1, 2)])
        halves = [half for h in ("_h1", "_h2") for half in (F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)))]
        sums = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(half).alias(f"_{i}") for i, half in enumerate(halves)])
        told = F.concat_ws("-", *[F.col(c).cast("string") for c in ("rows", "_0", "_1", "_2", "_3")])
        return sums.select(key, "rows", F.base64(F.unhex(F.md5(told))).alias("digest"))

    own = summed(rows, content)
    if shared is None:
        return own
    theirs = summed(shared, [c for c in shared.columns if c != key]).select(F.col(key).alias("_k"), F.col("digest").alias("_d"))
    both = own.join(theirs, F.col(key).eqNullSafe(F.col("_k")), "left")
    return both.select(key, "rows", F.concat_ws("/", "digest", "_d").alias("digest"))


def must_compute_all(store: Store, at: Snapshot | None, signature: str, full_every: int) -> str:
    """Why the stored results may not be reused; empty if they may. Whatever cannot be told counts as a reason."""
    if at is None:
        return "first run"
    if at.notes.get("signature") != signature:
        return "signature"
    if int(at.notes.get("reused", 0)) + 1 >= full_every:
        return "scheduled"
    try:
        for table in (RESULTS, DIGESTS):
            if store.read(table, at=at).count() != sum(p["zone"]["rows"] for p in at.parts(table).values()):
                return f"{table} damaged"
    except (PySparkException, Py4JError, KeyError):  # a lost file, an unknown layout
        return "unreadable"
    return ""


def recompute(
    store: Store,
    rows: DataFrame,
    key: str,
    content: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
    *,
    shared: DataFrame | None = None,
    signature: str = "",
    full_every: int = 8,
    buckets: int = 256,
) -> Run:
    """Publishes ``compute(rows)`` as the store's next version and says what it took; read it with ``store.read(RESULTS)``.

    ``compute`` must give each key's results from that key's rows (and from ``shared``, inputs by key) alone, with the
    column ``key``. The last version's digests, one a key, are read from the store; keys whose digest of ``content`` and
    shared inputs is new, different or gone are the changed ones. Only their rows are computed, only the hash parts that
    hold them are rewritten, with the unchanged keys' results carried over, and one commit publishes results and digests
    together. A run that ends before it leaves the last version. Everything is computed anew on the first run, if
    ``signature`` (of the code, or of inputs that every key shares) changed, if a stored table is damaged, and on every
    ``full_every``-th run, so that an input missing from ``content`` cannot stay wrong for long.

    Null keys are one key. No rows are a state too: every key is gone.
    """
    at = store.snapshot()
    why = must_compute_all(store, at, signature, full_every)
    many = buckets if at is None else int(at.notes.get("buckets", buckets))
    placed = lambda df: df.withColumn(PART, hash_part([key], many))
    now = placed(key_digests(rows, key, content, shared))
    if why:
        version = store.commit({RESULTS: placed(compute(rows)), DIGESTS: now}, None, based_on=at, notes={"buckets": many, "signature": signature, "reused": 0})
        written = store.snapshot(version).parts(DIGESTS)
        return Run(version, why, sum(p["zone"]["rows"] for p in written.values()), sorted(written))
    held = store.read(DIGESTS, at=at).select(F.col(key).alias("_k"), F.col("digest").alias("_d"), F.col(PART).alias("_p"))
    both = now.join(held, F.col(key).eqNullSafe(F.col("_k")) & (F.col(PART) == F.col("_p")), "full")
    differ = both.filter(~F.col("digest").eqNullSafe(F.col("_d")))
    gone = F.col("digest").isNull()
    changed = cut_lineage(differ.select(F.when(gone, F.col("_k")).otherwise(F.col(key)).alias(key), "rows", "digest", F.coalesce(PART, "_p").alias(PART), gone.alias("_gone")))
    touched = [r[0] for r in changed.select(PART).distinct().collect()]  # at most one a bucket
    if not touched:
        return Run(None, "", 0, [])
    names = changed.select(F.col(key).alias("_k"))
    without = lambda df: df.join(names, F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    fresh = placed(compute(rows.join(names, F.col(key).eqNullSafe(F.col("_k")), "left_semi")))
    results = fresh.unionByName(without(store.read(RESULTS, touched, at)))
    digests = changed.filter(~F.col("_gone")).drop("_gone").unionByName(without(store.read(DIGESTS, touched, at)))
    notes = {"buckets": many, "signature": signature, "reused": int(at.notes.get("reused", 0)) + 1}
    version = store.commit({RESULTS: results, DIGESTS: digests}, touched, based_on=at, notes=notes)
    return Run(version, "", changed.count(), sorted(touched))
