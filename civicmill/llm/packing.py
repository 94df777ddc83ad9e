"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.llm.bpe import encoder, slices
from civicmill.llm.common import ranked
from civicmill.session import cut_lineage

PIECE = "row_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
Plan = list[tuple[tuple[int, ...], int]]  # lengths of a sequence in order, number of such sequences


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Pieces of each text's ids followed by ``end_id``: only longer ones are cut, every ``capacity`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            at = 0
            for texts in slices(batch.column("body")):
                coded = [ids + end for ids in encoder(tokenizer)(texts.to_pylist())]
                size = np.fromiter((len(c) // 4 for c in coded), dtype=np.int64, count=len(coded))
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(coded)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                crc = [zlib.crc32(coded[r][4 * s : 4 * (s + n)]) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                key = batch.column("row_id").slice(at, len(texts)).take(pa.array(row))
                columns = [key, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "piece", "start", "length", "ids_crc32"])
                at += len(texts)

    return docs.select(F.col(row_id).cast("bigint").alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(cut, PIECE)


def plan_sequences(counts: dict[int, int], capacity: int) -> Plan:
    """Which lengths share a sequence, given how many pieces have each length: the best of three plans.

    Each plan fills gaps exactly by single lengths, by pairs too, or by triples too, and places the rest best fit.
    More exact filling uses up small pieces early, which may cost more later than it saves; ties go to more of it.
    Works on one count per length: its work and its result are bounded by ``capacity``, not by the number of pieces.
    """
    plans = [exact_complements(counts, capacity, parts) for parts in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def exact_complements(counts: dict[int, int], capacity: int, most: int) -> Plan:
    """From the longest length down, sequences that up to ``most`` further lengths fill exactly; then best fit.

    The gap above a length is looked up among the lengths at hand, then as the sum of a pair, then of a triple, larger
    parts first; as many sequences are made at once as the counts allow. Pieces that no exact filling takes are placed
    best fit, longest first, all pieces of a length and all gaps of a size together.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    plan: Plan = []

    def take(parts: tuple[int, ...]) -> None:
        need = {p: parts.count(p) for p in parts}
        n = min(left.get(p, 0) // k for p, k in need.items())
        if n:
            plan.append((parts, n))
            for p, k in need.items():
                left[p] -= n * k
                if not left[p]:
                    del left[p]

    def pairs(total: int, largest: int) -> list[tuple[int, int]]:
        """Pairs at hand with the sum ``total``, the larger part first and at most ``largest``."""
        return sorted(((a, total - a) for a in left if total / 2 <= a <= min(total - 1, largest) and total - a in left), reverse=True)

    if capacity in left:
        take((capacity,))
    residual: dict[int, int] = {}
    while left:
        longest = max(left)
        gap = capacity - longest
        if gap in left:
            take((longest, gap))
        if longest in left and most > 1:
            for pair in pairs(gap, longest):
                take((longest, *pair))
                if longest not in left:
                    break
        if longest in left and most > 2:
            for a in sorted((x for x in left if x <= min(gap - 2, longest)), reverse=True):
                for pair in pairs(gap - a, a):
                    take((longest, a, *pair))
                    if longest not in left or a not in left:
                        break
                if longest not in left:
                    break
        if longest in left:
            residual[longest] = left.pop(longest)
    return plan + best_fit(residual, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, on counts: sequences that look alike are kept together and split where needed."""
    open_by_gap: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(parts: tuple[int, ...], n: int, gap: int) -> None:
        if gap not in open_by_gap:
            open_by_gap[gap] = []
            insort(gaps, gap)
        open_by_gap[gap].append([parts, n])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no gap is wide enough: new sequences, each filled with this length as far as it goes
                each = min(n, capacity // length)
                many = n // each
                put((length,) * each, many, capacity - each * length)
                n -= many * each
                continue
            gap = gaps[at]
            group = open_by_gap[gap][-1]
            used = min(n, group[1])
            group[1] -= used
            if not group[1]:
                open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                    gaps.pop(at)
            put((*group[0], length), used, gap - length)
            n -= used
    return [(tuple(parts), n) for groups in open_by_gap.values() for parts, n in groups]


def plan_runs(plan: Plan) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset in the sequence): pieces of a length get ranks from 0."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for parts, n in plan:
        offset = 0
        for p in parts:
            runs.setdefault(p, []).append((used.get(p, 0), sequence, offset))
            used[p] = used.get(p, 0) + n
            offset += p
        sequence += n
    return {p: np.array(r, dtype=np.int64) for p, r in runs.items()}


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text", row_id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Every piece of every text with its sequence_id and offset; no sequence holds more than ``capacity`` ids.

    Lengths are at most ``capacity``, so one count per length describes all pieces; the driver plans on those counts
    (at most ``capacity`` rows, whatever the size of the table). Pieces of a length are interchangeable: each gets
    its exact rank among them, counted over buckets so that a length with a third of all pieces is not gathered, and
    reads its sequence and offset from the plan.

    A null text is empty and gives one piece, the end id alone. Null and repeated ids, and repeated rows, are packed
    as often as they occur. Ties among pieces of a length are broken by a seeded hash, id, piece and checksum. No
    rows give no rows. Other columns are ignored.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer, capacity, end_id, text, row_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(counts) <= capacity
    runs = plan_runs(plan_sequences(counts, capacity))
    mixed = pieces.withColumn("mix", F.xxhash64(F.lit(seed), "row_id", "piece", "ids_crc32"))
    numbered = ranked(mixed, ["length"], F.shiftright("mix", 54), ["mix", "row_id", "piece", "ids_crc32"], "rank", "of_length")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        lengths, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        for one in np.unique(lengths):
            here = np.nonzero(lengths == one)[0]
            table = runs[int(one)]
            row = table[np.searchsorted(table[:, 0], ranks[here], side="right") - 1]
            out[here, 0] = row[:, 1] + ranks[here] - row[:, 0]
            out[here, 1] = row[:, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = numbered.withColumn("p", place("length", "rank"))
    return placed.select("row_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")
