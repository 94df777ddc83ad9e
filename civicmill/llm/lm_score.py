"""Language-model scores by a probabilistic suffix tree over words, kept as Spark tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import gathered
from civicmill.session import cut_lineage

MIN_CONTEXT = 50  # least occurrences of a context, whatever the size of the corpus
MIN_COUNT = 8  # least occurrences of a next symbol that stands for itself; the others of a context are one event
SMOOTHING = 50.0  # pseudo-counts, dealt as the shorter context deals them
LOCAL_WORDS = 300_000  # most frequent words, coded by their rank; any other word by its hash
LOCAL_ENTRIES = 1_000_000  # most frequent entries of the tree that tasks look up themselves; all others by a join
FILTER_WORDS = 1 << 20  # of 64 bits: size of the filters before a shuffle; what they let through meets the exact join
END = 0  # the end of a text, which also precedes each text
ROOT = 0  # the node without context
HASHED = 1 << 62  # codes from here on are hashes
WORDS_AT_ONCE = 200_000
CACHED_WORDS = 1_000_000
SYMBOLS_AT_ONCE = 3_000_000
STEP, LEVEL, PAIR = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))  # odd


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space; bytes change no other letter and know no other space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held_out(row_id: Column) -> Column:
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column ``body``. Each task counts before it hands on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > WORDS_AT_ONCE:
                    yield out()
        yield out()

    return texts.select("body").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def hashed(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word, seed=42) & (HASHED - 1)) | HASHED


def encoded(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Rows with ``ids``, the symbols of ``body`` and END last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others: dict[bytes, int] = {}

        def other(word: bytes) -> int:
            found = others.get(word)
            if found is None:
                if len(others) > CACHED_WORDS:
                    others.clear()
                found = others[word] = hashed(word)
            return found

        def codes(words: list[bytes]) -> list[int]:
            found = list(map(ranks.get, words))
            return [other(w) if c is None else c for w, c in zip(words, found, strict=True)] if None in found else found

        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                coded = []
                for text in batch.column("body"):
                    coded.append(np.array([*codes(words_of(text.as_py())), END], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(coded, pa.list_(pa.int64()))], ["doc_id", "held_out", "ids"])

    return docs.mapInArrow(encode, "doc_id bigint, held_out boolean, ids array<bigint>")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(symbols: np.ndarray) -> np.ndarray:
    return mix(symbols.astype(np.uint64) + np.uint64(1))


def power(exponent: int) -> np.uint64:
    return np.uint64(pow(int(STEP), exponent, 1 << 64))


def level(length: int) -> np.uint64:
    return np.uint64(int(LEVEL) * length % (1 << 64))


END_CODE = spread(np.array([END]))[0]


def one_longer(node: np.ndarray, codes: np.ndarray, place: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The nodes of the ``length`` symbols before the places ``at``, from those of one symbol less (of none: ROOT).

    A node is the polynomial of its symbols' ``codes``, newest first, and the level's number. END stands before a text.
    """
    before = codes[np.maximum(at - length, 0)]
    before[place[at] < length] = END_CODE
    return node + LEVEL + before * power(length - 1)


def coded_pairs(node: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return mix(node * PAIR + codes)


def pair_keys(node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return coded_pairs(node, spread(symbol))


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of a batch, for each its place in its text, and the texts' lengths."""
    lists = batch.column("ids")
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """Fewer rows at once: the arrays made of a batch's symbols are many times the batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.astype(np.uint64).view(np.int64))


def mapped(df: DataFrame, schema: str, make: Callable[..., list[np.ndarray]]) -> DataFrame:
    """Columns made from all columns of ``df`` as arrays, batch by batch."""
    names = [part.split()[0] for part in schema.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([signed(m) if m.dtype == np.uint64 else pa.array(m) for m in made], names)

    return df.mapInArrow(step, schema)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Two bits a key in a table of fixed size: no key is missed, and others seldom pass while there are few keys a bit.
    ``keys`` has one column of well spread numbers."""
    key = keys.columns[0]
    bits = keys.select(F.explode(F.array(
        F.struct(F.shiftrightunsigned(key, 44).cast("int").alias("at"), (F.shiftrightunsigned(key, 38) % 64).cast("int").alias("bit")),
        F.struct((F.col(key).bitwiseAND(FILTER_WORDS - 1)).cast("int").alias("at"), (F.shiftrightunsigned(key, 20) % 64).cast("int").alias("bit")),
    )).alias("b"))
    rows = gathered(bits.groupBy("b.at").agg(F.bit_or(F.expr("shiftleft(1L, b.bit)")).alias("mask")))  # at most FILTER_WORDS
    table = np.zeros(FILTER_WORDS, dtype=np.uint64)
    table[rows["at"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return table


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, six, last = np.uint64(1), np.uint64(63), np.uint64(FILTER_WORDS - 1)
    first = table[(keys >> np.uint64(44)).astype(np.int64)] >> ((keys >> np.uint64(38)) & six) & one
    second = table[(keys & last).astype(np.int64)] >> ((keys >> np.uint64(20)) & six) & one
    return (first & second).astype(bool)


class Lookup:
    """Places of 64-bit numbers in a sorted table, by the few rows that share their first bits."""

    def __init__(self, table: np.ndarray):
        bits = len(table).bit_length() + 2
        self.table, self.shift = table, np.uint64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, dtype=np.int32)
        np.cumsum(np.bincount((table >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether each holds the wanted number."""
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        found = np.zeros(len(wanted), dtype=bool)
        left = np.nonzero(at < end)[0]
        while len(left):
            hit = self.table[at[left]] == wanted[left]
            found[left[hit]] = True
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return at, found


def transitions(coded: DataFrame, candidates: DataFrame, pairs: DataFrame, length: int) -> DataFrame:
    """(node, symbol, n): how often each symbol follows each candidate context, where it is listed after its suffix.

    Filters of fixed size keep most other places out of the shuffle; candidates are met exactly later on, and a symbol
    that is rare after the suffix is rarer here.
    """
    near = bit_filter(candidates.select("node"))
    listed = bit_filter(mapped(pairs.select("node", "symbol"), "key bigint", lambda node, symbol: [pair_keys(node.view(np.uint64), symbol)]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            node, symbol = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.lexsort((symbol, node))
            node, symbol = node[order], symbol[order]
            first = np.nonzero(np.append(True, (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])))[0]
            n = np.diff(np.append(first, len(node)))
            return pa.RecordBatch.from_arrays([signed(node[first]), pa.array(symbol[first]), pa.array(n)], ["node", "symbol", "n"])

        for batch in slices(batches):
            ids, place, _ = flat(batch)
            codes, every = spread(ids), np.arange(len(ids))
            parent = node = np.full(len(ids), ROOT, dtype=np.uint64)
            for symbols in range(1, length + 1):
                parent, node = node, one_longer(node, codes, place, every, symbols)
            at = np.nonzero(passes(near, node))[0]
            at = at[passes(listed, coded_pairs(parent[at], codes[at]))]
            held.append((node[at], ids[at]))
            size += len(at)
            if size > SYMBOLS_AT_ONCE:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    counted = coded.filter("not held_out").select("ids").mapInArrow(count, "node bigint, symbol bigint, n bigint")
    return counted.groupBy("node", "symbol").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def grow(coded: DataFrame, candidates: DataFrame, pairs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retained nodes (node, total, back_off) and their listed symbols (node, symbol, n, p, gain) among the candidates of
    ``length`` symbols (node, parent, oldest, total), and the candidates of one symbol more.

    The symbols of at least ``MIN_COUNT`` occurrences stand for themselves and all others are one event. A context is
    retained if these events diverge from what its suffix predicts by more than chance would have it: twice the count
    times the divergence is about chi-squared under the suffix's distribution. A listed symbol is listed after the
    suffix too, so ``pairs`` of the level before hold what the suffix predicts.
    """
    counts = transitions(coded, candidates, pairs, length).join(candidates, "node")
    before = pairs.select(F.col("node").alias("parent"), "symbol", F.col("p").alias("q"))
    found = cut_lineage(counts.join(before, ["parent", "symbol"]))
    share = F.col("n") / F.col("total")
    smooth = (F.col("n") + SMOOTHING * F.col("q")) / (F.col("total") + SMOOTHING)
    sums = found.groupBy("node").agg(
        F.first("total").alias("total"),
        F.count(F.lit(1)).alias("many"),
        F.sum(share * F.log(share / F.col("q"))).alias("each"),
        F.greatest(1 - F.sum(share), F.lit(0.0)).alias("rest"),
        F.greatest(1 - F.sum("q"), F.lit(1e-12)).alias("rest_before"),
        F.greatest(1 - F.sum(smooth), F.lit(1e-12)).alias("left"),
    )
    divergence = F.col("each") + F.when(F.col("rest") > 0, F.col("rest") * F.log(F.col("rest") / F.col("rest_before"))).otherwise(0.0)
    nodes = sums.filter(2 * F.col("total") * divergence > F.col("many") + 3 * F.sqrt(2 * F.col("many")) + 10)
    nodes = cut_lineage(nodes.select("node", "total", F.log10(F.col("left") / F.col("rest_before")).alias("back_off")))
    kept = found.join(nodes.select("node", "back_off"), "node")
    kept = cut_lineage(kept.select("node", "symbol", "n", smooth.alias("p"), (F.log10(smooth / F.col("q")) - F.col("back_off")).alias("gain")))

    def longer(node: np.ndarray, oldest: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        raw = (node.view(np.uint64) - level(length)) * STEP + spread(symbol)
        return [raw + level(length + 1), raw - spread(oldest) * power(length) + level(length), oldest, n]

    more = found.filter((F.col("n") >= MIN_CONTEXT) & (F.col("symbol") != END)).select("node", "oldest", "symbol", "n")
    more = mapped(more, "node bigint, parent bigint, oldest bigint, total bigint", longer)
    return nodes, kept, cut_lineage(more.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi"))


def suffix_tree(coded: DataFrame, words: DataFrame) -> tuple[DataFrame | None, int]:
    """The tree's entries (key, n, value), and its depth. ``words`` are the listed symbols of the root (symbol, n, p).

    The sum of the values of a token's retained contexts (``back_off``) and of its places in their lists (``gain``) is
    what the longest retained suffix adds to the token's log10 probability without context.
    """

    def first(symbol: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        return [spread(symbol) + level(1), np.full(len(symbol), ROOT, dtype=np.uint64), symbol, n]

    candidates = mapped(words.filter(F.col("n") >= MIN_CONTEXT).select("symbol", "n"), "node bigint, parent bigint, oldest bigint, total bigint", first)
    candidates = cut_lineage(candidates)
    pairs = words.select(F.lit(ROOT).cast("bigint").alias("node"), "symbol", "p")
    entries, depth = None, 0
    while candidates.count():
        nodes, pairs, candidates = grow(coded, candidates, pairs, depth + 1)
        keyed = mapped(pairs.select("node", "symbol", "n", "gain"), "key bigint, n bigint, value double", lambda node, symbol, n, gain: [pair_keys(node.view(np.uint64), symbol), n, gain])
        keyed = keyed.unionByName(nodes.select(F.col("node").alias("key"), F.col("total").alias("n"), F.col("back_off").alias("value")))
        entries = keyed if entries is None else entries.unionByName(keyed)
        depth += 1
    return entries, depth


def score_documents(docs: DataFrame, held_out: Column | None = None, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows that are not ``held_out`` (as the query's contract says, unless given). A context is retained
    if it occurs at least ``MIN_CONTEXT`` times, its suffix is retained, the context without its newest word was a
    candidate, and a divergence test tells its next-symbol distribution from its suffix's. All counts are fixed numbers,
    so the tree grows with the corpus, and its depth ends where no context passes. Distributions are smoothed by the
    shorter context's; each token is scored after its longest retained suffix.

    The tree is a table keyed by 64-bit hashes of contexts. Texts meet it in one join, after tasks have looked up its
    ``LOCAL_ENTRIES`` most frequent entries and its ``LOCAL_WORDS`` most frequent words; results do not depend on either.

    Null and blank texts are one token, the end. A null id counts as the empty text, so it is trained on. Repeated
    rows and ids stay rows of their own and count as often. Without training rows all scores are those of one unseen
    event a token. Other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.col(row_id)
    rows = docs.select(key.cast("bigint").alias("doc_id"), (is_held_out(key) if held_out is None else held_out).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    counts = cut_lineage(word_counts(rows.filter("not held_out")))
    n_words, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = rows.filter("not held_out").count()
    total, types = n_words + n_docs, n_types + (n_docs > 0)
    top = gathered(counts.orderBy(F.desc("n"), "word").limit(LOCAL_WORDS + 1))
    floor = int(top["n"].iloc[-1]) if len(top) > LOCAL_WORDS else 0  # words of this count or less are known by hash
    top = top[top["n"] > floor]
    ranks = {bytes(w): i for i, w in enumerate(top["word"], 1)}
    known = np.array([n_docs, *top["n"]], dtype=np.int64)
    coded = cut_lineage(encoded(rows, ranks).withColumn("uid", F.monotonically_increasing_id()))  # fixed once written
    del ranks

    unit = float(total + types + 1)  # add one: N + 1 * (V + 1), the root of the tree as the base
    symbol = F.xxhash64("word").bitwiseAND(HASHED - 1).bitwiseOR(HASHED).alias("symbol")
    rare = counts.filter(F.col("n") <= floor).select(symbol, "n").groupBy("symbol").agg(F.sum("n").alias("n"))
    frequent = spark.createDataFrame(pa.table({"symbol": np.arange(len(known)), "n": known}))
    words = rare.unionByName(frequent).filter(F.col("n") >= MIN_COUNT).select("symbol", "n", ((F.col("n") + 1) / unit).alias("p"))
    entries, depth = suffix_tree(coded, cut_lineage(words))

    def word_entries(symbol: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        return [pair_keys(np.full(len(n), ROOT, dtype=np.uint64), symbol), np.log10(n + 1.0), np.zeros(len(n)), np.ones(len(n), dtype=np.int64)]

    model = mapped(rare, "key bigint, base double, value double, known bigint", word_entries)
    local_keys, local_values, far = np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(FILTER_WORDS, dtype=np.uint64)
    if entries is not None:
        entries = cut_lineage(entries)
        local = gathered(entries.orderBy(F.desc("n"), "key").limit(LOCAL_ENTRIES).select("key", "value"))
        local_keys = local["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(local_keys)
        local_keys, local_values = local_keys[order], local["value"].to_numpy(np.float64)[order]
        if len(local) == LOCAL_ENTRIES:  # only then are there others; entries of the local ones are never asked for
            far = bit_filter(entries.select("key"))
            model = model.unionByName(entries.select("key", F.lit(0.0).alias("base"), "value", F.lit(0).cast("bigint").alias("known")))
    word_base = np.log10(known + 1.0)
    word_known = (known > 0).astype(np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local_place = Lookup(local_keys)
        for batch in slices(batches):
            ids, place, lengths = flat(batch)
            codes = spread(ids)
            row = np.repeat(np.arange(len(lengths)), lengths)
            near = ids < HASHED
            rank = np.where(near, ids, 0)
            base, words_known, gains = np.where(near, word_base[rank], 0.0), np.where(near, word_known[rank], 0), np.zeros(len(ids))
            others = [(row[~near], coded_pairs(np.full(int((~near).sum()), ROOT, dtype=np.uint64), codes[~near]))]

            def meet(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
                """Adds the values of the local keys, puts the others aside, and says which may be known at all."""
                found_at, found = local_place(keys)
                gains[at[found]] += local_values[found_at[found]]
                maybe = np.zeros(len(keys), dtype=bool)
                maybe[~found] = passes(far, keys[~found])
                others.append((row[at[maybe]], keys[maybe]))
                return found | maybe

            live = np.arange(len(ids))  # a tree: a context is retained only below its own suffix
            node = np.full(len(ids), ROOT, dtype=np.uint64)
            for length in range(1, depth + 1):
                node = one_longer(node, codes, place, live, length)
                known_node = meet(node, live)
                node, live = node[known_node], live[known_node]
                meet(coded_pairs(node, codes[live]), live)
            where, keys = (np.concatenate([o[i] for o in others]) for i in (0, 1))
            order = np.lexsort((keys, where))
            where, keys = where[order], keys[order]
            first = np.nonzero(np.append(np.ones(min(len(keys), 1), dtype=bool), (where[1:] != where[:-1]) | (keys[1:] != keys[:-1])))[0]
            many = np.diff(np.append(first, len(keys)))
            ends = np.searchsorted(where[first], np.arange(len(lengths) + 1)).astype(np.int32)
            wanted = pa.StructArray.from_arrays([signed(keys[first]), pa.array(many.astype(np.int64))], ["key", "c"])
            cuts = np.cumsum(lengths) - lengths
            added = [np.add.reduceat(x, cuts) if len(x) else x for x in (base, gains, words_known)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "doc_id", "held_out")), pa.array(lengths), *(pa.array(a) for a in added), pa.ListArray.from_arrays(pa.array(ends), wanted)],
                ["uid", "doc_id", "held_out", "n_tokens", "near_base", "near_gain", "near_known", "wanted"],
            )

    schema = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, near_base double, near_gain double, near_known bigint, wanted array<struct<key:bigint,c:bigint>>"
    scored = cut_lineage(coded.mapInArrow(score, schema))
    met = scored.select("uid", F.explode("wanted").alias("w")).select("uid", "w.key", "w.c").join(model, "key")
    met = met.groupBy("uid").agg(*[F.sum(F.col("c") * F.col(x)).alias(f"far_{y}") for x, y in (("base", "base"), ("value", "gain"), ("known", "known"))])
    joined = scored.drop("wanted").join(met, "uid", "left").fillna({"far_base": 0.0, "far_gain": 0.0, "far_known": 0})
    base = F.col("near_base") + F.col("far_base") - F.col("n_tokens") * float(np.log10(unit))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("near_known") + F.col("far_known")).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("near_gain") + F.col("far_gain")).alias("score"),
    )
