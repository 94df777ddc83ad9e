"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS_AT_ONCE, BYTES_AT_ONCE = 512, 4_000_000  # of a batch, whose new pieces are merged together
PIECES_KEPT = 250_000  # pieces of a generation whose ids a worker remembers
TOGETHER = 256  # pieces of at most so many symbols are merged side by side, longer ones each in a tree of its own
CELLS = 1 << 18  # symbols of the pieces merged side by side
NONE = np.int32(2**31 - 1)  # no mergeable pair: above every rank
# The split pattern of the vocabulary with word ends, and what it means for Latin-1 letters in lower case.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, SPACE = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Pairs with their ranks, bytes with their ids, and how a text is cut, read from a file of the tokenizers library.

    Byte-level BPE, with or without a suffix for word ends. Anything whose effect is not built here raises.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        unlike = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        special = [t for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        decoder = (spec["decoder"] or {}).get("type")
        if model["type"] != "BPE" or unlike or special or decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path}: not a byte-level BPE without options ({unlike}, {special}, {decoder})")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([ids[c] for c in letters], dtype=np.int32)
        self.last = np.array([ids[c + end] for c in letters], dtype=np.int32)  # the id of a piece's last byte
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.special_ids = {t: np.array([i], dtype="<i4").tobytes() for t, i in added.items()}
        self.size = max([*ids.values(), *added.values()]) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([ids[m[i]] for m in merges], dtype=np.int64) for i in (0, 1))
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = np.append(key[order], np.int64(2**62)), np.append(order.astype(np.int32), NONE)
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.cutter = tokenizer.normalizer, tokenizer.pre_tokenizer
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.latin = end != "" and steps[0].get("pattern") == {"Regex": WORD_SPLIT}
        token = {i: t for t, i in ids.items()} | {i: t for t, i in added.items()}
        self.token = pa.array([token.get(i, "") for i in range(self.size)])
        self.decoder = decoder

    @cached_property
    def rank(self) -> dict[int, int]:
        """Ranks by pair, for a tree of its own; few texts need one."""
        return dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist(), strict=True))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def pieces(self, text: str) -> list[str] | list[bytes]:
        """A text without special tokens, normalised and cut: pairs are merged inside a piece only."""
        if self.latin and is_latin(text):
            return LATIN_SPLIT.findall(text.lower())
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.cutter.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special tokens, and the special tokens, in order."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield text[at : found.start()], False
            yield found.group(), True
            at = found.end()
        yield text[at:], False


def is_latin(text: str) -> bool:
    """Latin-1 only: composition and lower case then change each character by itself, as the vocabulary does."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def merge_side_by_side(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """Ids of pieces of at most ``width`` bytes, a power of two: one segment tree a piece, all trees in one array.

    Leaf i holds the rank of the pair that starts at symbol i, times ``width``, plus i; a node holds the least of its
    two children, so the root is the leftmost pair of the lowest rank. A merge changes three leaves: the merged pair's
    own, that of the symbol taken in, and that of the symbol before; only their paths to the root are computed anew.
    """
    n = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    cell = row * width + col
    ids = np.zeros(len(n) * width, dtype=np.int32)
    ids[cell] = vocabulary.first[flat]
    ids[np.arange(len(n)) * width + n - 1] = vocabulary.last[flat[np.cumsum(n) - 1]]
    alive = np.zeros(len(ids), dtype=bool)
    alive[cell] = True
    place = np.tile(np.arange(width, dtype=np.int32), len(n))
    after, before = place + 1, place - 1  # neighbours still alive; ``length`` and -1 stand for none
    length = n.astype(np.int32)
    tree = np.full((len(n), 2 * width), NONE, dtype=np.int32)
    pair = col < np.repeat(n, n) - 1
    rank = vocabulary.pair_ranks(ids[cell[pair]], ids[cell[pair] + 1])
    tree[row[pair], width + col[pair]] = np.where(rank < NONE, rank * width + col[pair], NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    tree = tree.reshape(-1)
    live = np.nonzero(tree[1 :: 2 * width] < NONE)[0]
    while len(live):
        base, root = live * width, 2 * width * live
        best = tree[root + 1]
        i = best % width
        j = after[base + i]
        k = after[base + j]  # of symbols i and j, the second goes; k follows it
        h = before[base + i]
        new = vocabulary.merged[best // width]
        ids[base + i] = new
        alive[base + j] = False
        after[base + i] = k
        follows, leads = k < length[live], h >= 0
        before[(base + k)[follows]] = i[follows]
        tree[root + width + j] = NONE
        tree[root + width + i] = NONE
        rank = vocabulary.pair_ranks(new[follows], ids[(base + k)[follows]])
        tree[(root + width + i)[follows]] = np.where(rank < NONE, rank * width + i[follows], NONE)
        rank = vocabulary.pair_ranks(ids[(base + h)[leads]], new[leads])
        tree[(root + width + h)[leads]] = np.where(rank < NONE, rank * width + h[leads], NONE)
        for leaf in (i, j, np.where(leads, h, i)):
            node = (leaf + width) >> 1
            while node[0]:
                tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])
                node = node >> 1
        live = live[tree[root + 1] < NONE]
    kept = ids[alive].astype("<i4").tobytes()
    ends = (4 * np.cumsum(alive.reshape(len(n), width).sum(axis=1))).tolist()
    return [kept[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_alone(vocabulary: Vocabulary, piece: bytes) -> bytes:
    """Ids of one piece of any length by one segment tree: a merge costs the logarithm of the length, about 40 bytes a symbol."""
    symbols = vocabulary.first[np.frombuffer(piece, dtype=np.uint8)]
    symbols[-1] = vocabulary.last[piece[-1]]
    n, width = len(symbols), 1 << (len(symbols) - 1).bit_length()
    none = int(NONE) * width
    rank, merged, size = vocabulary.rank, vocabulary.merged, vocabulary.size
    first = vocabulary.pair_ranks(symbols[:-1], symbols[1:]).astype(np.int64)
    leaves = np.full(2 * width, none, dtype=np.int64)
    leaves[width : width + n - 1] = np.where(first < NONE, first * width + np.arange(n - 1), none)
    level = width
    while level > 1:
        leaves[level // 2 : level] = np.minimum(leaves[level : 2 * level : 2], leaves[level + 1 : 2 * level : 2])
        level //= 2
    tree, ids = array("q", leaves.tobytes()), array("i", symbols.tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

    def put(leaf: int, left: int, right: int) -> None:
        found = rank.get(left * size + right) if right >= 0 else None
        value = none if found is None else found * width + leaf
        at = leaf + width
        tree[at] = value
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                break
            tree[at] = least

    while tree[1] < none:
        best, i = divmod(tree[1], width)
        j = after[i]
        k, h = after[j], before[i]
        ids[i] = new = int(merged[best])
        ids[j] = -1
        after[i] = k
        if k < n:
            before[k] = i
        put(j, -1, -1)
        put(i, new, ids[k] if k < n else -1)
        if h >= 0:
            put(h, ids[h], new)
    out = np.frombuffer(ids, dtype=np.int32)
    return out[out >= 0].astype("<i4").tobytes()


class Generations(dict):
    """A dict of bounded size: when full, its entries become the older generation, from which those in use return."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys: set) -> list:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        keys = keys.difference(self)
        back = keys & self.older.keys()
        self.update((k, self.older[k]) for k in back)
        return list(keys - back)


class Encoder:
    """Ids of whole texts. Ids of pieces are remembered in two generations of bounded size; new pieces are merged together."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known = Generations(PIECES_KEPT)

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [[(p if special else self.vocabulary.pieces(p), special) for p, special in self.vocabulary.parts(t)] for t in texts]
        new = self.known.missing(set().union(*(p for text in cut for p, special in text if not special)))
        self._learn(new)
        get, of = self.known.__getitem__, self.vocabulary.special_ids
        return [b"".join(of[p] if special else b"".join(map(get, p)) for p, special in text) for text in cut]

    def _learn(self, pieces: list[str | bytes]) -> None:
        by_width: dict[int, tuple[list[str | bytes], list[bytes]]] = {}
        for p in pieces:
            raw = p.encode() if isinstance(p, str) else p
            names, same = by_width.setdefault(1 << (len(raw) - 1).bit_length(), ([], []))
            names.append(p)
            same.append(raw)
        for width, (names, same) in by_width.items():
            if width > TOGETHER:
                self.known.update((p, merge_alone(self.vocabulary, raw)) for p, raw in zip(names, same, strict=True))
                continue
            step = CELLS // width
            for lo in range(0, len(same), step):
                found = merge_side_by_side(self.vocabulary, same[lo : lo + step], width)
                self.known.update(zip(names[lo : lo + step], found, strict=True))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker: what one task has learnt serves the next."""
    return Encoder(path)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in turn, with a bounded number of texts and, but for one very long text, of bytes at once."""
    lo = held = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if i > lo and (i - lo >= TEXTS_AT_ONCE or held + size > BYTES_AT_ONCE):
            yield texts.slice(lo, i - lo)
            lo, held = i, 0
        held += size
    if lo < len(texts):
        yield texts.slice(lo)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", row_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(row_id, ids): the ids of each whole text by the vocabulary file at ``vocabulary``, special tokens in texts included.

    No special token is added; truncation and padding of the file are not used. A text is cut into pieces by the
    vocabulary's own rules; in each piece the leftmost pair of the lowest rank is merged until no pair can be. Texts
    are encoded where they are read: nothing is shuffled, and a worker holds one batch and a bounded memory of pieces.
    ``with_text`` adds ``decoded``, the ids' text (see there), in the same pass.

    A null text is empty, and an empty text has no ids. Ids, null or repeated, and repeated rows stay as they are. No
    rows give no rows. Other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("body")):
                coder = encoder(vocabulary)
                found = coder(texts.to_pylist())
                offsets = np.cumsum([0, *(len(b) // 4 for b in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                columns = [batch.column("row_id").slice(at, len(texts)), ids]
                columns += [decode_lists(coder.vocabulary, ids)] if with_text else []
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "ids", "decoded"][: len(columns)])
                at += len(texts)

    rows = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"row_id {kind}, ids array<int>" + (", decoded string" if with_text else ""))


def decoded(ids: Column, vocabulary: str) -> Column:
    """The text of an array of ids, special tokens included, as the vocabulary file's decoder gives it.

    Without a decoder that is the tokens with one space between; a byte-level decoder joins their bytes. Ids outside the
    vocabulary and null ids are left out. No ids give an empty text, null gives null.
    """

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        known = encoder(vocabulary).vocabulary
        out = [decode_lists(known, lists.slice(lo, TEXTS_AT_ONCE)) for lo in range(0, len(lists), TEXTS_AT_ONCE)]
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return decode(ids)


def decode_lists(known: Vocabulary, part: pa.Array) -> pa.Array:
    values = part.flatten()
    inside = pc.fill_null(pc.and_(pc.greater_equal(values, 0), pc.less(values, known.size)), False)
    if not pc.all(inside).as_py():
        part = pa.array([x and [i for i in x if i is not None and 0 <= i < known.size] for x in part.to_pylist()], pa.list_(pa.int32()))
        values = part.flatten()
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(part), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, known.token.take(values)), " " if known.decoder is None else "")
    if known.decoder is not None:
        joined = pa.array([from_letters(known, t) for t in joined.to_pylist()], pa.string())
    return pc.if_else(pc.is_null(part), pa.scalar(None, pa.string()), joined)


def from_letters(known: Vocabulary, text: str) -> str:
    """The text whose bytes the letters of ``text`` stand for; special tokens stand for themselves."""
    raw = bytearray()
    at = 0
    for found in known.special.finditer(text) if known.special else ():
        raw += bytes(map(known.byte_of.__getitem__, text[at : found.start()])) + found.group().encode()
        at = found.end()
    return (raw + bytes(map(known.byte_of.__getitem__, text[at:]))).decode("utf-8", "replace")
