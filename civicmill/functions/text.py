"""Text keys, tokens and shingles."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from civicmill.functions.ids import blank, col, let

# Words that carry no subject.
STOP_WORDS = ("the", "of", "and", "for", "to", "in", "a", "an", "or", "by", "on", "with", "certain", "relating", "act", "other",
              "generally")
PROCEDURE_STOP_WORDS = ("the", "a", "an", "of", "to", "by", "from", "in", "on", "at", "with", "for", "and", "or", "but", "as", "this",
                        "that", "these", "those", "was", "were", "is", "are", "be", "been", "being", "has", "have", "had")
# HTML entities that are decoded, and opening formulas that carry no content.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#160;": " ", "&#38;": "&"}
BOILERPLATE = (r"^\s*be it enacted by the general assembly of virginia[,:]?\s*", r"^\s*a bill to\s+")


def _array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip_chars_key(c) -> Column:
    """Committee key 1: filler text removed wherever it occurs, inside words too."""
    text = F.lower(blank(c))
    for token in ("committee", "on", "for", "the", "of", "and", "&", ",", ".", "-"):
        text = F.replace(text, F.lit(token), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def committee_core(c) -> Column:
    """Committee key 2: whole filler words removed, a subcommittee rolled up to its parent."""
    text = F.substring_index(F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")), "-", 1)
    text = F.regexp_replace(text, r"[^a-z0-9 ]", " ")
    text = F.regexp_replace(text, r"\b(house|senate|committee|on|for|the|of|and|subcommittee|sub|agenda)\b", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def committee_letters(c) -> Column:
    """Committee key 3: chamber words removed, parent part only, letters only."""
    text = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")), r"\b(senate|house|committee|the)\b", "")
    text = F.substring_index(F.substring_index(text, "subcommittee", 1), "-", 1)
    return F.regexp_replace(text, r"[^a-z]", "")


def chamber_letter(c) -> Column:
    name = F.lower(blank(c))
    return F.when(name.startswith("house"), "H").when(name.startswith("senate"), "S").otherwise("")


def description_key(c) -> Column:
    """Comparable form of an action description: no tag block, chamber letter or closing parenthesis."""
    text = F.regexp_replace(blank(c), r"^[^A-Za-z0-9]*\[[^\]]*\]\s*", "")
    text = F.regexp_replace(text, r"^\s*[HS]\s+", "")
    text = F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def reviewer_text(c, width: int | None = 80) -> Column:
    """Description without tag block and chamber letter, cut to ``width`` for display; whole if that is None."""
    text = F.regexp_replace(blank(c), r"^[^A-Za-z0-9]*\[[^\]]*\]\s*", "")
    text = F.regexp_replace(text, r"^\s*[HS]\s+", "")
    return text if width is None else F.substring(text, 1, width)


def title_head(c) -> Column:
    """Catalogue heading: the title up to its first ; : or ."""
    head = F.lower(F.element_at(F.split(blank(c), r"[;:.]"), 1))
    return F.trim(F.regexp_replace(F.regexp_replace(head, r"[^a-z0-9 ]", " "), r"\s+", " "))


# Classes of the closing clause of a title, first match wins.
CLAUSE_CLASSES = (("civil penalt", "civil penalty"), ("penalt", "penalty"), (r"\breport\b", "report"),
                  (r"\bstudy\b|work group|advisory", "study"), ("repeal", "repeal"), ("sunset|expiration", "sunset"),
                  ("definition", "definitions"), ("technical amend", "technical"), ("effective date|emergency", "effective date"),
                  (r"\bfund\b|appropriat", "funding"), ("exempt", "exemption"), (r"\bfee\b|\btax\b", "fee/tax"), (r"\bpilot\b", "pilot"))


def segments(c) -> Column:
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def closing_clause(c) -> Column:
    parts = segments(c)
    last = F.lower(F.try_element_at(parts, F.lit(-1)))
    chain = F.when(F.size(parts) < 2, F.lit("none"))
    for pattern, label in CLAUSE_CLASSES:
        chain = chain.when(last.rlike(pattern), label)
    return chain.otherwise("other")


def locality_count(c) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"(?i)\b(County|City|Town) of\b"))


def citation_count(c) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"§+\s*[\d.:\-]+"))


def any_word(c, words: Sequence[str]) -> Column:
    """Some whole word of ``words`` occurs, in singular or with -s / -es."""
    alternation = "|".join(F_escape(w) for w in words)
    return F.lower(blank(c)).rlike(r"\b(" + alternation + r")(es|s)?\b")


def F_escape(word: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch in " _") else ch for ch in word.lower())


def topic(c, rules: Mapping[str, Sequence[str]], default: str = "Unassigned / General") -> Column:
    """First topic, in rule order, one of whose words occurs in the text. One regex per topic, no join."""
    chain = None
    for name, words in rules.items():
        hit = any_word(c, words)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(default) if chain is not None else F.lit(default)


def flag_words(c, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Some included text occurs and no excluded text does (plain substrings)."""
    text = F.lower(blank(c))
    contains = lambda words: F.greatest(*[text.contains(w).cast("int") for w in words], F.lit(0)) == 1
    return contains(list(include)) & ~(contains(list(exclude)) if exclude else F.lit(False))


# Ranges of characters that NFKC neither changes nor joins with others: Latin and Cyrillic letters, Greek ones
# without numerals and symbols, plain punctuation, kana, ideographs. Text in these alone is in the form already.
UNCHANGED = (r"\x{0}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
             r"\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{482}\x{48A}-\x{52F}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20AC}"
             r"\x{3001}-\x{3020}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{30FC}-\x{30FE}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}")


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """A batch may be 10,000 whole texts: only 100 of them are Python objects at a time, the rest stays in Arrow."""
    form = lambda t: None if t is None else unicodedata.normalize("NFKC", t)
    parts = [pa.array([form(t) for t in text.slice(i, 100).to_pylist()], pa.string()) for i in range(0, len(text), 100)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalize_text(c, drop_boilerplate: bool = True) -> Column:
    """Comparison-ready text. Presentation goes, wording stays; '§' survives as part of a citation.

    NFKC is the only step Spark has no built-in for: its function gets a null in place of text in ``UNCHANGED`` characters
    only, which the form leaves as it is, so such text does not travel to Python.
    """
    raw, whole = col(c), F.coalesce(col(c), F.lit(""))
    text = whole
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.when(whole.contains("&"), text).otherwise(whole)
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    changes = (F.length(raw) != F.octet_length(raw)) & raw.rlike(rf"[\x{{A0}}-\x{{10FFFF}}&&[^{UNCHANGED}]]")
    text = F.coalesce(nfkc(F.when(changes, text)), text)
    text = F.regexp_replace(text, r"(?m)^\s*\d{1,4}\s", " ")
    text = F.lower(text)
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s§]", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    if drop_boilerplate:
        for pattern in BOILERPLATE:
            text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def words(c) -> Column:
    return F.filter(F.split(blank(c), r"\s+"), lambda w: w != "")


def shingles(c, k: int = 8) -> Column:
    """Distinct k-word windows of normalised text; short text is one shingle, empty text none."""

    def windows(tokens):
        n = F.size(tokens)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(cut))

    return let(words(c), windows)


def shingle_hashes(c, k: int = 8) -> Column:
    """Shingles as 64-bit hashes: eight bytes each through a shuffle instead of a sentence.

    A word is hashed once and a shingle is the hash of its words' hashes: no window becomes a string.
    """

    def windows(hashes):
        # behind the end of a short text are nulls, which a hash passes over
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(cut))

    return let(F.transform(words(c), lambda w: F.xxhash64(w)), windows)


def subject_tokens(c) -> Column:
    """Distinct letter runs of three or more, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(blank(c)), F.lit(r"([a-z]{3,})"), F.lit(1)))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def procedure_tokens(c, bigrams: bool = False) -> Column:
    """Unigrams of three or more characters without stop words; bigrams keep stop words."""
    raw = F.regexp_extract_all(F.lower(blank(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    single = lambda r: F.filter(r, lambda w: (F.length(w) >= 3) & ~w.isin(*PROCEDURE_STOP_WORDS))
    if not bigrams:
        return single(raw)

    def both(r):
        less = F.greatest(F.size(r) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(r, F.lit(1), less), F.slice(r, F.lit(2), less), lambda a, b: F.when((F.length(a) >= 2) & (F.length(b) >= 2), F.concat_ws("_", a, b)))
        return F.when(F.size(r) < 2, single(r)).otherwise(F.concat(single(r), F.filter(pairs, lambda p: p.isNotNull())))

    return let(raw, both)


def jaccard(a, b) -> Column:
    """0 when either side is empty: no text is not evidence of sameness."""
    inter = F.size(F.array_intersect(col(a), col(b)))
    return F.when((F.size(col(a)) == 0) | (F.size(col(b)) == 0), 0.0).otherwise(inter / (F.size(col(a)) + F.size(col(b)) - inter))


def ngrams(c, longest: int) -> Column:
    """(words, position, text) of every n-gram of the key up to ``longest`` words."""

    def per_size(tokens, size):
        n = F.size(tokens)
        grams = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.struct(
            F.lit(size).alias("size"), i.alias("pos"), F.array_join(F.slice(tokens, i + 1, size), " ").alias("gram")))
        return F.when(n >= size, grams).otherwise(F.array().cast("array<struct<size:int,pos:int,gram:string>>"))

    return let(words(c), lambda tokens: F.concat(*[per_size(tokens, s) for s in range(1, longest + 1)]))
