"""Identifiers: item ids, session codes, action refids, vote ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for a missing cell.
NULL_WORDS = ("nan", "none", "na", "<na>", "null")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where the body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(c) -> Column:
    """Trimmed text, with null as ''."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def clean_bill(c, strip_zeros: bool = False) -> Column:
    """Upper-case id without spaces; null reads as ''. ``strip_zeros`` also drops zeros before the number."""
    out = F.upper(F.regexp_replace(blank(c), " ", ""))
    return F.regexp_replace(out, r"^([A-Z]+)0+(\d+)$", "$1$2") if strip_zeros else out


def bill_prefix(c) -> Column:
    return F.regexp_extract(col(c), r"^([A-Z]+)", 1)


def bill_number(c) -> Column:
    """Numeric part of an id, for natural ordering (HB2 before HB10)."""
    return F.coalesce(F.regexp_replace(col(c), r"\D", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def normalize_session_code(c) -> Column:
    """Three-digit session codes gain their century; everything else is only trimmed."""
    code = blank(c)
    return F.when(code.rlike(r"^\d{3}$"), F.concat(F.lit("20"), code)).otherwise(code)


def session_year(c) -> Column:
    """Year of a five-digit session code; null for any other text, never a guess."""
    code = blank(c)
    return F.when(code.rlike(r"^\d{5}$"), F.substring(code, 1, 4).cast("int"))


def is_null_word(c) -> Column:
    return F.lower(blank(c)).isin(*NULL_WORDS)


def heal_cell(c) -> Column:
    """Null words become '' and a float artefact loses its '.0'."""
    text = blank(c)
    return F.when(is_null_word(c), F.lit("")).otherwise(F.regexp_replace(text, r"^(\d+)\.0$", "$1"))


def was_healed(c) -> Column:
    """True only for text sentinels: a real null is absence, not damage."""
    return F.coalesce(col(c).isNotNull() & is_null_word(c), F.lit(False))


def shape_signature(c) -> Column:
    """Every run of digits becomes '#'."""
    return F.regexp_replace(heal_cell(c), r"\d+", "#")


def vote_id_shape(c) -> Column:
    v = blank(c)
    return (
        F.when(v.rlike(r"^C\d+V\d+$"), "committee_id_only")
        .when(v.rlike(r"^[HS]\d+V\d+$"), "chamber_committee")
        .when(v.rlike(r"^\d{8}$"), "floor")
        .when(v.rlike(r"^VSV"), "voice_or_standing")
        .otherwise("other")
    )


def spelling_key(c) -> Column:
    """Letters, digits and single spaces only, lower-case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"[^a-z0-9 ]", " "), r"\s+", " "))


def compact_key(c) -> Column:
    return F.upper(F.regexp_replace(blank(c), r"\s+", ""))


# Name suffixes that are never a surname.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "md", "dr")


def name_tokens(c) -> Column:
    """Lower-case name tokens, given name first. 'Adams, D.M.' is turned round, 'Norment, Jr.' is not."""
    text = F.coalesce(col(c), F.lit(""))
    head, tail = F.substring_index(text, ",", 1), F.regexp_replace(text, r"^[^,]*,?", "")
    suffixes = F.array(*[F.lit(s) for s in NAME_SUFFIXES])
    tail_words = F.filter(F.split(F.lower(F.regexp_replace(tail, r"[^A-Za-z]", " ")), r"\s+"), lambda w: w != "")
    tail_is_suffix = (F.size(tail_words) > 0) & (F.size(F.array_except(tail_words, suffixes)) == 0)
    turned = F.when(F.contains(text, F.lit(",")) & ~tail_is_suffix, F.concat_ws(" ", F.trim(tail), F.trim(head))).otherwise(text)
    words = F.split(F.lower(F.regexp_replace(turned, r"[^A-Za-z-]", " ")), r"\s+")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^-+|-+$", ""))
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(suffixes, w))
