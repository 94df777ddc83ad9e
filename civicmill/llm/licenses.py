"""License scans by ordered signature rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import ascii_lower

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, once A-Z are lower-cased

# Fixed phrases and their labels, as words.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Families of licenses as they are named in running words. Each: label, names, versions.
# A version is written as words ("2 0"); an empty one stands for the bare name.
FAMILIES = (
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "1 0", "3", "3 0")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache license", "apache software license"), ("1 0", "1 1", "2", "2 0")),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2", "2 0")),
    ("epl", ("eclipse public license", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1")),
    ("eupl", ("european union public license", "european union public licence", "eupl"), ("1 0", "1 1", "1 2")),
    ("artistic", ("artistic license",), ("1 0", "2 0")),
    ("bsl", ("boost software license",), ("1 0",)),
    ("afl", ("academic free license",), ("2 1", "3 0")),
    ("osl", ("open software license",), ("2 1", "3 0")),
    ("mit", ("mit license", "mit licence", "expat license"), ()),
    ("bsd", ("bsd license", "bsd licence", "berkeley software distribution license"), ("2 clause", "3 clause", "4 clause")),
    ("isc", ("isc license", "isc licence"), ()),
    ("zlib", ("zlib license", "zlib libpng license"), ()),
    ("unlicense", ("the unlicense",), ()),
    ("wtfpl", ("wtfpl",), ("2", "2 0")),
    ("ofl", ("sil open font license",), ("1 0", "1 1")),
    ("psf", ("python software foundation license", "psf license"), ("2", "2 0")),
    ("odbl", ("open database license", "odbl"), ("1 0",)),
    ("ms-pl", ("microsoft public license",), ()),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", ("cc by", "creative commons attribution"), ("2 0", "2 5", "3 0", "4 0")),
)

# Signatures of notices that name no license. Each: label, keyword, pattern over words.
NOTICES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:dedicated|released|placed) (?:to|into|in) the public domain"),
    ("proprietary", "rights", r"all rights (?:are )?reserved"),
    ("gpl-or-later", "later", r"gpl (?:v )?\d (?:\d )?or (?:any )?later"),
    ("gpl-or-later", "later", r"general public license (?:as published by the free software foundation )?(?:either )?version \d (?:\d )?(?:of the license )?or (?:at your option )?any later version"),
)


@dataclass(frozen=True)
class Signature:
    """``pattern`` over words joined by single spaces; tried only where ``keyword`` occurs. A lower priority wins."""

    label: str
    keyword: str
    pattern: str
    priority: int


def signatures() -> list[Signature]:
    """The ordered rules: versioned names, identifiers, bare names, notices, in falling strength."""
    rules = []
    for label, names, versions in FAMILIES:
        for name in names:
            keyword = max(name.split(), key=len)
            for v in versions:
                dashed = label + "-" + v.replace(" clause", "-clause").replace(" ", ".")
                before = f"{v} {name}" if "clause" in v else f"{name}"
                after = "" if "clause" in v else rf" (?:v |version |international |v)?{v}"
                rules.append(Signature(dashed, keyword, before + after, 1))
            rules.append(Signature(label, keyword, name, 2))
            # named as the license of a work
            rules.append(Signature(label, keyword, rf"(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of the )?{name}", 2))
        spdx = label.replace("-", " ")
        rules.append(Signature(label, "spdx", rf"spdx license identifier {spdx}", 1))
    rules += [Signature(label, keyword, pattern, 3) for label, keyword, pattern in NOTICES]
    return rules


def normalised(text: Column) -> Column:
    """Words, A-Z lower-cased, each followed and preceded by exactly one space; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), GAPS, " ")


def _starts(words: str, phrase: str) -> Column:
    """Word numbers at which the words of ``phrase`` stand one after the other, every place counted."""
    first, *rest = phrase.split()
    hits = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())

    def follows(i: Column) -> Column:
        test = F.lit(True)
        for k, w in enumerate(rest, 1):
            test = test & F.coalesce(F.get(F.col(words), i + k) == w, F.lit(False))
        return test

    return F.filter(hits, follows)


def _spans(line: Column, rules: list[Signature]) -> Column:
    """Structs (start, minus_end, priority, label), in words, of the matches of the rules whose keyword occurs.

    Matches of one rule do not overlap. Marks set around them stick to words, so their places are places of words.
    """
    fields = lambda r: (F.lit(r.label).alias("label"), F.lit(f" {r.keyword} ").alias("keyword"), F.lit(f" ({r.pattern})(?= )").alias("pattern"), F.lit(r.priority).alias("priority"))
    literal = F.array(*[F.struct(*fields(r)) for r in rules])

    def matches(rule: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(line, rule["pattern"], F.lit(" \u0001$1\u0002"))), " ")
        places = F.transform(words, lambda w, i: F.struct(F.when(w.startswith("\u0001"), i).alias("a"), F.when(w.endswith("\u0002"), i).alias("b")))
        starts = F.transform(F.filter(places, lambda p: p["a"].isNotNull()), lambda p: p["a"])
        ends = F.transform(F.filter(places, lambda p: p["b"].isNotNull()), lambda p: p["b"])
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (-b - 1).alias("minus_end"), rule["priority"].alias("priority"), rule["label"].alias("label")))

    gated = F.filter(literal, lambda r: F.contains(line, r["keyword"]) & F.regexp(line, r["pattern"]))
    return F.flatten(F.transform(gated, matches))


def _resolved(spans: Column) -> Column:
    """(covered words, labels) once spans inside another of the same or a better priority are suppressed.

    In the order of start, longer first, better first, whatever contains a span comes before it. So the furthest end
    seen per priority tells whether a span is contained, and one pass decides all.
    """
    zero = F.struct(F.lit(0).alias("e1"), F.lit(0).alias("e2"), F.lit(0).alias("e3"), F.lit(0).alias("reach"), F.lit(0).alias("covered"), F.array().cast("array<string>").alias("labels"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["minus_end"]
        better = F.when(s["priority"] == 1, acc["e1"]).when(s["priority"] == 2, F.greatest(acc["e1"], acc["e2"])).otherwise(F.greatest(acc["e1"], acc["e2"], acc["e3"]))
        kept = better < end
        new = F.greatest(F.lit(0), end - F.greatest(s["start"], acc["reach"]))
        ends = [F.when(kept & (s["priority"] == p), F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3)]
        return F.struct(
            *ends,
            F.when(kept, F.greatest(acc["reach"], end)).otherwise(acc["reach"]).alias("reach"),
            F.when(kept, acc["covered"] + new).otherwise(acc["covered"]).alias("covered"),
            F.when(kept, F.array_union(acc["labels"], F.array(s["label"]))).otherwise(acc["labels"]).alias("labels"),
        )

    return F.aggregate(F.array_sort(spans), zero, step)


def scan_licenses(docs: DataFrame, text: str = "text", row_id: str = "doc_id", rules: list[Signature] | None = None) -> DataFrame:
    """Per row: n_words, the places of the base phrases, and the labels of all signature rules that stand.

    A text is looked at by the rules only if one of their keywords occurs in it, and by a rule only if its own does.
    A detection inside another one of the same or a better priority is suppressed (so ``apache-2`` inside
    ``apache-2.0``, a bare name inside a versioned one); detections that overlap only in part all stand. ``score`` is
    the share of words that the standing detections cover. All in one pass over each row: no shuffle, no Python.

    Labels of base phrases are always among ``labels``. A null, empty or wordless text has no words, no labels, null
    places and score 0. Repeated rows and ids, and null ids, stay as they are. Other columns are ignored.
    """
    rules = signatures() if rules is None else rules
    keywords = F.array(*[F.lit(f" {k} ") for k in sorted({r.keyword for r in rules})])
    body = docs.select(F.col(row_id).alias("doc_id"), normalised(F.col(text)).alias("line"))
    line = F.col("line")
    n_words = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) - 1
    any_base = F.lit(False)
    for phrase in BASE:
        any_base = any_base | line.contains(f" {phrase} ")
    body = body.select(
        "doc_id",
        F.greatest(n_words, F.lit(0)).cast("bigint").alias("n_words"),
        F.when(any_base, F.split(F.trim(line), " ")).alias("words"),
        F.when(F.exists(keywords, lambda k: F.contains(line, k)), _spans(line, rules)).alias("spans"),
    )
    found = F.array(*[F.struct(F.lit(label).alias("label"), _starts("words", phrase).alias("at")) for phrase, label in BASE.items()])
    body = body.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), found).alias("base"), F.when(F.size("spans") > 0, _resolved(F.col("spans"))).alias("method"))
    base = F.filter("base", lambda b: F.size(b["at"]) > 0)
    body = body.select("doc_id", "n_words", base.alias("base"), F.flatten(F.transform(base, lambda b: b["at"])).alias("at"), "method")
    no_labels = F.array().cast("array<string>")
    base_labels = F.coalesce(F.transform("base", lambda b: b["label"]), no_labels)
    labels = F.array_union(base_labels, F.coalesce(F.col("method.labels"), no_labels))
    return body.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("at"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min("at").cast("bigint").alias("first_word"),
        F.array_max("at").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.try_divide(F.col("method.covered").cast("double"), F.col("n_words").cast("double")), F.lit(0.0)).alias("score"),
    )
