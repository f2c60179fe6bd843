r"""Text functions on columns. `\w` of the rules means letters, marks, digits and the underscore of any script."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

W = r"[\p{L}\p{M}\p{N}_]"
# fixed values: the month names and the date shapes, tried in this order
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_PATTERNS = (
    r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}",
    rf"(?i)[0-9]{{1,2}}\s+(?:{MONTHS})\s+[0-9]{{4}}",
    rf"(?i)(?:{MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}",
)
# fixed values: words replaced in every third place of a query
CODE_MIX = {
    "bank": "बैंक",
    "rule": "नियम",
    "regulation": "विनियम",
    "money": "पैसा",
    "account": "खाता",
    "document": "दस्तावेज",
    "requirement": "आवश्यकता",
    "government": "सरकार",
}


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_unicode(text: Column) -> Column:
    """NFKC (the one step without a builtin), zero-width characters dropped, white space collapsed and trimmed."""
    bare = F.regexp_replace(nfkc(text), "[​‌‍﻿]", "")
    return F.trim(F.regexp_replace(bare, r"[\s\x1c-\x1f\x85\u1680\u2028\u2029]+", " "))


def dehyphenate(text: Column) -> Column:
    joined = F.regexp_replace(text, rf"({W}+)-\s*\n\s*({W}+)", "$1$2")
    return F.regexp_replace(joined, rf"({W}+)-\s+({W}+)", "$1$2")


def clean_noise(text: Column) -> Column:
    kept = F.regexp_replace(text, r"""[^\p{L}\p{M}\p{N}_\s.,;:!?()\[\]'"/\\-]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", " "), r"\.{3,}", "..."))


def text_quality(text: Column) -> Column:
    """0.7 of the share of letters and 0.3 of the share of readable characters; 0 for empty text."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    readable = F.regexp_count(text, F.lit(r"""[\p{L}\p{Nd}\s.,;:!?()\[\]'"/\\-]"""))
    n = F.length(text)
    score = F.least(F.lit(1.0), letters / n * 0.7 + readable / n * 0.3)
    return F.when(n > 0, score).otherwise(F.lit(0.0))


def detect_language(text: Column) -> Column:
    """hi where more than 0.3 of the Devanagari and Latin letters are Devanagari, en otherwise, unknown without any."""
    hindi = F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]"))
    both = hindi + F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when(both == 0, "unknown").when(hindi / both > 0.3, "hi").otherwise("en")


def dates_in(text: Column) -> Column:
    """array<struct<text,start,end>>: dates of the first shape, then of the second and third, each left to right."""
    found = [_with_offsets(text, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in DATE_PATTERNS]
    return F.concat(*found)


def _with_offsets(text: Column, matches: Column) -> Column:
    """Offsets of successive matches: each lies at the first place after the one before."""
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")

    def step(acc, m):
        at = F.call_function("locate", m, text, acc["at"])
        end = at - 1 + F.length(m)
        one = F.array(F.struct(m.alias("text"), (at - 1).alias("start"), end.alias("end")))
        return F.struct(F.concat(acc["out"], one).alias("out"), (end + 1).alias("at"))

    start = F.struct(empty.alias("out"), F.lit(1).alias("at"))
    return F.aggregate(matches, start, step, lambda acc: acc["out"])


def line_level(line: Column) -> Column:
    """struct(level, type) of a trimmed line."""
    return (
        F.when(line.rlike(r"^[0-9]+\."), _level(1, "numbered"))
        .when(line.rlike(r"^[A-Z\s]+$") & (F.length(line) < 100), _level(0, "heading"))
        .when(line.rlike(r"^\([a-z]\)"), _level(2, "subsection"))
        .otherwise(_level(0, "paragraph"))
    )


def _level(level: int, kind: str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type"))


def trust_gate(confidence: Column, threshold: float) -> Column:
    return F.coalesce(confidence, F.lit(1.0)) >= threshold


def merge_fragments(texts: Column) -> Column:
    """Fold of ordered texts: one that starts in lower case is glued to a predecessor that ends in a hyphen."""

    def step(acc, t):
        last = F.try_element_at(acc, F.lit(-1))
        glue = t.rlike(r"^\p{Ll}") & F.coalesce(F.endswith(last, F.lit("-")), F.lit(False))
        merged = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.substr(last, F.lit(1), F.length(last) - 1), t)))
        return F.when(glue, merged).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(texts, F.array().cast("array<string>"), step)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def join_coherently(parts: Column) -> Column:
    """Parts joined by a space after . ! ? , ; and by a full stop and a space otherwise."""

    def step(acc, part):
        return F.when(acc.isNull(), part).when(acc.rlike(r"[.!?,;]$"), F.concat(acc, F.lit(" "), part)).otherwise(F.concat(acc, F.lit(". "), part))

    return F.coalesce(F.aggregate(parts, F.lit(None).cast("string"), step), F.lit(""))


def answer_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def span_hash(document_id: Column, start: Column, end: Column, text: Column) -> Column:
    return answer_hash(F.concat_ws(":", document_id.cast("string"), start.cast("string"), end.cast("string"), text))


def dated_answer(text: Column, date: Column) -> Column:
    return F.concat(F.lit("As of "), F.date_format(date, "MMMM dd, yyyy"), F.lit(": "), text)


def word_set(text: Column) -> Column:
    """Distinct lower-case words, cut at anything but letters, marks, digits and the underscore."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != ""))


def space_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def code_mixed(query: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in CODE_MIX.items() for x in pair])
    mixed = F.transform(space_words(query), lambda w, i: F.when(i % 3 == 0, F.coalesce(F.try_element_at(mapping, F.lower(w)), w)).otherwise(w))
    return F.array_join(mixed, " ")


def negated_claim(claim: Column) -> Column:
    low = F.lower(claim)
    out = F.concat(F.lit("It is not true that "), low)
    for word in ("are", "is", "must", "shall"):
        out = F.when(F.contains(low, F.lit(word)), F.replace(low, F.lit(word), F.lit(f"{word} not"))).otherwise(out)
    return out


def modified_claim(claim: Column) -> Column:
    """One of five replacements, chosen by the length of the claim so that reruns agree."""
    choices = (("10%", "15%"), ("shall", "may"), ("must", "should"), ("all", "some"), ("every", "any"))
    out = claim
    for k, (old, new) in enumerate(choices):
        out = F.when(F.length(claim) % 5 == k, F.replace(claim, F.lit(old), F.lit(new))).otherwise(out)
    return out
