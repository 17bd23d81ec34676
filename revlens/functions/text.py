"""Text functions: comparison, keys, n-grams, cleaning."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that mean the same in drawing values.
TIMES = "[xX×ラｘＸ]"
DASHES = "[－−–—―〜～]"
# Folded in this order, on lower-cased text without white space.
FOLDS = [
    ("dia", "ø"), ("diameter", "ø"), ("deg", "°"), ("degrees", "°"), ("rad", "r"), ("radius", "r"),
    ("×", "x"), ("✕", "x"), ("✖", "x"), ("⨯", "x"), ("：", ":"), ("（", "("), ("）", ")"),
]


def compare_values(old: Column, new: Column) -> Column:
    """MATCHED, ADDED, REMOVED or CHANGED for two cell values; null, blank and NONE are all empty.

    A colon on one side and a slash on the other is a change, though the two are alike otherwise, as are the signs
    for times, the dashes, case and white space.
    """

    def bare(c: Column) -> Column:
        return F.trim(F.when(c.isNull() | (c == ""), "NONE").otherwise(c))

    def folded(c: Column) -> Column:
        c = F.regexp_replace(F.lower(c), TIMES, "x")
        c = F.regexp_replace(F.regexp_replace(c, ":", "/"), DASHES, "-")
        return F.regexp_replace(c, r"\s+", "")

    o, n = bare(old), bare(new)
    swapped = (o.contains(":") & n.contains("/")) | (o.contains("/") & n.contains(":"))
    fo, fn = (F.when(c == "NONE", "").otherwise(folded(c)) for c in (o, n))
    return (
        F.when(o == n, "MATCHED").when(swapped, "CHANGED").when(fo == fn, "MATCHED")
        .when(fo == "", "ADDED").when(fn == "", "REMOVED").otherwise("CHANGED")
    )


def _arrow(kind: str):
    def made(one):
        @F.pandas_udf(kind)
        def mapped(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else one(t))

        return mapped

    return made


def nfkc(text: Column) -> Column:
    """Unicode compatibility normal form; Spark has no built-in for it."""
    return _arrow("string")(lambda t: unicodedata.normalize("NFKC", t))(text)


def normal_key(text: Column) -> Column:
    """Key under which two notes are the same: NFKC, lower case, no white space, drawing signs folded in order."""
    key = F.regexp_replace(F.lower(nfkc(text)), "[ \\n\\t\\r\u3000]+", "")
    for old, new in FOLDS:
        key = F.replace(key, F.lit(old), F.lit(new))
    return key


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings, 0 where one is empty or null."""

    @F.pandas_udf("double")
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            pairs = list(zip(x, y, strict=True))
            seen = {(p, q): difflib.SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in set(pairs)}
            yield pd.Series([seen[pair] for pair in pairs], dtype="float64")

    return similarity(a, b)


def shared_characters(a: Column, b: Column) -> Column:
    """Characters that two strings have in common, counted: no matching of theirs is longer."""

    @F.pandas_udf("long")
    def shared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([(Counter(p or "") & Counter(q or "")).total() for p, q in zip(x, y, strict=True)], dtype="int64")

    return shared(a, b)


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words, each word padded by a blank on both sides; short words give themselves."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(n: int) -> Column:
        return F.flatten(
            F.transform(
                F.filter(padded, lambda w: F.length(w) >= n),
                lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n))),
            )
        )

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def component_of(value: Column, number: Column, position: str = "infix") -> Column:
    """Whether a value is the prefix, suffix or any part of a number, signs and case aside; a blank value is."""
    v, n = (F.upper(F.regexp_replace(c, r"[\s\-_/.]", "")) for c in (value, number))
    held = {"prefix": F.startswith(n, v), "suffix": F.endswith(n, v), "infix": F.contains(n, v)}[position]
    return F.coalesce(v == "", F.lit(True)) | F.coalesce(held, F.lit(False))


def dimension_key(kind: Column, measure: Column, text: Column) -> Column:
    """Comparison key: of a dimension its kind's low three bits and its measure to six places, else the text key."""
    shown = F.regexp_replace(F.format_string("%.6f", measure), r"\.?0+$", "")
    return F.when(measure.isNull(), text).otherwise(F.concat_ws(":", F.lit("dim"), kind.bitwiseAND(F.lit(7)), shown))


def plain_mtext(text: Column) -> Column:
    """Formatted drawing text without its codes: %%-signs, font and height switches, stacks, braces, line codes."""
    for code, sign in (("(?i)%%c", "⌀"), ("(?i)%%d", "°"), ("(?i)%%p", "±")):
        text = F.regexp_replace(text, code, sign)
    text = F.regexp_replace(text, r"\\[Pp](?![A-Za-z0-9.,]*;)", " ")
    text = F.regexp_replace(text, r"\\S([^;^#/]*)[\^#/]([^;]*);", "$1/$2")
    text = F.regexp_replace(text, r"\\[A-Za-z][^;\\{}]*;", "")
    text = F.regexp_replace(text, r"\\[LlOoKk]|[{}]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def exact_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def pair_key(old: Column, new: Column) -> Column:
    """Key of a text pair; one with a missing side has one key, whichever side holds the text."""
    a, b = (F.coalesce(exact_key(t), F.lit("")) for t in (old, new))
    return F.when(a == "", F.concat(b, F.lit("->"))).otherwise(F.concat(a, F.lit("->"), b))


def redact(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def safe_name(text: Column) -> Column:
    """A file name of letters, digits, dot, dash and underscore."""
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")


def banded(value: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first band (falling lower limits) that a value reaches."""
    out = F.lit(rest)
    for low, label in reversed(bands):
        out = F.when(value >= low, label).otherwise(out)
    return F.when(value.isNull(), rest).otherwise(out)


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that occurs in a text; order decides."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out
