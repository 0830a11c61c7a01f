"""Text functions: token normal form, Indel similarity, LRC time stamps and section markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import rounded

#: Section labels in the order in which they are tried, and the stamp and markup patterns.
LABELS = ("intro", "verse", "chorus", "bridge", "outro")
STAMP = r"\[(\d{1,3}):(\d{2})(?:\.(\d{1,3}))?\]"
MARKUP = r"^\[[^\]]+\]$"


def normal_token(x: Column) -> Column:
    """Lower case, with everything but (Unicode) word characters and apostrophes removed."""
    return F.regexp_replace(F.lower(x), r"(?U)[^\w']+", "")


def tokens(x: Column) -> Column:
    """Whitespace-separated tokens whose normal form isn't empty."""
    return F.filter(F.split(F.trim(x), r"\s+"), lambda t: normal_token(t) != "")


def normal_line(x: Column) -> Column:
    """The normal forms of a line's tokens, one space between them."""
    kept = F.regexp_replace(F.lower(x), r"(?U)[^\w'\x20\x09-\x0D]+", "")
    return F.trim(F.regexp_replace(kept, r"[\x20\x09-\x0D]+", " "))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings: one row of the table per character of a, kept as an array."""
    letters = F.filter(F.split(a, ""), lambda c: c != "")
    other = F.filter(F.split(b, ""), lambda c: c != "")
    zero = F.transform(other, lambda _: F.lit(0))
    row = F.aggregate(
        letters,
        zero,
        lambda previous, c: F.aggregate(
            F.sequence(F.lit(1), F.size(other)),
            F.expr("cast(array() as array<int>)"),
            lambda done, j: F.concat(
                done,
                F.array(
                    F.when(F.element_at(other, j) == c, F.when(j > 1, F.element_at(previous, F.greatest(j - 1, F.lit(1)))).otherwise(F.lit(0)) + 1).otherwise(
                        F.greatest(F.element_at(previous, j), F.when(j > 1, F.element_at(done, F.greatest(j - 1, F.lit(1)))).otherwise(F.lit(0)))
                    )
                ),
            ),
        ),
    )
    return F.when((F.size(letters) == 0) | (F.size(other) == 0), F.lit(0)).otherwise(F.element_at(row, -1))


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalised Indel similarity 2 LCS / (|a| + |b|); 1 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common_subsequence(a, b) / total)


def token_sort_ratio(a: Column, b: Column) -> Column:
    ordered = lambda x: F.array_join(F.array_sort(F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != "")), " ")
    return indel_ratio(ordered(a), ordered(b))


def has_stamp(text: Column) -> Column:
    """Whether any line starts with an LRC time stamp."""
    return F.exists(F.split(text, "\n"), lambda line: line.rlike(r"^\s*\[\d{1,3}:\d{2}"))


def stamp_seconds(line: Column) -> Column:
    """Seconds of a leading stamp, null without one; the fraction is padded on the right to thousandths."""
    part = lambda k: F.regexp_extract(line, "^" + STAMP, k)
    fraction = F.rpad(F.when(part(3) == "", "0").otherwise(part(3)), 3, "0")
    seconds = part(1).try_cast("int") * 60 + part(2).try_cast("int") + fraction.try_cast("int") / 1000
    return F.when(line.rlike("^" + STAMP), rounded(seconds, "seconds"))


def without_stamps(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, STAMP, ""))


def is_markup(text: Column) -> Column:
    return text.rlike(MARKUP)


def markup_label(text: Column) -> Column:
    """The first label that the bracketed text starts with, else 'other'."""
    inner = F.lower(F.trim(F.expr("substring({0}, 2, length({0}) - 2)".format("text")))) if isinstance(text, str) else F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"^\[", ""), r"\]$", "")))
    chain = None
    for label in LABELS:
        chain = F.when(inner.startswith(label), label) if chain is None else chain.when(inner.startswith(label), label)
    return chain.otherwise("other")
