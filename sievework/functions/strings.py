"""String predicates and codes as Columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUZZY_DISTANCE = 2


def like(c: Column, pattern: str) -> Column:
    """Only % is special; the empty pattern matches nothing. One literal part needs no pattern at all."""
    if not pattern:
        return F.lit(False)
    parts = [p for p in pattern.split("%") if p]
    front, back = not pattern.startswith("%"), not pattern.endswith("%")
    if not parts:
        return c.isNotNull()
    if len(parts) == 1:
        part = parts[0]
        return c == part if front and back else c.startswith(part) if front else c.endswith(part) if back else c.contains(part)
    return c.like(pattern.replace("\\", "\\\\").replace("_", "\\_"))


def contains(c: Column, part: str) -> Column:
    """Substring search; the empty string is in nothing."""
    return c.contains(part) if part else F.lit(False)


def soundex(c: Column) -> Column:
    """American Soundex over the ASCII letters; '' where there is none."""
    return F.soundex(F.regexp_replace(c, "[^A-Za-z]", ""))


def sounds(c: Column, value: str) -> Column:
    code = soundex(F.lit(value))
    return (soundex(c) == code) & (code != "")


def _bytes(c: Column) -> Column:
    """A character for each byte of the text, so that distances count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(_bytes(a), _bytes(b))


def within(c: Column, value: str, distance: int) -> Column:
    """Levenshtein distance of at most `distance`; lengths that differ by more need no matrix."""
    if distance < 0:
        return F.lit(False)
    near = F.abs(F.octet_length(c) - F.lit(len(value.encode()))) <= distance
    return near & F.levenshtein(_bytes(c), _bytes(F.lit(value)), distance).between(0, distance)


def _letters(c: Column) -> Column:
    """Upper-case ASCII letters; umlauts without their dots, ß as SS, all else gone."""
    wide = F.replace(c, F.lit("ß"), F.lit("SS"))
    up = F.translate(wide, "abcdefghijklmnopqrstuvwxyzäöüÄÖÜ", "ABCDEFGHIJKLMNOPQRSTUVWXYZAOUAOU")
    return F.regexp_replace(up, "[^A-Z]", "")


def cologne_digits(c: Column) -> Column:
    """Kölner Phonetik, at most seven digits: letters by their neighbours, runs once, 0 only in front."""
    s = _letters(c)

    def digit(i: Column) -> Column:
        at = lambda k: F.substring(s, i + k, F.lit(1))
        now, after = at(0), at(1)
        before = F.when(i == 1, F.lit("")).otherwise(at(-1))
        hard_c = F.when(i == 1, after.isin(*"AHKLOQRUX")).otherwise(after.isin(*"AHKOQUX") & ~before.isin("S", "Z"))
        return (
            F.when(now.isin(*"AEIJOUY"), "0")
            .when(now == "B", "1")
            .when(now == "P", F.when(after == "H", "3").otherwise("1"))
            .when(now.isin("D", "T"), F.when(after.isin(*"CSZ"), "8").otherwise("2"))
            .when(now.isin(*"FVW"), "3")
            .when(now.isin(*"GKQ"), "4")
            .when(now == "C", F.when(hard_c, "4").otherwise("8"))
            .when(now == "X", F.when(before.isin(*"CKQ"), "8").otherwise("48"))
            .when(now == "L", "5")
            .when(now.isin("M", "N"), "6")
            .when(now == "R", "7")
            .when(now.isin("S", "Z"), "8")
            .otherwise("")
        )

    places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    raw = F.array_join(F.transform(places, digit), "")
    once = F.regexp_replace(raw, r"(.)\1+", "$1")
    return F.substring(F.regexp_replace(once, "(?<!^)0", ""), 1, 7)


def cologne(c: Column) -> Column:
    """The digits as one number: a nibble each behind a leading 1; 0 without a code."""
    digits = cologne_digits(c)
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(F.conv(F.concat(F.lit("1"), digits), 16, 10).cast("bigint"))


def grams(c: Column, n: int = 3) -> Column:
    """The distinct runs of n characters."""
    count = F.length(c) - (n - 1)
    every = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(count > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))
