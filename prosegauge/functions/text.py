"""Text expressions. Character classes are spelled out, as ``\\s`` and ``\\b`` differ between engines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as L

# Patterns.
WORD = r"[A-Za-z][A-Za-z'\-]*"
BLANK = r"[ \t\n\r\f\x0B]"
INVISIBLE = "[\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff\\u00ad]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
EMAIL, PHONE, SSN = r"[\w.+-]+@[\w-]+\.[\w.]+", r"(?<!\d)(?:\+?\d[\d\s().-]{7,}\d)(?!\d)", r"\b\d{3}-\d{2}-\d{4}\b"
PUNCTUATION = ",.;:!?–()[]\"'…-"
MIN_CHARS, MAX_CHARS = 200, 60_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_space_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, BLANK + "+"), lambda w: w != "")).cast("long")


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def occurrences_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = [occurrences(text, p) for p in parts]
    return sum(found[1:], found[0])


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e, at least one; of a lower-case word without outer apostrophes and hyphens."""
    w = F.trim(F.lower(word), F.lit("'-"))
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.endswith("e") & ~w.rlike("(le|ee|ye)$") & (n > 1)
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - silent.cast("int")))


def nfkc(text: Column) -> Column:
    """The one step of normalising that has no built-in. Made when called: a session must run by then."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return of(text)


def normalise(text: Column) -> Column:
    """NFKC; line ends to \\n; no invisible or control characters; white space collapsed, never words or punctuation."""
    t = F.regexp_replace(nfkc(text), "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), CONTROL, "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def verdict_of_length(text: Column) -> Column:
    """empty, too_long, too_short or ok, asked in that order."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "") == ""
    return F.when(blank, "empty").when(F.length(text) > MAX_CHARS, "too_long").when(F.length(text) < MIN_CHARS, "too_short").otherwise("ok")


def scrub(text: Column) -> Column:
    """Addresses, phone numbers and social security numbers masked, in that order."""
    t = F.regexp_replace(F.regexp_replace(text, EMAIL, "<email>"), PHONE, "<phone>")
    return F.regexp_replace(t, SSN, "<ssn>")


def content_hash(text: Column, detector: str = "1.0.0", model: str = "1.0.0") -> Column:
    return F.sha2(F.concat(text, F.lit("\0"), F.lit(detector), F.lit("\0"), F.lit(model)), 256)


def duplicate_key(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), BLANK + "+", " "))


def in_list(word: Column, entries: tuple[str, ...]) -> Column:
    return word.isin(*entries)


CONTRACTION = "(?i)(?<![\\p{L}\\p{N}_])(" + L.CONTRACTIONS + ")(?![\\p{L}\\p{N}_])"
