"""Words of a text, for phrase search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}]+"
LONGEST = 40
#: Stands for a word too long to be indexed: no word of a query equals it.
SKIPPED = "\u0001"


def indexed_words(text: Column) -> Column:
    """Lower-case words in order; one of 40 bytes or more leaves its place to a mark that matches nothing."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(F.octet_length(w) >= LONGEST, F.lit(SKIPPED)).otherwise(w))


def normalized(text: Column) -> Column:
    """The indexed words with a blank before, between and behind them."""
    return F.concat(F.lit(" "), F.array_join(indexed_words(text), " "), F.lit(" "))


def phrase_pattern(phrase: Column) -> Column:
    """What a normalized text contains where the phrase occurs; null for a phrase without a word to seek."""
    found = F.filter(indexed_words(phrase), lambda w: w != F.lit(SKIPPED))
    return F.when(F.size(found) > 0, F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" ")))


def has_phrase(normal: Column, phrase: Column) -> Column:
    return F.coalesce(F.contains(normal, phrase_pattern(phrase)), F.lit(False))


def grams(found: Column, k: int) -> Column:
    """The runs of k words, from first to last, each joined by blanks."""
    starts = F.when(F.size(found) >= k, F.sequence(F.lit(0), F.size(found) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(found, i + 1, k), " "))
