"""Cleaning and cutting of text. Null gives null, empty text stays empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wenloom.functions.vectors import let

# What cleaning removes. In the second, ``$-_`` is a range of characters.
TAG = r"<[^>]+>"
URL = r"https?://[a-z!$-_]+"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SPACE = r"(?U)\s+"

#: Words of the feature extractors: Unicode letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"
#: Ideographs one by one, other words whole.
IDEOGRAPHIC = r"\p{IsHan}|[\p{L}\p{N}_&&[^\p{IsHan}]]+"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def strip_url(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def strip_email(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "")


def clean_text(text: Column) -> Column:
    """Without markup, addresses and repeated blanks."""
    return F.trim(F.regexp_replace(strip_email(strip_url(strip_tags(text))), SPACE, " "))


def tokenize(text: Column, pattern: str = WORD) -> Column:
    """The matches of a word pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """Words as the term statistics see them: lower case."""
    return tokenize(F.lower(text))


def without_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    """Tokens that are no stop-word and not blank; repeats stay, case counts."""
    # Many words become a hash set in the plan.
    return F.filter(tokens, lambda t: (~t.isin(*stopwords) if stopwords else F.lit(True)) & (F.trim(t) != ""))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of low to high tokens, joined by a blank."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))).when(tokens.isNotNull(), F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def word_ngrams(text: Column, low: int = 1, high: int = 2) -> Column:
    """``ngrams`` of ``words``, which are cut once."""
    return let(words(text), lambda own: ngrams(own, low, high))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def encode_characters(text: Column, vocabulary: Column, length: int = 128, unknown: int = 100, first: int = 101, last: int = 102) -> Column:
    """``ids`` and ``mask`` of a fixed length: first, the characters' ids, last; cut after that, padded with 0."""
    ids = F.transform(characters(F.coalesce(text, F.lit(""))), lambda c: F.coalesce(F.try_element_at(vocabulary, c), F.lit(unknown)))
    cut = F.slice(F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last))), 1, length)

    def padded(own: Column) -> Column:
        pad = F.array_repeat(F.lit(0), F.lit(length) - F.size(own))
        return F.struct(F.concat(own, pad).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size(own)), pad).alias("mask"))

    return let(cut, padded)
