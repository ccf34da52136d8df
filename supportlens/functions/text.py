"""Scalar text functions, all built-in expressions: they run inside code generation and are pushed into scans.

Explicit character classes are used throughout, so that Java's and RE2's readings agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\x0b\\f\\r\\u00a0\\u2003\\u3000]"
#: Words left out of token lists. Names of brands are a parameter.
STOPWORDS = tuple("a an and are as at be been but by can do for from get got have help i if in is it just me my of on or please so that the this to was we with you your".split())
#: Words and phrases that point back to earlier turns.
ANAPHORA = ("it", "this", "that", "still", "again", "already", "same", "they", "them")
ANAPHORIC_PHRASES = ("doing this", "still restarting", "wont let me", "won't let me")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def normalize(c: Column) -> Column:
    """Lower case, links and mentions out, single blanks."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(c), "https?://[^ \\t\\n\\r]+", " "), "@[a-z0-9_]+", " "))


def tokens(c: Column, words: str = "[a-z0-9]+(?:'[a-z0-9]+)?", brands: tuple[str, ...] = ()) -> Column:
    """Words of the normalised text without stop words and names of brands."""
    return F.filter(F.regexp_extract_all(normalize(c), F.lit(f"({words})"), F.lit(1)), lambda t: ~t.isin(*STOPWORDS, *brands))


def urls(c: Column) -> Column:
    """Links without the punctuation that ends a sentence."""
    return F.transform(F.regexp_extract_all(c, F.lit("(https?://[^ \\t\\n\\r]+)"), F.lit(1)), lambda u: F.regexp_replace(u, "[.,;!?:)\"'>]+$", ""))


def has_url(c: Column) -> Column:
    return c.rlike("(?i)https?://")


def strip_handle(c: Column) -> Column:
    return F.regexp_replace(c, "^@[A-Za-z0-9_]+[ \\t\\n\\r]*", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"{BLANK}+"), lambda x: x != ""))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clean(c: Column) -> Column:
    """Letters, digits, underscores and white space, lower case, trimmed."""
    return strip(F.lower(F.regexp_replace(c, "[^\\p{L}\\p{N}_ \\t\\n\\r]", "")))


def anaphoric(c: Column) -> Column:
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))
    told = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ANAPHORA]))
    for phrase in ANAPHORIC_PHRASES:
        told = told | low.contains(phrase)
    return told


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def percentage(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, digits))


def without(text: Column, parts: Column) -> Column:
    """The text without the given literal strings, trimmed."""
    return F.aggregate(parts, text, lambda t, u: strip(F.replace(t, u, F.lit(""))))


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n neighbours of an array."""
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
