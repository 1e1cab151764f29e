"""Column helpers over text: tokens, normalising, titles, summaries, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token keeps dotted and dashed names whole; else it is a run of letters, digits and underscores.
TOKEN = r"[\p{L}\p{N}_]+(?:[.-][\p{L}\p{N}_]+)*"
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-cased tokens in order, those of at least `least` characters."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= least)


def collapse(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\x0b\x0c]+", " "))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 3))), F.lit("..."))).otherwise(text)


def bound(x: Column, step) -> Column:
    """step(x) with x computed once, however often step reads it."""
    return F.get(F.transform(F.array(x), step), F.lit(0))


def running(values: Column, step, neutral: Column) -> Column:
    """Running results of an associative step over an array: each round combines an entry with the one 1, 2, 4, ... places
    before, so n entries cost n log n and no array grows entry by entry."""

    def scan(v: Column) -> Column:
        rounds = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(v))
        return F.aggregate(rounds, v, lambda acc, d: F.zip_with(acc, F.concat(F.array_repeat(neutral, d), F.slice(acc, F.lit(1), F.size(acc) - d)), lambda x, before: step(before, x)))

    return bound(values, scan)


def distinct_ci(values: Column, most: int = 1_000_000) -> Column:
    """The first of each value, case apart, in order, blanks dropped, at most `most`. Equal values are neighbours once
    (value, place) pairs are sorted, so n values cost n log n."""

    def first(v: Column) -> Column:
        pairs = F.sort_array(F.transform(v, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"))))
        fresh = lambda s: F.filter(s, lambda x, j: (j == 0) | (x["low"] != F.get(s, j - 1)["low"]))
        at = bound(pairs, lambda s: F.sort_array(F.transform(fresh(s), lambda x: x["i"])))
        return F.transform(F.slice(at, 1, most), lambda i: F.get(v, i))

    return bound(F.filter(values, lambda x: F.trim(x) != ""), first)


def ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams in order, from the characters as an array, so time is linear in the text."""
    grams = lambda c: F.transform(F.slice(c, 1, F.size(c) - (n - 1)), lambda _, i: F.concat(*[F.get(c, i + j) for j in range(n)]))
    return F.when(F.length(text) >= n, bound(F.split(text, ""), grams)).otherwise(F.array().cast("array<string>"))


def title(text: Column) -> Column:
    """The first heading line, else the first line of at most 60 characters that does not end a sentence, else Untitled."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    heading = F.get(F.filter(lines, lambda x: x.rlike("^#{1,6} ")), F.lit(0))
    short = F.get(F.filter(F.slice(lines, 1, 5), lambda x: (F.length(x) <= 60) & ~x.rlike("[.,]$")), F.lit(0))
    return F.coalesce(F.regexp_replace(heading, "^#+ ", ""), short, F.lit("Untitled"))


def summary(text: Column, sentences: int = 3, most: int = 240) -> Column:
    """The first sentences, cut to `most` characters."""
    parts = F.regexp_extract_all(collapse(text), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return ellipsis(F.trim(F.array_join(F.slice(parts, 1, sentences), "")), most)


#: What is masked, in order.
MASKS = (
    (r"[Bb]earer [A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (r"sk-[A-Za-z0-9]{16,}|AKIA[A-Z0-9]{16}", "[API_KEY]"),
    (r"(password|passwd|secret|token|api_key)(\s*[:=]\s*)\S+", "$1$2[REDACTED]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
)


def mask(text: Column) -> Column:
    for pattern, by in MASKS:
        text = F.regexp_replace(text, pattern, by)
    return text
