"""Quality rules as a short-circuit cascade, in built-in expressions only.

Each rule is a condition under which a text is rejected. On a bounded sample the cascade measures what each rule
costs and how much of the sample it rejects, then asks the rules in order of rejection per cost; the first rule that
holds ends the row's evaluation, and the statistics that only later rules read are not computed for it. A row's verdict
is the OR of the rules, so the measured order moves time and never the result; which rule ended a row is not returned.
`reasons` names all rules that hold, for those who want to know.

`apply_rules` returns the statistics of the base rule for every row, so there the base rule costs nothing more and is
asked first; the statistics of the other rules are computed for the rows that it passes, in the cascade's order.

Defined cases: a null or empty text has no words (all counts 0) and fails the base rule; repeated rows and null ids
give a row each; an empty table gives an empty one; extra columns are ignored by `apply_rules`, kept by `keep_good`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, let, text_of, words_of

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 20_000
SYMBOLS = r"[#*$%&|<>]"


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_runs(words: Column) -> Column:
    """Words equal to the one before."""
    return let(words, lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long"))


def window_hashes(words: Column, k: int = 5) -> Column:
    """A 64-bit hash of each window of k words."""
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return let(words, lambda w: F.when(F.size(w) >= k, hashes(w)).otherwise(F.array().cast("array<bigint>")))


def n_repeat_words(hashes: Column, k: int = 5) -> Column:
    """Words in windows whose hash occurs twice or more, the first included. Only where a hash repeats are windows
    sorted by (hash, place): equal ones are then neighbours, and each marked place adds the words up to the next marked
    place, k at most."""
    pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twin = lambda s, x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
    marked = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: twin(s, x, j)), lambda x: x["i"]))
    spread = lambda m: F.aggregate(F.transform(m, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(m, j + 1) - p, F.lit(k)))), F.lit(0), lambda a, x: a + x).cast("long")
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(h, pairs, marked, spread)))


def features(text: Column, words: Column) -> dict[str, Column]:
    """Every statistic that a rule may read, as expressions over a text and its words."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": n_dup_lines(text),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_bang": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_runs": n_runs(words),
        "n_repeat_words": n_repeat_words(window_hashes(words)),
    }


#: Statistics that apply_rules() returns.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def split_once(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep, _t (the text) and _w (its words)."""
    return docs.select(*keep, text_of().alias("_t")).select(*keep, "_t", words_of(F.col("_t")).alias("_w"))


@dataclass(frozen=True)
class Rule:
    """rejects: from the statistics by name to the condition under which a text is rejected."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


def base_failed(x: dict[str, Column]) -> Column:
    return (x["n_words"] < 10) | (F.lit(100) * x["n_repeat_words"] > F.lit(20) * x["n_words"])


def web_rules() -> list[Rule]:
    """The base rule and the further ones. Shares are of words, or of the characters in words."""
    n = lambda x: F.greatest(x["n_words"], F.lit(1))
    return [
        Rule("base", base_failed),
        Rule("symbols", lambda x: x["n_symbols"] > 0.2 * n(x)),
        Rule("shouting", lambda x: x["n_upper"] > 0.5 * F.greatest(x["word_chars"], F.lit(1))),
        Rule("exclaiming", lambda x: x["n_bang"] > 0.3 * n(x)),
        Rule("stutter", lambda x: x["n_runs"] > 0.3 * n(x)),
        Rule("lines", lambda x: x["n_dup_lines"] * 8 > n(x)),
        Rule("word_length", lambda x: (x["word_chars"] < 2 * n(x)) | (x["word_chars"] > 200 * n(x))),
    ]


def estimate(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds beyond splitting the texts) on the first `rows` rows that an incremental take
    finds, each rule over the text itself. The driver holds `rows` texts of at most `chars` characters; they set the
    order of the rules only."""
    taken = docs.select(F.left(text_of(), F.lit(chars)).alias("_t")).take(rows)
    if not taken:
        return [(r, 0.0, 1.0) for r in rules]
    sample = docs.sparkSession.createDataFrame(taken, "_t string").coalesce(1).cache()
    sample.count()
    x = features(F.col("_t"), words_of(F.col("_t")))

    def ask(test: Column) -> tuple[float, float]:
        t = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(test, F.lit(False)).cast("int"))).first()[0]
        return float(share or 0), time.perf_counter() - t

    idle = min(ask(x["n_words"] < 0)[1] for _ in range(2))
    out = [(r, *min((ask(r.rejects(x)) for _ in range(2)), key=lambda y: y[1])) for r in rules]
    sample.unpersist()
    return [(r, share, max(seconds - idle, 1e-4)) for r, share, seconds in out]


def order(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, the best first; ties by name."""
    return [r for r, _, _ in sorted(estimates, key=lambda e: (-e[1] / max(e[2], 1e-9), e[0].name))]


def cascade(rules: list[Rule], x: dict[str, Column]) -> Column:
    """Whether a rule rejects the row; CASE ends at the first that holds and computes nothing that only later ones read."""
    out = F.when(F.lit(False), F.lit(True))
    for r in rules:
        out = out.when(r.rejects(x), F.lit(True))
    return out.otherwise(F.lit(False))


def reasons(docs: DataFrame, *keep: str, rules: list[Rule] | None = None) -> DataFrame:
    """The columns in keep and rules, the names of all rules that reject the row, in the order they are given."""
    df = split_once(docs, *keep)
    x = features(F.col("_t"), F.col("_w"))
    names = F.array(*[F.when(r.rejects(x), F.lit(r.name)) for r in rules or web_rules()])
    return df.select(*keep, F.array_compact(names).alias("rules"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, all columns kept. Statistics are computed as the cascade asks for them,
    so a text that an early rule rejects pays for no later one."""
    ranked = order(estimate(docs, rules or web_rules(), rows))
    text = text_of()
    return docs.where(~cascade(ranked, features(text, words_of(text))))


def apply_rules(docs: DataFrame, *keep: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns in keep, the statistics in SHOWN, base_failed and kept."""
    base, *others = web_rules()
    ranked = order(estimate(docs, others, rows))
    every = features(F.col("_t"), F.col("_w"))
    df = split_once(docs, *keep).select(*keep, "_t", "_w", *[every[k].alias(k) for k in SHOWN])
    x = {k: F.col(k) if k in SHOWN else c for k, c in every.items()}
    return df.select(*keep, *SHOWN, base.rejects(x).alias("base_failed"), (~cascade([base, *ranked], x)).alias("kept"))
