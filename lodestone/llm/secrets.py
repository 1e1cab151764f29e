"""Secrets: base patterns, and a battery of randomness tests over long tokens. Built-ins only.

A token is a maximal run of 20 or more characters of [A-Za-z0-9+/_=-] with letters and digits. Its encoding is inferred
from the characters it uses (hexadecimal, base 32, lower-case letters and digits, base 64), and three tests ask whether
it could be uniformly random over that alphabet: chi-squared of the character counts, the number of runs above and below
the middle of the alphabet, and the serial correlation of neighbours. The least of the three p-values, times three, is
the token's. Two further tests ask whether it could be written in words, as identifiers are: whether neighbours differ in
class (lower case, upper case, digit, sign) more often than CHANGE, and whether equal characters meet less often than
MEET, the rate of running text. The least of these, times two, is its second p-value. Short tokens have little power and
long ones much, so both are decided within classes of length, over all tokens of a class in the corpus, by the
Benjamini-Hochberg rule at rate RATE: of tokens that are written in words, so chosen, about RATE of the reported ones are
expected; and of random ones about RATE of the rejected ones are dropped. Reported as kind "random" is what is not taken
for words and could be random. The p-values are counted in bins of a tenth of a decade, so that the corpus-wide step is a
table of at most 2 * CLASSES * BINS rows whatever the input.

Kinds in order within a start: assign, access, hex (the base, always returned), random. Offsets count code points,
end exclusive; an assign span is the whole match.

Defined cases: a null or empty text has no spans; repeated rows and null ids give a row each; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import count_kind, joined, let, places, text_of

BASE = ("assign", "access", "hex")
#: The base patterns. Runs shorter than a kind's least length are no match of it.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Encodings by the first pattern that holds, with their alphabets in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("alnum", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base64", "", UPPER + LOWER + DIGITS + "+/-_"),
)
LENGTHS, BINS, RATE = (32, 48, 64, 128), 200, 0.05
#: Of identifiers, how often neighbours differ in class at most; of text in lower case, the sums of squared
#: and of cubed shares of characters.
CHANGE, MEET, MEET3 = 1 / 3, 0.06, 0.0052


def fields(**columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0, by Abramowitz and Stegun 26.2.17 (error under 1e-7)."""
    q = lambda y: F.exp(-y["z"] * y["z"] / 2) * 0.3989422804014327 * y["t"] * (0.319381530 + y["t"] * (-0.356563782 + y["t"] * (1.781477937 + y["t"] * (-1.821255978 + y["t"] * 1.330274429))))
    return let(z, lambda x: fields(z=x, t=1 / (1 + 0.2316419 * x)), q)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def p_value(token: Column) -> Column:
    """The token's p-value under "uniform over its inferred alphabet"."""

    def read(s: Column) -> Column:
        alphabet = F.when(F.lit(False), F.lit(""))
        for _, pattern, letters in ENCODINGS:
            alphabet = alphabet.when(s.rlike(pattern), F.lit(letters))
        return fields(s=s, a=alphabet, n=F.length(s).cast("double"), c=F.split(s, ""))

    def places_in(b: Column) -> Column:
        counts = F.transform(F.array_distinct(b["c"]), lambda c: b["n"] - F.length(F.replace(b["s"], c)))
        return fields(k=F.length(b["a"]).cast("double"), n=b["n"], sq=total(F.transform(counts, lambda c: c * c)), v=F.transform(b["c"], lambda c: F.instr(b["a"], c).cast("double") - 1))

    def halves(b: Column) -> Column:
        return fields(k=b["k"], n=b["n"], sq=b["sq"], v=b["v"], high=F.transform(b["v"], lambda x: (x * 2 >= b["k"]).cast("double")))

    def sums(b: Column) -> Column:
        v, high = b["v"], b["high"]
        runs = 1.0 + F.size(F.filter(high, lambda x, i: (i > 0) & (x != F.get(high, i - 1)))).cast("double")
        lag = total(F.transform(v, lambda x, i: x * F.coalesce(F.get(v, i + 1), F.get(v, F.lit(0)))))
        return fields(df=b["k"] - 1, n=b["n"], chi=F.greatest(b["sq"] * b["k"] / b["n"] - b["n"], F.lit(1e-9)), n1=total(high), runs=runs, s1=total(v), s2=total(F.transform(v, lambda x: x * x)), lag=lag)

    def moments(t: Column) -> Column:
        mean = 2 * t["n1"] * (t["n"] - t["n1"]) / t["n"] + 1
        return fields(df=t["df"], n=t["n"], chi=t["chi"], runs=t["runs"], mean=mean, s1=t["s1"], lag=t["lag"], spread=t["n"] * t["s2"] - t["s1"] * t["s1"])

    def scores(t: Column) -> Column:
        """(|z|, sides) of the three tests; a chi-squared below its mean counts as p = 1/2. 40 stands for "no spread at all"."""
        z = (F.pow(t["chi"] / t["df"], F.lit(1 / 3)) - (1 - 2 / (9 * t["df"]))) / F.sqrt(2 / (9 * t["df"]))
        var = (t["mean"] - 1) * (t["mean"] - 2) / (t["n"] - 1)
        zr = F.when(var > 1e-9, F.abs(t["runs"] - t["mean"]) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(40.0))
        zs = F.when(t["spread"] > 1e-9, F.abs(t["n"] * t["lag"] - t["s1"] * t["s1"]) / F.greatest(t["spread"], F.lit(1e-9)) * F.sqrt(t["n"])).otherwise(F.lit(40.0))
        return F.array(fields(z=F.greatest(z, F.lit(0.0)), sides=F.lit(1.0)), fields(z=zr, sides=F.lit(2.0)), fields(z=zs, sides=F.lit(2.0)))

    least = lambda tests: F.array_min(F.transform(tests, lambda x: x["sides"] * tail(F.least(x["z"], F.lit(37.0)))))
    return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), 3 * let(F.regexp_replace(token, "=+$", ""), read, places_in, halves, sums, moments, scores, least)))


def words_p(token: Column) -> Column:
    """The token's p-value under "written in words"."""
    sign = "+/_=-"
    classes = "a" * 26 + "A" * 26 + "0" * 10 + "-" * len(sign)

    def read(s: Column) -> Column:
        kinds = F.split(F.translate(s, LOWER + UPPER + DIGITS + sign, classes), "")
        low = F.translate(s, UPPER, LOWER)
        return fields(n=F.length(s).cast("double"), kinds=kinds, low=low, own=F.array_distinct(F.split(low, "")))

    def count(b: Column) -> Column:
        changes = F.size(F.filter(b["kinds"], lambda x, i: (i > 0) & (x != F.get(b["kinds"], i - 1)))).cast("double")
        pairs = total(F.transform(b["own"], lambda c: let((F.length(b["low"]) - F.length(F.replace(b["low"], c))).cast("double"), lambda k: k * (k - 1) / 2)))
        return fields(n=b["n"], changes=changes, pairs=pairs)

    def scores(t: Column) -> Column:
        n = t["n"]
        many = (t["changes"] - 0.5 - (n - 1) * CHANGE) / F.sqrt((n - 1) * (CHANGE * (1 - CHANGE)))
        var = n * (n - 1) * (n - 2) * (MEET3 - MEET**2) + n * (n - 1) / 2 * (MEET - MEET**2)
        few = (n * (n - 1) / 2 * MEET - t["pairs"] - 0.5) / F.sqrt(var)
        return F.array(many, few)

    least = lambda zs: F.array_min(F.transform(zs, lambda z: tail(F.least(F.greatest(z, F.lit(0.0)), F.lit(37.0)))))
    return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), 2 * let(F.regexp_replace(token, "=+$", ""), read, count, scores, least)))


def bin_of(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-10 * F.log10(p))).cast("int")


def length_class(token: Column) -> Column:
    out = F.when(F.length(token) < LENGTHS[0], F.lit(0))
    for i, most in enumerate(LENGTHS[1:]):
        out = out.when(F.length(token) < most, F.lit(i + 1))
    return out.otherwise(F.lit(len(LENGTHS)))


def testable(token: Column) -> Column:
    """Tokens that the battery sees: with a letter and a digit, and 20 characters without padding."""
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.length(F.regexp_replace(token, "=+$", "")) >= 20)


def thresholds(docs: DataFrame, rate: float = RATE) -> dict[tuple[str, int], int]:
    """The least rejected bin by test ("random" or "words") and class of length. The driver gets one row each."""
    tokens = docs.select(F.explode(F.regexp_extract_all(text_of(), F.lit(TOKEN), F.lit(0))).alias("_k")).where(testable(F.col("_k")))
    tests = F.array(*[F.struct(F.lit(k).alias("test"), bin_of(p(F.col("_k"))).alias("bin")) for k, p in (("random", p_value), ("words", words_p))])
    bins = tokens.select(length_class(F.col("_k")).alias("cls"), F.inline(tests)).groupBy("test", "cls", "bin").count()
    by = Window.partitionBy("test", "cls")
    ranked = bins.select("test", "cls", "bin", F.sum("count").over(by).alias("m"), F.sum("count").over(by.orderBy(F.desc("bin"))).alias("k"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10.0) <= rate * F.col("k") / F.col("m"))
    return {(r["test"], r["cls"]): r["bin"] for r in passed.groupBy("test", "cls").agg(F.min("bin").alias("bin")).collect()}


def is_random(token: Column, cuts: dict[tuple[str, int], int]) -> Column:
    """Not taken for words and not rejected as random, by the thresholds."""
    cls = length_class(token)
    most = lambda test: F.coalesce(*[F.when(cls == c, F.lit(b)) for (t, c), b in sorted(cuts.items()) if t == test], F.lit(BINS + 1))
    return F.when(testable(token), (bin_of(words_p(token)) >= most("words")) & (bin_of(p_value(token)) < most("random"))).otherwise(F.lit(False))


def find(docs: DataFrame, *keep: str, rate: float = RATE) -> DataFrame:
    """The columns in keep, n_assign, n_access, n_hex, base_sha256 and spans."""
    cuts = thresholds(docs, rate)
    df = docs.select(*keep, text_of().alias("_t"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}
    df = df.select("*", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()])
    df = df.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("_t", p, -1)).alias(f"g_{k}") for k, p in patterns.items()], F.when(F.size("m_assign") > 0, F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2))).alias("v_assign"))
    keeps = {"assign": lambda x: F.length(x["more"]) >= 6, "random": lambda x: is_random(x["m"], cuts)}
    parts = []
    for rank, k in enumerate(patterns):
        at = places(F.col(f"m_{k}"), F.col(f"g_{k}"), F.col("v_assign") if k == "assign" else None)
        parts.append(F.transform(F.filter(at, keeps[k]) if k in keeps else at, span(k, rank)))
    df = df.select(*keep, F.sort_array(F.concat(*parts)).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return df.select(*keep, *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def span(kind: str, rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
