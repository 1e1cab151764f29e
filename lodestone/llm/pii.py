"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score. Built-ins only.

Kinds, in their order within a start: email, ip, card (Luhn), phone, iban (mod 97), ssn, birth (a date). The first four
are the base and are always returned; a span of the others is returned if its score reaches KEEP, so a bare number or
date needs a word of its kind among the CONTEXT characters before it, and a checksum suffices without one. Scores are in
hundredths and are returned with the spans. Words count whole and in either case of A to Z. Offsets count code points,
end exclusive. A pattern's matches and the text between them come from one extract and one split by the same pattern, so
places are running sums of lengths; context is read from blocks of the text. So the time is near linear however dense
the matches are.

The iban pattern matches the first four characters alone and looks ahead at the longest run that may follow, so that
no number hides behind another. A number may end at that run's end or before a space in it: its span is the longest
that mod 97 confirms, and one that lies within an earlier number is a part of it.

The patterns take whole runs: a possessive quantifier and "not after a character of the run, unless a match has just
ended" change no match of the plain form and keep the time linear in the text.

Defined cases: a null or empty text has no spans; repeated rows and null ids give a row each; extra columns are kept
by `redact` and ignored by `find`; an empty table gives an empty one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import blocks, count_kind, cut, joined, let, places, running, text_of

BYTE = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kind, pattern, words that raise its score when they stand in the CONTEXT characters before it.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("mail", "email", "contact", "write")),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ("ip", "host", "server", "address")),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", ("card", "visa", "credit", "payment")),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("phone", "call", "tel", "telephone", "mobile")),
    ("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])))", ("iban", "account", "bank", "transfer")),
    ("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", ("ssn", "social", "security")),
    ("birth", r"(?<![A-Za-z0-9_])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![A-Za-z0-9_])", ("born", "birth", "birthday", "dob")),
)
BASE = ("email", "ip", "card", "phone")
CHECKSUMMED = ("ip", "card", "iban")
CONTEXT, BARE, CHECKED, NEAR, KEEP = 40, 40, 80, 20, 60


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Doubling every second digit from the right, the digit sums add up to a multiple of ten."""
    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).try_cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """The account number with its first four characters moved to the end, letters read as 10 to 35, leaves 1."""
    s = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.left(s, F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    d = digits(m)
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "ssn":
        return ~d.rlike("^(000|666|9)|^...00|0000$")
    return F.lit(True)


def accounts(heads: Column) -> Column:
    """places() of the iban pattern, with what it looked ahead at, as places of the confirmed numbers: each ends where
    the longest confirmed one does; those within an earlier one go."""

    def longest(x: Column) -> Column:
        parts = F.split(F.concat(x["m"], x["more"]), "\\x20", -1)
        ends = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
        m = F.get(F.filter(ends, lambda e: (F.length(F.replace(e, F.lit(" "))) >= 12) & mod97(e)), F.lit(0))
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(m)).alias("end"), m.alias("m"))

    def outer(x: Column) -> Column:
        reach = running(F.transform(x, lambda y: F.coalesce(y["end"], F.lit(0))), lambda a, b: F.greatest(a, b))
        return let(reach, lambda r: F.filter(x, lambda y, i: y["end"] > F.coalesce(F.get(r, i - 1), F.lit(0))))

    return let(F.transform(heads, longest), outer)


def found(kind: str, near: tuple[str, ...], rank: int) -> Column:
    """The spans struct(start, rank, end, kind, score) that pass, from columns m_<kind> (all matches), g_<kind> (what
    stands between them), r_iban and _b (the blocks of a space and the text)."""
    m, g = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    at = accounts(places(m, g, F.col("r_iban"))) if kind == "iban" else places(m, g)

    def spans(b: Column) -> Column:
        def scored(x: Column) -> Column:
            window = F.translate(cut(b, F.greatest(x["start"] - CONTEXT, F.lit(0)), x["start"] + 1), string.ascii_uppercase, string.ascii_lowercase)
            score = F.lit(CHECKED if kind in CHECKSUMMED else BARE) + F.when(window.rlike("[^a-z](?:" + "|".join(near) + ")(?:[^a-z]|$)"), NEAR).otherwise(0)
            return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.when(valid(kind, x["m"]), score).alias("score"))

        return F.filter(F.transform(at, scored), lambda x: x["score"] >= (0 if kind in BASE else KEEP))

    return F.when(F.size(m) == 0, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:int>>")).otherwise(let(F.col("_b"), spans))


def spans(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep, _t (the text) and spans: array of struct(start, rank, end, kind, score) by start, rank."""
    df = docs.select(*keep, text_of().alias("_t"))
    df = df.select("*", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p, _ in KINDS])
    some = [F.size(f"m_{k}") > 0 for k, _, _ in KINDS]
    iban = F.regexp_extract_all("_t", F.lit(dict((k, p) for k, p, _ in KINDS)["iban"]), F.lit(1))
    df = df.select("*", *[F.when(s, F.split("_t", p, -1)).alias(f"g_{k}") for s, (k, p, _) in zip(some, KINDS)], F.when(F.size("m_iban") > 0, iban).alias("r_iban"), F.when(F.greatest(*[F.size(f"m_{k}") for k, _, _ in KINDS]) > 0, blocks(F.concat(F.lit(" "), "_t"))).alias("_b"))
    return df.select(*keep, "_t", F.sort_array(F.concat(*[found(k, near, i) for i, (k, _, near) in enumerate(KINDS)])).alias("spans"))


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """spans() with the counts of the base kinds, base_sha256, the spans and their scores as strings."""
    df = spans(docs, *keep)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE]
    return df.select(*keep, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by <kind>; spans that begin inside an earlier one are taken with it. A
    null text stays null; all other columns are kept as they are."""
    names = docs.columns
    t, s = "_pii_text", "_pii_spans"
    df = docs.withColumn("_pii_row", F.struct(*[F.col(f"`{c}`") for c in names]))
    df = spans(df, "_pii_row").withColumnsRenamed({"_t": t, "spans": s})

    def rewrite(v: Column) -> Column:
        """Of v.s (spans), v.r (how far each and those before reach) and v.b (blocks)."""
        fresh = F.filter(F.transform(v["s"], lambda x, i: F.struct(F.coalesce(F.get(v["r"], i - 1), F.lit(0)).alias("a"), x["start"].alias("z"), x["kind"].alias("kind"))), lambda x: x["z"] >= x["a"])
        last = F.element_at(v["r"], -1)
        return F.concat(F.array_join(F.transform(fresh, lambda x: F.concat(cut(v["b"], x["a"], x["z"]), F.lit("<"), x["kind"], F.lit(">"))), ""), cut(v["b"], last, v["n"]))

    reach = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    done = let(F.struct(F.col(s).alias("s"), reach.alias("r"), blocks(F.col(t)).alias("b"), F.length(t).alias("n")), rewrite)
    text = F.when(F.size(s) == 0, F.col("_pii_row")["text"]).otherwise(done)
    return df.select(*[text.alias(c) if c == "text" else F.col("_pii_row")[c].alias(c) for c in names])
