"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most CAP times its own words; what the cap leaves over is
shared again by weight among the rest. Within a source a document of 2^c to 2^(c+1) - 1 words has weight FLOOR + c, as
longer texts bear more context: it asks for level * weight copies, at most CAP, the level being such that the copies of
all documents have the target's words. So copies differ from document to document. Their whole part is certain; the
fraction p is an inclusion probability. Documents are ranked by the random odds u / (1 - u) over the inclusion odds
p / (1 - p), and taken in that order until the source's words are full; the document that crosses the line gives only
the words that fit. u is a hash of the document's id, so reruns agree.

The order is cut without sorting a source: logarithms of ranks fall into bins of 1 / STEPS, the words of a bin are summed
per source, and only the documents of the one bin in which the line falls, at most about one in 4 * STEPS of a class,
are ordered against each other. Sources and (source, class) pairs are tables of a row each, which are sorted in one task.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; repeated rows are documents of their own with equal ranks, ordered by size; extra columns are ignored by `mix`
and kept by `take`; an empty table gives an empty one; if all sizes are 0 so are all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, passing, settle, sized, text_of

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
FLOOR = 8
STEPS = 512
TINY = 1e-12


def targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size), a row for each source. Filling goes by cap over weight:
    with sources in that order, the first j are capped as long as the level of the rest passes the next one's cap."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    df = sizes.withColumn("weight", weight)
    whole = Window.partitionBy().orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap
    df = df.withColumn("level", (F.sum("source_size").over(whole) - capped) / F.sum("weight").over(rest))
    df = df.withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * cap)
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("level", final)
    return df.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("source_size") * cap).cast("double").alias("target"))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the id: 52 bits of its MD5."""
    bits = F.conv(F.left(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(13)), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def odds(p: Column) -> Column:
    return p / (1 - p)


def rank(u: Column, p: Column) -> Column:
    """The Pareto rank: random odds over inclusion odds."""
    return odds(u) / odds(F.greatest(F.least(p, F.lit(1 - TINY)), F.lit(TINY)))


def length_class(size: Column) -> Column:
    """floor(log2(size)), from the number of its binary digits."""
    return F.length(F.bin(size)) - 1


def copies(classes: DataFrame) -> DataFrame:
    """source, cls, copies, from (source, target, cls, words), a row for each class of a source. Heavier classes reach
    CAP first: with these in front, the first j are capped as long as the level of the rest passes the next one's cap."""
    by = Window.partitionBy("source")
    order = by.orderBy(F.desc("cls"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    weight = F.col("cls") + FLOOR
    level = (F.col("target") - F.coalesce(F.sum("words").over(before), F.lit(0)) * CAP) / F.sum(F.col("words") * weight).over(rest)
    df = classes.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") * weight <= CAP, -F.col("cls"))).over(by)
    df = df.withColumn("_first", first).withColumn("_level", F.max(F.when(-F.col("cls") == F.col("_first"), F.col("_level"))).over(by))
    return df.select("source", "cls", "words", F.when(F.col("_first").isNull() | (-F.col("cls") < F.col("_first")), F.lit(CAP)).otherwise(F.least(F.col("_level") * weight, F.lit(CAP))).alias("copies"))


def of_source(df: DataFrame, more: DataFrame, *tests: Column) -> DataFrame:
    """df with what more says of its source, null where it says nothing; a null source is a source."""
    more = more.withColumnRenamed("source", "_s")
    on = df["source"].eqNullSafe(F.col("_s"))
    for t in tests:
        on = on & t
    return df.join(more, on, "left").drop("_s")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each document."""
    with passing(docs.sparkSession) as keep:
        sizes = keep(settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))))
        sizes = sizes.withColumn("cls", F.when(F.col("size") > 0, length_class(F.col("size"))))
        classes = settle(sizes.groupBy("source", "cls").agg(F.sum("size").alias("words")))
        goal = settle(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"))))
        parts = settle(copies(of_source(classes.where("words > 0"), goal)))
        whole = F.floor("copies").cast("long")
        sure = parts.groupBy("source").agg(F.sum(whole * F.col("words")).alias("sure"))
        goal = of_source(goal, sure).withColumn("left", F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - F.coalesce("sure", F.lit(0)))).drop("sure")
        goal = keep(settle(goal))
        parts = keep(settle(parts.select("source", F.col("cls").alias("_c"), whole.alias("whole"), (F.col("copies") - whole).alias("p"))))
        rich = of_source(of_source(sizes, sized(goal)), sized(parts), F.col("cls") == F.col("_c")).drop("_c").withColumn("whole", F.coalesce("whole", F.lit(0).cast("long")))
        rich = rich.withColumn("q", F.when((F.col("p") > TINY) & (F.col("left") > 0) & (F.col("size") > 0), rank(uniform(F.col("doc_id")), F.col("p")))).withColumn("bin", F.floor(F.log("q") * STEPS))
        bins = rich.where("bin is not null").groupBy("source", "bin", "left").agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
        line = bins.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
        line = keep(settle(line.select("source", F.col("bin").alias("line"), (F.col("left") - F.col("before")).alias("room"))))
    rich = of_source(rich, sized(line))
    on_line = F.col("bin") == F.col("line")
    order = Window.partitionBy("source").orderBy("q", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = ["doc_id", "source", "size", "source_size", "target"]
    sure = F.col("whole") * F.col("size")
    whole_too = F.coalesce((F.col("bin") < F.col("line")) | (F.col("bin").isNotNull() & F.col("line").isNull()), F.lit(False))
    rest = rich.where(~F.coalesce(on_line, F.lit(False))).select(*out, (sure + F.when(whole_too, F.col("size")).otherwise(0)).alias("taken"))
    cut = rich.where(on_line).withColumn("used", F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.select(*out, (sure + F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("used")))).alias("taken"))
    return rest.unionByName(cut)


def take(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, all columns kept: a row for each whole copy, and for a copy in part a row whose text
    ends with the last word taken. Rows that agree in id, source and size share equally, rounded down, what the mix takes
    of them; only where the line falls within them does that leave words out, fewer than their number."""
    with passing(docs.sparkSession) as keep:
        taken = mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.floor(F.sum("taken") / F.count("*")).alias("_taken"))
        taken = sized(keep(settle(taken.where("_taken > 0"))))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_own_id"), F.col("source").cast("string").alias("_own_source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("_own_size"))
    both = rows.join(taken, F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_source").eqNullSafe(F.col("_source")) & (F.col("_own_size") == F.col("_size")))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size"))))
    both = both.select("_row", "_size", "_taken", copy.alias("_copy"))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    spans = F.slice(F.regexp_extract_all(F.col("_row")["text"], F.lit(r"(?s)[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), words)
    text = F.when(words < F.col("_size"), F.array_join(spans, "")).otherwise(F.col("_row")["text"])
    return both.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names])
