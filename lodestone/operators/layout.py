"""Layout over blocks or lines of a page: block types, reading order, repeated headers, captions, quality gates."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import bound, collapse, running

# What marks a block's type, the first that applies in the order of block_type.
CAPTION = r"(?i)^(图|表|figure|fig\.?|table)[ ]*[0-9]*[ ]*[:：.、]"
CODE = r"[{};]|=>|def\s+\w+\(|class\s+\w+"
FORMULA = r"[=+\-*/∑∫√≤≥≈]"
LIST = r"^([0-9]+(\.[0-9]+)*[.)]?|[一二三四五六七八九十]+[、.)]|[-*•▪◦]|\(?[0-9]+[.)]) "
#: Symbols that count as readable beside letters, digits and punctuation.
READABLE = r"[\p{L}\p{N}\p{P}+=<>$%^|~`]"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, text of lines that are not blank."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where(F.length(collapse(F.col("text"))) > 0)


def block_type(text: Column, bold: Column | None = None, size: Column | None = None) -> Column:
    """caption, code, formula, list, heading (bold or of size 14 up) or paragraph."""
    c = collapse(text)
    heading = F.coalesce(F.lit(False) if bold is None else bold, F.lit(False)) | F.coalesce(F.lit(False) if size is None else size >= 14, F.lit(False))
    formula = F.regexp_count(c, F.lit(FORMULA)) >= F.greatest(F.lit(2), F.floor(F.length(c) / 8))
    return F.when(c.rlike(CAPTION), "caption").when(c.rlike(CODE), "code").when(formula, "formula").when(c.rlike(LIST), "list").when(heading, "heading").otherwise("paragraph")


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks of (doc_id, page, x0, y0) with their place in the document."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0")))


def repeated_edges(edges: DataFrame, pages: int = 2) -> DataFrame:
    """doc_id, norm, n_pages: texts of (doc_id, page, text) in a header or footer band that stand on several pages, case,
    white space and digits apart. Distinct pages are counted after a partial count, so a common line moves few rows."""
    norm = F.regexp_replace(F.lower(collapse(F.col("text"))), "[0-9]+", "#")
    one = edges.select("doc_id", "page", norm.alias("norm")).where("norm != ''").distinct()
    return one.groupBy("doc_id", "norm").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= pages)


#: What a page number in a footer looks like, and the bands as shares of a page's height.
PAGE_NUMBER = r"^(?:(?i:page)? ?[0-9]+(?: ?/ ?[0-9]+)?|第 ?[0-9]+ ?(?:页|/ ?[0-9]+)?)$"
BANDS = {"header": 0.12, "footer": 0.12}


def prefix(norm: Column, share: float) -> Column:
    """What a text must share with one that is similar by `share`, twice the common characters over all characters: of its
    characters, numbered by occurrence and in one fixed order, the first ones, by the prefix filter of that similarity."""
    starts = lambda c: running(F.transform(c, lambda x, i: F.when((i == 0) | (x != F.get(c, i - 1)), i).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
    numbered = lambda c: bound(starts(c), lambda s: F.transform(c, lambda x, i: F.struct((F.get(s, i) - i).alias("turn"), x.alias("c"))))
    n = F.length(norm)
    first = n - F.ceil(n * share / (2 - share) - 1e-9).cast("int") + 1
    return F.slice(F.sort_array(bound(F.sort_array(F.filter(F.split(norm, ""), lambda x: x != "")), numbered)), F.lit(1), first)


def alike(keys: DataFrame, share: float) -> DataFrame:
    """doc_id, band, a, b: texts of keys (doc_id, band, norm; distinct) whose longest matching blocks hold `share` of their
    characters, in either order. Candidates share an element of their prefixes, so no group emits all its pairs."""

    @F.pandas_udf("boolean")
    def matches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() >= share for x, y in zip(a, b)], dtype=bool)

    rows = keys.select("doc_id", "band", "norm", F.explode(prefix(F.col("norm"), share)).alias("e"))
    left, right = rows.withColumnRenamed("norm", "a"), rows.withColumnRenamed("norm", "b")
    fits = F.expr("a <> b") & (F.least(F.length("a"), F.length("b")) * 2 >= share * (F.length("a") + F.length("b")) - 1e-9)
    return left.join(right, ["doc_id", "band", "e"]).where(fits).select("doc_id", "band", "a", "b").distinct().where(matches.asNondeterministic()("a", "b"))


def page_bands(blocks: DataFrame, share: float | None = 0.85, pages: int = 2) -> DataFrame:
    """blocks (doc_id, page, y0, y1, height, text) with kind (header, footer or body) and reason: texts in a band that stand
    on several pages, case and white space apart, or are alike by `share` to such (None: equal ones only), and page
    numbers in the footer of a document of several pages. Blocks without text, place or height are body; footer wins
    over header. Distinct texts of a band are compared, so a line on every page costs one."""
    ratio = {"header": F.col("y0") / F.nullif("height", F.lit(0)), "footer": (F.col("height") - F.col("y1")) / F.nullif("height", F.lit(0))}
    norm = F.lower(collapse(F.col("text")))
    tagged = blocks.withColumn("_norm", norm).withColumns({f"_{b}": F.coalesce((ratio[b] <= most) & (F.col("_norm") != ""), F.lit(False)) for b, most in BANDS.items()})
    seen = tagged.select("doc_id", "page", F.col("_norm").alias("norm"), F.explode(F.array_compact(F.array(*[F.when(F.col(f"_{b}"), F.lit(b)) for b in BANDS]))).alias("band")).distinct()
    near = seen.select("doc_id", "band", F.col("norm").alias("a"), F.col("norm").alias("b")).distinct()
    if share is not None:
        near = near.unionByName(alike(near.select("doc_id", "band", F.col("a").alias("norm")), share))
    key = ["doc_id", "band"]
    repeated = near.join(seen.withColumnRenamed("norm", "b"), [*key, "b"]).groupBy(*key, "a").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= pages)
    marked = near.join(repeated.select(*key, F.col("a").alias("b")), [*key, "b"], "left_semi").select(*key, F.col("a").alias("_norm")).distinct()
    for b in BANDS:
        tagged = tagged.join(marked.where(F.col("band") == b).select("doc_id", "_norm", F.lit(True).alias(f"_is_{b}")), ["doc_id", "_norm"], "left")
    several = blocks.groupBy("doc_id").agg((F.min("page") < F.max("page")).alias("_several"))
    tagged = tagged.join(several, "doc_id", "left")
    yes = {b: F.coalesce(F.col(f"_{b}") & F.col(f"_is_{b}"), F.lit(False)) for b in BANDS}
    number = F.coalesce(F.col("_footer") & F.col("_several") & collapse(F.col("text")).rlike(PAGE_NUMBER), F.lit(False))
    kind = F.when(yes["footer"] | number, "footer").when(yes["header"], "header").otherwise("body")
    reason = F.when(yes["footer"], "repeated_text").when(number, "page_number").when(yes["header"], "repeated_text")
    return tagged.select(*[F.col(f"`{c}`") for c in blocks.columns], kind.alias("kind"), reason.alias("reason"))


def captions(images: DataFrame, blocks: DataFrame, reach: float = 140.0) -> DataFrame:
    """images (doc_id, page, image_id, y1) with the nearest caption block of the page within reach; join keys are the
    document and the page, so a group is one page."""
    c = blocks.where("kind = 'caption'").select("doc_id", "page", F.col("y0").alias("_y"), F.col("text").alias("caption"))
    near = images.join(c, ["doc_id", "page"], "left").withColumn("_d", F.when(F.abs(F.col("_y") - F.col("y1")) <= reach, F.abs(F.col("_y") - F.col("y1"))))
    pick = F.row_number().over(Window.partitionBy("doc_id", "page", "image_id").orderBy(F.asc_nulls_last("_d"), "_y", "caption"))
    return near.withColumn("_n", pick).where("_n = 1").withColumn("caption", F.when(F.col("_d").isNotNull(), F.col("caption"))).drop("_n", "_d", "_y")


def continued_tables(tables: DataFrame) -> DataFrame:
    """doc_id, table_id, next_id: tables of equal width on a page and the next."""
    n = tables.select("doc_id", (F.col("page") - 1).alias("page"), "cols", F.col("table_id").alias("next_id"))
    return tables.join(n, ["doc_id", "page", "cols"]).select("doc_id", "table_id", "next_id")


def readable(text: Column, pages: Column, share: float = 0.8, least: int = 20) -> tuple[Column, Column]:
    """Share of readable characters among those not blank, and whether share and characters per page suffice."""
    effective = F.regexp_count(text, F.lit(READABLE))
    ratio = effective / F.greatest(F.regexp_count(text, F.lit(r"[^ \t\r\n]")), F.lit(1))
    return F.round(ratio, 6), (ratio >= share) & (effective / pages >= least)
