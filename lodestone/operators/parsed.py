"""Parsed documents: summaries, references to tables and images, garbled text, quality verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import collapse

#: Controls, formats and private characters, other symbols, letters that betray a wrong decoding.
UNREADABLE = r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\p{Cf}\p{Co}\x{FFFD}]"
MOJIBAKE = "[ÃÂÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞß]"
SOLID = r"[^ \t\r\n\x0b\x0c\x1c-\x1f\x85\p{Z}]"
#: The limits of a document's quality.
DENSITY, GARBLED, EMPTY, DUPLICATE = 20.0, 0.20, 0.50, 0.40


def garbled_ratio(text: Column) -> Column:
    """The share of characters, white space apart, that look damaged."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    symbols = n(r"\p{So}") - n("[©®™]") - n(r"\x{FFFD}")
    solid = n(SOLID)
    return F.when(solid == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (n(UNREADABLE) + symbols + n(MOJIBAKE)) / solid))


def quality(pages: DataFrame, blocks: DataFrame, reject_garbled: bool = False) -> DataFrame:
    """doc_id, text_density, garbled_ratio, empty_page_ratio, duplicate_block_ratio, status, warnings, from pages
    (doc_id, page, text) and blocks (doc_id, text); repeats are counted by a hash of the text, case and spaces apart."""
    text = F.coalesce("text", F.lit(""))
    n = lambda p: F.sum(F.regexp_count(text, F.lit(p)))
    p = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"),
        F.sum(F.length(text)).alias("chars"),
        F.sum((F.trim(collapse(text)) == "").cast("int")).alias("blank"),
        n(SOLID).alias("solid"),
        (n(UNREADABLE) + n(r"\p{So}") - n("[©®™]") - n(r"\x{FFFD}") + n(MOJIBAKE)).alias("bad"),
    )
    b = blocks.where(collapse(F.col("text")) != "").groupBy("doc_id", F.xxhash64(F.lower(collapse(F.col("text")))).alias("h")).agg(F.count("*").alias("c"))
    b = b.groupBy("doc_id").agg(F.sum("c").alias("n_blocks"), F.sum(F.col("c") - 1).alias("again"))
    df = p.join(b, "doc_id", "left")
    density, ratio = F.col("chars") / F.col("n_pages"), F.when(F.col("solid") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("bad") / F.col("solid")))
    empty, again = F.col("blank") / F.col("n_pages"), F.coalesce(F.col("again") / F.col("n_blocks"), F.lit(0.0))
    marks = F.array_compact(F.array(F.when(ratio >= GARBLED, "GARBLE_TEXT_DETECTED"), F.when(density < DENSITY, "LOW_TEXT_DENSITY"), F.when(empty > 0, "EMPTY_PAGE_DETECTED"), F.when(again > DUPLICATE, "DUPLICATE_BLOCK_DETECTED")))
    status = (
        F.when((F.col("blank") == F.col("n_pages")) & F.coalesce(F.col("n_blocks") == 0, F.lit(True)), "rejected")
        .when(ratio >= GARBLED, "rejected" if reject_garbled else "needs_manual_review")
        .when((density < DENSITY) | (empty > EMPTY), "needs_manual_review")
        .when(F.size(marks) > 0, "warning")
        .otherwise("accepted")
    )
    return df.select("doc_id", F.round(density, 2).alias("text_density"), F.round(ratio, 4).alias("garbled_ratio"), F.round(empty, 4).alias("empty_page_ratio"), F.round(again, 4).alias("duplicate_block_ratio"), status.alias("status"), marks.alias("warnings"))


def summary(blocks: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_blocks, n_tables, n_images, n_headings of blocks (doc_id, page, kind)."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"), F.count("*").alias("n_blocks"), kind("table").alias("n_tables"), kind("image").alias("n_images"), kind("heading").alias("n_headings"))


def references(text: Column, kind: str) -> Column:
    """The ids that a chunk names as [IMAGE: id] or [TABLE: id], once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\[{kind}:[ ]*([^\]]+)\]"), F.lit(1)))


def located(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """chunks (doc_id, text) with image_refs and table_refs, and page and box of the one table or image (refs: doc_id,
    ref_id, page, box) that a chunk names, null where it names none or several."""
    df = chunks.withColumns({"image_refs": references(F.col("text"), "IMAGE"), "table_refs": references(F.col("text"), "TABLE")})
    both = F.concat("image_refs", "table_refs")
    return df.withColumn("ref_id", F.when(F.size(both) == 1, F.get(both, F.lit(0)))).join(refs, ["doc_id", "ref_id"], "left").drop("ref_id")


def caption_candidates(images: DataFrame, least: int = 10) -> DataFrame:
    """Images (width, height) of more than `least` pixels each way; those of unknown size pass."""
    big = lambda c: F.col(c).isNull() | (F.col(c) > least)
    return images.where(big("width") & big("height"))
