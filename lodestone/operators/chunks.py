"""Chunkers and chunk statistics: a document's row becomes chunk rows by built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import WORD, bound, running


def sliding_window(docs: DataFrame, window: int = 500, step: int = 400) -> DataFrame:
    """doc_id, chunk_index, char_start, char_end, text: windows in characters, the last one ends with the text."""
    n = F.length("text")
    count = F.when(n <= window, F.lit(1)).otherwise(F.ceil((n - window) / F.lit(step)) + 1)
    rows = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select("doc_id", "chunk_index", start.alias("char_start"), F.least(start + window, n).alias("char_end"), F.substring("text", start + 1, F.lit(window)).alias("text"))


def identified(chunks: DataFrame) -> DataFrame:
    """chunks with content_hash and chunk_id = hash(doc)[:8] _ index(4 digits) _ hash(text)[:8]."""
    hashed = F.sha2("text", 256)
    doc = F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(8))
    return chunks.withColumns({"content_hash": hashed, "chunk_id": F.concat_ws("_", doc, F.lpad(F.col("chunk_index").cast("string"), 4, "0"), F.left(hashed, F.lit(8)))})


def headed_sections(docs: DataFrame, heading: str = r"^#{1,4} ", preamble: bool = False) -> DataFrame:
    """doc_id, section, level, heading, path, text: sections from each heading line to the next, with the headings above
    them; lines within ``` fences open none, and text before the first heading goes unless preamble keeps it (level 0).
    Array expressions over a document's lines, near linear in their number, so nothing is shuffled."""
    slots = 6
    none = F.array(*[F.lit(None).cast("string")] * slots)
    neutral = F.struct(F.lit(99).alias("m"), none.alias("at"))

    def level_of(line):
        return F.greatest(F.lit(1), F.length(F.regexp_extract(line, "^(#*)", 1)))

    def name_of(line):
        return F.trim(F.regexp_replace(line, "^#+", ""))

    def above(before, x):  # what x has not closed of before
        at = F.zip_with(before["at"], x["at"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(F.least(before["m"], x["m"]).alias("m"), F.transform(at, lambda y, i: F.when(i + 1 < x["m"], y["a"]).otherwise(y["b"])).alias("at"))

    def cut(v):
        n, heads = F.size(v["lines"]), v["heads"]
        state = lambda h: F.struct(level_of(F.get(v["lines"], h)).alias("m"), F.transform(none, lambda _, i: F.when(i + 1 == level_of(F.get(v["lines"], h)), name_of(F.get(v["lines"], h)))).alias("at"))
        paths = running(F.transform(heads, state), above, neutral)

        def section(h, k, p):
            body = F.array_join(F.slice(v["lines"], h + 2, F.coalesce(F.get(heads, k + 1), n) - h - 1), "\n")
            line = F.get(v["lines"], h)
            return F.struct(level_of(line).alias("level"), name_of(line).alias("heading"), F.array_compact(p["at"]).alias("path"), body.alias("text"))

        out = bound(paths, lambda ps: F.transform(heads, lambda h, k: section(h, k, F.get(ps, k))))
        if preamble:
            first = F.array_join(F.slice(v["lines"], F.lit(1), F.coalesce(F.get(heads, F.lit(0)), n)), "\n")
            lead = F.struct(F.lit(0).alias("level"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("path"), first.alias("text"))
            out = F.concat(F.when(F.trim(first) != "", F.array(lead)).otherwise(F.array().cast("array<struct<level:int,heading:string,path:array<string>,text:string>>")), out)
        return out

    def parts(lines):
        fences = running(F.transform(lines, lambda x: x.rlike("^```").cast("int")), lambda a, b: a + b, F.lit(0))
        heads = bound(fences, lambda f: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(heading) & (F.get(f, i) % 2 == 0), i)), lambda i: i.isNotNull()))
        return bound(F.struct(lines.alias("lines"), heads.alias("heads")), cut)

    rows = docs.where("text is not null").select("doc_id", F.posexplode(bound(F.split("text", "\n"), parts)).alias("section", "s"))
    return rows.select("doc_id", "section", "s.level", "s.heading", "s.path", F.regexp_replace("s.text", r"^\s+|\s+$", "").alias("text"))


def section_aware(docs: DataFrame, most: int = 3000, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, section, part, heading, path, text: headed sections, those over `most` characters split recursively."""
    from lodestone.operators.splits import recursive

    s = headed_sections(docs, preamble=True)
    long = F.length("text") > most
    key = F.xxhash64("doc_id", "section")
    cut = recursive(s.where(long).select(key.alias("doc_id"), "text"), size, overlap).select(F.col("doc_id").alias("_k"), F.col("chunk_index").alias("part"), F.col("text").alias("_t"))
    split = s.where(long).withColumn("_k", key).drop("text").join(cut, "_k").select("doc_id", "section", "part", "heading", "path", F.col("_t").alias("text"))
    return s.where(~long & (F.col("text") != "")).select("doc_id", "section", F.lit(0).alias("part"), "heading", "path", "text").unionByName(split)


def contextual(chunks: DataFrame, title, path, most: int = 500) -> DataFrame:
    """chunks with a context before their text: title and section (a string), `most` characters of them; the hash of the
    original text is kept, and ids are to be made from it."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    prefix = F.left(F.concat_ws("；", blank(title), blank(path)), F.lit(most))
    text = F.when(prefix == "", F.col("text")).otherwise(F.concat(prefix, F.lit("\n\n"), F.col("text")))
    return chunks.withColumns({"original_hash": F.sha2("text", 256), "contextualized": prefix != "", "text": text})


def parent_text(children: DataFrame, parents: DataFrame, most: int = 2000) -> DataFrame:
    """children (parent_chunk_id) with the text of their parent (chunk_id, text), cut to `most` characters."""
    p = parents.select(F.col("chunk_id").alias("parent_chunk_id"), F.left("text", F.lit(most)).alias("parent_text"))
    return children.join(p, "parent_chunk_id", "left")


def strategies() -> dict:
    """Chunkers by name, each from documents (doc_id, text) to chunks."""
    from lodestone.operators import splits

    return {
        "recursive": splits.recursive,
        "sliding_window": sliding_window,
        "semantic": splits.sentence_chunks,
        "markdown_header": headed_sections,
        "section_aware": section_aware,
        "parent_child": splits.parent_child,
        "table_aware": splits.table_chunks,
        "code_aware": splits.code_chunks,
        "contextual": lambda docs: contextual(splits.recursive(docs), F.lit(""), F.lit("")),
    }


def chunked(docs: DataFrame, strategy: str = "recursive", **options) -> DataFrame:
    if strategy not in strategies():
        raise ValueError(f"unknown strategy {strategy}")
    return strategies()[strategy](docs, **options)


def chunk_quality(chunks: DataFrame, short: int = 50, long: int = 2000) -> DataFrame:
    """Counts, ratios and flags of each chunk; a duplicate equals an earlier chunk of its document,
    by a 64-bit hash of its text, so texts are not sorted."""
    norm = F.xxhash64(F.lower(F.trim("text")))
    w = Window.partitionBy("doc_id", norm).orderBy("chunk_index")
    solid = F.greatest(F.regexp_count("text", F.lit(r"[^ \t\r\n]")), F.lit(1))
    bad = F.regexp_count("text", F.lit("�")) / solid
    return chunks.select(
        "doc_id",
        "chunk_index",
        F.length("text").alias("n_chars"),
        F.regexp_count("text", F.lit(WORD)).alias("n_tokens"),
        F.regexp_count("text", F.lit(r"[.!?]+")).alias("n_sentences"),
        F.round(F.regexp_count("text", F.lit(r"\p{P}")) / solid, 6).alias("punctuation"),
        F.round(bad, 6).alias("garbled"),
        (F.length("text") < short).alias("too_short"),
        (F.length("text") > long).alias("too_long"),
        (F.row_number().over(w) > 1).alias("duplicate"),
    )
