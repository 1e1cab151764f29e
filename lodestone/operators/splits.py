"""Chunkers with structure: recursive, parent and child, tables, code, packed sentences.

Each is a map over documents' rows, so none shuffles. The recursive split keeps the order and the place of what it cuts;
it runs over Arrow batches, the others are built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators tried in order, the last one parts characters. A separator opens the piece behind it.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
SPANS = "doc_id long, chunk_index int, char_start int, char_end int, text string"


def pieces(text: str, start: int, end: int, sep: str) -> Iterator[tuple[int, int]]:
    """Spans that tile text[start:end], parted before each separator."""
    at = start
    while at < end:
        skip = len(sep) if text.startswith(sep, at) else 0
        hit = text.find(sep, at + skip, end) if sep else at + 1
        stop = end if hit < 0 else hit
        yield at, stop
        at = stop


def joined(run: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Neighbouring spans joined up to `size`; each chunk opens with the last spans of the one before, up to `overlap`."""
    first = 0
    for i, (a, b) in enumerate(run):
        if i > first and b - run[first][0] > size:
            yield run[first][0], a
            while first < i and (a - run[first][0] > overlap or b - run[first][0] > size):
                first += 1
    if run:
        yield run[first][0], run[-1][1]


def spans(text: str, size: int, overlap: int, start: int = 0, end: int | None = None, level: int = 0) -> Iterator[tuple[int, int]]:
    """Chunks of text[start:end]: pieces under `size` are joined, a larger one is split by the separators after."""
    end = len(text) if end is None else end
    while SEPARATORS[level] and text.find(SEPARATORS[level], start, end) < 0:
        level += 1
    run: list[tuple[int, int]] = []
    for a, b in pieces(text, start, end, SEPARATORS[level]):
        if b - a < size or not SEPARATORS[level]:
            run.append((a, b))
        else:
            yield from joined(run, size, overlap)
            run = []
            yield from spans(text, size, overlap, a, b, level + 1)
    yield from joined(run, size, overlap)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    body = text[start:end]
    return start + len(body) - len(body.lstrip()), end - len(body) + len(body.rstrip())


def recursive(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_index, char_start, char_end, text; null and blank texts give no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("text", pa.string())])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                cut = [t for t in (trimmed(text, *s) for s in spans(text, size, overlap)) if t[0] < t[1]]
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "chunk_index": i, "char_start": a, "char_end": b, "text": text[a:b]} for i, (a, b) in enumerate(cut)], schema)

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def parent_child(docs: DataFrame, parent: tuple[int, int] = (1600, 200), child: tuple[int, int] = (500, 80)) -> DataFrame:
    """Children with parent_index and their parent's text, which is what retrieval hands on (cut to 2000 characters)."""
    top = recursive(docs, *parent).select("doc_id", F.col("chunk_index").alias("parent_index"), "text")
    key = F.struct("doc_id", "parent_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                cut = [t for t in (trimmed(text, *s) for s in spans(text, *child)) if t[0] < t[1]]
                yield pa.RecordBatch.from_pylist([{**row["key"], "chunk_index": i, "text": text[a:b], "parent_text": text[:2000]} for i, (a, b) in enumerate(cut)], pa.schema([("doc_id", pa.int64()), ("parent_index", pa.int32()), ("chunk_index", pa.int32()), ("text", pa.string()), ("parent_text", pa.string())]))

    return top.select(key.alias("key"), "text").mapInArrow(run, "doc_id long, parent_index int, chunk_index int, text string, parent_text string")


def table_chunks(docs: DataFrame, rows: int = 30) -> DataFrame:
    """doc_id, table_id, part, text: runs of lines with a bar (blank lines may lie between), of four bars or more; the
    two header lines stand before each rows - 1 body lines. A table of headers alone gives none."""
    prose = r"(?md)^(?=[^|\n]*+$)[ \t\r\x0b\x0c]*+[^\s|][^|\n]*+$"
    runs = F.split(F.regexp_replace("text", prose, "\x00"), "\x00")
    t = docs.select("doc_id", F.explode(F.transform(runs, lambda r: F.regexp_replace(r, r"^\s+|\s+$", ""))).alias("table"))
    t = t.where(F.regexp_count("table", F.lit(r"\|")) >= 4)
    t = t.withColumn("lines", F.filter(F.split("table", "\n"), lambda x: F.trim(x) != "")).where(F.size("lines") > 2)
    t = t.select("doc_id", "lines", F.concat(F.lit("table_"), F.left(F.sha2("table", 256), F.lit(12))).alias("table_id"), F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 3) / F.lit(rows - 1)).cast("int"))).alias("part"))
    body = F.slice("lines", F.col("part") * (rows - 1) + 3, F.lit(rows - 1))
    return t.select("doc_id", "table_id", "part", F.array_join(F.concat(F.slice("lines", 1, 2), body), "\n").alias("text"))


def code_chunks(docs: DataFrame, lines: int = 120) -> DataFrame:
    """doc_id, block, part, text: fenced blocks, of at most `lines` lines a part."""
    fence = F.regexp_extract_all("text", F.lit(r"(?s)```.*?```"), F.lit(0))
    c = docs.select("doc_id", F.posexplode(F.transform(fence, lambda x: F.split(x, "\n"))).alias("block", "lines"))
    c = c.select("doc_id", "block", "lines", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / F.lit(lines)).cast("int"))).alias("part"))
    return c.select("doc_id", "block", "part", F.array_join(F.slice("lines", F.col("part") * lines + 1, F.lit(lines)), "\n").alias("text"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_chunks(docs: DataFrame, most: int = 1200) -> DataFrame:
    """doc_id, chunk_index, text: sentences packed greedily up to `most` characters; a longer sentence stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, s):
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) + 1 > most)
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        return F.struct(F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(joined).alias("open"))

    packed = F.aggregate(sentences(F.col("text")), empty, add, lambda a: F.filter(F.array_append(a["done"], a["open"]), lambda x: x != ""))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_index", "text"))
