"""Files and JSON as documents: routing by suffix, decoding, symbols of code, JSON documents, question and golden sets, and
sinks for traces and reports."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions.text import bound

#: Suffixes that are read, and how.
LOADERS = {"pdf": "pdf", "md": "markdown", "txt": "text", "html": "html", "htm": "html", "docx": "docx", "py": "code", "js": "code", "java": "code"}
LANGUAGES = {"py": "python", "js": "javascript", "java": "java"}
#: What names a symbol in code.
SYMBOLS = {
    "javascript": (r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(", r"\bclass\s+([A-Za-z_$][\w$]*)\b", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?function\b"),
    "java": (r"\b(?:class|interface|enum)\s+([A-Za-z_]\w*)\b", r"\b(?:public|protected|private|static|final|synchronized|native|\s)+[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\("),
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def loader(path: Column, strict: bool = True) -> Column:
    """The loader of a file by its suffix; of an unknown suffix an error, or null where not strict."""
    out = F.create_map(*[F.lit(x) for kv in LOADERS.items() for x in kv])[suffix(path)]
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no loader for "), path)).cast("string")) if strict else out


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, loader, content of the files under path, by path; a suffix that nothing reads is an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", suffix(F.col("path")).alias("suffix"), loader(F.col("path")).alias("loader"), "content")


def decoded(content: Column) -> Column:
    """UTF-8 where valid, else GBK where each high byte has its second one, else Latin-1."""
    hexed = F.hex(content)
    gbk = hexed.rlike("^(?:[0-7][0-9A-F]|(?:8[1-9A-F]|[9A-E][0-9A-F]|F[0-9A-E])(?:[4-6][0-9A-F]|7[0-9A-E]|[89A-E][0-9A-F]|F[0-9A-E]))*$")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(gbk, _gbk(content)).otherwise(F.decode(content, "ISO-8859-1"))


@F.pandas_udf(StringType())
def _gbk(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else b.decode("gbk", "replace"))


@F.pandas_udf(ArrayType(StringType()))
def _python_symbols(code: pd.Series) -> pd.Series:
    def names(text: str | None) -> list[str]:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return []
        return sorted({x.name for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))})

    return code.map(names)


def symbols(code: Column, language: str) -> Column:
    """Sorted names of functions and classes; code that does not parse has none."""
    if language == "python":
        return _python_symbols(code)
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in SYMBOLS[language]])))


RECORD = "map<string,string>"
LISTS = ("documents", "records", "data", "items")


def json_records(text: Column) -> Column:
    """array<map<string,string>> of a JSON text: a list, the first of LISTS in an object, or the object itself; nested
    values stay JSON. A text that does not parse gives none."""
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    many = F.from_json(text, f"array<{RECORD}>")
    held = F.from_json(text, "struct<" + ",".join(f"{k}:array<{RECORD}>" for k in LISTS) + ">")
    one = F.from_json(text, RECORD)
    of_object = bound(held, lambda h: F.coalesce(*[h[k] for k in LISTS]))
    parsed = F.try_parse_json(text).isNotNull() & text.rlike(r"(?s)^\s*(\[.*\]|\{.*\})\s*$")
    return F.when(~parsed, F.array().cast(f"array<{RECORD}>")).when(F.ltrim(text).startswith("["), some(many)).otherwise(F.coalesce(some(of_object), F.array(one)))


def json_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """record (a map) of every record in JSON files, or in the lines of JSONL files; lines that do not parse are skipped."""
    text = spark.read.option("wholetext", not lines).text(path)
    return text.where(F.trim("value") != "").select(F.explode(json_records(F.col("value"))).alias("record"))


def question_set(rows: DataFrame, kinds: tuple[str, ...] = (), sources: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Questions (question_id, question, question_type, source_type) that have an id and a text, of the kinds and sources
    asked for, the first `most` by id."""
    df = rows.where(F.col("question_id").isNotNull() & (F.trim("question") != ""))
    df = df.where(F.lower("question_type").isin(*[k.lower() for k in kinds])) if kinds else df
    df = df.where(F.lower("source_type").isin(*[s.lower() for s in sources])) if sources else df
    return df if most is None else df.orderBy("question_id").limit(most)


def golden_set(text: Column) -> Column:
    """array of struct(query, expected_chunk_ids, expected_sources) of a golden set's JSON; an error where it has none."""
    cases = F.from_json(text, "test_cases array<struct<query string, expected_chunk_ids array<string>, expected_sources array<string>>>")["test_cases"]
    return F.coalesce(cases, F.raise_error(F.lit("a golden set needs test_cases")).cast("array<struct<query:string,expected_chunk_ids:array<string>,expected_sources:array<string>>>"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(rows: DataFrame, path: str, masked: dict[str, Column] | None = None) -> None:
    """rows appended as JSON lines, columns in masked replaced first."""
    rows.withColumns(masked or {}).write.mode("append").json(path)


def markdown_report(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row: a markdown table of rows (a report's few), ordered by name, "-" where a value is missing."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell(name), *map(cell, columns)), F.lit(" |"))
    head = "| " + " | ".join([name, *columns]) + " |\n|" + " --- |" * (len(columns) + 1)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), line.alias("l")))), lambda x: x["l"])
    return rows.agg(F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n")).alias("report"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """collection (the folder), image_id, path, bytes of image files under path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = F.element_at(F.split("path", "/"), -2)
    return df.select(folder.alias("collection"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("image_id"), "path", F.col("length").alias("bytes"))


def image_stats(images: DataFrame) -> DataFrame:
    return images.groupBy("collection").agg(F.count("*").alias("n_images"), F.sum("bytes").alias("bytes"))
