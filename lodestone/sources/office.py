"""Word processor files as text: paragraphs in order, then tables as markdown, read from the package's XML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

#: Namespaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DC = "{http://purl.org/dc/elements/1.1/}"


def words(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t")).strip()


def docx(content: bytes) -> tuple[str | None, str, str | None]:
    """title, text, error of one file; a broken or empty file has an error and no text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
            core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return None, "", f"unreadable: {type(e).__name__}"
    if body is None:
        return None, "", "no body"
    parts = [words(p) for p in body.findall(f"{W}p")]
    for table in body.findall(f"{W}tbl"):
        rows = [[words(c).replace("|", "\\|") for c in r.findall(f"{W}tc")] for r in table.findall(f"{W}tr")]
        if rows:
            bars = ["| " + " | ".join(r) + " |" for r in rows]
            parts.append("\n".join([bars[0], "|" + " --- |" * len(rows[0]), *bars[1:]]))
    text = "\n\n".join(p for p in parts if p)
    title = core.findtext(f"{DC}title") if core is not None else None
    return title or None, text, None if text else "empty"


def read_docx(files: DataFrame) -> DataFrame:
    """files (path, content) as path, title, text, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                title, text, error = docx(content.as_py() or b"")
                yield pa.RecordBatch.from_pylist([{"path": path, "title": title, "text": text, "error": error}], pa.schema([(n, pa.string()) for n in ("path", "title", "text", "error")]))

    return files.select("path", "content").mapInArrow(run, "path string, title string, text string, error string")
