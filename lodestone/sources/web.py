"""Web pages as documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def html_title(html: Column) -> Column:
    """<title>, else the first <h1>, else Untitled."""
    pick = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))
    return F.coalesce(pick("title"), pick("h1"), F.lit("Untitled"))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, tags part lines, lines are trimmed and blank ones dropped."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>|<!--.*?-->", "")
    lines = F.split(F.regexp_replace(bare, "<[^>]*>", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")
