"""Rule enrichment of chunks: entities, questions, heading paths, markdown clean-up, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse, distinct_ci, ellipsis

#: Families of entities, in the order they are listed.
ENTITIES = (
    r"\bv?\d+\.\d+(?:\.\d+)?(?:[-_][A-Za-z0-9]+)?\b",
    r"(?i)\b(?:HTTP\s*)?[45]\d{2}\b",
    r"(?i)\bError\s*[A-Za-z]?\d{3,5}\b",
    r"\bE\d{3,5}\b",
    r"(?<!\w)/(?:api|v\d+|[A-Za-z0-9_-]+)(?:/[A-Za-z0-9_{}.-]+)+",
    r"\b[A-Za-z_][A-Za-z0-9_]*\s*(?:=|:)\s*(?:[A-Za-z0-9_.:/-]+)",
    r"\b[A-Z][A-Za-z0-9]+(?:Service|Client|Config|Factory|Controller)\b",
    r"\b[a-zA-Z_][A-Za-z0-9_]*\(\)",
    r"\b[A-Z]{2,}(?:\d+)?\b",
)


def entities(text: Column, most: int = 15) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ENTITIES])
    return distinct_ci(F.transform(found, lambda v: F.regexp_replace(F.trim(v), "[.,;:]+$", "")), most)


#: A question's template, and the pattern of a context that calls for it ("" for every one).
QUESTIONS = (
    ("{} 的作用是什么？", ""),
    ("如何配置 {}？", "config|配置|部署|deployment|docker"),
    ("{} 报错如何排查？", "error|错误|报错|http|exception"),
    ("{} 有哪些关键注意事项？", ""),
)


def questions(title: Column, context: Column, most: int = 3) -> Column:
    """Up to three questions by QUESTIONS; no title, none."""
    subject, around = F.trim(F.left(F.trim(title), F.lit(60))), F.lower(F.concat_ws(" ", title, context))
    asks = F.array_compact(F.array(*[F.when(around.rlike(p) if p else F.lit(True), F.replace(F.lit(t), F.lit("{}"), subject)) for t, p in QUESTIONS]))
    return F.when(F.coalesce(subject, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(asks, 1, most))


def heading_path(text: Column, most: int = 5) -> Column:
    """The headings above a text's end: a heading closes those of its level and below."""
    heads = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    level = lambda h: F.length(F.regexp_extract(h, "^(#+)", 1))
    path = F.aggregate(heads, F.array().cast("array<string>"), lambda acc, h: F.array_append(F.filter(acc, lambda a: level(a) < level(h)), h))
    names = F.transform(path, lambda h: F.trim(F.regexp_replace(h, "^#+", "")))
    return F.slice(names, F.greatest(F.size(names) - (most - 1), F.lit(1)), most)


def refined(text: Column) -> Column:
    """Comments, tags and rules go, spaces and blank lines collapse; fenced code stays as it is."""
    plain = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>", ""), r"(?m)^[ \t]*(?:[─━═-]{10,})[ \t]*$", ""), r"[ \t]+", " "), r" ?\n(?:[ \t]*\n){2,}", "\n\n")
    parts = F.transform(F.split(text, "```", -1), lambda p, i: F.when(i % 2 == 1, p).otherwise(plain(p)))  # every second one is code
    return F.regexp_replace(F.regexp_replace(F.array_join(parts, "```"), r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


#: A tag and what a text with it contains.
TAG_MARKS = (
    ("error", ("error", "exception", "错误", "报错", "http 4", "http 5")),
    ("config", ("config", "configuration", "配置", "settings.yaml")),
    ("deployment", ("deploy", "deployment", "docker", "部署")),
    ("api", ("api", "/api/")),
    ("version", ("version", "v1.", "版本")),
    ("table", ("|", "[table:")),
    ("image", ("[image:", "image_id")),
)
IDENTIFIER = r"\b[a-z]+(?:[A-Z][A-Za-z0-9]*)+\b|\b[a-z]+_[a-z0-9_]+\b"
CAPITALISED = r"\b[A-Z][a-zA-Z]{2,}\b"


def tags(text: Column, title: Column, headings: Column, found: Column, kinds: list[Column] = (), most: int = 8) -> Column:
    """Kinds, headings, title, five entities, marks, five identifiers and eight capitalised words, the first `most` that
    differ beyond case; a blank text has none."""
    low = F.lower(text)
    marks = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(low, F.lit(m)) for m in ms]) if len(ms) > 1 else F.contains(low, F.lit(ms[0])), F.lit(t)) for t, ms in TAG_MARKS]))
    of = lambda p, n: F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, n)
    all_of = F.concat(F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>"), headings, F.array_compact(F.array(title)), F.slice(found, 1, 5), marks, of(IDENTIFIER, 5), of(CAPITALISED, 8))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(distinct_ci(F.transform(all_of, lambda x: collapse(x)), most))


#: How long a title or summary and how many entries of a list metadata may have.
LIMITS = {"title": 60, "summary": 240, "tags": 8, "heading_path": 5, "entities": 15, "questions": 5}


def validated(fields: dict[str, Column]) -> list[Column]:
    """Fields within LIMITS, lists freed of repeats, and a text beside each list: " > " joins a path, a comma the rest."""
    out = []
    for name, most in LIMITS.items():
        if name in fields and name in ("title", "summary"):
            out.append(ellipsis(collapse(fields[name]), most).alias(name))
        elif name in fields:
            value = F.transform(fields[name], lambda x: collapse(x))
            value = F.slice(value, F.greatest(F.size(value) - (most - 1), F.lit(1)), F.lit(most)) if name == "heading_path" else distinct_ci(value, most)
            out += [value.alias(name), F.array_join(value, " > " if name == "heading_path" else ",").alias(f"{name}_text")]
    return out


def json_object(answer: Column) -> Column:
    """The JSON object in a model's answer: within a fence, else the whole, else from the first brace to the last; null
    where none parses."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?[ \t\r\n]*(\{.*?\})[ \t\r\n]*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.trim(c))
    return F.coalesce(ok(fenced), ok(answer), ok(braces))


def merged(model: Column, rule: Column, most: int) -> Column:
    """What a model says first, then what the rules say, the first `most` that differ beyond case."""
    empty = F.array().cast("array<string>")
    return distinct_ci(F.concat(F.coalesce(model, empty), F.coalesce(rule, empty)), most)


def cached(chunks: DataFrame, cache: DataFrame, config: str) -> tuple[DataFrame, DataFrame]:
    """chunks (chunk_id, text) whose enrichment the cache (cache_key, result) has, with it, and those it lacks, with their
    keys: a key is the hash of id, text and configuration."""
    key = F.sha2(F.concat_ws(":", F.col("chunk_id").cast("string"), F.sha2("text", 256), F.lit(config)), 256)
    df = chunks.withColumn("cache_key", key)
    return df.join(cache, "cache_key"), df.join(cache.select("cache_key"), "cache_key", "left_anti")


def within_budget(rows: DataFrame, group: str, order: list, cost: Column, budget: float) -> DataFrame:
    """Rows of a group in order while the running cost stays within the budget. A group's ids and costs are sorted in
    one task: give groups whose rows fit one."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("spent", F.round(F.sum(cost).over(w), 8)).where(F.col("spent") <= budget)


def affordable(items: Column, budget: float) -> Column:
    """Of an array of struct(cost, ...) in order those taken when one that would pass the budget is skipped and later,
    cheaper ones may still be taken. A fold, as what is taken depends on what was: for the items of one document."""
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("i"))

    def add(acc, x):
        fits = acc["spent"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["spent"] + x["cost"]).otherwise(acc["spent"]).alias("spent"), F.when(fits, F.array_append(acc["taken"], acc["i"])).otherwise(acc["taken"]).alias("taken"), (acc["i"] + 1).alias("i"))

    return F.aggregate(items, start, add, lambda a: a["taken"])
