"""Query processing over a batch of queries as rows: filter syntax, keywords, rule rewriting. Column expressions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import collapse

FILTER = r"([\p{L}\p{N}_]+):([^ \t\r\n\x0b\x0c]+)"
#: The names under which a filter may be given.
ALIASES = {"collection": "collection", "col": "collection", "c": "collection", "type": "doc_type", "doc_type": "doc_type", "t": "doc_type", "source": "source_path", "src": "source_path", "s": "source_path", "tag": "tags", "tags": "tags"}
#: A term of letters with dots, dashes or numbers stays whole; a CJK character stands alone; then words.
CJK = r"[一-鿿]"
DOMAIN_TOKEN = rf"[A-Za-z]+[A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+|[A-Za-z]+[0-9]+(?:\.[0-9]+)?|{CJK}|(?:[^\P{{L}}一-鿿]|[\p{{N}}_])+"
#: Words that are no keywords.
STOPWORDS_EN = tuple("""a an the in on at to for of with by from as into about through between after before and or but if then because while although
i you he she it we they this that these those what which who whom whose is am are was were be been being have has had do does did will would
could should may might must can get use make how why when where not no yes so very just also too""".split())
STOPWORDS_ZH = tuple("""如何 怎么 怎样 什么 哪个 哪些 为什么 为何 谁 多少 几 是否 能否 可否 的 地 得 了 着 过 吗 呢 吧 啊 呀 在 于 和 与 或 及 并 而 但 但是
因为 所以 如果 那么 虽然 然而 我 你 他 她 它 我们 你们 他们 这 那 这个 那个 这些 那些 这里 那里 很 非常 特别 更 最 都 也 还 又 再 已 已经 正在 将 会 能 可以
应该 必须 是 有 做 进行 使用 通过 个 种 类""".split())


def parse_filters(query: Column) -> Column:
    """struct(collection, doc_type, source_path, tags, other, text): of a repeated key the last value, of tags all;
    other keys as they are in a map; text is the query without the filters."""
    q = collapse(query)
    names, values = (F.regexp_extract_all(q, F.lit(FILTER), F.lit(i)) for i in (1, 2))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])

    def canonical(k: Column) -> Column:
        return F.coalesce(known[F.lower(k)], k)

    pairs = F.zip_with(names, values, lambda k, v: F.struct(canonical(k).alias("key"), known[F.lower(k)].isNotNull().alias("known"), v.alias("value")))
    last = lambda key: F.get(F.reverse(F.filter(pairs, lambda p: p["known"] & (p["key"] == key))), F.lit(0))["value"]
    tags = F.flatten(F.transform(F.filter(pairs, lambda p: p["known"] & (p["key"] == "tags")), lambda p: F.split(p["value"], ",")))
    free = F.filter(pairs, lambda p: ~p["known"])
    newest = F.filter(free, lambda p, i: ~F.exists(F.slice(free, i + 2, F.size(free)), lambda o: o["key"] == p["key"]))
    other = F.map_from_arrays(F.transform(newest, lambda p: p["key"]), F.transform(newest, lambda p: p["value"]))
    return F.struct(*[last(k).alias(k) for k in ("collection", "doc_type", "source_path")], tags.alias("tags"), other.alias("other"), collapse(F.regexp_replace(q, FILTER, "")).alias("text"))


def merged_filters(extracted: Column, explicit: Column, tenant: str | None = None) -> Column:
    """Explicit filters (map) over extracted ones, the caller's tenant over both."""
    own = F.create_map(F.lit("tenant_id"), F.lit(tenant)) if tenant else F.create_map().cast("map<string,string>")
    keep = lambda m, over: F.map_filter(m, lambda k, _: ~F.map_contains_key(over, k))
    both = F.map_concat(keep(extracted, explicit), explicit)
    return F.map_concat(keep(both, own), own)


def domain_tokens(text: Column, ngrams: tuple[int, int] | None = None) -> Column:
    """Tokens in order and case; with ngrams (least, most), those of runs of CJK characters after them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOMAIN_TOKEN), F.lit(0))
    if ngrams is None:
        return found
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CJK + "{2,}"), F.lit(0))
    grams = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(found, F.flatten(F.transform(runs, lambda r: F.concat(*[grams(r, n) for n in range(ngrams[0], ngrams[1] + 1)]))))


def keywords(tokens: Column, most: int = 20, least: int = 1, stopwords: tuple[str, ...] = STOPWORDS_EN + STOPWORDS_ZH) -> Column:
    """The first of each token, case apart, without stop words, at most `most`."""
    stop = F.array(*map(F.lit, stopwords))
    kept = F.filter(tokens, lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t) & ~F.array_contains(stop, F.lower(t)))
    low = F.transform(kept, lambda t: F.lower(t))
    return F.slice(F.filter(kept, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, most)


def rewritten(query: Column, synonyms: Mapping[str, list[str]], abbreviations: Mapping[str, str], most: int = 3) -> Column:
    """struct(text, variants): the query with abbreviations spelt out beside them; the query, its forms with a synonym
    put in, and the spelt-out one, distinct and at most `most`."""
    text = query
    for k, v in abbreviations.items():
        text = F.replace(text, F.lit(k), F.lit(f"{k} {v}"))
    forms = [F.when(F.contains(query, F.lit(k)), F.replace(query, F.lit(k), F.lit(v))) for k, vs in synonyms.items() for v in vs]
    return F.struct(text.alias("text"), F.slice(F.array_distinct(F.array_compact(F.array(query, *forms, text))), 1, most).alias("variants"))


def matches_metadata(filters: Column, row: Mapping[str, Column]) -> Column:
    """Whether a row (columns by name) passes parse_filters(): collection and type equal, tags by any overlap, source by
    substring, other keys equal."""
    same = lambda k: filters[k].isNull() | F.coalesce(row[k] == filters[k], F.lit(False))
    tags = (F.size(filters["tags"]) == 0) | F.coalesce(F.arrays_overlap(row["tags"], filters["tags"]), F.lit(False))
    source = filters["source_path"].isNull() | F.coalesce(F.contains(row["source_path"], filters["source_path"]), F.lit(False))
    other = F.lit(True)
    for k, c in row.items():
        if k not in ("collection", "doc_type", "tags", "source_path"):
            other = other & (F.try_element_at(filters["other"], F.lit(k)).isNull() | F.coalesce(c.cast("string") == F.try_element_at(filters["other"], F.lit(k)), F.lit(False)))
    unknown = F.size(F.filter(F.map_keys(filters["other"]), lambda k: ~k.isin(*[k for k in row if k not in ("collection", "doc_type", "tags", "source_path")] or [""]))) == 0
    return same("collection") & same("doc_type") & tags & source & other & unknown
