"""Evaluation of retrieval and answers: labels, modalities, citations, trust, judges, reports over modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import metrics


def metric_means(rows: DataFrame, by: list[str], skip: tuple[str, ...] = ("count", "total")) -> DataFrame:
    """by, name, value: the mean over the queries that have a metric (long form: query_id, name, value), to four digits;
    counts are no metrics."""
    return rows.where(F.col("value").isNotNull() & ~F.col("name").isin(*skip)).groupBy(*by, "name").agg(F.round(F.avg("value"), 4).alias("value"))


def unbounded(ranks: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, hit_rate, mrr over whole lists; repeats keep their places, and a query without a relevant document has 0."""
    first = ranks.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    df = queries.select("query_id").join(first, "query_id", "left")
    return df.select("query_id", F.col("first").isNotNull().cast("double").alias("hit_rate"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def path_of(source: Column) -> Column:
    return F.lower(F.replace(F.trim(source), F.lit("\\"), F.lit("/")))


def base_of(source: Column) -> Column:
    return F.element_at(F.split(path_of(source), "/"), -1)


def relevance_labels(chunk_ids: Column, sources: Column) -> Column:
    """struct(kind, labels) of what a case expects: chunk ids, else sources (file names where none has a folder), else
    none."""
    some = F.filter(sources, lambda s: F.trim(s) != "")
    names = ~F.exists(some, lambda s: F.contains(path_of(s), F.lit("/")))
    labels = F.when(names, F.transform(some, base_of)).otherwise(F.transform(some, path_of))
    none = F.array().cast("array<string>")
    pick = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("labels"))
    return F.when(F.size(chunk_ids) > 0, pick("chunk_id", chunk_ids)).when(F.size(some) > 0, pick("source", labels)).otherwise(pick("none", none))


def as_documents(hits: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Hits (query_id, rank and columns that may name a document) as ranked documents: the first column with the pattern
    names it, its best hit ranks it; hits that name none go."""
    named = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), pattern, 1), F.lit("")) for c in columns])
    best = hits.withColumn("doc_id", named).where("doc_id is not null").groupBy("query_id", "doc_id").agg(F.min("rank").alias("_at"))
    return best.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "doc_id")).alias("rank"))


#: Other names of modalities, and those that count as images.
MODALITIES = {"img": "image", "picture": "image", "photo": "image", "graph": "chart", "plot": "chart", "tabular": "table"}
IMAGES = ("image", "figure", "chart", "diagram")


def modality(value: Column) -> Column:
    """A modality's one name; null for none."""
    v = F.lower(F.trim(value))
    v = F.coalesce(F.create_map(*[F.lit(x) for kv in MODALITIES.items() for x in kv])[v], v)
    has = lambda *ws: F.greatest(*[F.contains(v, F.lit(w)) for w in ws]) if len(ws) > 1 else F.contains(v, F.lit(ws[0]))
    return F.when(v == "", None).when(has("image", "figure"), "image").when(has("table"), "table").when(has("chart", "diagram"), F.when(v.isin("chart", "diagram"), v).otherwise("chart")).when(has("text"), "text").otherwise(v)


def truthy(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin("", "0", "false", "no", "none", "null"), F.lit(False))


def modality_metrics(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query_id, recall, image_hit, table_hit at k from hits (query_id, rank, modality, image_id, table_id) and expected
    (query_id, modalities); null where nothing of the kind is expected."""
    found = F.array_compact(F.array(modality(F.col("modality")), F.when(truthy(F.col("image_id")), "image"), F.when(truthy(F.col("table_id")), "table")))
    got = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_set(found))).alias("got"))
    want = F.array_distinct(F.array_compact(F.transform("modalities", modality)))
    df = expected.select("query_id", want.alias("want")).join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    images = F.array(*map(F.lit, IMAGES))
    hit = lambda of: F.when(F.arrays_overlap("want", of), F.arrays_overlap("got", of).cast("double"))
    recall = F.when(F.size("want") > 0, F.size(F.array_intersect("want", "got")) / F.size("want"))
    return df.select("query_id", F.round(recall, 6).alias("recall"), hit(images).alias("image_hit"), hit(F.array(F.lit("table"))).alias("table_hit"))


def cited_labels(answer: Column, labels: Column) -> Column:
    """The labels (kind:value, lower case) that an answer cites: ids it spells out, those of the results whose number
    stands in brackets (labels: array of the results' label arrays), and those whose value or page it names."""
    low = F.lower(F.coalesce(answer, F.lit("")))

    def prefixed(k: str):
        return lambda v: F.concat(F.lit(f"{k}:"), v)

    spelt = F.flatten(F.array(*[F.transform(F.regexp_extract_all(low, F.lit(rf"{k}\s*[:=]\s*([a-z0-9_.\-]+)"), F.lit(1)), prefixed(k)) for k in ("chunk_id", "image_id", "table_id")]))
    empty = F.array().cast("array<string>")
    numbered = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"\[([0-9]{1,6})\]"), F.lit(1)), lambda n: F.coalesce(F.get(labels, n.cast("int") - 1), empty)))
    pages = F.regexp_extract_all(low, F.lit(r"\b(?:page\s*|p\.\s*)(\d+)\b|第\s*(\d+)\s*页"), F.lit(1))
    also = F.regexp_extract_all(low, F.lit(r"第\s*(\d+)\s*页"), F.lit(1))
    value = lambda x: F.lower(F.regexp_replace(x, "^[^:]*:", ""))
    named = F.filter(F.flatten(labels), lambda x: F.when(x.startswith("page:"), F.array_contains(F.concat(pages, also), value(x))).otherwise((value(x) != "") & F.contains(low, value(x))))
    return F.when(F.trim(low) == "", empty).otherwise(F.array_distinct(F.transform(F.concat(spelt, numbered, named), lambda x: F.lower(x))))


def citation_accuracy(expected: Column, observed: Column) -> Column:
    """The share of expected labels that are observed; null where none is expected."""
    want = F.array_distinct(F.transform(expected, lambda x: F.lower(x)))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, observed)) / F.size(want))


def trust_metrics(valid: Column, invalid: Column, supported: Column, unsupported: Column, refused: Column, expected: Column) -> list[Column]:
    """citation_precision, invalid_citation_rate, unsupported_claim_ratio, refusal_accuracy (null without expectation)."""
    share = lambda a, b: F.round(F.when(a + b > 0, a / (a + b)).otherwise(0.0), 6)
    return [share(valid, invalid).alias("citation_precision"), share(invalid, valid).alias("invalid_citation_rate"), share(unsupported, supported).alias("unsupported_claim_ratio"), F.when(expected.isNotNull(), (refused == expected).cast("double")).alias("refusal_accuracy")]


def judged(answer: Column, contexts: Column, truth: Column, said: Column) -> Column:
    """struct(score, skipped) of a judge's JSON {"score": x}: clamped to 0 to 1; skipped for want of an answer, contexts,
    a truth, or a score."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    score = F.get_json_object(said, "$.score").try_cast("double")
    skipped = F.when(blank(answer), "no_answer").when(F.size(contexts) <= 0, "no_contexts").when(blank(truth), "no_ground_truth").when(score.isNull(), "no_score")
    return F.struct(F.when(skipped.isNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"), skipped.alias("skipped"))


def composite(*maps: Column) -> Column:
    """Metrics of several evaluators, of one name the last; null only where all failed (are null)."""
    empty = F.create_map().cast("map<string,double>")

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    out = F.coalesce(maps[0], empty)
    for m in maps[1:]:
        out = over(out, F.coalesce(m, empty))
    return F.when(F.coalesce(*maps).isNotNull(), out)


def compare_modes(lists: dict[str, DataFrame], relevant: DataFrame, k: int) -> DataFrame:
    """mode and ir_metrics() of each query, for ranked lists by mode, in one plan."""
    both = None
    for mode, x in lists.items():
        x = x.select(F.struct(F.lit(mode).alias("mode"), F.col("query_id").alias("q")).alias("query_id"), "doc_id", "rank")
        both = x if both is None else both.unionByName(x)
    modes = F.explode(F.array(*map(F.lit, lists)))
    need = relevant.select(modes.alias("mode"), "query_id", "doc_id").select(F.struct("mode", F.col("query_id").alias("q")).alias("query_id"), "doc_id")
    out = metrics.ir_metrics(both, need, k)
    return out.select("query_id.mode", F.col("query_id.q").alias("query_id"), *[c for c in out.columns if c != "query_id"])


def extractive_answer(contexts: DataFrame, most: int = 3, chars: int = 240) -> DataFrame:
    """query_id, answer: the first contexts (query_id, rank, text) of each query, in order, white space collapsed."""
    from lodestone.functions.text import collapse

    few = contexts.where(F.col("rank") <= most).select("query_id", F.struct("rank", F.left(collapse(F.col("text")), F.lit(chars)).alias("t")).alias("s"))
    return few.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), " ").alias("answer"))


def estimated_cost(query: Column, candidates: Column, price: float) -> Column:
    return F.round((F.greatest(F.lit(1), F.floor(F.length(query) / 4)) + F.greatest(F.lit(0), candidates)) / 1000.0 * price, 8)


def percentiles(rows: DataFrame, by: str, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """by, p, value: exact percentiles by linear interpolation. A sketch brackets each one, a second pass counts what lies
    below its bracket, and only the distinct values within the bracket, about 4 / accuracy of a group, are sorted."""
    near = lambda d: F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in ps])
    rows = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"))
    q = rows.groupBy(by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", near(-2 / accuracy), accuracy).alias("_lo"), F.percentile_approx("_v", near(2 / accuracy), accuracy).alias("_hi"))
    q = q.select(by, "_n", F.posexplode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))).alias("_i", "_b"))
    q = q.select(by, "_n", F.col("_b.p").alias("p"), F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"))
    both = rows.join(q, by)
    below = both.groupBy(by, "p").agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    inside = both.where("_v between _lo and _hi").groupBy(by, "p", "_n", "_v").agg(F.count("*").alias("_c")).join(below, [by, "p"])
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(by, "p").orderBy("_v"))
    at = (F.col("_n") - 1) * F.col("p")
    found = inside.withColumn("_upto", upto).groupBy(by, "p", "_n").agg(F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))).alias("a"), F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))).alias("b"))
    return found.select(by, "p", (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("value"))
