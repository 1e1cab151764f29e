"""Answers after generation: claims and their citations, refusal, confidence, conflicts between sources, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import WORD, collapse

#: What makes a sentence a claim without a citation.
FACT = r"(?i)\d|%|％|金额|元|美元|人民币|日期|版本|状态|结论|因此|说明|表明|显示|支持|需要|必须|已经|已|未|不能|可以|完成|启用|停用|通过|拒绝|approved|rejected|enabled|disabled|completed|failed"
#: Where an answer's sentences end, and a field with its value. White space is spelt out, as SQL engines'
#: classes of it differ.
SENTENCE_END = r"(?<=[。！？!?；;])|(?<!\d)\.(?!\d)"
FIELD = r"([\w一-鿿]{2,20})[ \t\r\n\x0b\x0c]*[:：=][ \t\r\n\x0b\x0c]*([^,，。；; \t\r\n\x0b\x0c]+)"
#: Statements that contradict each other.
OPPOSITES = (("已启用", "未启用"), ("已完成", "未完成"), ("通过", "未通过"), ("是", "否"), ("enabled", "disabled"), ("approved", "rejected"), ("completed", "incomplete"), ("passed", "failed"))
#: What each factor weighs in an answer's confidence.
WEIGHTS = {"top_retrieval": 0.14, "average_retrieval": 0.10, "top_rerank": 0.12, "supporting": 0.12, "coverage": 0.18, "supported": 0.12, "agreement": 0.08, "answer_length": 0.04, "retrieval": 0.06, "answered": 0.04}
#: Boosts of a hit whose title, heading or tags have a query word, or that has the whole query.
BOOSTS = {"title": 1.20, "heading": 1.15, "tag": 1.10, "exact": 1.25}


def claims(answers: DataFrame, most: int | None = 20) -> DataFrame:
    """answer_id, claim, text, citations, confidence: sentences that cite or state a fact. A citation that opens the
    next sentence belongs to the one before. An answer gives its first `most` ones (None: all); 20 is the reference's
    default, for generated answers."""
    glued = F.regexp_replace("answer", r"([.!?;。！？；])(\s*(?:\[[Cc]\d+\]\s*)+)", "$2$1 ")
    parts = F.transform(F.split(glued, SENTENCE_END), collapse)
    kept = F.filter(parts, lambda s: s.rlike(r"\[[Cc]\d+\]") | s.rlike(FACT))
    kept = kept if most is None else F.slice(kept, 1, most)
    rows = answers.select("answer_id", F.posexplode(kept).alias("claim", "text"))
    cited = F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"\[(C\d+)\]"), F.lit(1)))
    return rows.select("answer_id", "claim", "text", cited.alias("citations"), F.when(F.size(cited) > 0, 1.0).otherwise(0.7).alias("confidence"))


def citation_report(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """answer_id, n_claims, coverage, invalid: the share of claims with a citation that names a context (answer_id,
    citation_id), and citations that name none."""
    each = found.select("answer_id", "claim", F.explode_outer("citations").alias("citation_id"))
    known = contexts.select("answer_id", "citation_id", F.lit(True).alias("ok")).distinct()
    each = each.join(known, ["answer_id", "citation_id"], "left")
    by_claim = each.groupBy("answer_id", "claim").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"), F.array_sort(F.collect_set(F.when(F.col("ok").isNull(), F.col("citation_id")))).alias("bad"))
    return by_claim.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("coverage"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bad")))).alias("invalid"))


def refusal(n: Column, best: Column, coverage: Column, unsupported: Column, n_claims: Column, denied: Column, scope: Column, injected: Column, floor: float = 0.2) -> Column:
    """Why an answer is refused, the first rule that applies; null where it stands. Claims without any valid citation
    have coverage 0."""
    return (
        F.when(n == 0, "NO_RETRIEVAL_RESULTS")
        .when(best < floor, "LOW_RETRIEVAL_SCORE")
        .when(denied, "PERMISSION_DENIED")
        .when(scope, "OUT_OF_SCOPE")
        .when(injected, "PROMPT_INJECTION_DETECTED")
        .when((n_claims > 0) & (coverage == 0), "NO_VALID_CITATIONS")
        .when(unsupported > 0.35, "UNSUPPORTED_GENERATED_CLAIMS")
        .when((n_claims > 0) & (coverage < 0.5), "NO_VALID_CITATIONS")
    )


def length_factor(length: Column, coverage: Column) -> Column:
    long = (1 - F.least(F.lit(0.7), (length - 800) / 4000)) * (0.6 + 0.4 * coverage)
    return F.when(length == 0, 0.0).when(length <= 800, 1.0).otherwise(long)


def confidence(best: Column, mean: Column, supporting: Column, coverage: Column, unsupported: Column, n: Column, length: Column, status: Column, refused: Column, conflicts: Column, rerank: Column | None = None) -> Column:
    """0 to 1, rounded to 4: 0 where nothing was retrieved or the answer is refused, x 0.7 where sources conflict."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    factors = {
        "top_retrieval": unit(best),
        "average_retrieval": unit(mean),
        "top_rerank": unit(best if rerank is None else rerank),
        "supporting": F.least(F.lit(1.0), supporting / 3),
        "coverage": unit(coverage),
        "supported": 1 - unit(unsupported),
        "agreement": F.when((conflicts > 0) | (n == 0), 0.0).when(n > 1, 1.0).otherwise(0.7),
        "answer_length": length_factor(length, coverage),
        "retrieval": F.when(status == "sufficient", 1.0).when(status == "insufficient", 0.35).otherwise(0.0),
        "answered": F.when(refused, 0.0).otherwise(1.0),
    }
    total = sum((f * WEIGHTS[name] for name, f in factors.items()), F.lit(0.0))
    total = F.when(refused | (status == "no_results") | (n == 0), 0.0).otherwise(total)
    return F.round(unit(F.when(conflicts > 0, total * 0.7).otherwise(total)), 4)


def label(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low")


def conflicts(contexts: DataFrame) -> DataFrame:
    """query_id, kind, value, n: statements and fields on which the contexts (query_id, doc_id, text) of a query differ,
    with the number of contexts that take part; of a field that a context states again the last value counts. Grouped by what they state; no pair of contexts is formed."""
    low = F.lower("text")
    sides = F.array(*[F.struct(F.lit("status").alias("kind"), F.lit(f"{a}/{b}").alias("value"), F.when(F.contains(low, F.lit(a)), F.lit(a)).alias("says"), F.when(F.contains(low, F.lit(b)), F.lit(b)).alias("also")) for a, b in OPPOSITES])
    status = contexts.select("query_id", "doc_id", F.explode(sides).alias("s")).select("query_id", "doc_id", "s.kind", "s.value", F.explode(F.array_compact(F.array("s.says", "s.also"))).alias("says"))
    names, values = (F.regexp_extract_all("text", F.lit(FIELD), F.lit(i)) for i in (1, 2))
    fields = contexts.select("query_id", "doc_id", F.posexplode(F.arrays_zip(names.alias("f"), values.alias("v"))).alias("i", "p"))
    fields = fields.groupBy("query_id", "doc_id", F.col("p.f").alias("value")).agg(F.max_by("p.v", "i").alias("says")).select("query_id", "doc_id", F.lit("field_value").alias("kind"), "value", "says")
    g = status.unionByName(fields).groupBy("query_id", "kind", "value", "says").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count_distinct("doc_id").alias("d"))
    g = g.groupBy("query_id", "kind", "value").agg(F.count("*").alias("sides"), F.sum("d").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.where((F.col("sides") > 1) & (F.col("lo") < F.col("hi"))).select("query_id", "kind", "value", "n")


def boosted(score: Column, query: Column, title: Column, heading: Column, tags: Column, text: Column) -> Column:
    q = F.lower(query)
    terms = F.regexp_extract_all(q, F.lit(WORD.replace("_]", "_-]")), F.lit(0))
    has = lambda c: F.exists(terms, lambda t: F.contains(F.lower(c), t))
    whole = F.contains(F.lower(text), q) | F.contains(F.lower(title), q) | F.contains(F.lower(heading), q)
    for hit, by in ((has(title), "title"), (has(heading), "heading"), (has(tags), "tag"), (whole, "exact")):
        score = score * F.when(hit, BOOSTS[by]).otherwise(1.0)
    return score
