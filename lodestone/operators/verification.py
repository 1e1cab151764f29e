"""Verification of grounded answers: safety, guards, citation records, claims against what they cite, assembled answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import collapse

#: What marks an injected prompt.
INJECTIONS = (
    r"ignore\s+(?:all\s+)?previous\s+instructions",
    r"disregard\s+the\s+system\s+prompt",
    r"reveal\s+your\s+prompt",
    r"you\s+are\s+now",
    r"\bbypass\b",
    r"\bjailbreak\b",
    r"system\s+message",
    r"developer\s+message",
    "忽略以上指令",
    "忽略之前的规则",
    "忽略之前规则",
    "泄露提示词",
    "输出系统提示词",
    "绕过限制",
    "你现在是",
    "不要引用来源",
    "不要遵守知识库规则",
)
#: Phrases of knowledge from elsewhere.
EXTERNAL = ("according to my experience", "generally speaking", "in general", "i think", "i believe", "based on my knowledge", "根据我的经验", "一般来说", "我认为", "我觉得", "常识上")
#: Words that support nothing, what a token and a number are, and the least score of support.
BARE = ("的", "是", "为", "了", "在", "和", "与", "the", "is", "a", "an", "of", "to")
TOKEN, NUMBER, MARKER = r"[a-z0-9_./:-]+|[一-鿿]", r"[0-9]+(?:\.[0-9]+)?(?:%|％)?", r"\[[Cc]([0-9]+)\]"
LEAST = 0.35


def injected(*texts: Column) -> Column:
    one = "(?i)" + "|".join(INJECTIONS)
    return F.exists(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), lambda t: t.rlike(one))


def external(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.greatest(*[F.contains(low, F.lit(p)) for p in EXTERNAL])


def guard(answer: Column, ids: Column, status: Column) -> Column:
    """Warnings of an answer over contexts with citation ids (C1, ...) and a retrieval status."""
    said = F.trim(F.coalesce(answer, F.lit(""))) != ""
    used = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[C([0-9]+)\]"), F.lit(1)), lambda n: F.concat(F.lit("C"), n)))
    wrong = F.array_sort(F.array_except(used, ids))
    return F.array_compact(
        F.array(
            F.when((F.size(ids) == 0) & said, "NO_CONTEXT_FOR_ANSWER"),
            F.when(F.size(wrong) > 0, F.concat(F.lit("INVALID_CITATION_MARKER:"), F.array_join(wrong, ","))),
            F.when((F.size(ids) > 0) & (F.size(used) == 0) & said, "MISSING_CITATION_MARKER"),
            F.when(external(answer), "POSSIBLE_EXTERNAL_INFERENCE"),
            F.when(status == "no_results", "NO_RETRIEVAL_RESULTS").when(status == "insufficient", "INSUFFICIENT_RETRIEVAL_RESULTS"),
        )
    )


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def support(claim: Column, evidence: Column) -> Column:
    """1 where the evidence contains the claim, else 0.7 x share of its tokens, bare ones apart, + 0.3 x share of its
    numbers; citation markers are no part of a claim, nor of its numbers."""
    bare = F.regexp_replace(claim, MARKER, "")
    low, seen = F.lower(F.trim(bare)), F.lower(F.coalesce(evidence, F.lit("")))
    tokens = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)))
    mine = F.array_except(tokens(low), F.array(*map(F.lit, BARE)))
    overlap = F.size(F.array_intersect(mine, tokens(seen))) / F.greatest(F.lit(1), F.size(mine))
    n = numbers(bare)
    share = F.when(F.size(n) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(n, numbers(evidence))) / F.size(n))
    return F.when((low != "") & F.contains(seen, low), F.lit(1.0)).otherwise(overlap * 0.7 + share * 0.3)


def numbers_supported(claim: Column, evidence: Column) -> Column:
    return F.size(F.array_except(numbers(F.regexp_replace(claim, MARKER, "")), numbers(evidence))) == 0


def verify_claims(claims: DataFrame, contexts: DataFrame) -> DataFrame:
    """answer_id, claim, status, confidence, evidence of claims (answer_id, claim, text, citations) against contexts
    (answer_id, citation_id, chunk_id, text, page, allowed). A claim is held against the best of what it cites; a citation
    is valid if its context exists, may be read, and its page is positive or unknown."""
    valid = contexts.where(F.col("allowed") & (F.col("page").isNull() | (F.col("page") > 0))).select("answer_id", "citation_id", F.col("chunk_id").alias("_chunk"), F.col("text").alias("_evidence"))
    each = claims.select("answer_id", "claim", "text", F.explode("citations").alias("citation_id")).join(valid, ["answer_id", "citation_id"], "left")
    s = F.when(F.col("_evidence").isNotNull(), support(F.col("text"), F.col("_evidence")))
    n = F.substring("citation_id", 2, 9).try_cast("int")
    best = F.max(F.when(s.isNotNull(), F.struct(s.alias("s"), (-n).alias("n"), numbers_supported(F.col("text"), F.col("_evidence")).alias("ok"), F.col("_chunk").alias("chunk"))))
    got = each.groupBy("answer_id", "claim").agg(F.bool_and(F.col("_evidence").isNotNull()).alias("_known"), best.alias("_b"))
    df = claims.join(got, ["answer_id", "claim"], "left")
    score = F.col("_b.s")
    status = (
        F.when(F.col("_known").isNull(), "unsupported")
        .when(~F.col("_known"), "invalid_citation")
        .when((score >= LEAST) & F.col("_b.ok"), "verified")
        .when(score > 0, "partially_supported")
        .otherwise("unsupported")
    )
    sound = status.isin("verified", "partially_supported")
    return df.select("answer_id", "claim", status.alias("status"), F.round(F.when(sound, score).otherwise(0.0), 4).alias("confidence"), F.when(sound, F.col("_b.chunk")).alias("evidence"), F.size("citations").alias("n_citations"))


def verify(answers: DataFrame, claims: DataFrame, contexts: DataFrame) -> DataFrame:
    """answer_id, status, coverage, unsupported_ratio, n_valid, invalid of answers (answer_id, answer): one with an invalid
    citation is invalid, with an unsupported claim unsupported, with a partly supported one partly supported."""
    c = verify_claims(claims, contexts)
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    by = c.groupBy("answer_id").agg(F.count("*").alias("n"), of("unsupported", "invalid_citation").alias("bad"), of("partially_supported").alias("part"), F.count_if(F.col("n_citations") > 0).alias("cited"))
    good = contexts.where(F.col("allowed") & (F.col("page").isNull() | (F.col("page") > 0)))
    ids = contexts.groupBy("answer_id").agg(F.count_if(~F.col("allowed")).alias("removed"), F.collect_set(F.when(F.col("allowed") & (F.col("page") <= 0), F.col("citation_id"))).alias("off"))
    known = good.groupBy("answer_id").agg(F.collect_set("citation_id").alias("known"))
    df = answers.join(by, "answer_id", "left").join(ids, "answer_id", "left").join(known, "answer_id", "left")
    none = F.array().cast("array<string>")
    used = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1)), lambda n: F.concat(F.lit("C"), n)))
    wrong = F.array_sort(F.array_union(F.array_except(used, F.coalesce("known", none)), F.coalesce("off", none)))
    n = F.coalesce("n", F.lit(0))
    df = df.withColumns({"invalid": wrong, "_used": used})
    status = F.when(F.size("invalid") > 0, "invalid_citation").when(F.col("bad") > 0, "unsupported").when(F.col("part") > 0, "partially_supported").otherwise("verified")
    coverage = F.when(n > 0, F.col("cited") / n).when(F.size("_used") > 0, 1.0).when(F.coalesce("answer", F.lit("")) != "", 0.0).otherwise(1.0)
    warnings = F.array_compact(F.array(F.when(F.coalesce("removed", F.lit(0)) > 0, "UNAUTHORIZED_CITATION_REMOVED"), F.when(F.size("invalid") > 0, "INVALID_CITATION"), F.when((n > 0) & (F.col("cited") == 0) & F.col("known").isNotNull(), "MISSING_CITATION_MARKER"), F.when(F.col("bad") > 0, "UNSUPPORTED_CLAIM")))
    return df.select("answer_id", status.alias("status"), F.round(coverage, 4).alias("coverage"), F.round(F.when(n > 0, F.col("bad") / n).otherwise(0.0), 4).alias("unsupported_ratio"), F.size(F.coalesce("known", none)).alias("n_valid"), "invalid", warnings.alias("warnings"))


def citation_records(hits: DataFrame, most: int = 240) -> DataFrame:
    """query_id, citation_id, doc_id, title, source, page_start, page_end, snippet, confidence of hits (query_id, rank,
    doc_id, score, text, title, source, page, page_start, page_end): aliases resolved, the score clamped to 0 to 1."""
    snippet = F.left(collapse(F.coalesce("text", F.lit(""))), F.lit(most))
    return hits.select("query_id", F.concat(F.lit("C"), "rank").alias("citation_id"), "doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.element_at(F.split("source", "/"), -1)).alias("title"), "source", F.coalesce("page_start", "page").alias("page_start"), F.coalesce("page_end", "page_start", "page").alias("page_end"), snippet.alias("snippet"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))).alias("confidence"))


def word_snippet(text: Column, most: int = 200) -> Column:
    """The beginning of a text, cut at a word."""
    t = collapse(text)
    cut = F.regexp_replace(F.left(t, F.lit(most)), r"\s+\S*$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(F.substring(t, most + 1, 1) == " ", F.left(t, F.lit(most))).otherwise(cut), F.lit("...")))


def fallback_summary(contexts: DataFrame, prefix: str, most: int = 3, chars: int = 220) -> DataFrame:
    """query_id, answer: a line for each of the first contexts (query_id, rank, text), with its marker."""
    line = F.concat(F.lit("- "), F.left(collapse(F.coalesce("text", F.lit(""))), F.lit(chars)), F.lit(" [C"), F.col("rank").cast("string"), F.lit("]"))
    few = contexts.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls"))
    return few.select("query_id", F.concat_ws("\n", F.lit(prefix), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("answer"))


def grounded(answers: DataFrame, verified: DataFrame, contexts: DataFrame, confidence: DataFrame) -> DataFrame:
    """answer_id, answer, status, confidence, label, sources (distinct, by their first context), warnings: one struct's
    worth of columns an answer, from answers, verify(), contexts (answer_id, rank, source) and (answer_id, confidence)."""
    from lodestone.operators.answers import label

    first = contexts.groupBy("answer_id", "source").agg(F.min("rank").alias("rank")).groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"))
    df = answers.join(verified, "answer_id", "left").join(first, "answer_id", "left").join(confidence, "answer_id", "left")
    return df.select("answer_id", "answer", "status", "confidence", label(F.col("confidence")).alias("label"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "warnings")


def answer_pipeline(queries: DataFrame, hits: DataFrame, limit: int = 6000) -> DataFrame:
    """query_id, answer, refusal, status, coverage, confidence of queries (query_id, text) over hits (query_id, doc_id,
    rank, score, text): safety, extractive answer from contexts within a budget, guard, claims, verification, conflicts,
    refusal, confidence; each step one join by query."""
    from lodestone.operators import answers as an
    from lodestone.operators.grounding import context_budget, retrieval_status

    contexts = context_budget(hits, ["rank"], limit).withColumn("text", collapse(F.col("text")))
    said = fallback_summary(contexts, "", most=3).withColumn("answer", F.regexp_replace("answer", r"^\n", ""))
    flat = said.select(F.col("query_id").alias("answer_id"), "answer")
    claims = an.claims(flat).select("answer_id", "claim", "text", "citations")
    cited = contexts.select(F.col("query_id").alias("answer_id"), F.concat(F.lit("C"), "rank").alias("citation_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text", F.lit(None).cast("int").alias("page"), F.lit(True).alias("allowed"))
    v = verify(flat, claims, cited).withColumnRenamed("answer_id", "query_id").withColumnRenamed("status", "verification")
    n_claims = claims.groupBy(F.col("answer_id").alias("query_id")).agg(F.count("*").alias("n_claims"))
    sides = an.conflicts(contexts.select("query_id", "doc_id", "text")).groupBy("query_id").agg(F.count("*").alias("n_conflicts"))
    mean = hits.groupBy("query_id").agg(F.avg("score").alias("mean"))
    bad = contexts.groupBy("query_id").agg(F.bool_or(injected(F.col("text"))).alias("_bad"))
    df = retrieval_status(hits, queries, least=1).join(queries.select("query_id", injected(F.col("text")).alias("_asked")), "query_id")
    for x in (said, v, n_claims, sides, mean, bad):
        df = df.join(x, "query_id", "left")
    df = df.na.fill(0, ["n_claims", "n_conflicts", "mean", "best"]).na.fill({"coverage": 0.0, "unsupported_ratio": 0.0, "n_valid": 0, "_bad": False, "_asked": False})
    no = F.lit(False)
    df = df.withColumn("refusal", an.refusal(F.col("n"), F.col("best"), F.col("coverage"), F.col("unsupported_ratio"), F.col("n_claims"), no, no, F.col("_bad") | F.col("_asked")))
    c = an.confidence(F.col("best"), F.col("mean"), F.col("n_valid"), F.col("coverage"), F.col("unsupported_ratio"), F.col("n"), F.length(F.coalesce("answer", F.lit(""))), F.col("status"), F.col("refusal").isNotNull(), F.col("n_conflicts"))
    return df.select("query_id", F.when(F.col("refusal").isNull(), F.col("answer")).alias("answer"), "refusal", "status", "coverage", c.alias("confidence"))
