"""Evaluation, each query with its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluation, grounding
from lodestone.plans import queries
from lodestone.plans.queries import BM25, OVER, bm25_list, overlap_list, questions
from lodestone.plans.registry import SQL, query, read
from lodestone.sources import files

REL = "rel AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text))"


def relevant(spark, sf_dir):
    """Pairs of a passage and a document that contains it."""
    return queries.containing(spark, sf_dir)


@query(f"WITH x AS ({SQL['ir_metrics']}) SELECT name, round(avg(value), 4) AS value FROM (UNPIVOT (SELECT recall::DOUBLE AS recall, precision::DOUBLE AS precision, mrr::DOUBLE AS mrr, ndcg::DOUBLE AS ndcg FROM x) ON recall, precision, mrr, ndcg INTO NAME name VALUE value) GROUP BY name")
def metric_means(spark, sf_dir):
    m = queries.ir_metrics(spark, sf_dir)
    long = m.select("query_id", F.explode(F.create_map(*[x for c in ("recall", "precision", "mrr", "ndcg") for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value"))
    return evaluation.metric_means(long, [])


@query(f"WITH {BM25}, {REL}, f AS (SELECT query_id, min(rank) AS f FROM bm JOIN rel USING (query_id, doc_id) GROUP BY query_id) SELECT item_id AS query_id, (f IS NOT NULL)::INTEGER::DOUBLE AS hit_rate, round(coalesce(1.0 / f, 0), 6)::DOUBLE AS mrr FROM benchmark LEFT JOIN f ON query_id = item_id")
def unbounded_metrics(spark, sf_dir):
    return evaluation.unbounded(bm25_list(spark, sf_dir, 20), relevant(spark, sf_dir), questions(spark, sf_dir))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'chunk_id' WHEN 3 THEN 'none' ELSE 'source' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'k' || doc_id WHEN 1 THEN 'a.md,' || lower(coalesce(source, '')) || '.md' WHEN 2 THEN 'x/y/a.md,b.md' ELSE '' END AS labels FROM documents""")
def relevance_labels(spark, sf_dir):
    m, none = F.col("doc_id") % 4, F.array().cast("array<string>")
    ids = F.when(m == 0, F.array(F.concat(F.lit("k"), "doc_id"))).otherwise(none)
    sources = F.when(m == 1, F.array(F.lit(" A.md "), F.concat(F.coalesce("source", F.lit("")), F.lit(".MD")))).when(m == 2, F.array(F.lit("X\\Y\\a.md"), F.lit("b.md"))).otherwise(none)
    d = read(spark, sf_dir, "documents").select("doc_id", evaluation.relevance_labels(ids, sources).alias("r"))
    return d.select("doc_id", "r.kind", F.array_join("r.labels", ",").alias("labels"))


@query("""WITH h AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE (l_partkey % 3)::VARCHAR END AS doc_id FROM lineitem), b AS (SELECT query_id, doc_id, min(rank) AS place FROM h WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place, doc_id) AS rank FROM b""")
def document_hits(spark, sf_dir):
    """Order lines as chunk hits; the document stands in the source or in the id, or nowhere."""
    named = F.concat(F.lit("s3/doc_"), F.col("l_partkey") % 3, F.lit(".md"))
    m = F.col("l_partkey") % 5
    h = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.when(m.isin(1, 2), named).otherwise("").alias("source"), F.when(m > 2, named).alias("chunk_id"))
    return evaluation.as_documents(h, "doc_([0-9a-f]+)", "source", "chunk_id")


@query("""WITH h AS (SELECT l_orderkey AS q, CASE l_partkey % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 2 THEN 'chart' WHEN 3 THEN 'text' WHEN 5 THEN 'diagram' END AS m FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_orderkey, 'table' FROM lineitem WHERE l_linenumber <= 3 AND l_suppkey % 4 = 0),
g AS (SELECT q, list(DISTINCT m) FILTER (m IS NOT NULL) AS got FROM h GROUP BY q), e AS (SELECT o_orderkey AS q, CASE o_orderkey % 3 WHEN 0 THEN ['image', 'table'] WHEN 1 THEN ['text'] ELSE []::VARCHAR[] END AS want FROM orders)
SELECT q AS query_id, CASE WHEN len(want) > 0 THEN round(len(list_intersect(want, coalesce(got, []))) / len(want), 6) ELSE -1 END AS recall, CASE WHEN list_contains(want, 'image') THEN list_has_any(coalesce(got, []), ['image', 'figure', 'chart', 'diagram'])::INTEGER::DOUBLE ELSE -1 END AS image_hit,
  CASE WHEN list_contains(want, 'table') THEN list_contains(coalesce(got, []), 'table')::INTEGER::DOUBLE ELSE -1 END AS table_hit FROM e LEFT JOIN g USING (q)""")
def modality_metrics(spark, sf_dir):
    """Order lines as hits of many kinds; -1 stands for "nothing expected"."""
    kinds = F.array(*map(F.lit, ("Photo", "tabular", "plot", "plain text", "", "Diagram")))
    h = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int")).alias("modality"), F.lit("no").alias("image_id"), F.when(F.col("l_suppkey") % 4 == 0, "t1").otherwise("0").alias("table_id"))
    m = F.col("o_orderkey") % 3
    e = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(m == 0, F.array(F.lit("picture"), F.lit("Table"))).when(m == 1, F.array(F.lit("text"))).otherwise(F.array().cast("array<string>")).alias("modalities"))
    return evaluation.modality_metrics(h, e, 3).na.fill(-1.0)


@query("""WITH r AS (SELECT l_orderkey AS q, list(['chunk_id:k' || l_partkey, 'page:' || l_linenumber] ORDER BY l_linenumber, 'chunk_id:K' || l_partkey) AS labels FROM lineitem GROUP BY l_orderkey)
SELECT q AS query_id, round(CASE q % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN list_contains(flatten(labels), 'page:1') THEN 0.5 ELSE 0 END ELSE CASE WHEN len(labels) > 1 THEN 1.0 ELSE 0 END END, 6)::DOUBLE AS accuracy FROM r""")
def citation_accuracy(spark, sf_dir):
    """Answers that cite by number, by page, or by a number that may be too high."""
    lab = F.array(F.concat(F.lit("chunk_id:K"), "l_partkey"), F.concat(F.lit("page:"), "l_linenumber"))
    r = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", lab.alias("x")))), lambda s: s["x"]).alias("labels"))
    first, second, m = F.get("labels", F.lit(0)), F.get("labels", F.lit(1)), F.col("q") % 3
    want = F.when(m == 0, first).when(m == 1, F.array(F.lit("page:1"), F.lit("image_id:none"))).otherwise(F.coalesce(F.slice(second, 1, 1), F.array(F.lit("chunk_id:zzz"))))
    answer = F.when(m == 0, "As stated [1].").when(m == 1, "See page 1 of it.").otherwise("It is so [2].")
    return r.select(F.col("q").alias("query_id"), F.round(evaluation.citation_accuracy(want, evaluation.cited_labels(answer, F.col("labels"))), 6).alias("accuracy"))


@query("""WITH a AS (SELECT l_orderkey AS q, count(*) FILTER (l_returnflag = 'N') AS v, count(*) FILTER (l_returnflag = 'R') AS i, count(*) FILTER (l_linestatus = 'O') AS s, count(*) FILTER (l_linestatus = 'F') AS u FROM lineitem GROUP BY l_orderkey)
SELECT q AS query_id, round(CASE WHEN v + i > 0 THEN v / (v + i) ELSE 0 END, 6) AS citation_precision, round(CASE WHEN v + i > 0 THEN i / (v + i) ELSE 0 END, 6) AS invalid_citation_rate, round(CASE WHEN s + u > 0 THEN u / (s + u) ELSE 0 END, 6) AS unsupported_claim_ratio, ((v = 0) = (q % 2 = 0))::INTEGER::DOUBLE AS refusal_accuracy FROM a""")
def trust_metrics(spark, sf_dir):
    """An order's lines as citations and claims."""
    n = lambda c, x: F.count_if(F.col(c) == x)
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(n("l_returnflag", "N").alias("v"), n("l_returnflag", "R").alias("i"), n("l_linestatus", "O").alias("s"), n("l_linestatus", "F").alias("u"))
    return a.select(F.col("q").alias("query_id"), *evaluation.trust_metrics(F.col("v"), F.col("i"), F.col("s"), F.col("u"), F.col("v") == 0, F.col("q") % 2 == 0))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN coalesce(CASE doc_id % 5 WHEN 2 THEN 'no_contexts' WHEN 3 THEN 'no_ground_truth' END, '') ELSE 'no_answer' END AS skipped, CASE WHEN doc_id % 5 IN (1, 4) THEN least(1.0, (doc_id % 13) / 10)::DOUBLE ELSE -1 END AS score FROM documents")
def judge_scores(spark, sf_dir):
    m = F.col("doc_id") % 5
    said = F.concat(F.lit('{"score": '), ((F.col("doc_id") % 13) / 10).cast("string"), F.lit("}"))
    contexts = F.when(m == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("c")))
    j = evaluation.judged(F.when(m == 0, " ").otherwise("a"), contexts, F.when(m != 3, "t"), said)
    return read(spark, sf_dir, "documents").select("doc_id", j.alias("j")).select("doc_id", F.coalesce("j.skipped", F.lit("")).alias("skipped"), F.coalesce("j.score", F.lit(-1.0)).alias("score"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a=1.0,b=3.0,c=4.0' WHEN 1 THEN 'a=1.0,b=2.0' ELSE '' END AS metrics FROM documents")
def composite_metrics(spark, sf_dir):
    m = F.col("doc_id") % 3
    one = F.when(m < 2, F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)))
    two = F.when(m == 0, F.create_map(F.lit("b"), F.lit(3.0), F.lit("c"), F.lit(4.0)))
    pairs = F.array_sort(F.map_entries(evaluation.composite(one, two)))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"].cast("string"))), ",")
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(text, F.lit("")).alias("metrics"))


@query(f"""WITH {BM25}, {OVER}, {REL}, m AS (SELECT 'bm25' AS mode, query_id, doc_id, rank FROM bm UNION ALL SELECT 'overlap', query_id, doc_id, rank FROM ov),
h AS (SELECT mode, query_id, min(rank) AS f, count(*) AS h FROM m JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY ALL), n AS (SELECT query_id, count(*) AS r FROM rel GROUP BY query_id), b AS (SELECT unnest(['bm25', 'overlap']) AS mode, query_id, r FROM n)
SELECT mode, query_id, round(coalesce(h, 0) / r, 6) AS recall, round(coalesce(1.0 / f, 0), 6)::DOUBLE AS mrr FROM b LEFT JOIN h USING (mode, query_id)""")
def mode_comparison(spark, sf_dir):
    out = evaluation.compare_modes({"bm25": bm25_list(spark, sf_dir, 20), "overlap": overlap_list(spark, sf_dir, 20)}, relevant(spark, sf_dir), 10)
    return out.select("mode", "query_id", "recall", "mrr")


@query(rf"WITH {BM25}, c AS (SELECT query_id, rank, left(trim(regexp_replace(text, '[ \t\r\n\x0b\x0c]+', ' ', 'g')), 240) AS t FROM bm JOIN documents USING (doc_id) WHERE rank <= 3) SELECT query_id, string_agg(t, ' ' ORDER BY rank) AS answer FROM c GROUP BY query_id")
def extractive_answers(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluation.extractive_answer(bm25_list(spark, sf_dir, 3).join(d, "doc_id"))


@query(rf"""WITH {BM25}, c AS (SELECT query_id, doc_id, rank, trim(regexp_replace(text, '[ \t\r\n\x0b\x0c]+', ' ', 'g')) AS t FROM bm JOIN documents USING (doc_id) WHERE rank <= 5),
u AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c) SELECT query_id, doc_id, rank, left(t, (6000 - used)::BIGINT) AS text FROM u WHERE used < 6000""")
def packed_contexts(spark, sf_dir):
    from lodestone.functions.text import collapse

    d = read(spark, sf_dir, "documents").select("doc_id", collapse(F.col("text")).alias("text"))
    c = bm25_list(spark, sf_dir, 5).join(d, "doc_id").select("query_id", "doc_id", "rank", "text")
    return grounding.context_budget(c, ["rank"], 6000)


@query("""WITH e AS (SELECT event_type, count(*) AS n, round(sum(round((greatest(1, length(event_type) // 4) + user_id % 7) / 1000.0::DOUBLE * 0.002, 8)), 6) AS cost FROM events GROUP BY event_type)
SELECT '| event_type | n | cost | none |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' | ' || printf('%.6f', cost) || ' | - |', chr(10) ORDER BY event_type) AS report FROM e""")
def markdown_report(spark, sf_dir):
    """Estimated cost by event type, as a table."""
    cost = evaluation.estimated_cost(F.col("event_type"), F.col("user_id") % 7, 0.002)
    e = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"))
    e = e.select("event_type", "n", F.format_string("%.6f", "cost").alias("cost"), F.lit(None).alias("none"))
    return files.markdown_report(e, "event_type", ["n", "cost", "none"])


@query("""SELECT l_returnflag AS flag, 0.5::DOUBLE AS p, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6)::DOUBLE AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 0.95, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.99, round(quantile_cont(l_extendedprice::DOUBLE, 0.99), 6) FROM lineitem GROUP BY 1""")
def exact_percentiles(spark, sf_dir):
    out = evaluation.percentiles(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.select(F.col("l_returnflag").alias("flag"), "p", F.round("value", 6).alias("value"))
