"""The registered queries of the retrieval, evaluation and operations side, each with its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import answers, chunks, dense, enrich, filters, grounding, layout, metrics, records, retrieval, splits, traces
from lodestone.sources import web
from lodestone.streaming import metrics as stream
from lodestone.streaming import state
from lodestone.plans.registry import QUERIES, SQL, TOK, query, read

__all__ = ["QUERIES", "SQL"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25 = f"""
t AS (SELECT doc_id, {TOK} AS ts FROM documents),
p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t WHERE len(ts) > 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * qtf), 6) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20)"""
OVER = f"""
qd AS (SELECT DISTINCT query_id, term FROM qt), qn AS (SELECT query_id, count(*) AS n FROM qd GROUP BY query_id),
oc AS (SELECT query_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM tf JOIN qd USING (term) JOIN qn USING (query_id) GROUP BY query_id, doc_id),
ov AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM oc QUALIFY rank <= 20)"""


def bm25_list(spark, sf_dir, k=20):
    return retrieval.ranked(retrieval.bm25(read(spark, sf_dir, "documents"), questions(spark, sf_dir)), k)


def overlap_list(spark, sf_dir, k=20):
    return retrieval.ranked(retrieval.overlap(read(spark, sf_dir, "documents"), questions(spark, sf_dir)), k)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return bm25_list(spark, sf_dir, 10)


@query(f"WITH t AS (SELECT {TOK} AS ts FROM documents) SELECT count(*) AS n_docs, round(avg(len(ts)), 6) AS avgdl FROM t WHERE len(ts) > 0")
def corpus_statistics(spark, sf_dir):
    return retrieval.corpus_statistics(read(spark, sf_dir, "documents")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH p AS (SELECT doc_id, unnest({TOK}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term")
def term_statistics(spark, sf_dir):
    return retrieval.term_statistics(retrieval.postings(read(spark, sf_dir, "documents")))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(greatest(0, (1 + list_cosine_similarity(embedding::DOUBLE[], q)) / 2), 6) AS score FROM embeddings, q)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def dense_topk(spark, sf_dir):
    """The queries are the vectors of every hundredth id, against all vectors."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.ranked(dense.search(v, v.where("id % 100 = 0"), 10), 10)


@query(f"""WITH {BM25}, {OVER}, u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM bm UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM ov),
f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def rrf_fusion(spark, sf_dir):
    return retrieval.ranked(retrieval.rrf([bm25_list(spark, sf_dir), overlap_list(spark, sf_dir)]), 10).drop("first_list")


@query(f"""WITH {BM25}, {OVER}, u AS (SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rank) AS s FROM bm UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) FROM ov),
f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def weighted_rrf(spark, sf_dir):
    return retrieval.ranked(retrieval.rrf([bm25_list(spark, sf_dir), overlap_list(spark, sf_dir)], [0.7, 0.3]), 10).drop("first_list")


@query(f"""WITH {BM25}, {OVER}, u AS (SELECT query_id, doc_id, rank, 0 AS l FROM bm UNION ALL SELECT query_id, doc_id, rank, 1 FROM ov),
m AS (SELECT query_id, doc_id, min(rank * 2 + l) AS place FROM u GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM m QUALIFY rank <= 10""")
def interleave(spark, sf_dir):
    return retrieval.interleave([bm25_list(spark, sf_dir), overlap_list(spark, sf_dir)], 10)


def containing(spark, sf_dir):
    """query_id, doc_id of documents that contain a passage. They have its tokens, but for the first and the last, which
    may be parts of longer ones; a passage without others is held against all documents, block by block of passages."""
    q, d = questions(spark, sf_dir), read(spark, sf_dir, "documents")
    ts = tx.tokens(F.col("text"))
    inner = q.select("query_id", F.array_distinct(F.filter(F.slice(ts, 2, F.greatest(F.size(ts) - 2, F.lit(0))), lambda t: F.length(t) >= 2)).alias("ts"))
    terms = inner.select("query_id", F.size("ts").alias("n"), F.explode("ts").alias("term"))
    rows = d.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text"), 2))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    cand = rows.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"), F.first("n").alias("n")).where("c = n").select("query_id", "doc_id")
    found = cand.join(d.select("doc_id", F.col("text").alias("body")), "doc_id").join(q, "query_id").where(F.contains("body", "text")).select("query_id", "doc_id")
    bare = q.join(inner.where(F.size("ts") == 0), "query_id", "left_semi").groupBy().agg(F.collect_list(F.struct("query_id", "text")).alias("qs"))
    held = d.crossJoin(F.broadcast(bare)).select("doc_id", F.explode(F.filter("qs", lambda x: F.contains(F.col("text"), x["text"]))).alias("x")).select("x.query_id", "doc_id")
    return found.unionByName(held)


@query(f"""WITH {BM25}, rel AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text)),
need AS (SELECT query_id, count(*) AS r FROM rel GROUP BY query_id), hits AS (SELECT query_id, rank FROM bm JOIN rel USING (query_id, doc_id) WHERE rank <= 10),
g AS (SELECT query_id, count(*) AS h, min(rank) AS f, sum(1 / log2(rank + 1.0)) AS dcg FROM hits GROUP BY query_id)
SELECT query_id, round(coalesce(h, 0) / r, 6) AS recall, round(coalesce(h, 0) / 10, 6) AS precision, round(coalesce(1.0 / f, 0), 6)::DOUBLE AS mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(r, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg, (coalesce(h, 0) > 0)::INTEGER AS hit FROM need LEFT JOIN g USING (query_id)""")
def ir_metrics(spark, sf_dir):
    return metrics.ir_metrics(bm25_list(spark, sf_dir, 20), containing(spark, sf_dir), 10)


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY event_type""")
def latency_report(spark, sf_dir):
    return metrics.latency(read(spark, sf_dir, "events"), "event_type", "value")


ACL = """SELECT doc_id, lang AS tenant_id, source AS owner_id, ['public','private','users','roles','department'][(doc_id % 5 + 1)::INTEGER] AS vis, 'src' || (doc_id % 7) AS u, 'R' || (doc_id % 3) AS ro, 'd' || (doc_id % 2) AS dep FROM documents"""


@query(f"WITH a AS ({ACL}) SELECT doc_id FROM a WHERE tenant_id = 'en' AND (vis = 'public' OR vis = 'private' AND owner_id = 'src1' OR vis = 'users' AND (u = 'src1' OR owner_id = 'src1') OR vis = 'roles' AND ro = 'R2' OR vis = 'department' AND dep = 'd1')")
def acl_filter(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    kinds = F.array(*map(F.lit, ("public", "private", "users", "roles", "department")))
    d = d.select("doc_id", F.col("lang").alias("tenant_id"), F.col("source").alias("owner_id"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("acl_visibility"), F.array(F.concat(F.lit("src"), F.col("doc_id") % 7)).alias("acl_users"), F.array(F.concat(F.lit("R"), F.col("doc_id") % 3)).alias("acl_roles"), F.concat(F.lit("d"), F.col("doc_id") % 2).alias("acl_department"))
    return d.where(filters.can_access(filters.Caller("en", "src1", ("r2",), "d1"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def typed_filter(spark, sf_dir):
    f = filters.RetrievalFilter(tenant="en", source_types=("src1", "src2"), columns={"tenant": "lang", "id": "doc_id", "type": "source"})
    return read(spark, sf_dir, "documents").where(f.matches()).select("doc_id")


CHUNKS = """c AS (SELECT doc_id, i::INTEGER AS chunk_index, i * 400 AS s, text AS body FROM documents, LATERAL (SELECT unnest(range(CASE WHEN length(text) <= 500 THEN 1 ELSE ceil((length(text) - 500) / 400.0)::BIGINT + 1 END)) AS i) WHERE length(text) > 0),
k AS (SELECT doc_id, chunk_index, s::INTEGER AS char_start, least(s + 500, length(body))::INTEGER AS char_end, substr(body, s + 1, 500) AS text FROM c)"""


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, char_start, char_end, sha256(text) AS content_hash, sha256(doc_id::VARCHAR)[:8] || '_' || lpad(chunk_index::VARCHAR, 4, '0') || '_' || sha256(text)[:8] AS chunk_id FROM k")
def sliding_chunks(spark, sf_dir):
    return chunks.identified(chunks.sliding_window(read(spark, sf_dir, "documents"))).drop("text")


@query(rf"""WITH {CHUNKS}, q AS (SELECT *, greatest(len(regexp_extract_all(text, '[^ \t\r\n]')), 1) AS solid FROM k)
SELECT doc_id, chunk_index, length(text)::INTEGER AS n_chars, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::INTEGER AS n_tokens, len(regexp_extract_all(text, '[.!?]+'))::INTEGER AS n_sentences,
  round(len(regexp_extract_all(text, '\p{{P}}')) / solid, 6) AS punctuation, round(len(regexp_extract_all(text, '�')) / solid, 6) AS garbled, length(text) < 50 AS too_short, length(text) > 2000 AS too_long,
  row_number() OVER (PARTITION BY doc_id, lower(trim(text)) ORDER BY chunk_index) > 1 AS duplicate FROM q""")
def chunk_quality(spark, sf_dir):
    return chunks.chunk_quality(chunks.sliding_window(read(spark, sf_dir, "documents")))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[Bb]earer [A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), 'sk-[A-Za-z0-9]{16,}|AKIA[A-Z0-9]{16}', '[API_KEY]', 'g'), '(password|passwd|secret|token|api_key)(\s*[:=]\s*)\S+', '\1\2[REDACTED]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS text FROM documents""")
def redaction(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.mask(F.col("text")).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, trim(array_to_string(regexp_extract_all(trim(regexp_replace(text, '[ \t\r\n\x0b\x0c]+', ' ', 'g')), '[^.!?]+[.!?]*')[:3], '')) AS s FROM documents)
SELECT doc_id, coalesce(regexp_replace(list_filter(ls, lambda x: regexp_matches(x, '^#{1,6} '))[1], '^#+ ', ''), list_filter(ls[:5], lambda x: length(x) <= 60 AND NOT regexp_matches(x, '[.,]$'))[1], 'Untitled') AS title, CASE WHEN length(s) > 240 THEN rtrim(left(s, 237)) || '...' ELSE s END AS summary FROM l""")
def titles_and_summaries(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.title(F.col("text")).alias("title"), tx.summary(F.col("text")).alias("summary"))


@query(r"""WITH p AS (SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')), '') AS t, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), '') AS h,
  regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g') AS bare FROM pages)
SELECT page_id, coalesce(t, h, 'Untitled') AS title, array_to_string(list_filter(list_transform(string_split(bare, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM p""")
def html_documents(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.html_title(F.col("html")).alias("title"), web.html_text(F.col("html")).alias("text"))


@query(rf"""WITH {BM25}, b AS (SELECT query_id, doc_id, rank, b.text AS claim, d.text AS ev FROM bm JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE rank <= 3),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[\p{{L}}\p{{N}}_]+')) AS cw, list_distinct(regexp_extract_all(lower(ev), '[\p{{L}}\p{{N}}_]+')) AS ew, list_distinct(regexp_extract_all(claim, '[0-9]+(?:\.[0-9]+)?')) AS cn, list_distinct(regexp_extract_all(ev, '[0-9]+(?:\.[0-9]+)?')) AS en,
  contains(lower(trim(regexp_replace(ev, '[ \t\r\n\x0b\x0c]+', ' ', 'g'))), lower(trim(regexp_replace(claim, '[ \t\r\n\x0b\x0c]+', ' ', 'g')))) AS inside FROM b),
s AS (SELECT query_id, doc_id, rank, round(CASE WHEN inside THEN 1.0::DOUBLE ELSE 0.7::DOUBLE * CASE WHEN len(cw) = 0 THEN 1 ELSE len(list_intersect(cw, ew)) / len(cw) END + 0.3::DOUBLE * CASE WHEN len(cn) = 0 THEN 1 ELSE len(list_intersect(cn, en)) / len(cn) END END, 6) AS support FROM w)
SELECT *, CASE WHEN support >= 0.35 THEN 'verified' WHEN support > 0 THEN 'partial' ELSE 'unsupported' END AS status FROM s""")
def claim_support(spark, sf_dir):
    """Every benchmark passage as a claim, against its three best documents."""
    hits = bm25_list(spark, sf_dir, 3)
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("evidence"))
    both = hits.join(d, "doc_id").join(questions(spark, sf_dir), "query_id")
    s = F.round(grounding.support(F.col("text"), F.col("evidence")), 6)
    return both.select("query_id", "doc_id", "rank", s.alias("support"), grounding.verdict(s).alias("status"))


@query(f"""WITH {BM25}, {OVER}, h AS (SELECT query_id, count(*) AS n, max(score) AS best FROM ov WHERE rank <= 5 GROUP BY query_id)
SELECT item_id AS query_id, coalesce(n, 0)::BIGINT AS n, best, CASE WHEN n IS NULL THEN 'no_results' WHEN n < 3 OR best < 0.2 THEN 'insufficient' ELSE 'sufficient' END AS status FROM benchmark LEFT JOIN h ON h.query_id = item_id""")
def retrieval_status(spark, sf_dir):
    return grounding.retrieval_status(overlap_list(spark, sf_dir, 5), questions(spark, sf_dir), least=3)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_version(spark, sf_dir):
    return records.latest(read(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH b AS (SELECT doc_id, sha256(text) AS content_hash FROM documents) SELECT doc_id, content_hash FROM b WHERE content_hash NOT IN (SELECT content_hash FROM b WHERE doc_id % 2 = 0)
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1""")
def idempotent_ingest(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return records.unseen(d, d.where("doc_id % 2 = 0")).select("doc_id", "content_hash")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), q AS (SELECT *, n * 97 / sum(n) OVER () AS q FROM c), f AS (SELECT *, floor(q)::BIGINT AS f FROM q)
SELECT source, n, (f + CASE WHEN row_number() OVER (ORDER BY round(q - f, 9) DESC, source) <= 97 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS seats FROM f""")
def largest_remainder(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return records.largest_remainder(counts, "source", "n", 97)


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    return stream.windowed(read(spark, sf_dir, "events")).withColumns({"total": F.round("total", 6), "start": F.col("start").cast("timestamp_ntz")})


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    return stream.sessions(read(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT lang, source, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def collection_report(spark, sf_dir):
    return read(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


COMPACT = r"trim(regexp_replace(text, '[ \t\r\n\x0b\x0c]+', ' ', 'g'))"
LINES = f"l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS text FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(documents.text, chr(10))) + 1)) AS i)), k AS (SELECT doc_id, line_no::INTEGER AS line_no, {COMPACT} AS c FROM l WHERE length({COMPACT}) > 0)"


@query(f"""WITH {LINES} SELECT doc_id, line_no, CASE WHEN regexp_matches(c, '{layout.CAPTION}') THEN 'caption' WHEN regexp_matches(c, '{layout.CODE}') THEN 'code'
WHEN len(regexp_extract_all(c, '{layout.FORMULA}')) >= greatest(2, length(c) // 8) THEN 'formula' WHEN regexp_matches(c, '{layout.LIST}') THEN 'list' ELSE 'paragraph' END AS kind FROM k""")
def block_types(spark, sf_dir):
    return layout.lines(read(spark, sf_dir, "documents")).select("doc_id", "line_no", layout.block_type(F.col("text")).alias("kind"))


@query(f"""WITH e AS (SELECT DISTINCT source, doc_id, regexp_replace(lower({COMPACT.replace('text', 'line')}), '[0-9]+', '#', 'g') AS norm FROM (SELECT source, doc_id, string_split(text, chr(10))[1] AS line FROM documents)) SELECT source, norm, count(*) AS n_pages FROM e WHERE norm <> '' GROUP BY source, norm HAVING count(*) >= 2""")
def repeated_headers(spark, sf_dir):
    """The documents of a source as its pages, their first lines as the header band."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.split("text", "\n")[0].alias("text"))
    return layout.repeated_edges(d).withColumnRenamed("doc_id", "source")


@query(f"""WITH e AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents), b AS (SELECT source, doc_id, 'header' AS place, {COMPACT.replace('text', 'ls[1]')} AS c FROM e UNION ALL SELECT source, doc_id, 'footer', {COMPACT.replace('text', 'ls[-1]')} FROM e),
r AS (SELECT source AS rs, place AS rp, lower(c) AS norm FROM b WHERE c <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2), s AS (SELECT source AS ss, count(DISTINCT doc_id) > 1 AS several FROM documents GROUP BY source)
SELECT doc_id, place, CASE WHEN norm IS NOT NULL THEN place WHEN place = 'footer' AND several AND regexp_matches(c, '{layout.PAGE_NUMBER}') THEN place ELSE 'body' END AS kind,
  CASE WHEN norm IS NOT NULL THEN 'repeated_text' WHEN place = 'footer' AND several AND regexp_matches(c, '{layout.PAGE_NUMBER}') THEN 'page_number' END AS reason FROM b LEFT JOIN r ON source = rs AND place = rp AND lower(c) = norm LEFT JOIN s ON ss = source""")
def page_bands(spark, sf_dir):
    """The documents of a source as its pages, their first and last lines as blocks at the edges; equal texts only."""
    ls = F.split("text", "\n")
    block = lambda place, y, text: F.struct(F.lit(place).alias("place"), F.lit(y).alias("y0"), F.lit(y + 10.0).alias("y1"), text.alias("text"))
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array(block("header", 10.0, F.get(ls, F.lit(0))), block("footer", 780.0, F.element_at(ls, -1)))).alias("b"))
    d = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "b.*", F.lit(800.0).alias("height"))
    return layout.page_bands(d, share=None).select(F.col("page").alias("doc_id"), "place", "kind", "reason")


@query(r"""WITH r AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{P}+=<>$%^|~`]')) AS e, greatest(len(regexp_extract_all(text, '[^ \t\r\n]')), 1) AS s FROM documents) SELECT doc_id, round(e / s, 6) AS ratio, e / s >= 0.8 AND e >= 20 AS passes FROM r""")
def page_quality(spark, sf_dir):
    ratio, passes = layout.readable(F.col("text"), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", ratio.alias("ratio"), passes.alias("passes"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
c AS (SELECT o_custkey AS doc_id, n // 4 AS part, string_agg('| ' || o_orderkey || ' | x |', chr(10) ORDER BY n) AS body FROM o GROUP BY ALL)
SELECT doc_id, part::INTEGER AS part, '| order | mark |' || chr(10) || '| --- | --- |' || chr(10) || body AS text FROM c""")
def table_chunks(spark, sf_dir):
    """A customer's orders as a markdown table, between two lines of prose, cut into parts of four rows."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    body = F.array_join(F.transform("ks", lambda k: F.concat(F.lit("| "), k.cast("string"), F.lit(" | x |"))), "\n")
    d = o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("Orders\n| order | mark |\n| --- | --- |\n"), body, F.lit("\nend")).alias("text"))
    return splits.table_chunks(d, rows=5).select("doc_id", "part", "text")


@query()
def recursive_chunks(spark, sf_dir):
    return splits.recursive(read(spark, sf_dir, "documents"))


@query()
def parent_child_chunks(spark, sf_dir):
    return splits.parent_child(read(spark, sf_dir, "documents"))


@query()
def sentence_chunks(spark, sf_dir):
    return splits.sentence_chunks(read(spark, sf_dir, "documents"))


@query("""WITH f AS (SELECT page_id AS doc_id, regexp_extract_all('page' || chr(10) || '```' || chr(10) || html || chr(10) || '```' || chr(10), '(?s)```.*?```') AS bs FROM pages), b AS (SELECT doc_id, i - 1 AS block, string_split(bs[i], chr(10)) AS ls FROM f, LATERAL (SELECT unnest(range(1, len(bs) + 1)) AS i)),
p AS (SELECT doc_id, block, ls, unnest(range((len(ls) - 1) // 10 + 1)) AS part FROM b) SELECT doc_id, block::INTEGER AS block, part::INTEGER AS part, array_to_string(ls[part * 10 + 1:part * 10 + 10], chr(10)) AS text FROM p""")
def code_chunks(spark, sf_dir):
    """Every page's markup in a fence, by ten lines."""
    p = read(spark, sf_dir, "pages")
    return splits.code_chunks(p.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("page\n```\n"), F.col("html"), F.lit("\n```\n")).alias("text")), lines=10)


@query()
def enriched(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", enrich.entities(t).alias("entities"), enrich.questions(tx.title(t), tx.summary(t)).alias("questions"), enrich.heading_path(t).alias("heading_path"))


@query()
def refined_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", enrich.refined(F.col("text")).alias("text"))


@query("""WITH c AS (SELECT doc_id, source, (length(text) // 4 + 512) / 1000 * 0.002 AS cost FROM documents), s AS (SELECT *, round(sum(cost) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 8) AS spent FROM c) SELECT source, doc_id, spent FROM s WHERE spent <= 0.05""")
def enrichment_budget(spark, sf_dir):
    """The documents of a source, in order, that a model's budget pays for."""
    cost = (F.floor(F.length("text") / 4) + 512) / 1000 * 0.002
    return enrich.within_budget(read(spark, sf_dir, "documents"), "source", ["doc_id"], cost, 0.05).select("source", "doc_id", "spent")


@query(f"""WITH {BM25}, h AS (SELECT query_id, doc_id, score, lower(b.text) AS q, lower(d.text) AS t, lower(d.source) AS s, lower(d.lang) AS l FROM bm JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 10),
w AS (SELECT *, regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_-]+') AS ts FROM h)
SELECT query_id, doc_id, round(score * CASE WHEN len(list_filter(ts, lambda x: contains(s, x))) > 0 THEN 1.20::DOUBLE ELSE 1 END * CASE WHEN len(list_filter(ts, lambda x: contains(l, x))) > 0 THEN 1.15::DOUBLE * 1.10 ELSE 1 END * CASE WHEN contains(t, q) OR contains(s, q) OR contains(l, q) THEN 1.25::DOUBLE ELSE 1 END, 4) AS score FROM w""")
def score_boost(spark, sf_dir):
    """Source as title, language as heading and tag."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), "source", "lang")
    both = bm25_list(spark, sf_dir, 10).join(d, "doc_id").join(questions(spark, sf_dir), "query_id")
    s = answers.boosted(F.col("score"), F.col("text"), F.col("source"), F.col("lang"), F.col("lang"), F.col("body"))
    return both.select("query_id", "doc_id", F.round(s, 4).alias("score"))


@query(f"""WITH {BM25}, {OVER}, h AS (SELECT query_id, count(*) AS n, max(score) AS best, avg(score) AS mean, sum((score >= 0.35)::INTEGER) AS sup FROM ov WHERE rank <= 5 GROUP BY query_id),
f AS (SELECT item_id AS query_id, coalesce(n, 0) AS n, coalesce(best, 0) AS best, coalesce(mean, 0) AS mean, coalesce(sup, 0) AS sup, length(text) AS len FROM benchmark LEFT JOIN h ON query_id = item_id),
g AS (SELECT *, CASE WHEN n > 0 THEN sup / n ELSE 0 END AS cov, CASE WHEN n = 0 THEN 0 WHEN n < 3 OR best < 0.2 THEN 0.35 ELSE 1 END AS st FROM f),
r AS (SELECT *, CASE WHEN n = 0 THEN 'NO_RETRIEVAL_RESULTS' WHEN best < 0.2 THEN 'LOW_RETRIEVAL_SCORE' WHEN cov = 0 THEN 'NO_VALID_CITATIONS' WHEN 1 - cov > 0.35 THEN 'UNSUPPORTED_GENERATED_CLAIMS' WHEN cov < 0.5 THEN 'NO_VALID_CITATIONS' END AS refusal FROM g)
SELECT query_id, refusal, round(CASE WHEN refusal IS NOT NULL OR n = 0 THEN 0 ELSE best * 0.14::DOUBLE + mean * 0.10 + best * 0.12 + least(1, sup / 3) * 0.12 + cov * 0.18 + cov * 0.12 + CASE WHEN n > 1 THEN 1 ELSE 0.7 END * 0.08
  + CASE WHEN len = 0 THEN 0 WHEN len <= 800 THEN 1 ELSE (1 - least(0.7, (len - 800) / 4000)) * (0.6 + 0.4 * cov) END * 0.04 + st * 0.06 + 0.04 END, 4)::DOUBLE AS confidence FROM r""")
def answer_confidence(spark, sf_dir):
    """The passage as the answer: contexts that hold 0.35 of its terms support it."""
    hits = overlap_list(spark, sf_dir, 5)
    got = hits.groupBy("query_id").agg(F.avg("score").alias("mean"), F.sum((F.col("score") >= 0.35).cast("int")).alias("sup"))
    s = grounding.retrieval_status(hits, questions(spark, sf_dir), least=3).join(got, "query_id", "left").join(questions(spark, sf_dir), "query_id").na.fill(0, ["best", "mean", "sup"])
    s = s.withColumn("cov", F.when(F.col("n") > 0, F.col("sup") / F.col("n")).otherwise(0.0))
    no = F.lit(False)
    s = s.withColumn("refusal", answers.refusal(F.col("n"), F.col("best"), F.col("cov"), 1 - F.col("cov"), F.col("n"), no, no, no))
    c = answers.confidence(F.col("best"), F.col("mean"), F.col("sup"), F.col("cov"), 1 - F.col("cov"), F.col("n"), F.length("text"), F.col("status"), F.col("refusal").isNotNull(), F.lit(0))
    return s.select("query_id", "refusal", c.alias("confidence"))


@query()
def answer_claims(spark, sf_dir):
    """Every document as an answer, with all its claims."""
    a = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.col("text").alias("answer"))
    return answers.claims(a, most=None).select("answer_id", "claim", "text", F.size("citations").alias("n_citations"), "confidence")


@query(f"""WITH f0 AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '{answers.FIELD}', 1)) AS value, unnest(regexp_extract_all(text, '{answers.FIELD}', 2)) AS says, unnest(range(len(regexp_extract_all(text, '{answers.FIELD}', 2)))) AS i FROM documents), f AS (SELECT source, doc_id, value, arg_max(says, i) AS says FROM f0 GROUP BY ALL),
s AS (SELECT source, doc_id, a || '/' || b AS value, unnest([a, b]) AS says, lower(text) AS t FROM documents, (VALUES {', '.join(f"('{a}', '{b}')" for a, b in answers.OPPOSITES)}) AS o(a, b)),
u AS (SELECT source, doc_id, 'field_value' AS kind, value, says FROM f UNION ALL SELECT source, doc_id, 'status', value, says FROM s WHERE contains(t, says)),
g AS (SELECT source, kind, value, says, min(doc_id) AS lo, max(doc_id) AS hi, count(DISTINCT doc_id) AS d FROM u GROUP BY ALL)
SELECT source, kind, value, sum(d)::BIGINT AS n FROM g GROUP BY source, kind, value HAVING count(*) > 1 AND min(lo) < max(hi)""")
def source_conflicts(spark, sf_dir):
    """The documents of a source as its contexts."""
    return answers.conflicts(read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", "text")).withColumnRenamed("query_id", "source")


@query("SELECT user_id::VARCHAR AS trace_id, event_type AS stage, value AS duration FROM events")
def trace_rows(spark, sf_dir):
    """A user's events as the stages of a trace."""
    s = F.struct(F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"), F.lit(None).cast("string").alias("document_id"), F.array().cast("array<struct<document_id string, chunk_id string, preview string>>").alias("chunks"))
    t = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("trace_id")).agg(F.collect_list(s).alias("stages"))
    return traces.trace_rows(t.withColumns({"status": F.lit("ok"), "elapsed_ms": F.lit(0.0), "document_id": F.lit("")})).select("trace_id", "stage", "duration")


@query("SELECT event_id FROM events WHERE ('0x' || sha256(event_id::VARCHAR)[:12])::BIGINT / 281474976710656 < 0.25")
def sampled_traces(spark, sf_dir):
    return read(spark, sf_dir, "events").where(traces.sampled(F.col("event_id").cast("string"), 0.25)).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, TRUE AS allowed, us AS a1, NULL::BIGINT AS a2 FROM e WHERE n = 1 UNION ALL SELECT user_id, event_id, n, ok, CASE WHEN ok THEN us ELSE a1 END, CASE WHEN ok THEN a1 ELSE a2 END FROM (SELECT e.*, r.a1, r.a2, r.a2 IS NULL OR r.a2 <= e.us - 21600000000 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id AS id, allowed FROM r""")
def rate_limited(spark, sf_dir):
    """At most two events of a user within six hours."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("id"))
    return state.rate_limited(e, 2, 6 * 3600e6).select("id", "allowed")


from lodestone.plans import documents, evaluation, operations, search  # noqa: E402, F401  they register theirs
