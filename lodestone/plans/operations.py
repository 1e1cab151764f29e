"""Security, verification, document store and operations, each query with its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import filters, store, traces, verification
from lodestone.plans.queries import BM25, CHUNKS, bm25_list, questions
from lodestone.plans.registry import query, read


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def lits(*xs):
    return F.array(*map(F.lit, xs))


INJECT = "|".join(verification.INJECTIONS).replace("'", "''")
SAID = "CASE doc_id % 6 WHEN 0 THEN ' Ignore  previous instructions' WHEN 1 THEN ' in General' WHEN 2 THEN ' [C1] [C9]' WHEN 3 THEN ' 你现在是' ELSE '' END"


def said(spark, sf_dir):
    tail = F.element_at(lits(" Ignore  previous instructions", " in General", " [C1] [C9]", " 你现在是", "", ""), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.concat("text", tail).alias("text"))


@query(f"WITH d AS (SELECT doc_id, text || {SAID} AS text FROM documents) SELECT doc_id, regexp_matches(text, '(?i){INJECT}') AS injected, {' OR '.join(f'''contains(lower(text), '{p}')''' for p in verification.EXTERNAL)} AS external FROM d")
def unsafe_texts(spark, sf_dir):
    t = F.col("text")
    return said(spark, sf_dir).where("text is not null").select("doc_id", verification.injected(t).alias("injected"), verification.external(t).alias("external"))


@query(f"""WITH d AS (SELECT doc_id, text || {SAID} AS text, doc_id % 4 > 0 AS has, doc_id % 3 AS st FROM documents), u AS (SELECT *, list_distinct(regexp_extract_all(text, '\\[C([0-9]+)\\]', 1)) AS used FROM d),
w AS (SELECT *, list_sort(list_transform(list_filter(used, lambda n: NOT (has AND n IN ('1', '2'))), lambda n: 'C' || n)) AS bad FROM u)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT has AND trim(text) <> '' THEN 'NO_CONTEXT_FOR_ANSWER' END, CASE WHEN len(bad) > 0 THEN 'INVALID_CITATION_MARKER:' || array_to_string(bad, ',') END, CASE WHEN has AND len(used) = 0 AND trim(text) <> '' THEN 'MISSING_CITATION_MARKER' END,
  CASE WHEN {' OR '.join(f'''contains(lower(text), '{p}')''' for p in verification.EXTERNAL)} THEN 'POSSIBLE_EXTERNAL_INFERENCE' END, CASE st WHEN 0 THEN 'NO_RETRIEVAL_RESULTS' WHEN 1 THEN 'INSUFFICIENT_RETRIEVAL_RESULTS' END], lambda x: x IS NOT NULL), ' ') AS warnings FROM w""")
def answer_guard(spark, sf_dir):
    ids = F.when(F.col("doc_id") % 4 > 0, lits("C1", "C2")).otherwise(F.array().cast("array<string>"))
    status = F.element_at(lits("no_results", "insufficient", "sufficient"), (F.col("doc_id") % 3 + 1).cast("int"))
    return said(spark, sf_dir).select("doc_id", F.array_join(verification.guard(F.col("text"), ids, status), " ").alias("warnings"))


STOP = "[" + ", ".join(f"'{w}'" for w in verification.BARE) + "]"
CLAIMED = rf"""cl AS (SELECT item_id AS a, text AS claim, list_filter([CASE WHEN item_id % 5 <> 4 THEN 'C1' END, CASE WHEN item_id % 5 IN (1, 2) THEN 'C2' END, CASE WHEN item_id % 5 = 2 THEN 'C9' END], lambda x: x IS NOT NULL) AS cs FROM benchmark),
ev_ AS (SELECT query_id AS a, 'C' || rank AS cid, text AS ev FROM bm JOIN documents USING (doc_id) WHERE rank <= 3 AND NOT (query_id % 7 = 0 AND rank = 1)),
xx AS (SELECT c.a, claim, u.cid, ev, lower(trim(regexp_replace(claim, '\[[Cc][0-9]+\]', '', 'g'))) AS low FROM cl c, LATERAL (SELECT unnest(cs) AS cid) u LEFT JOIN ev_ e ON e.a = c.a AND e.cid = u.cid),
tt AS (SELECT *, list_filter(list_distinct(regexp_extract_all(low, '[a-z0-9_./:-]+|[一-鿿]')), lambda w: NOT list_contains({STOP}, w)) AS ct, list_distinct(regexp_extract_all(lower(ev), '[a-z0-9_./:-]+|[一-鿿]')) AS et, list_distinct(regexp_extract_all(claim, '{verification.NUMBER}')) AS cn, list_distinct(regexp_extract_all(ev, '{verification.NUMBER}')) AS en FROM xx),
sc_ AS (SELECT *, CASE WHEN ev IS NULL THEN NULL WHEN low <> '' AND contains(lower(ev), low) THEN 1.0::DOUBLE ELSE len(list_intersect(ct, et)) / greatest(1, len(ct)) * 0.7::DOUBLE + CASE WHEN len(cn) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(cn, en)) / len(cn) END * 0.3::DOUBLE END AS s, len(list_filter(cn, lambda n: NOT list_contains(en, n))) = 0 AS ok FROM tt),
bb AS (SELECT a, bool_and(ev IS NOT NULL) AS known, max(s) AS best, arg_max(ok, (s, -substr(cid, 2)::INTEGER)) AS ok FROM sc_ GROUP BY a),
vv AS (SELECT c.a, len(cs) AS n, CASE WHEN known IS NULL THEN 'unsupported' WHEN NOT known THEN 'invalid_citation' WHEN best >= 0.35 AND ok THEN 'verified' WHEN best > 0 THEN 'partially_supported' ELSE 'unsupported' END AS status, best FROM cl c LEFT JOIN bb USING (a))"""


def claimed(spark, sf_dir):
    """Passages as claims that cite the first contexts, one that does not exist, or nothing; some contexts are denied."""
    m = F.col("query_id") % 5
    cs = F.array_compact(F.array(F.when(m != 4, "C1"), F.when(m.isin(1, 2), "C2"), F.when(m == 2, "C9")))
    claims = questions(spark, sf_dir).select(F.col("query_id").alias("answer_id"), F.lit(0).alias("claim"), "text", cs.alias("citations"))
    hits = bm25_list(spark, sf_dir, 3).join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    allowed = ~((F.col("query_id") % 7 == 0) & (F.col("rank") == 1))
    contexts = hits.select(F.col("query_id").alias("answer_id"), F.concat(F.lit("C"), "rank").alias("citation_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text", F.lit(None).cast("int").alias("page"), allowed.alias("allowed"))
    return claims, contexts


@query(f"WITH {BM25}, {CLAIMED} SELECT a AS answer_id, status, round(CASE WHEN status IN ('verified', 'partially_supported') THEN best ELSE 0 END, 4)::DOUBLE AS confidence FROM vv")
def verified_claims(spark, sf_dir):
    return verification.verify_claims(*claimed(spark, sf_dir)).select("answer_id", "status", "confidence")


@query(f"""WITH {BM25}, {CLAIMED}, w AS (SELECT v.*, list_sort(list_filter(cs, lambda x: x = 'C9' OR v.a % 7 = 0 AND x = 'C1')) AS bad FROM vv v JOIN cl c USING (a))
SELECT a AS answer_id, CASE WHEN len(bad) > 0 THEN 'invalid_citation' WHEN status IN ('unsupported', 'invalid_citation') THEN 'unsupported' ELSE status END AS status, (n > 0)::INTEGER::DOUBLE AS coverage, (status IN ('unsupported', 'invalid_citation'))::INTEGER::DOUBLE AS unsupported_ratio, array_to_string(bad, ',') AS invalid FROM w""")
def verified_answers(spark, sf_dir):
    claims, contexts = claimed(spark, sf_dir)
    marks = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c, F.lit("]"))), " ")
    answers = claims.select("answer_id", F.concat_ws(" ", "text", marks).alias("answer"))
    return verification.verify(answers, claims, contexts).select("answer_id", "status", "coverage", "unsupported_ratio", F.array_join("invalid", ",").alias("invalid"))


@query(rf"""WITH {BM25} SELECT query_id, 'C' || rank AS citation_id, doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END), ''), source || '.md') AS title, left(trim(regexp_replace(text, '[ \t\r\n\x0b\x0c]+', ' ', 'g')), 240) AS snippet, greatest(0, least(1, score / 40))::DOUBLE AS confidence FROM bm JOIN documents USING (doc_id) WHERE rank <= 5""")
def citation_records(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("title"), F.concat(F.lit("a/b/"), "source", F.lit(".md")).alias("source"))
    none = F.lit(None).cast("int")
    hits = bm25_list(spark, sf_dir, 5).withColumn("score", F.col("score") / 40).join(d, "doc_id").withColumns({"page": none, "page_start": none, "page_end": none})
    return verification.citation_records(hits).select("query_id", "citation_id", "doc_id", "title", "snippet", "confidence")


@query(rf"""WITH {BM25}, c AS (SELECT query_id, rank, left(trim(regexp_replace(text, '[ \t\r\n\x0b\x0c]+', ' ', 'g')), 220) AS t FROM bm JOIN documents USING (doc_id) WHERE rank <= 3) SELECT query_id, 'Found:' || chr(10) || string_agg('- ' || t || ' [C' || rank || ']', chr(10) ORDER BY rank) AS answer FROM c GROUP BY query_id""")
def fallback_summaries(spark, sf_dir):
    return verification.fallback_summary(bm25_list(spark, sf_dir, 3).join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id"), "Found:")


@query()
def grounded_answers(spark, sf_dir):
    """The whole chain from hits to an answer with its confidence, for every passage."""
    from lodestone.plans.queries import overlap_list

    hits = overlap_list(spark, sf_dir, 5).join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return verification.answer_pipeline(questions(spark, sf_dir), hits)


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a|b ' || doc_id WHEN 1 THEN 'x|y' ELSE '' END AS users FROM documents""")
def acl_lists(spark, sf_dir):
    m = F.col("doc_id") % 3
    v = F.when(m == 0, F.concat(F.lit('["a", " ", "b '), "doc_id", F.lit('"]'))).when(m == 1, " x, ,y ")
    return docs(spark, sf_dir).select("doc_id", F.array_join(filters.acl_list(v), "|").alias("users"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 't1') AS tenant_id, 'u1' AS owner_id, CASE WHEN doc_id % 3 = 0 THEN 'private' ELSE 'tenant' END AS acl_visibility FROM documents")
def acl_stamps(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("tenant_id"), F.when(F.col("doc_id") % 3 == 0, "Private").alias("acl_visibility"))
    return filters.stamped(d, filters.Caller("t1", "u1", (), "d1")).select("doc_id", "tenant_id", "owner_id", "acl_visibility")


@query(f"WITH {BM25} SELECT query_id, count(*) AS n_in, count(*) FILTER (lang = 'en') AS n_out, count(*) >= 20 AND count(*) FILTER (lang = 'en') < count(*) AS potential_recall_loss FROM bm JOIN documents USING (doc_id) GROUP BY query_id")
def recall_loss(spark, sf_dir):
    hits = bm25_list(spark, sf_dir, 20).join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return filters.recall_loss(hits, F.col("lang") == "en", 20)


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source <> 'src1' AND doc_id >= 10 AND doc_id < 900")
def where_clause(spark, sf_dir):
    c = {"lang": ["en", "de"], "source": {"$ne": "src1"}, "doc_id": {"$gte": 10, "$lt": 900}}
    return docs(spark, sf_dir).where(filters.where(c)).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= DATE '1995-03-01' AND o_orderdate <= DATE '1997-06-30'")
def dated_filter(spark, sf_dir):
    """A retrieval filter with types and a range of times."""
    f = filters.RetrievalFilter.of({"tenant": "O", "source_types": ["1-URGENT", "2-HIGH"], "since": "1995-03-01", "until": "1997-06-30"}, columns={**filters.COLUMNS, "tenant": "o_orderstatus", "type": "o_orderpriority", "at": "o_orderdate"})
    return read(spark, sf_dir, "orders").where(f.matches()).select("o_orderkey")


VERSIONS = "v AS (SELECT o_custkey AS document_id, o_orderkey AS version_id, ['active', 'failed', 'deleted', 'processing'][(o_orderkey % 4 + 1)::INTEGER] AS status, o_orderdate AS created_at FROM orders)"


def versions(spark, sf_dir):
    status = F.element_at(lits("active", "failed", "deleted", "processing"), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


@query("""WITH b AS (SELECT DISTINCT (doc_id % 40) AS d, sha256((doc_id % 40) || '|' || coalesce(lang, '')) AS fp FROM documents), o AS (SELECT fp, CASE d % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'failed' END AS old FROM b)
SELECT fp AS fingerprint, CASE WHEN old = 'active' THEN 'active' ELSE 'processing' END AS status, CASE WHEN old IS NULL THEN 'created' WHEN old = 'failed' THEN 'reset' ELSE 'reused' END AS action FROM o""")
def version_ingest(spark, sf_dir):
    b = docs(spark, sf_dir).select((F.col("doc_id") % 40).alias("document_id"), F.col("lang").alias("content_hash"))
    b = b.withColumn("fingerprint", store.fingerprint(b))
    m = F.col("document_id") % 3
    old = b.where(m < 2).select("fingerprint", F.when(m == 0, "active").otherwise("failed").alias("status")).distinct()
    return store.ingest_versions(old, b)


@query(f"""WITH {VERSIONS}, r AS (SELECT document_id, arg_max(version_id, (created_at, version_id)) FILTER (status = 'active') AS cur FROM v GROUP BY document_id), g AS (SELECT cur FROM r WHERE cur % 3 <> 0),
n AS (SELECT document_id, arg_max(version_id, (created_at, version_id)) FILTER (status = 'active' AND version_id NOT IN (SELECT cur FROM g WHERE cur IS NOT NULL)) AS new FROM v GROUP BY document_id), f AS (SELECT document_id, CASE WHEN cur IN (SELECT cur FROM g WHERE cur IS NOT NULL) THEN new ELSE cur END AS c FROM r JOIN n USING (document_id))
SELECT document_id, coalesce(c, -1) AS current_version_id, CASE WHEN c IS NULL THEN 'deleted' ELSE 'active' END AS status FROM f""")
def version_delete(spark, sf_dir):
    """Orders as versions of a customer; current ones not divisible by three are deleted."""
    v = versions(spark, sf_dir)
    r = store.current(v)
    gone = r.where("current_version_id % 3 <> 0").select(F.col("current_version_id").alias("version_id"))
    return store.delete_versions(v, r, gone)[1].na.fill(-1, ["current_version_id"])


@query(f"""WITH {VERSIONS}, r AS (SELECT document_id, arg_max(version_id, (created_at, version_id)) FILTER (status = 'active') AS cur FROM v GROUP BY document_id), c AS (SELECT document_id, min(version_id) AS x FROM v GROUP BY document_id), ok AS (SELECT c.document_id, x FROM c JOIN v ON v.version_id = x WHERE status <> 'deleted')
SELECT document_id, coalesce(x, cur, -1) AS current_version_id FROM r LEFT JOIN ok USING (document_id)""")
def version_rollback(spark, sf_dir):
    """Back to each document's first version, where it was not deleted."""
    v = versions(spark, sf_dir)
    first = v.groupBy("document_id").agg(F.min("version_id").alias("version_id"))
    return store.activate(v, store.current(v).drop("status"), first).na.fill(-1, ["current_version_id"])


@query(f"WITH {CHUNKS} SELECT 'documents' AS store, count(*) AS deleted FROM documents WHERE source = 'src1' UNION ALL SELECT 'chunks', count(*) FROM k WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src1') UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def cascade_delete(spark, sf_dir):
    from lodestone.operators import chunks

    d = docs(spark, sf_dir)
    every = {"documents": d, "chunks": chunks.sliding_window(d), "labels": read(spark, sf_dir, "labels")}
    return store.cascade_delete(every, d.where("source = 'src1'"))[1]


@query("WITH h AS (SELECT sha256(text) AS content_hash, doc_id FROM documents), c AS (SELECT DISTINCT content_hash FROM h WHERE doc_id % 2 = 0) SELECT 'hit' AS kind, count(*) AS n FROM h WHERE content_hash IN (SELECT content_hash FROM c) UNION ALL SELECT 'computed', count(DISTINCT content_hash) FROM h WHERE content_hash NOT IN (SELECT content_hash FROM c)")
def embedding_cache(spark, sf_dir):
    h = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    hit, miss = store.cache_split(h, h.where("doc_id % 2 = 0").select("content_hash", F.lit(1).alias("v")).distinct())
    return hit.agg(F.count("*").alias("n")).select(F.lit("hit").alias("kind"), "n").unionByName(miss.agg(F.count("*").alias("n")).select(F.lit("computed").alias("kind"), "n"))


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS price FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE o_totalprice::DOUBLE END AS o_totalprice FROM orders) GROUP BY o_custkey")
def store_upsert(spark, sf_dir):
    """Every fifth order is written again with another price; the last write wins."""
    from lodestone.operators import records

    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    new = records.upsert(o, o.where("o_orderkey % 5 = 0").withColumn("price", F.lit(1.0)), "o_orderkey")
    return new.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("price").alias("price"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN doc_id || '::' || chunk_index ELSE sha256('p' || doc_id)[:8] || '_' || lpad(chunk_index::VARCHAR, 4, '0') || '_' || sha256(text)[:8] END AS id FROM k")
def upsert_ids(spark, sf_dir):
    from lodestone.operators import chunks

    c = chunks.sliding_window(docs(spark, sf_dir))
    own = F.when(F.col("chunk_index") % 2 == 0, F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))).otherwise("")
    return c.select("doc_id", "chunk_index", store.upsert_id(own, F.concat(F.lit("p"), "doc_id"), F.col("chunk_index"), F.col("text")).alias("id"))


@query("SELECT source AS collection, count(*) FILTER (lang = 'en') AS n_visible FROM documents GROUP BY source HAVING count(*) FILTER (lang = 'en') > 0")
def visible_collections(spark, sf_dir):
    return store.visible_collections(docs(spark, sf_dir).withColumnRenamed("source", "collection"), F.col("lang") == "en")


def cells(spark, sf_dir):
    from lodestone.operators import chunks

    c = chunks.sliding_window(docs(spark, sf_dir)).join(docs(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")
    i = F.col("chunk_index")
    meta = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("page"), F.when(i > 2, i.cast("string")), F.lit("k"), F.when(F.col("doc_id") % 9 == 0, "v")), lambda _, v: v.isNotNull())
    return c.select("doc_id", i, F.col("source").alias("collection"), F.floor(i / 3).alias("page"), "text", F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("lang")).alias("title"), F.lit(None).cast("string").alias("summary"), F.concat(F.lit("x/"), "source", F.lit(".md")).alias("source"), meta.alias("metadata"), "lang")


@query(f"""WITH {CHUNKS}, x AS (SELECT k.*, source, lang FROM k JOIN documents USING (doc_id)), m AS (SELECT source, unnest(list_filter([CASE WHEN lang IS NOT NULL THEN 'lang' END, CASE WHEN chunk_index > 2 THEN 'page' END, CASE WHEN doc_id % 9 = 0 THEN 'k' END], lambda y: y IS NOT NULL)) AS mk FROM x), g AS (SELECT source, string_agg(DISTINCT mk, ',' ORDER BY mk) AS metadata_keys FROM m GROUP BY source)
SELECT source AS collection, count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, any_value(metadata_keys) AS metadata_keys FROM x JOIN g USING (source) GROUP BY source""")
def collection_payload(spark, sf_dir):
    return store.collection_payload(cells(spark, sf_dir).where("collection is not null")).withColumn("metadata_keys", F.array_join("metadata_keys", ","))


@query(f"WITH {CHUNKS} SELECT k.doc_id, count(*) AS n_chunks, min(chunk_index // 3)::BIGINT AS page_start, max(chunk_index // 3)::BIGINT AS page_end, CASE WHEN k.doc_id % 2 = 0 THEN any_value(d.source) ELSE any_value(d.lang) END AS title, left(arg_min(k.text, chunk_index), 200) AS summary FROM k JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL GROUP BY k.doc_id")
def document_payload(spark, sf_dir):
    return store.document_payload(cells(spark, sf_dir).where("collection is not null"))


@query(f"WITH {CHUNKS} SELECT k.doc_id, chunk_index FROM k JOIN documents d USING (doc_id) WHERE d.source = 'src1' AND d.lang = 'en' AND chunk_index = 1")
def chunk_payload(spark, sf_dir):
    return store.resource(cells(spark, sf_dir), F.col("lang") == "en", collection="src1", chunk_index=1).select("doc_id", "chunk_index")


@query("SELECT event_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id, value LIMIT 50")
def newest_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "event_type")
    least = e.agg(F.min("event_type").alias("event_type"))
    return store.newest(e.join(F.broadcast(least), "event_type", "left_semi").drop("event_type"), "ts", 50)


@query("SELECT o_custkey, count(*) - 1 AS again FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return store.first_of_id(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"])[1]


@query("SELECT 'lang' AS name, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def manifest_counts(spark, sf_dir):
    return store.manifest(docs(spark, sf_dir), "lang", "source")


@query("SELECT l_partkey AS doc_id, count(DISTINCT l_orderkey) AS n_questions, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS source_types FROM lineitem GROUP BY l_partkey")
def gold_requirements(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("source_type"))
    return store.gold_requirements(pairs).select("doc_id", "n_questions", F.array_join("source_types", ",").alias("source_types"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS \"n_A\", count(*) FILTER (l_returnflag = 'R') AS \"n_R\" FROM lineitem GROUP BY l_orderkey")
def hit_counters(spark, sf_dir):
    return store.hit_counters(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ("A", "R"))


@query("WITH h AS (SELECT doc_id, source, sha256('7:' || doc_id) AS h FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS turn FROM h) SELECT doc_id, source FROM t ORDER BY turn, source NULLS FIRST LIMIT 60")
def balanced_sample(spark, sf_dir):
    return store.balanced_sample(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 60, seed=7)


@query("WITH x AS (SELECT user_id, event_id, ts, value FROM events) SELECT a.event_id, coalesce(b.event_id, -1) AS before FROM (SELECT * FROM x WHERE event_id % 2 = 0) a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM x WHERE event_id % 2 = 1 GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of_join(spark, sf_dir):
    """For every even event, the last odd one of its user at or before its time."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = store.as_of(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumnRenamed("event_id", "before"), "user_id", "ts", ["before"])
    return out.select("event_id", F.coalesce("before", F.lit(-1)).alias("before"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'collection' WHEN 2 THEN 'chunk' END AS kind, CASE WHEN doc_id % 5 < 3 THEN 'my docs' END AS collection, CASE doc_id % 5 WHEN 0 THEN 'd' || doc_id WHEN 2 THEN 'a+b' END AS id FROM documents")
def resource_addresses(spark, sf_dir):
    base = f"{scalars.SCHEME}://collections/my%20docs"
    uri = F.element_at(F.array(F.concat(F.lit(f"{base}/documents/d"), "doc_id"), F.lit(base), F.lit(f"{base}/chunks/a+b"), F.lit(f"{base}/documents/..%2Fx"), F.lit(f"{base}/documents")), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", scalars.resource(uri).alias("r")).select("doc_id", "r.kind", "r.collection", "r.id")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN 'not a time' ELSE '—' END AS at FROM events")
def zoned_times(spark, sf_dir):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    m = F.col("event_id") % 3
    at = F.when(m == 0, F.concat(iso, F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))).when(m == 1, "not a time").otherwise("")
    return read(spark, sf_dir, "events").select("event_id", scalars.zoned(at).alias("at"))


@query("SELECT o_orderkey, least(60.0, power(2.0, o_orderkey % 9)) AS wait, ceil(o_custkey / 32.0)::BIGINT AS batches, CASE WHEN o_orderkey % 10 = 0 THEN sha256('---')[:8] ELSE 'a-b-' || o_orderkey END AS slug FROM orders")
def retry_and_slugs(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 0, "---").otherwise(F.concat(F.lit(" A b!"), k))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.backoff(k % 9 + 1).alias("wait"), scalars.batches(F.col("o_custkey"), 32).alias("batches"), scalars.slug(text).alias("slug"))


@query(r"SELECT doc_id, left(regexp_replace(regexp_replace('auth Bearer abc.def, sk-abcdefghijkl12 password: p' || doc_id || ' mail me' || doc_id || '@x.org ' || left(replace(coalesce(lang, ''), '@', ''), 20), 'abc.def,? sk-abcdefghijkl12', 'abc.def, sk-abcdefghijkl12'), '^auth Bearer abc\.def, sk-abcdefghijkl12 password: p[0-9]+ mail me[0-9]+@x\.org', 'auth Bearer [REDACTED], [REDACTED] password: [REDACTED] mail [REDACTED]'), 256) AS text FROM documents")
def redacted_texts(spark, sf_dir):
    t = F.concat(F.lit("auth Bearer abc.def, sk-abcdefghijkl12 password: p"), "doc_id", F.lit(" mail me"), "doc_id", F.lit("@x.org "), F.coalesce("lang", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", scalars.redacted(t).alias("text"))


@query("SELECT event_id FROM events WHERE event_type <> (SELECT max(event_type) FROM events) AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retained_traces(spark, sf_dir):
    """Without the traces of one type, and only those of the last ten days."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    last = e.agg(F.max("ts").alias("_now"), F.max("event_type").alias("_gone"))
    e = traces.without(e.crossJoin(F.broadcast(last)), F.col("event_type") == F.col("_gone"))
    return traces.retained(e, "ts", F.col("_now"), 10).select("event_id")


@query("SELECT item_id, 'sha256:' || sha256(item_id::VARCHAR) AS actor, sha256(text) AS query_hash, left(text, 80) AS preview FROM benchmark")
def audit_rows(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    _, query_hash, preview = traces.audit(F.col("item_id").cast("string"), F.col("text"))
    return b.select("item_id", scalars.actor(F.col("item_id").cast("string")).alias("actor"), query_hash, preview)


@query("SELECT coalesce(source, '') AS collection, count(*) AS n_images, sum(length(text))::BIGINT AS bytes FROM documents GROUP BY source")
def image_stats(spark, sf_dir):
    from lodestone.sources import files

    return files.image_stats(docs(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("collection"), F.length("text").alias("bytes")))


@query("""WITH i AS (SELECT o_custkey AS d, list((o_orderkey % 7 + 1)::BIGINT ORDER BY o_orderkey) AS cs FROM orders GROUP BY o_custkey)
SELECT d AS doc_id, list_reduce(list_prepend(0::BIGINT, cs), lambda a, c: CASE WHEN a % 1000 + c <= 20 THEN a + c + 1000 ELSE a END) // 1000 AS n_taken FROM i""")
def affordable_items(spark, sf_dir):
    """A customer's orders within a budget; one that would pass it is skipped."""
    from lodestone.operators import enrich

    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("double").alias("cost")))).alias("xs"))
    return o.select("doc_id", F.size(enrich.affordable(F.transform("xs", lambda x: F.struct(x["cost"].alias("cost"))), 20.0)).cast("long").alias("n_taken"))
