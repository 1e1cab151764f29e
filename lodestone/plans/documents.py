"""Loading, parsing, chunking and enrichment of documents, each query with its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunks, enrich, parsed, tables
from lodestone.plans.queries import CHUNKS
from lodestone.plans.registry import query, read
from lodestone.sources import files


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' WHEN 2 THEN 'html' WHEN 3 THEN 'code' END AS loader FROM part")
def file_loaders(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("a/x.md", "b.v2.TXT", "c.HTM", "d.py", "e.xyz"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", files.loader(names, strict=False).alias("loader"))


@query(r"""WITH c AS (SELECT p_partkey, 'class P' || p_partkey || ' { } function f' || (p_partkey % 3) || ' (a) {} const g_' || (p_partkey % 2) || ' = (x) => x; let h = async function () {}; function f0(b) {}' AS code FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(code, '\bfunction\s+([A-Za-z_$][\w$]*)\s*\(', 1) || regexp_extract_all(code, '\bclass\s+([A-Za-z_$][\w$]*)\b', 1) || regexp_extract_all(code, '\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(', 1)
  || regexp_extract_all(code, '\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?function\b', 1))), ' ') AS names FROM c""")
def code_symbols(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.concat(F.lit("class P"), k, F.lit(" { } function f"), k % 3, F.lit(" (a) {} const g_"), k % 2, F.lit(" = (x) => x; let h = async function () {}; function f0(b) {}"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(files.symbols(code, "javascript"), " ").alias("names"))


@query("SELECT doc_id, source AS name, (1 + (doc_id % 4 = 1)::INTEGER)::BIGINT AS n FROM documents WHERE doc_id % 4 < 3")
def json_documents(spark, sf_dir):
    """An id's remainder by 4 says whether it is an object, a list of two, held under "records", or broken."""
    one = F.to_json(F.struct("doc_id", F.col("source").alias("name")), {"ignoreNullFields": "false"})
    m = F.col("doc_id") % 4
    text = F.when(m == 0, one).when(m == 1, F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]"))).when(m == 2, F.concat(F.lit('{"records": ['), one, F.lit("]}"))).otherwise(F.concat(one, F.lit("}{")))
    d = docs(spark, sf_dir).select(F.explode(files.json_records(text)).alias("r"))
    return d.groupBy(F.col("r")["doc_id"].cast("long").alias("doc_id"), F.col("r")["name"].alias("name")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS question_id, text AS question, lang AS question_type, source AS source_type FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2') AND trim(text) <> '' ORDER BY doc_id LIMIT 25")
def question_set(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"), F.col("lang").alias("question_type"), F.col("source").alias("source_type"))
    return files.question_set(d, ("EN", "de"), ("src1", "src2"), 25)


@query("SELECT item_id::VARCHAR AS query_id, text AS query, 'c' || item_id || ',c' || (item_id + 1) AS ids FROM benchmark")
def golden_set(spark, sf_dir):
    case = F.struct(F.col("text").alias("query"), F.array(F.concat(F.lit("c"), "item_id"), F.concat(F.lit("c"), F.col("item_id") + 1)).alias("expected_chunk_ids"), F.col("item_id").cast("string").alias("id"))
    one = read(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct(F.array(case).alias("test_cases"))).alias("j"))
    return one.select(F.col("item_id").cast("string").alias("query_id"), F.inline(files.golden_set(F.col("j")))).select("query_id", "query", F.array_join("expected_chunk_ids", ",").alias("ids"))


PAGES = r"""l AS (SELECT doc_id, i - 1 AS n, string_split(text, chr(10))[i] AS text FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(documents.text, chr(10))) + 1)) AS i)),
pg AS (SELECT doc_id, n // 5 AS page, string_agg(text, chr(10) ORDER BY n) AS text FROM l GROUP BY ALL)"""
SQUEEZE = r"trim(regexp_replace(text, '[ \t\r\n\x0b\x0c]+', ' ', 'g'))"


def pages_and_blocks(spark, sf_dir):
    """Lines as blocks, five of them a page."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    cut = F.split("text", "\n", -1)
    per_page = F.transform(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / 5).cast("int")), lambda i: F.array_join(F.slice(cut, i * 5 + 1, 5), "\n"))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(per_page).alias("page", "text")), lines


@query(rf"""WITH {PAGES}, c AS (SELECT doc_id, count(*) AS np, sum(length(text)) AS ch, sum(({SQUEEZE} = '')::INTEGER) AS bl, sum(len(regexp_extract_all(text, '[^ \t\r\n\x0b\x0c\x1c-\x1f\x{{85}}\p{{Z}}]'))) AS so,
  sum(len(regexp_extract_all(text, '[\x00-\x08\x0e-\x1b\x7f-\x{{84}}\x{{86}}-\x{{9f}}\p{{Cf}}\p{{Co}}\x{{FFFD}}]')) + len(regexp_extract_all(text, '\p{{So}}')) - len(regexp_extract_all(text, '[©®™]')) - len(regexp_extract_all(text, '\x{{FFFD}}')) + len(regexp_extract_all(text, '{parsed.MOJIBAKE}'))) AS bad FROM pg GROUP BY doc_id),
b AS (SELECT doc_id, lower({SQUEEZE}) AS t, count(*) AS c FROM l WHERE {SQUEEZE} <> '' GROUP BY ALL), g AS (SELECT doc_id, sum(c) AS nb, sum(c - 1) AS ag FROM b GROUP BY doc_id),
f AS (SELECT c.doc_id, ch / np AS d, CASE WHEN so = 0 THEN 0 ELSE least(1.0, bad / so) END AS r, bl / np AS e, coalesce(ag / nb, 0) AS a, bl = np AND coalesce(nb, 0) = 0 AS nothing FROM c LEFT JOIN g USING (doc_id))
SELECT doc_id, round(d, 2)::DOUBLE AS text_density, round(r, 4)::DOUBLE AS garbled_ratio, round(e, 4)::DOUBLE AS empty_page_ratio, round(a, 4)::DOUBLE AS duplicate_block_ratio,
  CASE WHEN nothing THEN 'rejected' WHEN r >= 0.2 THEN 'needs_manual_review' WHEN d < 20 OR e > 0.5 THEN 'needs_manual_review' WHEN e > 0 OR a > 0.4 THEN 'warning' ELSE 'accepted' END AS status FROM f""")
def parsed_quality(spark, sf_dir):
    return parsed.quality(*pages_and_blocks(spark, sf_dir)).drop("warnings")


@query(rf"""WITH {PAGES}, k AS (SELECT doc_id, n, CASE WHEN starts_with(text, '|') THEN 'table' WHEN regexp_matches(text, '^[A-Z]') THEN 'heading' ELSE 'paragraph' END AS kind FROM l)
SELECT doc_id, count(DISTINCT n // 5) AS n_pages, count(*) AS n_blocks, count(*) FILTER (kind = 'table') AS n_tables, count(*) FILTER (kind = 'image') AS n_images, count(*) FILTER (kind = 'heading') AS n_headings FROM k GROUP BY doc_id""")
def parsed_summary(spark, sf_dir):
    kind = F.when(F.col("text").startswith("|"), "table").when(F.col("text").rlike("^[A-Z]"), "heading").otherwise("paragraph")
    lines = pages_and_blocks(spark, sf_dir)[1].select("doc_id", F.floor(F.col("n") / 5).alias("page"), kind.alias("kind"))
    return parsed.summary(lines)


@query("""WITH c AS (SELECT l_orderkey AS doc_id, CASE WHEN count(*) % 2 = 0 THEN 'i1' ELSE 'i2' END AS img, count(*) > 5 AS two FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, CASE WHEN two THEN img || ',t1' ELSE img END AS refs, CASE WHEN two THEN 0 WHEN img = 'i1' THEN 3 ELSE 4 END AS page FROM c""")
def reference_sync(spark, sf_dir):
    """Chunks that name one image, or an image and a table; only the first kind takes page and box."""
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    img = F.when(F.col("n") % 2 == 0, "i1").otherwise("i2")
    c = c.select("doc_id", F.concat(F.lit("See [IMAGE: "), img, F.lit("] and [IMAGE: "), img, F.lit("]"), F.when(F.col("n") > 5, " beside [TABLE: t1]").otherwise("")).alias("text"))
    ids = F.array(F.struct(F.lit("i1").alias("ref_id"), F.lit(3).alias("page")), F.struct(F.lit("i2").alias("ref_id"), F.lit(4).alias("page")), F.struct(F.lit("t1").alias("ref_id"), F.lit(5).alias("page")))
    refs = c.select("doc_id", F.inline(ids)).withColumn("box", F.array(F.lit(0.0)))
    return parsed.located(c, refs).select("doc_id", F.array_join(F.concat("image_refs", "table_refs"), ",").alias("refs"), F.coalesce("page", F.lit(0)).alias("page"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
m AS (SELECT o_custkey, count(*) AS n_rows, string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY n) FILTER (n > 1) AS body, max('| ' || o_orderkey || ' | ' || o_orderstatus || ' |') FILTER (n = 1) AS head FROM o GROUP BY o_custkey HAVING count(*) >= 2),
t AS (SELECT o_custkey, n_rows::INTEGER AS n_rows, 2 AS n_cols, head || chr(10) || '| --- | --- |' || chr(10) || body AS markdown FROM m)
SELECT *, sha256(markdown)[:8] AS table_id FROM t""")
def text_tables(spark, sf_dir):
    """A customer's orders as rows parted by bars, tabs or spaces, between lines of prose."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    sep = F.element_at(F.array(F.lit(" | "), F.lit("\t"), F.lit("   ")), (F.col("o_custkey") % 3 + 1).cast("int"))
    edge = F.when(F.col("o_custkey") % 3 == 0, "|").otherwise("")
    lines = F.transform("o", lambda x: F.concat(edge, x["o_orderkey"].cast("string"), sep, x["o_orderstatus"], edge))
    d = o.select("o_custkey", F.concat(F.lit("All orders so far\n"), F.array_join(lines, "\n"), F.lit("\nend")).alias("text"))
    return tables.tables_of_text(d, "o_custkey").drop("confidence")


@query("""WITH w AS (SELECT o_custkey AS page, (o_orderkey % 90)::DOUBLE AS x, (o_orderkey % 70)::DOUBLE AS y, o_orderkey::VARCHAR AS text FROM orders),
r AS (SELECT page, row, col, x, text FROM w, (SELECT unnest(range(3)) AS row), (SELECT unnest(range(2)) AS col) WHERE y + 5 >= row * 30 - 1 AND y + 5 <= row * 30 + 31 AND x + 4 >= col * 50 - 1 AND x + 4 <= col * 50 + 51),
c AS (SELECT page, row, col, string_agg(text, ' ' ORDER BY x, text) AS cell FROM r GROUP BY ALL), f AS (SELECT page, row::INTEGER AS row, coalesce(max(cell) FILTER (col = 0), '') || '|' || coalesce(max(cell) FILTER (col = 1), '') AS cells FROM c GROUP BY page, row)
SELECT page, row, cells FROM f QUALIFY count(*) OVER (PARTITION BY page) >= 2""")
def grid_tables(spark, sf_dir):
    """A customer's orders as words on a page of three rows and two columns."""
    k = F.col("o_orderkey")
    w = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (k % 90).cast("double").alias("x0"), (k % 70).cast("double").alias("y0"), (k % 90 + 8).cast("double").alias("x1"), (k % 70 + 10).cast("double").alias("y1"), k.cast("string").alias("text"))
    rules = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    g = w.select("page").distinct().select("page", tables.distinct_rules(rules(0, 30, 31.5, 60, 90, 0.5)).alias("ys"), rules(0, 50, 100).alias("xs"))
    return tables.tables_of_grid(w, g, ["page"]).select("page", "row", F.array_join("cells", "|").alias("cells"))


MARKED = r"m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^([A-M])', '# \1', 'g'), '(?m)^([N-Z])', '## \1', 'g') AS text FROM documents)"


def marked(spark, sf_dir):
    t = F.regexp_replace(F.regexp_replace("text", r"(?md)^([A-M])", "# $1"), r"(?md)^([N-Z])", "## $1")
    return docs(spark, sf_dir).select("doc_id", t.alias("text"))


@query(rf"""WITH {MARKED}, l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM m, LATERAL (SELECT unnest(range(1, len(string_split(m.text, chr(10))) + 1)) AS i)),
f AS (SELECT *, sum(starts_with(line, '```')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM l), h AS (SELECT *, regexp_matches(line, '^#{{1,4}} ') AND fences % 2 = 0 AS hd FROM f),
s AS (SELECT *, sum(hd::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h), g AS (SELECT doc_id, k - 1 AS section, max(line) FILTER (hd) AS head, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hd), '') AS body FROM s WHERE k > 0 GROUP BY doc_id, k),
n AS (SELECT *, CASE WHEN starts_with(head, '## ') THEN 2 ELSE 1 END AS level, trim(regexp_replace(head, '^#+', '')) AS heading FROM g),
p AS (SELECT *, last_value(CASE WHEN level = 1 THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section) AS top FROM n)
SELECT doc_id, section::INTEGER AS section, heading, CASE WHEN level = 2 AND top IS NOT NULL THEN top || ' > ' || heading ELSE heading END AS path, regexp_replace(body, '^[ \t\r\n\x0b\x0c]+|[ \t\r\n\x0b\x0c]+$', '', 'g') AS text FROM p""")
def headed_sections(spark, sf_dir):
    """Lines that begin with a capital as headings of two levels."""
    s = chunks.headed_sections(marked(spark, sf_dir))
    return s.select("doc_id", "section", "heading", F.array_join("path", " > ").alias("path"), "text")


@query()
def section_chunks(spark, sf_dir):
    return chunks.section_aware(marked(spark, sf_dir)).select("doc_id", "section", "part", "heading", "text")


@query(f"WITH {CHUNKS}, x AS (SELECT k.*, left(concat_ws('；', nullif(trim(d.source), ''), nullif(trim(d.lang), '')), 6) AS prefix FROM k JOIN documents d USING (doc_id)) SELECT doc_id, chunk_index, sha256(text) AS original_hash, prefix <> '' AS contextualized, CASE WHEN prefix = '' THEN text ELSE prefix || chr(10) || chr(10) || text END AS text FROM x")
def contextual_chunks(spark, sf_dir):
    c = chunks.sliding_window(docs(spark, sf_dir)).join(docs(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")
    return chunks.contextual(c, F.col("source"), F.col("lang"), 6).select("doc_id", "chunk_index", "original_hash", "contextualized", "text")


@query(f"WITH {CHUNKS} SELECT c.doc_id, c.chunk_index, left(p.text, 200) AS parent_text FROM k c LEFT JOIN k p ON p.doc_id = c.doc_id AND p.chunk_index = c.chunk_index - 1")
def parent_lookup(spark, sf_dir):
    """A chunk's predecessor as its parent."""
    c = chunks.sliding_window(docs(spark, sf_dir))
    key = lambda i: F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string"))
    parents = c.select(key(F.col("chunk_index")).alias("chunk_id"), "text")
    return chunks.parent_text(c.withColumn("parent_chunk_id", key(F.col("chunk_index") - 1)), parents, 200).select("doc_id", "chunk_index", "parent_text")


MARKS = "[" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(low, '{m}')''' for m in ms)} THEN '{t}' END" for t, ms in enrich.TAG_MARKS) + "]"


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS twice, lower(text) AS low, lang, source FROM documents WHERE trim(text) <> ''),
c AS (SELECT doc_id, list_transform(list_filter([lang] || [source] || {MARKS} || regexp_extract_all(twice, '(?:^|[^\p{{L}}\p{{N}}_])([a-z]+(?:[A-Z][A-Za-z0-9]*)+|[a-z]+_[a-z0-9_]+)(?:[^\p{{L}}\p{{N}}_]|$)', 1)[:5] || regexp_extract_all(twice, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-zA-Z]{{2,}})(?:[^\p{{L}}\p{{N}}_]|$)', 1)[:8], lambda x: x IS NOT NULL AND trim(x) <> ''), lambda x: trim(x)) AS c FROM d)
SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i)[:8], ',') AS tags FROM c""")
def chunk_tags(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.trim("text") != "")
    empty = F.array().cast("array<string>")
    return d.select("doc_id", F.array_join(enrich.tags(F.col("text"), F.col("source"), empty, empty, [F.col("lang")]), ",").alias("tags"))


@query(r"""SELECT doc_id, CASE WHEN length(c) > 60 THEN rtrim(c[:57]) || '...' ELSE c END AS title, array_to_string(ts, ',') AS tags_text, array_to_string(hs[-5:], ' > ') AS heading_path_text FROM
(SELECT doc_id, trim(regexp_replace(left(text, 90), '[ \t\r\n\x0b\x0c]+', ' ', 'g')) AS c, list_filter(ts, lambda x, i: list_position(list_transform(ts, lambda y: lower(y)), lower(x)) = i)[:8] AS ts, [lang, 'a', 'b', source, 'c', 'd'] AS hs
 FROM (SELECT doc_id, text, lang, source, [lang, upper(lang), 'Tag', 'tag', source, '1', '2', '3', '4', '5', '6'] AS ts FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL))""")
def enrichment_fields(spark, sf_dir):
    d = docs(spark, sf_dir).where("source is not null and lang is not null")
    lits = lambda *xs: [F.lit(x) for x in xs]
    fields = {"title": F.left("text", F.lit(90)), "tags": F.array("lang", F.upper("lang"), *lits("Tag", "tag"), "source", *lits("1", "2", "3", "4", "5", "6")), "heading_path": F.array("lang", *lits("a", "b"), "source", *lits("c", "d"))}
    return d.select("doc_id", *enrich.validated(fields)).select("doc_id", "title", "tags_text", "heading_path_text")


@query("""SELECT item_id, CASE item_id % 4 WHEN 3 THEN NULL ELSE 'x' || item_id END AS title FROM benchmark""")
def model_answers(spark, sf_dir):
    """JSON within a fence, alone, between words, or broken."""
    obj = F.concat(F.lit('{"title": "x'), "item_id", F.lit('"}'))
    m = F.col("item_id") % 4
    said = F.when(m == 0, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n``` done"))).when(m == 1, obj).when(m == 2, F.concat(F.lit("so "), obj, F.lit(" ok"))).otherwise(F.concat(F.lit("no {"), obj))
    return read(spark, sf_dir, "benchmark").select("item_id", F.get_json_object(enrich.json_object(said), "$.title").alias("title"))


@query("WITH a AS (SELECT doc_id, [source, 'X', lang, 'x', upper(source), 'y'] AS a FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i)[:4], ',') AS tags FROM a")
def merged_tags(spark, sf_dir):
    d = docs(spark, sf_dir).where("source is not null and lang is not null")
    return d.select("doc_id", F.array_join(enrich.merged(F.array("source", F.lit("X")), F.array("lang", F.lit("x"), F.upper("source"), F.lit("y")), 4), ",").alias("tags"))


@query("WITH k AS (SELECT doc_id, sha256(doc_id || ':' || sha256(text) || ':v1') AS cache_key FROM documents), c AS (SELECT cache_key FROM k WHERE doc_id % 3 = 0) SELECT doc_id, cache_key, cache_key IN (SELECT cache_key FROM c) AS hit FROM k")
def enrichment_cache(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    every = enrich.cached(d, spark.createDataFrame([], "cache_key string, result string"), "v1")[1]
    hit, miss = enrich.cached(d, every.where("chunk_id % 3 = 0").select("cache_key", F.lit("r").alias("result")), "v1")
    out = hit.select("chunk_id", "cache_key", F.lit(True).alias("hit")).unionByName(miss.select("chunk_id", "cache_key", F.lit(False).alias("hit")))
    return out.withColumnRenamed("chunk_id", "doc_id")


@query(r"SELECT doc_id, page, line_no FROM (SELECT doc_id, i // 5 AS page, i AS line_no, row_number() OVER (PARTITION BY doc_id ORDER BY i // 5, length(string_split(text, chr(10))[i + 1]), i) AS place FROM documents, LATERAL (SELECT unnest(range(len(string_split(documents.text, chr(10))))) AS i)) WHERE place <= 3")
def reading_order(spark, sf_dir):
    """Lines as blocks, five a page, their length as the height at which they stand."""
    from lodestone.operators import layout

    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    b = lines.select("doc_id", "line_no", F.floor(F.col("line_no") / 5).alias("page"), F.length("text").alias("y0"), F.col("line_no").alias("x0"))
    return layout.reading_order(b).where("place <= 3").select("doc_id", "page", "line_no")


@query("""WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS image_id, (o_orderkey % 500)::DOUBLE AS y1 FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT o_custkey AS doc_id, (o_orderkey % 500)::DOUBLE AS y, 'Figure ' || o_orderkey AS text FROM orders WHERE o_orderkey % 3 = 1)
SELECT i.doc_id, image_id, CASE WHEN abs(y - y1) <= 140 THEN text END AS caption FROM i LEFT JOIN c USING (doc_id) QUALIFY row_number() OVER (PARTITION BY i.doc_id, image_id ORDER BY CASE WHEN abs(y - y1) <= 140 THEN abs(y - y1) END NULLS LAST, y, text) = 1""")
def captioned_images(spark, sf_dir):
    """A customer as a document of one page, some orders as images and some as captions."""
    from lodestone.operators import layout

    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), k.alias("image_id"), (k % 500).cast("double").alias("y1"))
    images, blocks = o.where("image_id % 3 = 0"), o.where("image_id % 3 = 1").select("doc_id", "page", F.lit("caption").alias("kind"), F.col("y1").alias("y0"), F.concat(F.lit("Figure "), "image_id").alias("text"))
    return layout.captions(images, blocks).select("doc_id", "image_id", "caption")


@query("""WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, o_orderkey % 9 AS page, o_orderkey % 4 AS cols FROM orders)
SELECT a.doc_id, a.table_id, b.table_id AS next_id FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.page = a.page + 1 AND b.cols = a.cols""")
def continued_tables(spark, sf_dir):
    from lodestone.operators import layout

    k = F.col("o_orderkey")
    return layout.continued_tables(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("table_id"), (k % 9).alias("page"), (k % 4).alias("cols")))
