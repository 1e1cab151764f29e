import io
import random
import time
import zipfile
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodestone.functions.text import distinct_ci
from lodestone.operators import answers, enrich, layout, splits, traces
from lodestone.plans import queries
from lodestone.sources import office
from lodestone.streaming import metrics as drain
from lodestone.streaming import state


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_recursive_and_parent_child(spark):
    text = "First part. " * 30 + "\n\n" + "x" * 250 + "\nlast one"
    got = splits.recursive(docs(spark, text, "", None, "  "), 100, 20).orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {0} and [r.chunk_index for r in got] == list(range(len(got)))
    assert all(r.text == text[r.char_start : r.char_end] and 0 < len(r.text) <= 100 for r in got)
    covered = {i for r in got for i in range(r.char_start, r.char_end)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    for r in splits.parent_child(docs(spark, text), (200, 20), (50, 5)).collect():
        assert r.text in r.parent_text and len(r.text) <= 50


def test_separators_open_the_piece_behind_them():
    cut = lambda t, size, overlap: [t[a:b] for a, b in splits.spans(t, size, overlap)]
    assert cut("aaa. bbb. ccc", 9, 0) == ["aaa. bbb", ". ccc"]
    assert cut("aaa. bbb. ccc", 10, 5) == ["aaa. bbb", ". bbb. ccc"]
    assert cut("abcdef", 4, 2) == ["abcd", "cdef"]
    assert cut("\n\na\n\nb", 3, 0) == ["\n\na", "\n\nb"]
    assert cut("one two\n\nthree", 6, 0) == ["one", " two", "\n", "\nthree"]
    assert cut("", 4, 0) == []


def test_tables_code_sentences(spark):
    table = "intro\n|a|b|\n|-|-|\n|1|2|\n\n|3|4|\n|5|6|\nend | of\n"
    got = [r.text for r in splits.table_chunks(docs(spark, table, "a | b", "", None), rows=3).orderBy("part").collect()]
    assert got == ["|a|b|\n|-|-|\n|1|2|\n|3|4|", "|a|b|\n|-|-|\n|5|6|\nend | of"]
    many = "|a|b|\n|-|-|\n" + "|1|2|\n" * 20000
    assert splits.table_chunks(docs(spark, many), rows=30).count() == -(-20000 // 29)
    got = [r.text for r in splits.code_chunks(docs(spark, "p\n```py\n1\n2\n```\nq", "none", "", None), lines=2).orderBy("part").collect()]
    assert got == ["```py\n1", "2\n```"]
    assert splits.code_chunks(docs(spark, "```\n" + "y\n" * 50000 + "```"), lines=120).count() == -(-50002 // 120)
    got = [r.text for r in splits.sentence_chunks(docs(spark, "Aa. Bb! Cc? Dddddddddddd.", "", None), most=8).orderBy("chunk_index").collect()]
    assert got == ["Aa. Bb!", "Cc?", "Dddddddddddd."]


def test_layout(spark):
    want = {"Figure 1: x": "caption", "def f(x)": "code", "a = b + c": "formula", "- item": "list", "2.1 Part": "list", "Plain words here": "paragraph"}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", layout.block_type(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == want
    assert spark.range(1).select(layout.block_type(F.lit("Title"), size=F.lit(16)).alias("k")).first().k == "heading"
    e = spark.createDataFrame([(1, 1, "Page 1"), (1, 2, "page  2"), (1, 3, "other")], "doc_id long, page int, text string")
    assert [(r.norm, r.n_pages) for r in layout.repeated_edges(e).collect()] == [("page #", 2)]
    b = spark.createDataFrame([(1, 1, 210.0, "caption", "near"), (1, 1, 330.0, "caption", "far"), (1, 2, 0.0, "caption", "else")], "doc_id long, page int, y0 double, kind string, text string")
    i = spark.createDataFrame([(1, 1, "i1", 200.0), (1, 2, "i2", 500.0), (2, 1, "i3", 1.0)], "doc_id long, page int, image_id string, y1 double")
    assert {r.image_id: r.caption for r in layout.captions(i, b).collect()} == {"i1": "near", "i2": None, "i3": None}


def test_page_bands(spark):
    heads = ["Annual report of the harbour board 2021", "Annual report of the harbour board 2022", "annual  report of the harbour board 2021", "Quite another line of text", "Annual report of harbour boards 21", "aaaa", "aaab", "short", None, ""]
    rows = [(1, p, "h", 10.0, 20.0, 800.0, t) for p, t in enumerate(heads)] + [(1, p, "f", 780.0, 790.0, 800.0, f"Page {p} / 9") for p in range(2)]
    rows += [(1, 0, "b", 400.0, 410.0, 800.0, heads[0]), (1, 1, "n", None, None, 800.0, heads[0]), (1, 2, "z", 0.0, 0.0, 0.0, heads[0]), (2, 1, "f", 780.0, 790.0, 800.0, "7"), (2, 1, "h", 1.0, 2.0, 800.0, "x"), (2, 1, "h", 1.0, 2.0, 800.0, "x")]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, id string, y0 double, y1 double, height double, text string")
    like = lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.85
    norms = [" ".join((t or "").lower().split()) for t in heads]
    again = {a for a in norms if a and len({p for p, b in enumerate(norms) if b and like(a, b)}) >= 2}
    want = {p for p, a in enumerate(norms) if a and any(like(a, b) for b in again)}
    assert {0, 1, 2} <= want and not {3, 7, 8, 9} & want
    got = layout.page_bands(blocks).collect()
    assert len(got) == len(rows)
    assert {r.page for r in got if r.doc_id == 1 and r.kind == "header"} == want
    assert sorted((r.page, r.reason) for r in got if r.kind == "footer") == [(0, "repeated_text"), (1, "repeated_text")]
    equal = layout.page_bands(blocks, share=None).collect()
    assert {(r.page, r.kind, r.reason) for r in equal if r.kind != "body"} == {(0, "header", "repeated_text"), (2, "header", "repeated_text"), (0, "footer", "page_number"), (1, "footer", "page_number")}
    assert layout.page_bands(blocks.limit(0)).count() == 0


def test_alike_misses_nothing(spark):
    rng = random.Random(5)
    words = ["report", "page", "harbour", "board", "of", "the", "2021", "part", "a"]
    bases = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(25)]

    def edited(t):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", "x", " 12", "e"]) + t[i + rng.randint(0, 2) :]
        return " ".join(t.split())

    texts = sorted({edited(b) for b in bases for _ in range(5)} - {""})
    keys = spark.createDataFrame([(1, "header", t) for t in texts], "doc_id long, band string, norm string")
    want = {(a, b) for a in texts for b in texts if a != b and SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert {(r.a, r.b) for r in layout.alike(keys, 0.85).collect()} == want and len(want) > 20


def test_answer_claims_gives_all(spark, tmp_path):
    text = " ".join(f"It rose to {i}.5 units [C1]." for i in range(50))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.claim for r in queries.answer_claims(spark, str(tmp_path)).orderBy("claim").collect()] == list(range(50))
    assert answers.claims(spark.createDataFrame([(1, text)], "answer_id long, answer string")).count() == 20


def test_claims_refusal_confidence(spark):
    a = spark.createDataFrame([(1, "It rose to 2.5 units.[C1] Nice. It failed [C9]"), (2, ""), (3, None)], "answer_id long, answer string")
    found = answers.claims(a)
    assert [(r.text, r.citations, r.confidence) for r in found.orderBy("claim").collect()] == [("It rose to 2.5 units[C1]", ["C1"], 1.0), ("It failed [C9]", ["C9"], 1.0)]
    c = spark.createDataFrame([(1, "C1")], "answer_id long, citation_id string")
    r = answers.citation_report(found, c).first()
    assert (r.n_claims, r.coverage, r.invalid) == (2, 0.5, ["C9"])
    no, lit = F.lit(False), F.lit
    why = lambda n, best, cov, bad, k, denied=no: answers.refusal(lit(n), lit(best), lit(cov), lit(bad), lit(k), denied, no, no)
    r = spark.range(1).select(why(0, 0.0, 0.0, 0.0, 0).alias("a"), why(1, 0.1, 0.0, 0.0, 0).alias("b"), why(1, 0.9, 0.0, 0.0, 2, lit(True)).alias("c"), why(1, 0.9, 0.0, 1.0, 2).alias("d"), why(1, 0.9, 0.6, 0.4, 2).alias("e"), why(1, 0.9, 0.4, 0.3, 2).alias("f"), why(1, 0.9, 1.0, 0.0, 2).alias("g")).first()
    assert tuple(r) == ("NO_RETRIEVAL_RESULTS", "LOW_RETRIEVAL_SCORE", "PERMISSION_DENIED", "NO_VALID_CITATIONS", "UNSUPPORTED_GENERATED_CLAIMS", "NO_VALID_CITATIONS", None)
    s = answers.confidence(lit(1.0), lit(1.0), lit(3), lit(1.0), lit(0.0), lit(2), lit(100), lit("sufficient"), no, lit(0))
    t = answers.confidence(lit(1.0), lit(1.0), lit(3), lit(1.0), lit(0.0), lit(2), lit(100), lit("sufficient"), no, lit(1))
    r = spark.range(1).select(s.alias("s"), t.alias("t"), answers.label(s).alias("l")).first()
    assert (r.s, r.t, r.l) == (1.0, 0.644, "high")


def test_conflicts(spark):
    c = spark.createDataFrame([(1, 1, "It is enabled. mode: fast"), (1, 2, "It is disabled. mode: slow"), (1, 3, "quiet"), (2, 1, "enabled"), (2, 2, None)], "query_id long, doc_id long, text string")
    assert sorted((r.kind, r.value, r.n) for r in answers.conflicts(c).where("query_id = 1").collect()) == [("field_value", "mode", 2), ("status", "enabled/disabled", 2)]
    assert answers.conflicts(c).where("query_id = 2").count() == 0


def test_enrichment(spark):
    t = F.lit("v1.2.3 and HTTP 404, E1234; /api/v1/x OrderService run() API api")
    r = spark.range(1).select(enrich.entities(t).alias("e"), enrich.heading_path(F.lit("# A\n## B\n# C\n### D")).alias("h"), enrich.refined(F.lit("a   b<br>\n\n\n\n<!-- x -->```\nx   y\n```")).alias("f"), enrich.questions(F.lit("T"), F.lit("docker")).alias("q")).first()
    assert {"v1.2.3", "HTTP 404", "E1234", "/api/v1/x", "OrderService", "run()", "API"} <= set(r.e) and len({x.lower() for x in r.e}) == len(r.e)
    assert r.h == ["C", "D"] and r.f == "a b\n\n```\nx   y\n```" and len(r.q) == 3


def test_enrichment_of_long_texts(spark):
    many = " ".join(f"Name{i}Service name{i}service NAME{i % 7}SERVICE" for i in range(30000))
    code = "a   b <br>\n```\nx   y\n```\n" * 5000
    began = time.perf_counter()
    r = spark.createDataFrame([(many, code)], "m string, c string").select(distinct_ci(F.split("m", " ")).alias("d"), enrich.refined(F.col("c")).alias("f")).first()
    assert time.perf_counter() - began < 60
    assert list(r.d) == [f"Name{i}Service" for i in range(30000)]
    assert r.f == ("a b\n```\nx   y\n```\n" * 5000).rstrip()
    empty = spark.createDataFrame([("", None), (None, "`` ```")], "m string, c string").select(distinct_ci(F.array("m")).alias("d"), enrich.refined(F.col("c")).alias("f")).collect()
    assert [(list(x.d), x.f) for x in empty] == [([], None), ([], "`` ```")]


def test_traces(spark):
    stages = [("s1", 5.0, None, [("d1", "c1", "p")]), ("s2", None, "d2", None)]
    t = spark.createDataFrame([("t", "ok", 9.0, "d0", stages), ("u", "ok", 1.0, None, None)], f"trace_id string, status string, elapsed_ms double, document_id string, stages {traces.STAGES}")
    got = sorted(tuple(r) for r in traces.trace_rows(t).drop("status").collect())
    assert got == [("t", 0, "s1", 5.0, "d1", "c1", "p"), ("t", 1, "s2", 9.0, "d2", "", ""), ("u", 0, "", 1.0, "", "", "")]


def test_rate_limit_batch_and_stream(spark, tmp_path):
    at = [0.0, 1.0, 2.0, 10.0, 10.5, 11.0, 11.5]
    log = spark.createDataFrame([(k, t, i) for k in ("a", "b") for i, t in enumerate(at)], "key string, at double, id long").repartition(3)
    want = [True, True, False, True, False, True, False]
    log.write.parquet(str(tmp_path / "log"))
    for name, got in (("b", state.rate_limited(log, 2, 10)), ("s", drain.drained(state.rate_limited_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), 2, 10), "limited", "append"))):
        for k in ("a", "b"):
            assert [r.allowed for r in got.where(F.col("key") == k).orderBy("id").collect()] == want, name


def test_tasks_and_circuit(spark):
    ev = ["submit", "claim", "recover", "recover", "claim", "retryable", "claim", "retryable", "claim", "done"]
    log = spark.createDataFrame([("t", 10.0 * i if i != 3 else 35.0, i, e) for i, e in enumerate(ev)], "key string, at double, id long, event string")
    got = [r.status for r in state.task_status(log, retries=1, lease=20).orderBy("id").collect()]
    assert got == ["queued", "running", "running", "queued", "running", "retrying", "running", "dead_letter", "dead_letter", "dead_letter"]
    log = spark.createDataFrame([("m", float(t), t, ok) for t, ok in ((0, False), (1, False), (2, True), (12, True))], "key string, at double, id long, ok boolean")
    assert [r.circuit for r in state.circuit(log, 2, 10).orderBy("id").collect()] == ["closed", "closed", "open", "closed"]


def test_ingest(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (["a", "b", "a"], ["b", "c"]):
        docs(spark, *batch).write.mode("append").parquet(src)
        q = state.ingest(spark.readStream.schema("doc_id long, text string").parquet(src), store, str(tmp_path / "ck"))
        q.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell(1)}{cell(2)}</w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    df = spark.createDataFrame([("x.docx", bytearray(out.getvalue())), ("bad.docx", bytearray(b"zz")), ("none.docx", None)], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in office.read_docx(df).collect()}
    assert got["x.docx"] == ("Hello\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", None) and got["bad.docx"][1] and got["none.docx"][1]
