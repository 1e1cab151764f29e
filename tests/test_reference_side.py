import math

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunks, dense, filters, grounding, metrics, records, retrieval


def lists(spark, ids, q=1):
    return spark.createDataFrame([(q, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id string, rank int")


def test_rrf_golden(spark):
    got = {r.doc_id: r.score for r in retrieval.rrf([lists(spark, "abc"), lists(spark, "bcd")]).collect()}
    assert math.isclose(got["b"], 1 / 62 + 1 / 61) and math.isclose(got["c"], 1 / 63 + 1 / 62) and math.isclose(got["a"], 1 / 61) and math.isclose(got["d"], 1 / 63)


def test_interleave(spark):
    got = [r.doc_id for r in retrieval.interleave([lists(spark, "abc"), lists(spark, "bcd")], 10).orderBy("rank").collect()]
    assert got == ["a", "b", "c", "d"]


def test_ir_goldens(spark):
    rel = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, doc_id string")
    r = metrics.ir_metrics(lists(spark, "abc"), rel, 2).first()
    assert (r.recall, r.precision, r.mrr, r.ndcg, r.hit) == (1, 1, 1, 1, 1)
    r = metrics.ir_metrics(lists(spark, "xby"), rel, 3).first()
    assert (r.recall, r.mrr) == (0.5, 0.5) and math.isclose(r.precision, 1 / 3, abs_tol=1e-6)
    assert math.isclose(r.ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs_tol=1e-6)


def test_acl(spark):
    df = spark.createDataFrame([("t1", "alice", "private", ["x"], ["R"], ""), ("t1", "bob", "private", ["x"], ["R"], ""), ("t2", "alice", "public", ["x"], ["R"], ""), (None, "alice", "public", None, None, None), ("t1", "bob", "users", ["alice"], None, None), ("t1", "bob", "roles", None, ["MEMBER"], None), ("t1", "bob", "department", None, None, "")], "tenant_id string, owner_id string, acl_visibility string, acl_users array<string>, acl_roles array<string>, acl_department string")
    got = [r.ok for r in df.select(filters.can_access(filters.Caller("t1", "alice", ("member",), "")).alias("ok")).collect()]
    assert got == [True, False, False, False, True, True, False]


def test_chunks(spark):
    d = spark.createDataFrame([(1, "x" * 950), (2, "y"), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_index): (r.char_start, r.char_end) for r in chunks.sliding_window(d).collect()}
    assert got == {(1, 0): (0, 500), (1, 1): (400, 900), (1, 2): (800, 950), (2, 0): (0, 1)}
    d = spark.createDataFrame([(1, "lost\n# A\na\n```\n# not\n```\n## B\nb")], "doc_id long, text string")
    assert [(r.heading, r.text) for r in chunks.headed_sections(d).orderBy("section").collect()] == [("A", "a\n```\n# not\n```"), ("B", "b")]


def test_dense_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(301, 8)).astype("float32")
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(301)], "id long, embedding array<float>").repartition(3)
    hits = retrieval.ranked(dense.search(df, df.where("id % 100 = 0"), 5, block=2), 5)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    for q in (0, 100, 200, 300):
        s = np.round((1 + u @ u[q]) / 2, 6)
        want = sorted(range(301), key=lambda i: (-s[i], i))[:5]
        assert [r.doc_id for r in hits.where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_text_and_records(spark):
    r = spark.range(1).select(tx.mask(F.lit("token: abc a@b.co Bearer xyz")).alias("m"), tx.title(F.lit("x.\n# Head\nbody")).alias("t"), tx.summary(F.lit("One. Two!  Three? Four.")).alias("s"), grounding.support(F.lit("a 5"), F.lit("b 5 a")).alias("p")).first()
    assert r.m == "token: [REDACTED] [EMAIL] Bearer [REDACTED]" and r.t == "Head" and r.s == "One. Two! Three?" and r.p == 1.0
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "g string, n long")
    assert [x.seats for x in records.largest_remainder(c, "g", "n", 4).orderBy("g").collect()] == [2, 1, 1]
