import random
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(31)
    words = "river bridge morning people walk along water stone market street garden window letter evening summer winter doctor teacher village machine paper silver golden quiet".split()
    out = []
    for i in range(240):
        text = ". ".join(" ".join(rnd.choices(words, k=rnd.randrange(6, 12))).capitalize() for _ in range(rnd.randrange(4, 9))) + "."
        if i % 10 == 3 and i > 30:  # a near copy
            w = out[i - 30][1].split()
            w[-1] = "changed."
            text = " ".join(w)
        if i % 12 == 5 and i > 30:  # an exact copy
            text = out[i - 25][1]
        if i % 7 == 1:
            text += f" Write to user{i}@mail.example.org or +49 30 {1000000 + i}."
        if i % 6 == 2:
            text = rnd.choice(["BUY NOW!!! $$$ ", "| # | * | ", "stone "]) * rnd.randrange(20, 60)
        out.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
    return [*out, (1000, None, None, None, None), (1001, "", None, "s1", 0), (None, "one two three four five six seven", None, "s2", 33)]


@pytest.fixture
def folder(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, DOCS).withColumn("_taken", F.lit(1)).withColumn("spans", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    bad = lambda t: bool(t) and ("$$$" in t or "| #" in t or "stone stone stone" in t)
    spark.createDataFrame([(d, int(not bad(t)), 0) for d, t, *_ in data if d is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def groups(texts):
    """doc_id to the least one of its group of near duplicates."""
    sets = {}
    for d, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in sets}


def test_every_stage_against_plain_python(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]

    def apply(name, df):
        out = stages[name](spark, df, folder)
        if name != "packing":
            assert out.columns == docs.columns
        kept = out.collect()
        return kept, spark.createDataFrame(kept, out.schema)

    good, df = apply("quality", docs)
    texts = {r.doc_id: r.text for r in good if r.doc_id is not None}
    bad = [d for d, t, *_ in rows() if t and ("$$$" in t or "| #" in t)]
    assert not set(bad) & set(texts)
    clean = [d for d, t, *_ in rows() if t and t.endswith(".") and d is not None]
    assert len(set(clean) - set(texts)) <= len(clean) // 50

    kept, df = apply("near_duplicates", df)
    least = groups(texts)
    assert {r.doc_id for r in kept if r.doc_id is not None} == {d for d in texts if least[d] == d}
    assert all(r.text == texts[r.doc_id] for r in kept if r.doc_id is not None)
    assert len(kept) < len(good)

    plain = {r.doc_id: r.text for r in kept}
    kept, df = apply("personal_data", df)
    for r in kept:
        want = plain[r.doc_id]
        if want is not None:
            want = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>", want)
            want = re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "<phone>", want)
        assert r.text == want and r.n_chars == (None if want is None else len(want))
    assert sum("<email>" in (r.text or "") for r in kept) > 10

    size = {r.doc_id: (r.source, len((r.text or "").split()), r.text) for r in kept}
    taken, df = apply("mixing", df)
    total = sum(n for _, n, _ in size.values())
    names = sorted({s for s, _, _ in size.values() if s is not None}) + [None]
    own = {s: sum(n for x, n, _ in size.values() if x == s) for s in names}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, rest, free = {}, total, set(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * own[s]}
        for s in full or free:
            target[s] = 3 * own[s] if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        free = free - full if full else set()
    for s in names:
        assert abs(sum(len(r.text.split()) for r in taken if r.source == s) - target[s]) <= 1, s
    times = {}
    for r in taken:
        assert size[r.doc_id][2].startswith(r.text)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3

    pieces = stages["packing"](spark, df, folder).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), len(own.encode(r.text, add_special_tokens=False).ids) + 1) for r in taken)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pieces if r.start == 0) == want
    assert sum(r.length for r in pieces) == sum(n for _, n in want)
    seqs = {}
    for r in pieces:
        seqs[r.sequence_id] = seqs.get(r.sequence_id, 0) + r.length
    assert max(seqs.values()) <= 2048

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.start, r.doc_tokens) for r in whole if r.start == 0) == sorted((str(r.doc_id), r.start, r.doc_tokens) for r in pieces if r.start == 0)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
