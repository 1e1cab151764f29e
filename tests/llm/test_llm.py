import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, media, mixing, neardup, packing, pii, quality, repeats, rules, secrets

ROWS = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, ""), (5, "word " * 3000), (6, "é😀 x@y.com +1 (234) 567-8901 4111 1111 1111 1111"), (6, "é😀 x@y.com +1 (234) 567-8901 4111 1111 1111 1111")]


@pytest.fixture
def edge(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"source": F.lit(None).cast("string"), "spans": F.lit(1), "size": F.lit("x"), "node": F.lit(2), "n": F.lit(3)})
    return df


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")


def test_edges_and_empty_tables(spark, edge):
    runs = {
        "pii": lambda d: pii.find(d, "doc_id"), "redact": pii.redact, "pack": packing.pack, "link": lambda d: neardup.link(d, 2), "dedup": neardup.dedup, "mix": mixing.mix, "take": mixing.take,
        "score": lambda d: quality.score(d, labels(spark)), "filter": lambda d: quality.filter_good(d, labels(spark)), "media": media.describe, "secrets": lambda d: secrets.find(d, "doc_id"), "repeats": repeats.remove, "rules": lambda d: rules.apply_rules(d, "doc_id"),
    }
    per_row = {"pii", "redact", "link", "mix", "score", "media", "secrets", "repeats", "rules"}
    for name, run in runs.items():
        assert run(edge.limit(0)).count() == 0, name
        n = run(edge).count()
        assert n == len(ROWS) or name not in per_row, name


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghij") + str(rnd.randrange(60)) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(len(w))] = rnd.choice("klmn") + str(rnd.randrange(9))
        rows.append((i, " ".join(w)))
    sets = {d: frozenset(zip(t.split(), t.split()[1:])) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    for rounds in (1, 4):
        neardup.ROUNDS, before = rounds, neardup.ROUNDS
        got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
        neardup.ROUNDS = before
        assert got == {d: top(d) for d in sets}


def test_near_duplicates_of_hot_keys(spark, monkeypatch):
    """Every join dealt: no broadcast, and parts of three rows."""
    from lodestone.llm import common

    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(w) if i % 5 else " ".join(f"own{i}y{j}" for j in range(30))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, neardup.link(df, 2).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "KEYS_ROWS", -1)
    monkeypatch.setattr(common, "HOT", 3)
    assert sorted(map(tuple, neardup.link(df, 2).collect())) == want


def test_near_duplicates_of_repeated_ids(spark):
    rnd = random.Random(11)
    base = [[rnd.choice("abcdefghij") + str(rnd.randrange(60)) for _ in range(50)] for _ in range(8)]
    rows = []
    for i in range(120):
        w = list(base[i % 8])
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(len(w))] = rnd.choice("klmn") + str(rnd.randrange(9))
        rows.append((i, " ".join(w)))
        if i % 3 == 0:  # another text, of words of its own
            rows.append((i, " ".join(f"own{i}x{j}" for j in range(101))))
        if i % 5 == 0:  # texts of one size, and one that a lesser id has too
            rows.append((i, " ".join(f"of{i}y{j}" for j in range(50))))
            rows.append((i + 1, rows[0][1]))
    sets = [frozenset(zip(t.split(), t.split()[1:])) for _, t in rows]
    node: dict = {}
    for (d, _), s in zip(rows, sets):
        node[s] = min(node.get(s, d), d)
    up = {d: d for d in node.values()}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in node:
        for b in node:
            i = len(a & b)
            if 100 * i >= 80 * (len(a) + len(b) - i):
                x, y = sorted((top(node[a]), top(node[b])))
                up[y] = x
    want = collections.Counter((d, len(s), top(node[s])) for (d, _), s in zip(rows, sets))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 2, 3, 4):
        neardup.ROUNDS, before = rounds, neardup.ROUNDS
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.link(df, 2).collect())
        neardup.ROUNDS = before
        assert got == want, rounds


def test_pii_account_numbers_end_where_confirmed(spark):
    def ok(s):
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    texts = ["BE68539007547034 EUR 100", "ES9121000418450200051332 2024", "BE68 5390 0754 7034 100 euros", "é😀 BE68539007547034 ES9121000418450200051332 USD", "AB12 3456 7890 BE68 5390 0754 7034 AT61 1904 3002 3457 3201 2024 DE89 3704 0044 0532 0130 00 EUR"]
    texts += ["BE68 5390 0754 7034 ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32, NO9386011117947 NOK", "BE69539007547034 EUR 100", "xBE68539007547034 BE68539007547034x", "none"]
    want = {}
    for i, t in enumerate(texts):
        want[i], last = [], 0
        for h in re.finditer(r"\b[A-Z]{2}[0-9]{2}", t):
            ends = [e for e in range(h.start() + 12, len(t) + 1) if re.fullmatch(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", t[h.start() : e]) and not t[e : e + 1].isalnum() and ok(t[h.start() : e].replace(" ", ""))]
            if ends and ends[-1] > last:
                last = ends[-1]
                want[i].append(f"iban:{h.start()}:{last}")
    assert [len(want[i]) for i in range(len(texts))] == [1, 1, 1, 2, 3, 2, 2, 0, 0, 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in pii.find(df, "doc_id").collect()} == want
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[0] == "<iban> EUR 100"


def test_pii_context_is_the_text_before(spark):
    rows = [(1, "SSN: 219-09-9998, 219-09-9997"), (2, "é😀 ssn 219-09-9998 219-09-9997 " + "x" * 36 + " 219-09-9996"), (3, "ssn" + " " * 37 + "219-09-9998"), (4, "ssn" + " " * 38 + "219-09-9998"), (5, "219-09-9998 ssn 219-09-9997")]
    want = {d: [f"ssn:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t) if "ssn" in t[max(0, m.start() - 40) : m.start()].lower()] for d, t in rows}
    assert [len(want[d]) for d, _ in rows] == [2, 2, 1, 0, 1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: [s for s in r.spans.split(",") if s] for r in pii.find(df, "doc_id").collect()} == want
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[1] == "SSN: <ssn>, <ssn>"


def test_dense_matches_take_linear_time(spark):
    rows = [(1, " ".join(f"user{i}@host{i}.example.org" for i in range(100_000))), (2, "+1 234 567 8901, " * 50_000), (3, "1" * 1_000_000), (4, "token=abcdef1 " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    t = time.perf_counter()
    got = {r.doc_id: r for r in pii.find(df, "doc_id").collect()}
    assert (got[1].n_email, got[2].n_phone, got[3].n_card) == (100_000, 50_000, 0)
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[1] == " ".join(["<email>"] * 100_000)
    assert {r.doc_id: r.n_assign for r in secrets.find(df, "doc_id").collect()}[4] == 60_000
    assert time.perf_counter() - t < 120


def test_pii_against_brute_force(spark):
    rnd = random.Random(9)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "1.2.3.4.5.6", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1 2", "card", "é😀", ",", "12", "@", ".", "call", "hotel", "born 1980-02-30", "dob 1980-01-31"]
    rows = [(i, "".join(rnd.choice(parts) + rnd.choice([" ", "", "\n"]) for _ in range(rnd.randrange(0, 25)))) for i in range(300)]

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0

    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    for d, t in rows:
        found = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(tests) for m in re.finditer(p, t) if ok(m[0]))
        base = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in found)
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert [s for s in got[d].spans.split(",") if s and s.split(":")[0] in ("email", "ip", "card", "phone")] == base.split(",") * bool(base)
        scores = dict(zip(got[d].spans.split(","), got[d].scores.split(",")))
        for a, _, z, kind in found:
            if kind == "phone":
                near = re.search(r"(?<![a-z])(phone|call|tel|telephone|mobile)(?![a-z])", t[max(0, a - 40) : a].lower()) and not (a > 40 and re.match("[a-z]", t[a - 41].lower()) and not re.search(r"[^a-z](phone|call|tel|telephone|mobile)(?![a-z])", t[a - 40 : a].lower()))
                assert scores[f"phone:{a}:{z}"] == ("60" if near else "40"), t


def test_repeats_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    base = ["".join(rnd.choices("ab é", k=400)) for _ in range(3)]
    rows = [(i, "".join(rnd.choice(base)[rnd.randrange(0, 350) :][: rnd.randrange(0, 120)] for _ in range(8))) for i in range(40)] + [(100, "a" * 500), (101, "b" + "a" * 300), (None, "a" * 60), (5, base[1])]
    first: dict = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], repeats.LAST), repeats.LAST if d is None else d)
    want = []
    for d, t in rows:
        b, m = t.encode(), np.zeros(len(t.encode()), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (repeats.LAST if d is None else d):
                m[i : i + 50] = True
        want.append((str(d), len(b), int(m.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shard, hot in ((repeats.SHARD, repeats.HOT_ANCHOR), (500, 0), (3000, 2)):
        monkeypatch.setattr(repeats, "SHARD", shard)
        monkeypatch.setattr(repeats, "MOST", 2)
        monkeypatch.setattr(repeats, "HOT_ANCHOR", hot)
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.remove(df).collect()]
        assert sorted(got) == sorted(want), (shard, hot)


def test_secrets_base_and_random(spark):
    rnd = random.Random(8)
    key = "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=43))
    rows = [(1, 'secret: token: abcdefgh password=token=abcdefgh API_KEY = "a-b.c=defg" apikey:12345'), (2, "AKIA" + "A" * 15 + " AKIA" + "Z" * 16), (3, "ab" * 12 + " x" + "0" * 23), (4, key + " thinbleanderonationha1")]
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = [f"assign:{m.start()}:{m.end()}" for m in assign.finditer(rows[0][1]) if len(m[2]) >= 6]
    assert got[1].spans.split(",") == want and got[2].n_access == 1 and got[3].n_hex == 1 and got[4].spans == "random:0:43"


def test_secrets_base_against_brute_force(spark):
    rnd = random.Random(21)
    parts = ["token", "=", ":", '"', "'", " ", "abcdef", "AKIA", "A" * 16, "0" * 23, "ab", "API_key", "apikey", "password", "é", "\n", "x-y_z.="]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randrange(0, 30)))) for i in range(400)]
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    for d, t in rows:
        found = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, flags, ok) in enumerate(kinds) for m in re.finditer(p, t, flags) if ok(m))
        assert got[d].base_sha256 == hashlib.sha256(",".join(x for _, _, x in found).encode()).hexdigest(), t


def test_secrets_reports_are_precise(spark):
    rnd = random.Random(2)
    words = "value index parser handle config stream buffer customer record count table column update message service request response manager factory builder context session version".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(0, "HelloWorldThisIsAVariable123", 0, 0), (1, "ISO8859-1_to_UTF8_converter", 0, 0)]
    for i in range(2, 3000):
        if rnd.random() < 0.3:
            n = rnd.choice([20, 24, 32, 40, 64])
            rows.append((i, "".join(rnd.choices(letters, k=n)), 1, n))
        else:
            w = [rnd.choice(words) for _ in range(rnd.randrange(3, 6))]
            rows.append((i, rnd.choice(["_".join(w), "-".join(w), "".join(w), "".join(x.title() for x in w)]) + str(rnd.randrange(2030)), 0, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, secret int, n int")
    got = secrets.find(df, "doc_id", "secret", "n").toPandas()
    hit = got.spans.str.contains("random")
    assert (got.secret[hit] == 1).mean() >= 0.95 and hit.sum() > 100
    assert hit[got.n == 64].mean() > 0.9 and hit[got.n == 40].mean() > 0.6

def test_packing_is_whole_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    letters = "abc déß ÄÖ\n\t  .,!?'’-0123456789日本語😀\u3000\u200b"
    rows = [(i, "".join(rnd.choices(letters, k=rnd.randrange(0, 400))) + "some words here, déjà vu! " * (i * 7 % 190)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "<|endoftext|> a <|endoftext|>b"), (203, "x" + " " * 150_000 + "y"), (204, "don't I'll we've " * 2000), (205, "\r\n \r\n a")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toPandas()
    want = {d: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    assert want[202].tolist()[:2] == [50256, 257]
    place = dict.fromkeys(want, 0)
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        ids = want[r.doc_id]
        assert r.start == place[r.doc_id] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        place[r.doc_id] += r.length
    assert place == {d: len(x) for d, x in want.items()}
    total = got.groupby("sequence_id").length.sum()
    assert total.max() <= 2048 and len(total) * 2048 - total.sum() < 2 * 2048
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()


def test_packing_takes_the_least_cost_with_room():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        lengths = np.concatenate([rng.integers(1, 2048, 600), rng.integers(1, 200, 1448)])[: (2048, 1, 2, 700)[seed % 4]]
        pieces, seqs = packing.assign(lengths)
        n = int(-(-lengths.sum() // packing.MAX_TOKENS))
        left, cost, got = [packing.MAX_TOKENS] * n, [0.0] * n, np.zeros(len(lengths), np.int64)
        for (item, start, length), seq in zip(pieces, seqs.tolist()):
            room = [i for i in range(n) if left[i] >= lengths[item]] if not start else []
            if room:
                assert length == lengths[item] and seq == min(room, key=lambda i: (cost[i], i))
            assert start == got[item] and 0 < length <= left[seq]
            left[seq] -= length
            got[item] += length
            cost[seq] += packing.LINEAR * length + packing.QUADRATIC * length * length
        assert (got == lengths).all()


def test_media_round_trip_and_damage():
    for n in (0, 1, 191, 192, 193, 5000, 100_001):
        p = media.padded(bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)))
        raw = media.mux(p)
        s = media.demux(raw)
        assert s.payload == p and s.stamps == [k * media.TICKS for k in range(s.units)] and s.packets * 188 == len(raw)
        assert s.clocks == s.stamps[:: media.GROUP] and len(s.random_access) == len(s.clocks)
        for at in s.random_access:  # tables stand before each, so a reader can begin there
            assert media.demux(raw[188 * (at - 2) :]).payload == p[s.clocks[s.random_access.index(at)] // media.TICKS * media.UNIT :]
    raw = media.mux(b" " * 20_000)
    last = media.demux(raw).random_access[-1]
    for where in (188 * 4 + 3, 188 * (last - 1) + 3, 188 * (last - 2) + 20, 188 * (last - 2) + 3, 0):
        bad = bytearray(raw)
        bad[where] ^= 1
        with pytest.raises(ValueError):
            media.demux(bytes(bad))


def test_media_columns_against_plain_python(spark):
    rows = [(1, None), (2, ""), (3, "é" * 4000), (4, "x" * 192), (5, "x" * 193), (5, "x" * 193), (None, "abc " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = media.describe(df).collect()
    stored = {r.doc_id: bytes(r.media) for r in media.streams(df).collect()}
    read = {r.doc_id: r for r in media.parse(media.streams(df)).collect()}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        pay = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert bytes(read[r.doc_id].payload) == pay and read[r.doc_id].pts == r.pts and read[r.doc_id].random_access == r.random_access
        assert f"mean={np.frombuffer(pay, np.uint8).mean():.4f};" in r.feature and len(r.pts) == -(-len(pay) // media.UNIT)


def test_chat_reads_back(spark):
    rows = [(1, 0, "a\\b\nc", "\\<|x|>\\\\|\n"), (1, 1, None, None), (1, 1, None, None), (None, None, "assistant", "<\\|im_end|>"), (None, 2, "assistant", "<|im_end|>")]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: [("a\\b\nc", "\\<|x|>\\\\|\n"), ("", ""), ("", "")], None: [("assistant", "<\\|im_end|>"), ("assistant", "<|im_end|>")]}


def test_chat_edges(spark):
    rows = [(1, 2, "user", "b\\"), (1, 2, "user", "b<|"), (1, 2, "user", "bz"), (1, 2, "a\\", "x"), (1, 2, "a\n", "y"), (1, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit("x"), "_turns": F.lit(1), "turns": F.lit(2)})
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_chats(df)).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
    assert got == {1: [(r or "", t or "") for _, _, r, t in want]}
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0
    assert {r.conv_id: r.n_turns for r in chat.digest(chat.format_chats(chat.with_adversary(df))).collect()} == {1: 6, -1: 2}
    long = spark.createDataFrame([(7, i, ("user", "assistant")[i // 3 % 2], "t" * (i % 50)) for i in range(20_000)], df.select("conv_id", "turn", "role", "text").schema)
    r = chat.digest(chat.format_chats(long)).first()
    said = "".join("t" * (i % 50) for i in range(20_000) if i // 3 % 2)
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (20_000, len(said), hashlib.sha256(said.encode()).hexdigest())


def mixing_rows():
    rnd = random.Random(6)
    return [(i, "w " * rnd.choice([1, 2, 3, 7, 30, 200, 900]), f"s{i % 4}" if i % 9 else None) for i in range(900)]


def test_mixing_hits_targets(spark):
    rows = mixing_rows()
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.target - by.taken) <= 1).all() and (got.taken <= 3 * got["size"]).all()
    assert abs(by.target.sum() - got["size"].sum()) < 1e-6


def test_mixing_against_plain_pareto_sampling(spark):
    rows = mixing_rows()
    got = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    target = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    shares = set()
    for source, goal in target.items():
        docs = [(d, len(t.split())) for d, t, s in rows if s == source]
        low, high = 0.0, 3.0
        for _ in range(200):  # the level by bisection
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(3.0, mid * (8 + n.bit_length() - 1)) for _, n in docs) < goal else (low, mid)
        want, ranked = {}, []
        for d, n in docs:
            c = min(3.0, low * (8 + n.bit_length() - 1))
            shares.add(round(c, 6))
            want[d] = int(c) * n
            u = (int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if c - int(c) > 1e-9:
                p = c - int(c)
                ranked.append(((u / (1 - u)) / (p / (1 - p)), d, n))
        room = max(0, round(goal) - sum(want.values()))
        for _, d, n in sorted(ranked):
            take = min(n, room)
            want[d] += take
            room -= take
        assert want == {d: got[d] for d, _ in docs}, source
    assert len(shares) > 10


def test_mixing_takes_what_it_says(spark):
    rows = [(i, f"a{i} b  c\td\ne"[: 3 + i % 8], f"s{i % 3}") for i in range(60)] + [(7, "x y z w v u t s r q", "s0")] * 40 + [(99, None, None), (98, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_taken": F.lit(5), "size": F.lit("q")})
    want = {r.source: (r.target, r.taken) for r in mixing.mix(df).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    got = mixing.take(df)
    assert got.columns == df.columns
    words = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("n")).collect()}
    for source, (target, taken) in want.items():
        assert abs(target - taken) <= 1 and taken - 40 < words.get(source, 0) <= taken, source
    texts = {t for _, t, _ in rows if t}
    assert all(any(t.startswith(r.text) for t in texts) for r in got.collect())


def test_quality_held_out():
    rng = np.random.default_rng(0)
    X = rng.random((3000, len(quality.NAMES)))
    y = ((X[:, 2] < 0.7) & (X[:, 8] > 0.2)).astype(float)
    m = quality.fit_arrays(X[:2000], y[:2000])
    z = np.full(1000, m.bias)
    for w, r in zip(m.weights, m.rules):
        z += w * quality.fires(X[2000:], r)
    assert ((z > 0) == y[2000:]).mean() > 0.97


def test_quality_of_texts(spark):
    """Held-out order of good and bad texts, the compiled column against plain arithmetic, and the bound on training rows."""
    rnd = random.Random(12)
    words = "the river runs under a bridge and people walk along it every morning before work starts in town".split()

    def good():
        return ". ".join(" ".join(rnd.choices(words, k=rnd.randrange(6, 14))).capitalize() for _ in range(rnd.randrange(3, 9))) + "."

    def bad():
        return rnd.choice([lambda: "BUY NOW!!! $$$ " * rnd.randrange(3, 30), lambda: "| # | * | " * rnd.randrange(5, 40), lambda: (rnd.choice(words) + " ") * rnd.randrange(20, 60)])()

    rows = [(i, good(), 1) if rnd.random() < 0.7 else (i, bad(), 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    marks = df.select("doc_id", "quality")
    got = quality.score(df.select("doc_id", "text"), marks).toPandas().merge(marks.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id) == {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    rank = held.score.rank()
    k, n = (held.quality == 1).sum(), len(held)
    assert (rank[held.quality == 1].sum() - k * (k + 1) / 2) / (k * (n - k)) > 0.95
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    ids = quality.training_ids(df, marks, 100)
    assert ids.count() == 100 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in ids.collect())
    least = [r.doc_id for r in quality.known(marks).orderBy(F.xxhash64("doc_id")).limit(100).collect()]
    assert {r.doc_id for r in ids.collect()} == set(least)
    stats = quality.with_statistics(df.select("doc_id", "text"))
    model = quality.fit(stats, quality.training_ids(df, marks))
    pdf = stats.withColumn("score", model.score(quality.prefixed())).toPandas()
    X = pdf[[f"_q_{x}" for x in quality.NAMES]].to_numpy()
    z = model.bias + sum(w * quality.fires(X, r) for w, r in zip(model.weights, model.rules))
    assert np.allclose(1 / (1 + np.exp(-z)), pdf.score)
    kept = {r.doc_id for r in quality.filter_good(df.select("doc_id", "text"), marks).collect()}
    assert kept == set(got.doc_id[got.predicted == 1])
    twice = df.select("doc_id", "text").unionByName(df.where("doc_id = 1").select("doc_id", "text").crossJoin(spark.range(500).select()))
    assert quality.fit(quality.with_statistics(twice), quality.training_ids(twice, marks)) == model


def test_rules_cascade(spark):
    rows = [(1, "clean words in a line of their own with more than ten"), (2, "few"), (3, "a b c d e " * 9), (4, "$$$ " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in rules.apply_rules(df, "doc_id").collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, False, False] and got[3].n_repeat_words == 45
    assert [r.doc_id for r in rules.keep_good(df).collect()] == [1]
    assert collections.Counter(r.base_failed for r in got.values())[True] == 3
    assert {r.doc_id: r.rules for r in rules.reasons(df, "doc_id").collect()} == {1: [], 2: ["base"], 3: ["base", "word_length"], 4: ["base", "symbols", "stutter"]}


def test_rules_do_not_depend_on_the_order(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["ok words follow here and there in plain sense of it ", "A! B! C! ", "$ # ", "x\nx\n", "LOUD WORDS "]) * rnd.randrange(1, 9) + " tail") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id for r in rules.reasons(df, "doc_id").collect() if not r.rules}
    for seed in range(3):
        some = rules.web_rules()
        random.Random(seed).shuffle(some)
        text = rules.text_of()
        assert {r.doc_id for r in df.where(~rules.cascade(some, rules.features(text, rules.words_of(text)))).collect()} == want
    assert {r.doc_id for r in rules.keep_good(df).collect()} == want == {r.doc_id for r in rules.apply_rules(df, "doc_id").collect() if r.kept}
