"""Near duplicates by fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017), banding and exact verification.

Sketch: in round i < T every element of a document's shingle set is thrown by a fresh hash into one of T bins with a
value i + v; in rounds T to 2T - 1 every element goes into bin i - T. Each bin keeps its least value, so after 2T
rounds each is filled, and coordinates of two sets agree with the probability of their Jaccard similarity, as
concentrated as independent samples. Rounds are computed in blocks, as many as fill the bins; since earlier rounds
have smaller values, a block more changes nothing.

Banding: BANDS bands of ROWS coordinates; two sets of similarity 0.8 share no band with probability under 1.2e-6.

Linking: documents of one shingle set are one class. Within a bucket no list of pairs is made: the class with most
company across its buckets leads, every other is compared with it on the full sets, and components are merged. A
leader leaves its buckets, a bucket ends when its rest lies in one component, and the next leader follows. After
the first round, entries that can have no partner by size and by elements of their own are dropped; after ROUNDS
rounds, an exact prefix join over the nodes that are still open finds what pairs may be left. Components come from
alternating large-star and small-star steps; no link, set or label passes through the driver. Buckets and leaders of very
many rows are dealt over tasks (common.HOT); the stars' rows are two numbers, whose skew Spark's adaptive joins split.

Defined cases: no words or no text: an empty set, linked with nothing; rows of one doc_id are judged by their own
texts, and are one node where each is the least id of its class; rows of a null doc_id take the component of their class if it has another id, and else stay alone with a null component;
repeated rows give a row each; extra columns are ignored by `link` and kept by `dedup`; an empty table gives an empty
one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm.common import copies_of, dealt_join, only, passing, release, settle, sized

BANDS, ROWS = 45, 6
T = BANDS * ROWS
ROUNDS = 4
WORDS_CACHED = 400_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes by word, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence. Lower case for A-Z only,
    and bytes.split() parts at the six white-space bytes."""
    seq = (text or "").encode().lower().split()
    if not seq:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, seq), np.uint64, len(seq))
    width = min(k, len(seq))
    out = np.full(len(seq) - width + 1, width, np.uint64)
    for j in range(width):
        out = mix64(out * GOLDEN + h[j : j + len(out)])
    return np.unique(out)


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit elements."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    done, n = 0, len(s)
    need = t * (np.log(t) + 3)
    while done < t:
        rounds = int(min(t - done, max(1, np.ceil(need / n))))
        i = np.arange(done, done + rounds, dtype=np.uint64)[:, None]
        h = mix64(s[None, :] + (i + np.uint64(1)) * GOLDEN)
        bins = ((h & np.uint64(0xFFFFFF)) * np.uint64(t)) >> np.uint64(24)
        np.minimum.at(out, bins.astype(np.int64).ravel(), ((i << np.uint64(48)) | (h >> np.uint64(24))).ravel())
        done += rounds
        if (out != np.iinfo(np.uint64).max).all():
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        h = mix64(s + np.full(1, t + b + 1, np.uint64) * GOLDEN)
        out[b] = (np.uint64(t + b) << np.uint64(48)) | (h.min() >> np.uint64(24))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    c = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * GOLDEN + c[:, j])
    return key.view(np.int64)


def key_of(s: np.ndarray) -> bytes | None:
    """What rows of one non-empty shingle set share."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, k, words)
                n.append(len(s))
                keys.append(key_of(s))
                bands.append(band_keys(sketch(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return run


def setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [shingles(t, k, words) for t in batch.column(1).to_pylist()]
            keys, items = pa.array([key_of(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), keys, items], names=["node", "set_key", "items"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of edges (a, b)."""
    e = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; settled) of nodes that have sets, with 100 * intersection >= percent * union of some set of each.
    A node of very many pairs, as a leader may be, has its pairs dealt over tasks, each with a copy of its sets."""
    held = sets.select("node", "part", "items", F.size("items").alias("n"))
    hot, salt = None, []
    if pairs.count() > common.HOT:  # else no node can have more
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(copies_of(F.count("*")).alias("copies")).where("copies > 1")
        hot, salt, many = sized(settle(ends)), ["salt"], F.coalesce("copies", F.lit(1))
        held = held.join(hot, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("copies")

    def beside(df: DataFrame, end: str, other: str, columns: list[str]) -> DataFrame:
        """df with columns of the sets of its end."""
        if hot is not None:
            df = df.join(hot.withColumnRenamed("node", end), end, "left").withColumn("salt", F.pmod(F.xxhash64(other), many).cast("int")).drop("copies")
        keys = [end, *salt, *([f"p{end}"] if f"p{end}" in df.columns else [])]
        right = held.select(F.col("node").alias(end), *salt, F.col("part").alias(f"p{end}"), *[F.col(c).alias(f"{c}{end}") for c in columns])
        return df.join(right, keys).drop(*salt)

    fit = beside(beside(pairs, "a", "b", ["n"]), "b", "a", ["n"])
    fit = fit.where(F.lit(100) * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "pa", "b", "pb")
    x = beside(beside(fit, "a", "b", ["items"]), "b", "a", ["items"])
    x = x.select("a", "b", F.size(F.array_intersect("itemsa", "itemsb")).alias("i"), (F.size("itemsa") + F.size("itemsb")).alias("t"))
    return x.where(F.lit(100) * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b").distinct()


def labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """entries with label: a node's component, itself where it has no link yet."""
    if labels is None:
        return entries.withColumn("label", F.col("node"))
    return entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def still_open(now: DataFrame) -> DataFrame:
    """The entries (node, key, company, label, ...) of buckets that hold two components, with the leader and its label."""
    rank = F.struct("company", -F.col("node"))
    keys = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by("node", rank).alias("lead"), F.max_by("label", rank).alias("lead_label"), copies_of(F.count("*")).alias("copies")).where("lo <> hi")
    return dealt_join(now, settle(keys.drop("lo", "hi")), "key", "node")


def bounds(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, n (its least set's size) and most (the largest partner that any of its sets can have among nodes). Of a
    set's elements, the x that no other set has are in no intersection: with a partner of size s the similarity is at
    most (n - x) / (s + x)."""
    own = settle(sets.join(nodes, "node", "left_semi"))
    lone = own.select("node", "part", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("part").alias("part")).where("c = 1")
    lone = lone.groupBy("node", "part").agg(F.count("*").alias("x"))
    size = own.select("node", "part", F.size("items").alias("n")).join(lone, ["node", "part"], "left")
    x = F.coalesce("x", F.lit(0))
    most = F.floor((F.col("n") - x) * 100 / percent) - x
    return settle(size.groupBy("node").agg(F.min("n").alias("n"), F.max(most).alias("most")))


def possible(now: DataFrame) -> DataFrame:
    """Without the entries that can have no partner in their bucket, by the sizes in bounds()."""
    keys = now.groupBy("key").agg(F.min("n").alias("_least"), F.max("most").alias("_most"), copies_of(F.count("*")).alias("copies"))
    return dealt_join(now, settle(keys), "key", "node").where("_least <= most and n <= _most").drop("_least", "_most")


def rest_pairs(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of open nodes in different components that can still be similar enough, by an exact prefix join:
    elements are ordered by how few of the nodes have them; the smaller set of a similar pair has one of its first
    elements among the first ones of the larger, and at the first they share, what follows in either set must suffice
    for the intersection that the pair needs."""
    nodes = settle(now.groupBy("node").agg(F.min("label").alias("label"), F.min("most").alias("most")))
    items = settle(sets.join(nodes.select("node"), "node", "left_semi").select("node", "part", F.size("items").alias("n"), F.explode("items").alias("item")))
    spread = items.groupBy("item").agg(F.count("*").alias("c"))
    order = items.join(spread, "item").groupBy("node", "part", "n").agg(F.sort_array(F.collect_list(F.struct("c", "item"))).alias("o"))
    reach = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    order = order.join(nodes, "node").select("node", "label", "n", "most", F.posexplode(F.slice("o", F.lit(1), reach.cast("int"))).alias("i", "e"))
    order = settle(order.where("e.c > 1").select("node", "label", "n", "most", "i", F.col("e.item").alias("item")))
    inner = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1
    small = order.where(F.col("i") < inner).select("item", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "most", "i")])
    large = order.select("item", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "most", "i")])
    enough = F.expr("least(n_a - i_a, n_b - i_b)") * (100 + percent) >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))
    fits = F.expr("label_a <> label_b and n_a <= n_b and n_a <= most_b and n_b <= most_a") & enough
    return small.join(large, (small["item"] == large["item"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def linked(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """node and label, settled, of every node of classes that has a link; None if there is no company at all. The sets
    of a node are those of its classes, part telling them apart; what its id has of other nodes' classes is not among
    them."""
    spark = docs.sparkSession
    entries = classes.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    with passing(spark) as keep:
        shared = settle(shared.select("key", "c", copies_of(F.col("c")).alias("copies")))
        entries = settle(dealt_join(entries, shared, "key", "node"))
        company = entries.groupBy("node").agg(F.sum("c").alias("company"))
        entries = keep(settle(entries.select("node", "key").distinct().join(company, "node")))
        nodes = settle(entries.select("node").distinct())
        parts = settle(classes.join(nodes, "node", "left_semi").select("node", F.xxhash64("set_key").alias("part")))
        sets = only(docs.withColumnRenamed("doc_id", "node"), nodes, "node").mapInArrow(setter(k), "node long, set_key binary, items array<long>").where("set_key is not null")
        sets = sets.select("node", F.xxhash64("set_key").alias("part"), "items").join(sized(parts), ["node", "part"], "left_semi")
        sets = keep(settle(sets.distinct()))

    labels, links = None, None
    for done in range(ROUNDS + 1):
        with passing(spark) as keep:
            now = labelled(entries, labels)
            if done == 1:
                limits = bounds(settle(still_open(now).select("node").distinct()), sets, percent)
                now = possible(now.join(limits, "node"))
            now = settle(still_open(now))
            if now.isEmpty():
                break
            if done < ROUNDS:
                pairs = now.where("label <> lead_label").select(F.col("lead").alias("a"), F.col("node").alias("b"))
                entries = keep(now).where("node <> lead").select("node", "key", "company", *[c for c in ("n", "most") if c in now.columns])
            else:
                pairs = rest_pairs(now, sets, percent)
            new = verified(settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), sets, percent)
            links = new if links is None else links.unionByName(new)
            labels = keep(settle(components(links)))
            links = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
    return labels


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    with passing(spark) as keep:
        seen = keep(settle(docs.mapInArrow(sketcher(k), SCHEMA)))
        classes = keep(settle(seen.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")).where("node is not null")))
        labels = linked(docs, classes, k, percent)
        if labels is not None:
            keep(labels)
    where = labelled(classes.select("set_key", "node"), labels).select("set_key", F.col("label").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "set_key").join(where, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that represent their component, all columns kept. Rows of one doc_id stay or go together, and
    go if none of them represents a component; rows of a null doc_id stay."""
    with passing(docs.sparkSession) as keep:
        ids = link(docs, k, percent).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("_kept"))
        gone = keep(settle(ids.where("not _kept").select("doc_id")))
    release(docs.sparkSession)
    return docs.join(sized(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
