"""Inverted index, keyword and vector scoring, top-k, fusion and boosting, over a batch of queries as rows.

Postings stay distributed; only query terms (bounded by the query batch) and one-row statistics are broadcast by size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import bound, tokens

K1, B = 1.5, 0.75
RRF_K = 60
#: Rows (query, term, count) of a query batch that may be broadcast; a larger batch is joined by shuffles.
QUERY_ROWS = 500_000


def token_rows(docs: DataFrame, least: int = 2, lead: bool = False) -> DataFrame:
    """doc_id, dl (the document's number of tokens), term: a row for each token, with lead an empty one before them. The
    array is exploded as an expression: of a column, Spark would infer a filter on its size, push it down to the scan and
    tokenise every text twice."""

    def paired(ts):
        every = F.concat(F.array(F.lit("")), ts) if lead else ts
        return F.when(F.size(ts) > 0, F.transform(every, lambda t: F.struct(F.size(ts).alias("dl"), t.alias("term"))))

    return docs.select("doc_id", F.explode(bound(tokens(F.col("text"), least), paired)).alias("x")).select("doc_id", "x.dl", "x.term")


def postings(docs: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, term, tf, doc_length (repeats counted). A document's tokens are counted where they are made; one shuffle
    of its distinct terms follows."""
    return token_rows(docs, least).withColumnRenamed("dl", "doc_length").groupBy("doc_id", "doc_length", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(docs: DataFrame, least: int = 2) -> DataFrame:
    """One row: n_docs and avgdl over documents with a token."""
    n = docs.select(F.size(tokens(F.col("text"), least)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("avgdl"))


def term_statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(queries: DataFrame, least: int = 2) -> DataFrame:
    """query_id, term, qtf: a term repeated in a query counts as often."""
    return queries.select("query_id", F.explode(tokens(F.col("text"), least)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def hint(terms: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Marks tables with a row for each of the batch's query terms, or fewer: for broadcast if these are few, by count."""
    return F.broadcast if terms.count() <= QUERY_ROWS else lambda df: df


def wanted_terms(docs: DataFrame, terms: DataFrame, mark: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, dl, term, tf of the terms asked for, and a row of an empty term for each document with a token. What df, N
    and mean length need is in it, and whoever reads all its columns shares its one shuffle: documents are read once."""
    asked = terms.select("term").distinct().unionByName(docs.sparkSession.sql("SELECT '' AS term"))
    rows = token_rows(docs, 2, lead=True).join(mark(asked), "term", "left_semi")
    return rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score for every document with a query term. Documents are cut down to the queries' terms
    before anything is counted or shuffled, and score beside the batch's terms, both broadcast while the batch is small; all statistics come from the same cut rows. The
    empty term meets no query term, so no branch filters by term and all of them read one shuffle."""
    terms = query_terms(queries)
    mark = hint(terms)
    cut = wanted_terms(docs, terms, mark)
    some = (F.col("tf") > 0) & (F.col("dl") > 0) & F.coalesce(F.col("doc_id") == F.col("doc_id"), F.lit(True))
    whole = some & (F.col("term") == "")
    stats = cut.agg(F.count_if(whole).alias("n_docs"), F.avg(F.when(whole, F.col("dl"))).alias("avgdl"))
    df = cut.groupBy("term").agg(F.count_if(some).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(1.0)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    scored = cut.join(mark(df.join(terms, "term")), "term").crossJoin(F.broadcast(stats))
    return scored.groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("qtf")).alias("score"))


def ranked(hits: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by (score rounded to `digits`, doc_id), with their rank."""
    hits = hits.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score: the share of the query's distinct terms that the document has."""
    terms = query_terms(queries).select("query_id", "term")
    size = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text"), 2))).alias("term"))
    hits = rows.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    return hits.join(size, "query_id").select("query_id", "doc_id", (F.col("c") / F.col("n")).alias("score"))


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank): one union and one aggregation."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists) or min(weights) < 0:
        raise ValueError("a non-negative weight for each list")
    parts = [x.select("query_id", "doc_id", (F.lit(w) / (k + F.col("rank"))).alias("s"), F.lit(i).alias("list_no")) for i, (x, w) in enumerate(zip(lists, weights))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.min("list_no").alias("first_list"))


def interleave(lists: list[DataFrame], k: int) -> DataFrame:
    """Round robin over ranked lists, the first occurrence of a document kept."""
    out = None
    for i, x in enumerate(lists):
        x = x.select("query_id", "doc_id", "rank", F.lit(i).alias("list_no"))
        out = x if out is None else out.unionByName(x)
    out = out.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.rank", "at.list_no")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
