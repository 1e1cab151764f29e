"""Document store: versions, cascades, caches, catalogue views, sampling, and the join to what held at a time.

State is tables; a change is a new table from the old one and the rows that changed, by equi-joins on ids. A version's
document and fingerprint are its key, so histories of any length are handled where they lie."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINGERPRINT = ("document_id", "content_hash", "metadata_hash", "parser_version", "chunker_version", "embedding_model")


def fingerprint(df: DataFrame) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FINGERPRINT if c in df.columns]), 256)


def ingest_versions(versions: DataFrame, batch: DataFrame) -> DataFrame:
    """fingerprint, status, action for a batch's fingerprints against versions (fingerprint, status): known ones are
    reused, failed or deleted ones go back to processing, others are new. Repeats within a batch count once."""
    old = versions.select("fingerprint", F.col("status").alias("_old"))
    df = batch.select("fingerprint").distinct().join(old, "fingerprint", "left")
    again = F.col("_old").isin("failed", "deleted")
    action = F.when(F.col("_old").isNull(), "created").when(again, "reset").otherwise("reused")
    return df.select("fingerprint", F.when(F.col("_old").isNull() | again, "processing").otherwise(F.col("_old")).alias("status"), action.alias("action"))


def current(versions: DataFrame) -> DataFrame:
    """document_id, current_version_id, status: the newest active version (document_id, version_id, status, created_at) of
    each document, none and "deleted" where there is none."""
    newest = F.max(F.when(F.col("status") == "active", F.struct("created_at", "version_id")))
    v = versions.groupBy("document_id").agg(newest["version_id"].alias("current_version_id"))
    return v.withColumn("status", F.when(F.col("current_version_id").isNull(), "deleted").otherwise("active"))


def delete_versions(versions: DataFrame, records: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions with those in gone (version_id) deleted, and records (document_id, current_version_id): a deleted current
    version gives way to the newest active one left, a document without any is deleted; others stay as they are."""
    hit = gone.select("version_id", F.lit(True).alias("_gone")).distinct()
    v = versions.join(hit, "version_id", "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")
    lost = records.join(hit.withColumnRenamed("version_id", "current_version_id"), "current_version_id", "left")
    new = current(v).withColumnsRenamed({"current_version_id": "_new", "status": "_status"})
    r = lost.join(new, "document_id", "left")
    pick = F.when(F.col("_gone"), F.col("_new")).otherwise(F.col("current_version_id"))
    return v, r.select("document_id", pick.alias("current_version_id"), F.when(pick.isNull(), "deleted").otherwise("active").alias("status"))


def activate(versions: DataFrame, records: DataFrame, chosen: DataFrame) -> DataFrame:
    """records with the versions in chosen (document_id, version_id) current; those that are deleted or of another
    document are passed over. Rolling back is choosing an older one."""
    ok = versions.where("status <> 'deleted'").join(chosen, ["document_id", "version_id"], "left_semi").select("document_id", F.col("version_id").alias("_new"))
    r = records.join(ok, "document_id", "left")
    return r.select("document_id", F.coalesce("_new", "current_version_id").alias("current_version_id"))


def cascade_delete(stores: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each store without the documents in ids, and a row each with how many rows went."""
    ids = ids.select(key).distinct()
    left = {name: df.join(ids, key, "left_anti") for name, df in stores.items()}
    counts = [df.join(ids, key, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("store"), "deleted") for name, df in stores.items()]
    return left, reduce(DataFrame.unionByName, counts)


def cache_split(rows: DataFrame, cache: DataFrame, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """rows with a cached value, and the distinct keys that have none, so each is computed once."""
    return rows.join(cache, key), rows.select(key).distinct().join(cache.select(key), key, "left_anti")


def upsert_id(chunk_id: Column, path: Column, index: Column, text: Column) -> Column:
    """An id with "::" as it is; else hash of the path, index and hash of the content."""
    made = F.concat_ws("_", F.left(F.sha2(path, 256), F.lit(8)), F.lpad(index.cast("string"), 4, "0"), F.left(F.sha2(text, 256), F.lit(8)))
    return F.when(F.contains(chunk_id, F.lit("::")), chunk_id).otherwise(made)


def visible_collections(chunks: DataFrame, allowed: Column) -> DataFrame:
    """collection, n_visible of collections with a chunk that the caller may see."""
    return chunks.groupBy("collection").agg(F.count_if(allowed).alias("n_visible")).where("n_visible > 0")


def collection_payload(chunks: DataFrame) -> DataFrame:
    """collection, n_documents, n_chunks, and the sorted union of metadata keys (metadata: map)."""
    keys = chunks.select("collection", F.explode(F.map_keys("metadata")).alias("k")).distinct().groupBy("collection").agg(F.array_sort(F.collect_list("k")).alias("metadata_keys"))
    n = chunks.groupBy("collection").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"))
    return n.join(keys, "collection", "left")


def document_payload(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, page_start, page_end, title, summary of chunks (doc_id, chunk_index, page, title, summary, text,
    source): of the first chunk, with the source's file name and the text's beginning as fallbacks."""
    first = F.min_by(F.struct("title", "summary", "text", "source"), "chunk_index")
    d = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), first.alias("f"))
    name = F.regexp_replace(F.element_at(F.split("f.source", "/"), -1), r"\.[^.]*$", "")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return d.select("doc_id", "n_chunks", "page_start", "page_end", F.coalesce(blank(F.col("f.title")), name).alias("title"), F.coalesce(blank(F.col("f.summary")), F.left("f.text", F.lit(200))).alias("summary"))


def resource(chunks: DataFrame, allowed: Column, **keys) -> DataFrame:
    """The chunks of given keys (collection=, doc_id=, chunk_id=) that the caller may see."""
    out = chunks.where(allowed)
    for k, v in keys.items():
        out = out.where(F.col(k) == v)
    return out


def newest(rows: DataFrame, at: str, most: int, **equal) -> DataFrame:
    """The newest rows with the values given, ties by all columns."""
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    return rows.orderBy(F.desc(at), *[c for c in rows.columns if c != at]).limit(most)


def first_of_id(rows: DataFrame, key: str, order: list) -> tuple[DataFrame, DataFrame]:
    """The first row of each id, and ids with how many rows more they have."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    kept = rows.withColumn("_n", n).where("_n = 1").drop("_n")
    return kept, rows.groupBy(key).agg((F.count("*") - 1).alias("again")).where("again > 0")


def manifest(rows: DataFrame, *columns: str) -> DataFrame:
    """name, value, n: how many rows have each value of each column, in one pass."""
    long = rows.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("name", "value"))
    return long.groupBy("name", "value").agg(F.count("*").alias("n"))


def gold_requirements(pairs: DataFrame) -> DataFrame:
    """doc_id, n_questions, questions, source_types of pairs (doc_id, question_id, source_type)."""
    return pairs.groupBy("doc_id").agg(F.count_distinct("question_id").alias("n_questions"), F.array_sort(F.collect_set("question_id")).alias("questions"), F.array_sort(F.collect_set("source_type")).alias("source_types"))


def hit_counters(rows: DataFrame, by: str, method: str, methods: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(by).agg(*[F.count_if(F.col(method) == m).alias(f"n_{m}") for m in methods])


def balanced_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, turn by turn over the strata: within each in the order of a seeded hash of the key. A sample, by intent:
    only the n first of each stratum take part in the last step."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    w = Window.partitionBy(stratum).orderBy("_h", key)
    return rows.withColumn("_h", h).withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= n).orderBy("_turn", stratum).limit(n).drop("_h", "_turn")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """left with columns of the latest row of right at or before its time, by key: one union and one window in time
    order, so no pair of rows is formed. Rows of right at one time: the greatest by columns."""
    r = right.select(key, at, F.struct(*columns).alias("_r"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"))
    u = r.unionByName(left.select(key, at, F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_side"), F.struct("*").alias("_l")))
    w = Window.partitionBy(key).orderBy(at, "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = u.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_l.*", *[F.col("_r")[c].alias(c) for c in columns])
