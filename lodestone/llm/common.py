"""What the training-data operators share: words, table reading, the shared scratch folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.spread import spread

#: White space between words: space and the bytes 9 to 13; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents that are small beside the cores are dealt over them, as they may be one row group."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id", "text") if name == "documents" else df


def text_of(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """array<string> of the text's words; no words: an empty array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def crc_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def let(x: Column, *steps: Callable[[Column], Column]) -> Column:
    """x through the steps in turn; each step's value is computed once however often the next one reads it."""
    out = F.array(x)
    for step in steps:
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


#: The scratch folders of this process that are marked for deletion.
_homes: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names; a local folder only where it names none and driver and
    executors are one process. What a run leaves there is deleted when its JVM ends."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(top)
    home = f"{top.rstrip('/')}/lodestone/{context.applicationId}"
    if home not in _homes:
        at = spark._jvm.org.apache.hadoop.fs.Path(home)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _homes.add(home)
    return f"{home}/{uuid.uuid4().hex}"


#: The paths settled in the innermost passing() block.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: its lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    path = scratch(df.sparkSession)
    if _passing.get() is not None:
        _passing.get().append(path)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled in the block are deleted at its end, but for those given to the function it yields: these go to
    the block around it, if there is one. Nothing lazy that reads a deleted table may leave the block."""
    outer, paths = _passing.get(), []
    token = _passing.set(paths)

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df._settled)
        if outer is not None:
            outer.append(df._settled)
        return df

    try:
        yield keep
    finally:
        _passing.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shards(spark: SparkSession) -> int:
    """How many ways the cluster deals a shuffle: its own setting, which its owner sizes to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The array of step's running results over values (integers, step associative, 0 neutral): each round combines an
    entry with the one 1, 2, 4, ... places before, so n entries cost n log n and no array is grown entry by entry."""

    def scan(v: Column) -> Column:
        rounds = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(v))
        return F.aggregate(rounds, v, lambda acc, d: F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), d), F.slice(acc, F.lit(1), F.size(acc) - d)), step))

    return let(values, scan)


def places(matches: Column, between: Column, more: Column | None = None) -> Column:
    """array<struct(start, end, m[, more])> of a pattern's matches, from its extract (matches) and its split (between,
    one entry more, or null where there is no match); more is an array beside matches. Offsets count code points. Each
    argument is read once and the ends are running sums, so time is near linear in the number of matches."""
    extra = [] if more is None else ["more"]
    kind = "array<struct<start:int,end:int,m:string" + ",more:string" * len(extra) + ">>"
    pairs = F.zip_with(matches, between, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    if extra:
        pairs = F.zip_with(pairs, more, lambda p, x: F.struct(p["m"].alias("m"), p["g"].alias("g"), x.alias("more")))

    def spans(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"])), lambda a, b: a + b)
        return F.zip_with(p, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("m"), *[x[c].alias(c) for c in extra]))

    return F.when(F.size(matches) == 0, F.array().cast(kind)).otherwise(let(F.filter(pairs, lambda p: p["m"].isNotNull()), spans))


#: Characters of a block: what lies at an offset is found from its block, not from the start of the text.
BLOCK = 256


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK characters, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive, within the text) of a text in blocks(); the time is that of what is cut."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(near, start - first * BLOCK + 1, end - start)


def joined(array: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(array: Column, kind: str) -> Column:
    return F.size(F.filter(array, lambda s: s["kind"] == kind)).cast("long")


#: Rows and stored bytes that a broadcast may hold. Beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000
#: Rows that are broadcast in place of a join by key that grows with the input.
KEYS_ROWS = 100_000
#: Rows of one join key that a task may get; keys with more are dealt over several.
HOT = 10_000


def only(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows of df whose col is in ids (settled, distinct, one column named col): broadcast while it is small, by
    count, shuffled otherwise."""
    return df.join(sized(ids), col, "left_semi")


def small(settled: DataFrame, rows: int | None = None) -> bool:
    stored = int(settled._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return stored <= BROADCAST_BYTES and settled.count() <= (BROADCAST_ROWS if rows is None else rows)


def sized(ids: DataFrame) -> DataFrame:
    """A settled table of a few columns, marked for broadcast where its rows and bytes allow it."""
    return F.broadcast(ids) if small(ids) else ids


def copies_of(n: Column) -> Column:
    """Over how many tasks a key of n rows is dealt."""
    return F.ceil(n / F.lit(HOT)).cast("int")


def dealt_join(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """left joined with right (settled, a row for each key, with copies = copies_of(the rows that left has of it)). A small
    right is broadcast; else the rows of a hot key are dealt by other, and its row of right is copied to each part, so no
    task gets more than about HOT rows of a key."""
    if small(right, KEYS_ROWS):
        return left.join(F.broadcast(right.drop("copies")), key)
    hot = sized(settle(right.where("copies > 1").select(key, F.col("copies").alias("_copies"))))
    left = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return left.join(right, [key, "_salt"]).drop("_salt")


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that the shuffle files of finished steps are deleted now: once for what
    Python has let go of, once for what the JVM then has."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
