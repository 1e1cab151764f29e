"""Exact repeats across documents, by a run-length Burrows-Wheeler index.

A byte goes if a LENGTH-byte string over it also starts in a document of smaller id. Three steps, none of which holds
more than a shard:

1. Anchors. Each LENGTH-byte window has an anchor, the GRAM-byte string in it of least hash; equal windows have equal
   anchors. The windows of one anchor form a segment, 50 to 76 bytes, and a row (anchor, hash of the segment, document,
   place) is dealt to a shard by its anchor. Within CHUNK bytes of input, of equal segments only the least document's
   is dealt; so a passage that a third of all documents share reaches its shard once a chunk. There is a shard for each
   SHARD bytes of input, dealt over partitions of which there are at most MOST, and a task takes its shards one by one.
2. Shards. Equal segments collapse into one, of the least document, and the others' windows are marked: whole copies are
   decided here, by hash, and do not enter the index. Only where different segments share an anchor can windows match in
   part, and only these segments are asked for.
3. Index. The segments asked for are fetched, dealt again by anchor, and indexed: suffixes of all segments are sorted,
   the transform is cut into runs (also where a group of suffixes with a common LENGTH-byte beginning starts), and a
   run keeps its head, its start, the row its first character maps to, and the least document of its rows as its
   sample. Matching statistics are streamed: every segment is walked from its end by mapping rows through runs, all
   segments of a block at once; where LENGTH bytes remain, the row's group gives the least document that has them.
   Segments of an anchor with more than HOT_ANCHOR of them are dealt by anchor and the bytes on one side of it: a window
   that two of them share has SIDE bytes before the anchor or SIDE after it, so each match lies within one such group.

Defined cases: a null or empty text, or one under LENGTH bytes, loses nothing; a null id counts as larger than every
other; rows of one doc_id don't remove from each other; repeated rows lose the same bytes; extra columns are ignored;
an empty table gives an empty one. Segments are told apart by 48 bits of their hash under 40 bits of the anchor's beyond
the shard's own part; two different ones of one anchor are taken for equal with probability 2^-48.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import release, settle, shards
from lodestone.llm.neardup import GOLDEN, mix64

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
CHUNK, PIECE, BLOCK = 3_000_000, 200_000, 400_000
SHARD, MOST, HOT_ANCHOR = 8_000_000, 20_000, 4096
SIDE = (LENGTH - GRAM) // 2
LAST = np.iinfo(np.int64).max
ROW = np.dtype([("anchor", "<u8"), ("segment", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("n", "u1"), ("before", "u1"), ("after", "u1")])
ASK = np.dtype([("anchor", "<u8"), ("at", "<u4"), ("n", "u1")])
RANGE = np.dtype([("start", "<u4"), ("end", "<u4")])
_rng = np.random.default_rng(20240607)
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def powers(b: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, b, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_powers: dict[int, np.ndarray] = {}


def cached_powers(b: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(int(b), ())) < n:
        _powers[int(b)] = powers(b, max(n, 2 * PIECE))
    return _powers[int(b)][:n]


class Hasher:
    """Hashes of substrings of data: polynomial over random byte values modulo 2^64, then mixed with the length."""

    def __init__(self, data: np.ndarray):
        self.up = cached_powers(BASE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * cached_powers(INVERSE, len(data)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64) * GOLDEN)

    def grams(self, k: int) -> np.ndarray:
        """Of every k neighbours."""
        return mix64((self.sums[k:] - self.sums[:-k]) * self.up[: len(self.sums) - k] + np.full(1, k, np.uint64) * GOLDEN)


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over each w neighbours."""
    size = 1
    while 2 * size <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: for each segment its anchor's hash, its own hash, its first window's place in data,
    its number of windows, and a byte of the hash of the SIDE bytes before and after the anchor, 0 where the document
    has fewer."""
    none = (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 4
    if len(data) < LENGTH:
        return none
    h = Hasher(data)
    gram = h.grams(GRAM)
    low = sliding(gram, SPAN, np.minimum)
    begins = np.concatenate([[0], ends[:-1]])
    last = np.repeat(ends, ends - begins)
    windows = np.flatnonzero(np.arange(LENGTH, LENGTH + len(low)) <= last[: len(low)])
    if not len(windows):
        return none
    # a gram is chosen if it is the least of a window; walk each window to its first chosen gram of the least hash
    edge = np.zeros(SPAN - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), SPAN, np.maximum) == gram)
    low = low[windows]
    j = np.searchsorted(chosen, windows)
    wrong = np.flatnonzero(gram[chosen[j]] != low)
    while len(wrong):
        j[wrong] += 1
        wrong = wrong[gram[chosen[j[wrong]]] != low[wrong]]
    first = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    n = np.diff(np.append(first, len(windows)))
    start, place = windows[first], chosen[j[first]]
    doc = np.searchsorted(ends, start, "right")

    def side(a: np.ndarray, fits: np.ndarray) -> np.ndarray:
        a = np.where(fits, a, 0)
        return np.where(fits, (h(a, a + SIDE) % np.uint64(255)).astype(np.int64) + 1, 0)

    before, after = side(place - SIDE, place - SIDE >= begins[doc]), side(place + GRAM, place + GRAM + SIDE <= ends[doc])
    return gram[place], h(start, start + n + LENGTH - 1), start, n, before, after


def all_anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """anchors() of many texts, PIECE bytes at a time; places count from the first text's start."""
    out, base, i = [], 0, 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and total < PIECE:
            total += len(texts[j])
            j += 1
        a = anchors(np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([len(t) for t in texts[i:j]]))
        out.append((*a[:2], a[2] + base, *a[3:]))
        base, i = base + total, j
    return tuple(np.concatenate(c) for c in zip(*out))


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows (d, h, bytes, *rest) in lists of about size bytes."""
    rows, total = [], 0
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for d, h, text, *rest in zip(*cols):
            raw = (text or "").encode()
            rows.append((LAST if d is None else d, h, raw, *rest))
            total += len(raw)
            if total >= size:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), RANGE)
    out["start"], out["end"] = start, start + n + LENGTH - 1
    return out


def by_doc(doc: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        yield int(doc[a]), values[a:b].tobytes()


OUT = "shard int, kind int, d long, h long, docs binary, rows binary"


def table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in OUT.split(", ")])


MARK, DEAL, ASKED = 1, 0, 2


#: Bytes that a dealt row keeps of its anchor (above the shard's own part of it), segment hash, place, windows and sides,
#: each byte of all rows together; a clash of anchors costs a needless request, and segments are told apart by both.
WIDTHS = (5, 6, 4, 1, 1, 1)


def packed(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, WIDTHS))


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // sum(WIDTHS)
    planes = np.frombuffer(raw, np.uint8).reshape(sum(WIDTHS), n)
    out, k = np.zeros(n, ROW), 0
    for name, w in zip(("anchor", "segment", "at", "n", "before", "after"), WIDTHS):
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = planes[k : k + w].T
        out[name] = full.view("<u8")[:, 0]
        k += w
    return out


def dealer(p: int):
    """Rows of segments by shard (DEAL), and marks that a chunk settles itself (MARK)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in chunks(batches, CHUNK):
            docs = sorted((x for x in docs if len(x[2]) >= LENGTH), key=lambda x: x[0])
            if not docs:
                continue
            ends = np.cumsum([len(x[2]) for x in docs])
            begins = np.concatenate([[0], ends[:-1]])
            anchor, segment, start, n, before, after = all_anchors([x[2] for x in docs])
            doc = np.searchsorted(ends, start, "right")
            ids = np.array([x[0] for x in docs], np.int64)
            order = np.lexsort((segment, anchor))
            anchor, segment, start, n, doc, before, after = (x[order] for x in (anchor, segment, start, n, doc, before, after))
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])]) if len(anchor) else np.empty(0, bool)
            least = ids[doc[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(anchor) else ids[:0]
            again = ids[doc] > least
            at = start - begins[doc]
            out = [(int(docs[d][1] % p), MARK, docs[d][0], docs[d][1], None, v) for d, v in by_doc(doc[again], ranges(at[again], n[again]))]
            anchor, segment, doc, at, n, before, after = (x[~again] for x in (anchor, segment, doc, at, n, before, after))
            shard = (anchor % np.uint64(p)).astype(np.int64)
            order = np.lexsort((at, doc, shard))
            anchor, segment, doc, at, n, before, after, shard = (x[order] for x in (anchor // np.uint64(p), segment, doc, at, n, before, after, shard))
            cuts = np.searchsorted(shard, np.arange(p + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                a = slice(cuts[s], cuts[s + 1])
                own, which = np.unique(doc[a], return_counts=True)
                names = np.array([(*docs[d][:2], k) for d, k in zip(own, which)], "<i8")
                out.append((int(s), DEAL, None, None, names.tobytes(), packed(anchor[a], segment[a], at[a], n[a], before[a], after[a])))
            yield table(out)

    return run


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Marks to pass on, and the rows (shard, docs, rows) of one shard, from rows sorted by shard."""
    dealt: list[tuple] = []
    for batch in batches:
        b, marks = batch.to_pydict(), []
        for row in zip(b["shard"], b["kind"], b["d"], b["h"], b["docs"], b["rows"]):
            if row[1] == MARK:
                marks.append(row)
                continue
            if dealt and dealt[0][0] != row[0]:
                yield [], dealt
                dealt = []
            dealt.append((row[0], row[4], row[5]))
        if marks:
            yield marks, []
    if dealt:
        yield [], dealt


def settle_shard(p: int, most: int, dealt: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Of a shard: marks of segments that equal one of a lesser document, and asks for those that share an anchor; an
    anchor of more than `most` of these is split by side."""
    names, parts, base = [], [], 0
    for shard, docs, rows in dealt:
        own, part = np.frombuffer(docs, "<i8").reshape(-1, 3), unpacked(rows)
        part["doc"] = np.repeat(np.arange(base, base + len(own)), own[:, 2])
        part["anchor"] = part["anchor"] * np.uint64(p) + np.uint64(shard)
        names.append(own)
        parts.append(part)
        base += len(own)
    who, rows = np.concatenate(names), np.concatenate(parts)
    del names, parts
    ids = who[:, 0]
    rows = rows[np.argsort(rows["anchor"])]
    lone = np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]])
    rows = rows[~(lone & np.append(lone[1:], True))]
    if not len(rows):
        return
    rows = rows[np.lexsort((ids[rows["doc"]], rows["segment"], rows["anchor"]))]
    fresh = np.concatenate([[True], (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["segment"][1:] != rows["segment"][:-1])])
    own = ids[rows["doc"]]
    again = own > own[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    yield table([(0, MARK, int(who[d, 0]), int(who[d, 1]), None, v) for d, v in by_doc(rows["doc"][again], ranges(rows["at"][again].astype(np.int64), rows["n"][again].astype(np.int64)))])
    rows, own = rows[~again], own[~again]
    # a window of two different segments shares SIDE bytes before the anchor, or SIDE bytes after it
    wanted = {}
    for side in ("before", "after"):
        key = rows["anchor"] * np.uint64(256) + rows[side]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        many = np.minimum.reduceat(own[order], starts) != np.maximum.reduceat(own[order], starts)
        wanted[side] = np.empty(len(rows), bool)
        wanted[side][order] = np.repeat(many, np.diff(np.append(starts, len(rows)))) & (rows[side][order] > 0)
    either = wanted["before"] | wanted["after"]
    begins = np.flatnonzero(np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]]))
    sizes = np.diff(np.append(begins, len(rows)))
    hot = np.repeat(np.add.reduceat(either.astype(np.int64), begins) > most, sizes)

    def ask(which: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        asks = np.empty(int(which.sum()), ASK)
        asks["anchor"], asks["at"], asks["n"] = keys[which], rows["at"][which], rows["n"][which]
        return table([(0, ASKED, int(who[d, 0]), int(who[d, 1]), None, v) for d, v in by_doc(rows["doc"][which], asks)])

    yield ask(either & ~hot, rows["anchor"])
    if hot.any():
        for k, side in enumerate(("before", "after")):
            yield ask(wanted[side] & hot, mix64(rows["anchor"] * np.uint64(512) + rows[side] + np.uint64(256 * k)))


def settler(p: int, most: int):
    """Partitions of whole shards, sorted by shard: marks pass, each shard is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, dealt in by_shard(batches):
            if marks:
                yield table(marks)
            else:
                yield from settle_shard(p, most, dealt)

    return run


def fetcher(p: int):
    """Segments asked for, by shard: docs holds (d, h) pairs and text lengths, rows the asks and the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in chunks(batches, CHUNK):
            by: dict[int, list] = {}
            for d, h, raw, asks in docs:
                a = np.frombuffer(b"".join(asks), ASK)
                shard = (a["anchor"] % np.uint64(p)).astype(int)
                for s in np.unique(shard):
                    for anchor, at, n in a[shard == s].tolist():
                        by.setdefault(int(s), []).append((anchor, d, h, at, raw[at : at + n + LENGTH - 1]))
            yield table([(s, DEAL, None, None, np.array([(x[1], x[2]) for x in v], "<i8").tobytes() + np.array([(x[0], x[3], len(x[4])) for x in v], "<u8").tobytes(), b"".join(x[4] for x in v)) for s, v in by.items()])

    return run


class RunIndex:
    """The run-length transform of a collection of byte strings, each with the number of its document.

    rows: suffixes in order, a string's end before every byte and ends in the order of the strings. A run is a maximal
    stretch of rows with one preceding byte within one group, a group being the suffixes with a common beginning of
    `length` bytes. Kept of a run: start, the row that its first row maps to, and the least document (the sample).
    """

    def __init__(self, strings: list[bytes], docs: np.ndarray, length: int = LENGTH):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        n = len(text)
        owner = np.repeat(np.arange(len(strings)), sizes + 1)
        room = self.ends[owner] - np.arange(n)

        def later(x: np.ndarray, k: int) -> np.ndarray:
            y = np.zeros(n, np.int64)
            y[: n - k] = x[k:]
            return np.where(room > k, y, 0)

        def dense(key: np.ndarray) -> np.ndarray:
            """Ranks from 1 by key, 0 at the strings' ends."""
            order = np.argsort(key)
            ranked = key[order]
            out = np.empty(n, np.int64)
            out[order] = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            return np.where(room > 0, out, 0)

        one = np.where(room > 0, text.astype(np.int64) + 1, 0)
        k, key = 7, one
        for j in range(1, k):
            key = key * 257 + later(one, j)
        rank = dense(key)
        common = None
        longest = int(sizes.max(initial=1))
        while k < max(longest, length):
            if k * 2 >= length and common is None:
                common = np.where(room >= length, rank * (n + 2) + later(rank, length - k), -1)
            rank = dense(rank * (n + 2) + later(rank, k))
            k *= 2
        rows = np.lexsort((owner, rank))
        before = np.where(rows > 0, text[rows - 1].astype(np.int64) + 1, 0)
        before[(rows == 0) | (room[rows - 1] == 0)] = 0
        common = common[rows]
        group = np.concatenate([[True], (common[1:] != common[:-1]) | (common[1:] < 0)])
        run = group | np.concatenate([[True], before[1:] != before[:-1]])
        self.starts = np.flatnonzero(run)
        heads = before[self.starts]
        lengths = np.diff(np.append(self.starts, n))
        order = np.argsort(heads, kind="stable")
        self.maps = np.empty(len(heads), np.int64)
        self.maps[order] = np.cumsum(lengths[order]) - lengths[order]
        self.samples = np.minimum.reduceat(docs[owner[rows]], self.starts)
        of_run = np.cumsum(group[self.starts]) - 1
        self.group_least = np.minimum.reduceat(self.samples, np.flatnonzero(group[self.starts]))[of_run]
        self.end_rows = np.arange(len(strings))
        self.sizes, self.n_strings, self.length = sizes, len(strings), length

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of all strings, from their ends: (string, place, least document that has the `length`
        bytes from there)."""
        at, rows, alive = self.sizes.copy(), self.end_rows.copy(), np.arange(self.n_strings)
        while len(alive):
            run = np.searchsorted(self.starts, rows[alive], "right") - 1
            full = self.sizes[alive] - at[alive] >= self.length
            if full.any():
                yield alive[full], at[alive][full], self.group_least[run[full]]
            more = at[alive] > 0
            alive, run = alive[more], run[more]
            rows[alive] = self.maps[run] + rows[alive] - self.starts[run]
            at[alive] -= 1


def index_shard(dealt: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The marks of a shard of fetched segments, from an index of BLOCK bytes of whole groups at a time."""
    got: list[tuple] = []
    for _, head, text in dealt:
        k = len(head) // 40
        ids = np.frombuffer(head, "<i8", 2 * k).reshape(-1, 2).tolist()
        rest = np.frombuffer(head, "<u8", 3 * k, 16 * k).reshape(-1, 3).tolist()
        at = 0
        for (d, h), (anchor, start, size) in zip(ids, rest):
            got.append((anchor, d, h, start, text[at : at + size]))
            at += size
    got.sort(key=lambda x: x[:4])
    i = 0
    while i < len(got):
        j, total = i, 0
        while j < len(got) and (total < BLOCK or got[j][0] == got[j - 1][0]):
            total += len(got[j][4]) + 1
            j += 1
        part, i = got[i:j], j
        ids = np.array([x[1] for x in part], np.int64)
        hits_s, hits_at = [], []
        for s, at, least in RunIndex([x[4] for x in part], ids).stream():
            hit = least < ids[s]
            hits_s.append(s[hit])
            hits_at.append(at[hit])
        s, at = np.concatenate(hits_s or [ids[:0]]), np.concatenate(hits_at or [ids[:0]])
        if len(s):
            starts = np.array([x[3] for x in part], np.int64)
            yield table([(0, MARK, part[k][1], part[k][2], None, v) for k, v in by_doc(s, ranges(starts[s] + at, np.ones(len(at), np.int64)))])


def indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, dealt in by_shard(batches):
        yield from index_shard(dealt)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(marks: list[bytes] | None) -> list[tuple[int, int]]:
    """The union of marked ranges as maximal runs."""
    r = np.frombuffer(b"".join(marks or []), RANGE)
    if not len(r):
        return []
    r = r[np.argsort(r["start"], kind="stable")]
    reach = np.maximum.accumulate(r["end"])
    first = np.flatnonzero(np.concatenate([[True], r["start"][1:] > reach[:-1]]))
    return list(zip(r["start"][first].tolist(), reach[np.append(first[1:], len(r)) - 1].tolist()))


def remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d, text, marks in zip(*[c.to_pylist() for c in batch.columns]):
            raw, at, kept, gone = (text or "").encode(), 0, [], 0
            runs = covered(marks)
            for a, b in runs:
                kept.append(raw[at:a])
                at, gone = b, gone + b - a
            kept.append(raw[at:])
            rows.append((d, len(raw), gone, len(runs), hashlib.sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()])], names=[x.split()[0] for x in RESULT.split(", ")])


def layout(docs: DataFrame) -> tuple[int, int]:
    """Partitions and shards (a multiple of them) for the bytes of docs: the cluster's own number of partitions or a
    shard each, MOST at most, and as many shards a partition as SHARD asks for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shards(docs.sparkSession), min(MOST, -(-size // SHARD)))
    return parts, parts * max(1, -(-size // (parts * SHARD)))


def marks(docs: DataFrame) -> DataFrame:
    """d, h (of a document: its id, the largest number for null, and its text's hash) and marks, array<binary> of RANGE."""
    spark = docs.sparkSession
    parts, p = layout(docs)
    dealt = lambda df: df.repartition(parts, "shard").sortWithinPartitions("shard")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    found = settle(dealt(keyed.mapInArrow(dealer(p), OUT)).mapInArrow(settler(p, HOT_ANCHOR), OUT).select("kind", "d", "h", "rows"))
    release(spark)
    asks = found.where(F.col("kind") == ASKED).groupBy("d", "h").agg(F.collect_list("rows").alias("asks"))
    wanted = keyed.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("d"), "h", "text").join(asks, ["d", "h"])
    more = settle(dealt(wanted.mapInArrow(fetcher(p), OUT)).mapInArrow(indexer, OUT).select("kind", "d", "h", "rows"))
    release(spark)
    return found.where(F.col("kind") == MARK).unionByName(more).groupBy("d", "h").agg(F.collect_list("rows").alias("marks"))


def remove(docs: DataFrame) -> DataFrame:
    """RESULT's columns, a row for each row of docs (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return keyed.join(marks(docs), ["d", "h"], "left").select("doc_id", "text", "marks").mapInArrow(remover, RESULT)
