"""Cost-balanced packing of documents into token sequences.

A document's ids are its tokens and a closing id. It is cut into full sequences and a rest; rests are packed in
windows of WINDOW pieces: in descending length, each goes to the sequence of least estimated cost (linear in its
tokens plus quadratic in each piece, as attention within a document is) that has room for it. A window opens as many
sequences as its tokens need, so when no sequence has room for a piece, it is cut over those with most room; a window
wastes less than one sequence. Windows are filled within a partition of the input, so nothing is shuffled, a task
holds the lengths of WINDOW pieces and no more, and a lost task is redone alone.

Sequence numbers are (partition number << 40) + a count. Defined cases: a null or empty text is its closing id alone;
repeated rows and null ids are documents of their own; extra columns are ignored; an empty table gives an empty one.
Ids are those of the vocabulary file by its own library; a second library with the same vocabulary computes them
several times faster. Texts that hold a string of an added token (which the first library reads as that token), and
those with a run of LONG_RUN white-space characters, where the second's pattern engine overflows, go to the first.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

MAX_TOKENS, CLOSING = 2048, 1
WINDOW = 2048
LONG_RUN = 100_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_encoders: dict = {}


def encoder(name: str = "byte_bpe_50k"):
    """Text to ids, made once a worker."""
    if name not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = Tokenizer.from_file(P.path(f"{name}.json"))
        added = [t.content for t in own.get_added_tokens_decoder().values()]

        def plain(text: str) -> list[int]:
            return own.encode(text, add_special_tokens=False).ids

        def encode(text: str) -> list[int]:
            long = len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+", text))
            return plain(text) if long or any(t in text for t in added) else fast.encode_ordinary(text)

        encode.plain = plain
        _encoders[name] = encode
    return _encoders[name]


def assign(lengths: np.ndarray, room: int = MAX_TOKENS) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Pieces (item, start in it, length), and the sequence of each; items are shorter than room."""
    n = int(-(-lengths.sum() // room))
    left, cost = np.full(n, room, np.int64), np.zeros(n)
    out, where = [], []

    def put(item: int, start: int, length: int, seq: int) -> None:
        out.append((item, start, length))
        where.append(seq)
        left[seq] -= length
        cost[seq] += LINEAR * length + QUADRATIC * length * length

    for item in np.argsort(-lengths, kind="stable").tolist():
        start, length = 0, int(lengths[item])
        seq = int(np.argmin(np.where(left >= length, cost, np.inf)))
        if left[seq] >= length:
            put(item, 0, length, seq)
            continue
        for seq in np.argsort(-left, kind="stable").tolist():  # none has room: cut it over those with most
            take = min(int(left[seq]), length)
            put(item, start, take, seq)
            start, length = start + take, length - take
            if not length:
                break
    return out, np.array(where, np.int64)


def packer(name: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        first = TaskContext.get().partitionId() << 40
        used = 0
        full: list[tuple] = []
        rests: list[tuple] = []

        def flush(rests: list[tuple], full: list[tuple]) -> pa.RecordBatch:
            nonlocal used
            rows = []
            for d, start, ids, total in full:
                rows.append((d, start, MAX_TOKENS, ids, total, first + used, 0, LINEAR * MAX_TOKENS + QUADRATIC * MAX_TOKENS**2))
                used += 1
            if rests:
                pieces, seqs = assign(np.array([len(r[2]) // 4 for r in rests], np.int64))
                at: dict[int, int] = {}
                for (item, start, length), seq in zip(pieces, seqs.tolist()):
                    d, begun, raw, total = rests[item]
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    rows.append((d, begun + start, length, crc, total, first + used + seq, at.get(seq, 0), LINEAR * length + QUADRATIC * length * length))
                    at[seq] = at.get(seq, 0) + length
                used += max(at) + 1
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), CLOSING], "<u4")
                whole = len(ids) // MAX_TOKENS * MAX_TOKENS
                for s in range(0, whole, MAX_TOKENS):
                    full.append((d, s, zlib.crc32(ids[s : s + MAX_TOKENS].tobytes()), len(ids)))
                if whole < len(ids):
                    rests.append((d, whole, ids[whole:].tobytes(), len(ids)))
                if len(rests) >= window or len(full) >= window:
                    yield flush(rests, full)
                    rests, full = [], []
        yield flush(rests, full)

    return run


def pack(docs: DataFrame, name: str = "byte_bpe_50k", window: int = WINDOW) -> DataFrame:
    """SCHEMA's columns, a row for each piece of docs (doc_id, text)."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(packer(name, window), SCHEMA)
