"""Media columns as MPEG transport streams (188-byte packets, ISO/IEC 13818-1).

`mux` stores a payload as one private elementary stream of packetised units of UNIT payload bytes, each begun with a
presentation time stamp. Every GROUP-th unit is a random-access point: before it stand a program association table and a
program map table, and its first packet carries the random-access flag and the program clock. `demux` reads bytes alone:
it parses all tables (checking their CRC, and that they do not change), checks the continuity counter of every stream,
tables included, reassembles the units and gives the payload, the time stamps, the clock and the random-access points.

`streams` stores texts, `parse` reads stored streams, `describe` does both and gives digests. Time stamps (ticks of a
90 kHz clock) and the packets at which random-access units begin are columns, so a reader can seek without the stream.

Defined cases: a null or empty text is one block of spaces; equal texts give equal rows; repeated rows and null ids
give a row each; extra columns are ignored; an empty table gives an empty one; damaged streams raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKET, SYNC, BLOCK = 188, 0x47, 192
PAT_PID, PMT_PID, ES_PID = 0, 0x100, 0x101
PRIVATE_DATA, STREAM_ID = 0x06, 0xBD
UNIT, GROUP, TICKS = 8 * BLOCK, 4, 3600
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: polynomial 04C11DB7, most significant bit first, started with ones."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _TABLE[(c >> 24) ^ b]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def packet(pid: int, counter: int, payload: bytes, start: bool, flags: int = 0, extra: bytes = b"") -> bytes:
    """One packet; what the payload leaves free is an adaptation field. flags: its flag byte, extra: what the flags
    announce; the rest is stuffing."""
    room = PACKET - 4 - len(payload)
    if room == 0 and not flags:
        adaptation = b""
    elif room == 1 and not flags:
        adaptation = b"\x00"
    else:
        adaptation = bytes([room - 1, flags]) + extra + b"\xff" * (room - 2 - len(extra))
    head = bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if adaptation else 0x10) | counter & 15])
    return head + adaptation + payload


def _tables(counter: int) -> bytes:
    pat = section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    fill = lambda s: b"\x00" + s + b"\xff" * (PACKET - 5 - len(s))
    return packet(PAT_PID, counter, fill(pat), True) + packet(PMT_PID, counter, fill(pmt), True)


#: The two tables' packets by their continuity counter.
TABLES = [_tables(c) for c in range(16)]
RANDOM_ACCESS, CLOCK = 0x40, 0x10


def clock(t: int) -> bytes:
    """A program clock reference of t ticks: 33 bits, 6 reserved ones, an extension of 9 bits."""
    return ((t << 15) | 0x7E00).to_bytes(6, "big")


def stamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 1 | (t >> 14) & 0xFE, t >> 7 & 0xFF, 1 | (t << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        t = k * TICKS & (2**33 - 1)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(t) + data
        if k % GROUP == 0:
            out.append(TABLES[k // GROUP & 15])
            first = PACKET - 4 - 8
            out.append(packet(ES_PID, counter, pes[:first], True, RANDOM_ACCESS | CLOCK, clock(t)))
        else:
            first = PACKET - 4
            out.append(packet(ES_PID, counter, pes[:first], True))
        counter += 1
        body = pes[first:]
        n = len(body) // (PACKET - 4)
        if n:
            block = np.empty((n, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
            block[:, 4:] = np.frombuffer(body, np.uint8, n * (PACKET - 4)).reshape(n, -1)
            out.append(block.tobytes())
            counter += n
        if rest := body[n * (PACKET - 4) :]:
            out.append(packet(ES_PID, counter, rest, False))
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """random_access: the packets at which such units begin; clocks: the program clock at them."""

    payload: bytes = b""
    packets: int = 0
    units: int = 0
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)


def _section(packet_payload: bytes, table_id: int) -> bytes:
    s = packet_payload[1 + packet_payload[0] :]
    n = int.from_bytes(s[1:3], "big") & 0xFFF
    if s[0] != table_id or crc32_mpeg(s[: 3 + n]):
        raise ValueError("damaged table")
    return s[8 : n - 1]


def demux(data: bytes) -> Stream:
    """The private stream of the first program, from bytes alone."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) % PACKET or not len(raw):
        raise ValueError("not whole packets")
    p = raw.reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(int) & 0x1F) << 8 | p[:, 2]
    begin = np.where(p[:, 3] >> 4 & 2, 5 + p[:, 4].astype(int), 4)

    def packets_of(which: int) -> np.ndarray:
        rows = np.flatnonzero(pid == which)
        if not len(rows):
            raise ValueError("missing stream")
        if ((np.diff((p[rows, 3] & 15).astype(int)) & 15) != 1).any():
            raise ValueError("continuity counter breaks")
        return rows

    def table(which: int, table_id: int) -> bytes:
        rows = packets_of(which)
        bodies = {_section(x, table_id) for x in {p[r, begin[r] :].tobytes() for r in rows}}
        if len(bodies) != 1:
            raise ValueError("tables change")
        return bodies.pop()

    pat = table(PAT_PID, 0)
    pmt = table(int.from_bytes(pat[2:4], "big") & 0x1FFF, 2)
    if pmt[4] != PRIVATE_DATA or pmt[:2] != pmt[5:7]:
        raise ValueError("another stream type, or a clock elsewhere")
    own = packets_of(int.from_bytes(pmt[5:7], "big") & 0x1FFF)
    out, parts = Stream(packets=len(p)), []
    starts = np.flatnonzero(p[own, 1] & 0x40)
    for k, a in enumerate(starts):
        rows = own[a : starts[k + 1] if k + 1 < len(starts) else len(own)]
        flags = int(p[rows[0], 5]) if begin[rows[0]] > 5 else 0
        if flags & RANDOM_ACCESS:
            out.random_access.append(int(rows[0]))
        if flags & CLOCK:
            out.clocks.append(int.from_bytes(p[rows[0], 6:12].tobytes(), "big") >> 15)
        plain = begin[rows] == 4
        if plain[1:-1].all() and len(rows) > 2:
            pes = p[rows[0], begin[rows[0]] :].tobytes() + p[rows[1:-1], 4:].tobytes() + p[rows[-1], begin[rows[-1]] :].tobytes()
        else:
            pes = b"".join(p[r, begin[r] :].tobytes() for r in rows)
        if pes[:3] != b"\x00\x00\x01" or len(pes) != 6 + int.from_bytes(pes[4:6], "big"):
            raise ValueError("damaged unit")
        t = pes[9:14]
        out.stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        parts.append(pes[9 + pes[8] :])
    out.units, out.payload = len(starts), b"".join(parts)
    return out


def padded(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of BLOCK."""
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def feature(s: Stream) -> str:
    """Of the stream read back: packets, units, random-access points, last time stamp, mean and deviation of samples,
    entropy in bits."""
    x = np.frombuffer(s.payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    return f"packets={s.packets};units={s.units};rap={len(s.random_access)};last_pts={s.stamps[-1]};mean={x.mean():.4f};dev={x.std():.4f};entropy={abs((share * np.log2(share)).sum()):.4f}"


def _batch(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names.split())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            stored = mux(padded(raw))
            back = demux(stored)
            own = back.payload
            rows.append((d, len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back), back.stamps, back.random_access))
        yield _batch(rows, "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature pts random_access", kinds)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(d, mux(padded((t or "").encode()))) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], "doc_id media", [pa.int64(), pa.binary()])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        read = [(d, demux(m)) for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield _batch([(d, s.payload, s.packets, s.units, s.stamps, s.random_access, s.clocks) for d, s in read], "doc_id payload packets units pts random_access clocks", [pa.int64(), pa.binary(), pa.int64(), pa.int64(), longs, longs, longs])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def streams(docs: DataFrame) -> DataFrame:
    """doc_id and media (the stored stream) of docs (doc_id, text)."""
    return _texts(docs).mapInArrow(_store, "doc_id long, media binary")


def parse(stored: DataFrame) -> DataFrame:
    """doc_id, payload, packets, units, pts, random_access and clocks of stored (doc_id, media)."""
    return stored.select("doc_id", "media").mapInArrow(_parse, "doc_id long, payload binary, packets long, units long, pts array<long>, random_access array<long>, clocks array<long>")


def describe(docs: DataFrame) -> DataFrame:
    """SCHEMA's columns: every text stored as a stream, read back and described."""
    return _texts(docs).mapInArrow(_describe, SCHEMA)
