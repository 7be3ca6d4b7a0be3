"""MPEG transport streams (ISO/IEC 13818-1) as a column: multiplexing, parsing, checking, timestamps.

mux() stores a payload losslessly as private data in packets of 188 bytes: program association and program map
tables, one elementary stream of PES packets with presentation time stamps, clock references and random-access
indicators. parse() reads any stream: it follows the program tables, checks continuity counters and table CRCs,
reassembles elementary packets and lists their timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, text_bytes

PACKET = 188
PMT_PID, DATA_PID, PROGRAM, PRIVATE_DATA = 0x100, 0x101, 1, 0x06
UNIT_BYTES, UNITS_PER_RANDOM_ACCESS, TICKS = 4096, 8, 3600


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(1024)
def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


@lru_cache(64)
def _table_packets(counter: int) -> bytes:
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))
    return b"".join(struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter & 15) + b"\0" + s + b"\xff" * (183 - len(s)) for pid, s in ((0, pat), (PMT_PID, pmt)))


def _time(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE))


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """A transport stream that carries payload in units of unit_bytes, one PES packet each; at least one unit."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, max(1, len(payload)), unit_bytes)):
        unit = payload[at : at + unit_bytes]
        pts = k * TICKS & 0x1FFFFFFFF
        random_access = k % UNITS_PER_RANDOM_ACCESS == 0
        if random_access:
            out.append(_table_packets(tables & 15))
            tables += 1
            field_ = b"\x50" + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        else:
            field_ = b""
        data = b"\0\0\1\xbd" + struct.pack(">H", len(unit) + 8) + b"\x84\x80\x05" + _time(pts) + unit
        room = 184 - (1 + len(field_) if field_ else 0)
        first, rest = data[:room], data[room:]
        lack = room - len(first)
        if lack and not field_:
            field_ = b"\0" * (lack > 1) + b"\xff" * (lack - 2)
        elif lack:
            field_ += b"\xff" * lack
        if lack or field_:
            first_packet = struct.pack(">BHBB", 0x47, 0x4000 | DATA_PID, 0x30 | counter & 15, len(field_)) + field_ + first
        else:
            first_packet = struct.pack(">BHB", 0x47, 0x4000 | DATA_PID, 0x10 | counter & 15) + first
        out.append(first_packet)
        counter += 1
        full = len(rest) // 184
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | counter + np.arange(full) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * 184).reshape(full, 184)
            out.append(block.tobytes())
            counter += full
        if tail := rest[full * 184 :]:
            free = 183 - len(tail)
            stuffing = b"" if free == 0 else b"\0" + b"\xff" * (free - 1)
            out.append(struct.pack(">BHBB", 0x47, DATA_PID, 0x30 | counter & 15, free) + stuffing + tail)
            counter += 1
    return b"".join(out)


@dataclass
class Unit:
    pid: int
    pts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)  # program number -> PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID -> stream type
    units: list[Unit] = field(default_factory=list)
    counter_errors: int = 0
    table_errors: int = 0
    sync_errors: int = 0


def _read_section(part: bytes, out: Stream) -> bytes | None:
    part = part[1 + part[0] :] if part else b""
    if len(part) < 12 or len(part) < (n := 3 + (part[1] << 8 & 0xF00 | part[2])) or n < 12 or crc32_mpeg(bytes(part[:n])):
        out.table_errors += 1
        return None
    return part[:n]


def parse(data: bytes) -> Stream:
    """Read a stream; damage is counted, and packets that can't be read are left out."""
    out = Stream()
    n = len(data) // PACKET
    p = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    good = (p[:, 0] == 0x47) & (p[:, 1] & 0x80 == 0)
    out.sync_errors = int(n - good.sum()) + (len(data) % PACKET > 0)
    pids = ((p[:, 1].astype(np.int32) & 0x1F) << 8) | p[:, 2]
    starts, kind, counters = p[:, 1] & 0x40 > 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    offsets = 4 + np.where(kind & 2 > 0, 1 + p[:, 4].astype(np.int32), 0)
    has = good & (kind & 1 > 0) & (offsets < PACKET)
    for pid in np.unique(pids[has]):
        c = counters[has & (pids == pid)].astype(np.int32)
        if pid != 0x1FFF:
            out.counter_errors += int(((np.diff(c) % 16) != 1).sum() - ((np.diff(c) == 0).sum()))
    part = lambda k: data[k * PACKET + int(offsets[k]) : (k + 1) * PACKET]
    for k in np.nonzero(has & starts & (pids == 0))[0]:
        if s := _read_section(part(k), out):
            out.programs.update({a: b & 0x1FFF for a, b in struct.iter_unpack(">HH", s[8:-4]) if a})
    for pid in set(out.programs.values()):
        for k in np.nonzero(has & starts & (pids == pid))[0]:
            if s := _read_section(part(k), out):
                at = 12 + (s[10] << 8 & 0xF00 | s[11])
                while at + 5 <= len(s) - 4:
                    out.streams[(s[at + 1] << 8 | s[at + 2]) & 0x1FFF] = s[at]
                    at += 5 + (s[at + 3] << 8 & 0xF00 | s[at + 4])
    for pid in out.streams:
        own = np.nonzero(has & (pids == pid))[0]
        # a repeated counter is a repeated packet
        own = own[np.concatenate([[True], counters[own][1:] != counters[own][:-1]])] if len(own) else own
        begin = np.nonzero(starts[own])[0]
        offs = offsets[own].tolist()
        for a, b in zip(begin, [*begin[1:], len(own)]):
            pes = b"".join(data[k * PACKET + o : (k + 1) * PACKET] for k, o in zip(own[a:b].tolist(), offs[a:b]))
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                out.sync_errors += 1
                continue
            size = pes[4] << 8 | pes[5]
            pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1 if pes[7] & 0x80 and len(pes) >= 14 else None
            k = own[a]
            random_access = bool(kind[k] & 2 and p[k, 4] > 0 and p[k, 5] & 0x40)
            out.units.append(Unit(int(pid), pts, random_access, pes[9 + pes[8] : 6 + size if size else None]))
    return out


def padded(text: bytes | None) -> bytes:
    data = text or b""
    return data + b"\0" * (-len(data) % 64 or 64 * (not data))


def features(s: Stream, payload: bytes) -> str:
    """A few numbers of the parsed stream and its payload's bytes, as one string."""
    times = [u.pts for u in s.units if u.pts is not None]
    hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = hist[hist > 0] / max(1, hist.sum())
    return f"programs={len(s.programs)};streams={len(s.streams)};units={len(s.units)};random_access={sum(u.random_access for u in s.units)};pts={min(times, default=-1)}-{max(times, default=-1)};errors={s.counter_errors + s.table_errors + s.sync_errors};entropy={float(-(p * np.log2(p)).sum()):.6f}"


def _store(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        rows = []
        for t in text_bytes(b.column(1)):
            ts = mux(padded(t))
            s = parse(ts)
            payload = b"".join(u.data for u in s.units)
            rows.append((len(t or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(ts), hashlib.sha256(ts).hexdigest(), features(s, payload), len(s.units), sum(u.random_access for u in s.units), max((u.pts for u in s.units if u.pts is not None), default=None)))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_units", "n_random_access", "last_pts"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [b.schema.names[0], *names])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a transport stream and read back: sizes, digests, timestamps and features, one row per row.

    A null text counts as an empty one; an empty one is stored as 64 zero bytes. Nothing depends on the id, which may
    be null or repeat. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    x = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_mr_text"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_random_access long, last_pts long"
    return map_arrow(x, _store, schema)


def _media(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([mux(padded(t)) for t in text_bytes(b.column(1))], pa.binary())], [b.schema.names[0], "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, media): every text as the bytes of a transport stream."""
    x = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_mr_text"))
    return map_arrow(x, _media, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, media binary")


def _units(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = parse(data or b"")
            n = len(s.units)
            yield pa.record_batch(
                [pa.array([i] * n, b.column(0).type), pa.array(range(n), pa.int64()), pa.array([u.pid for u in s.units], pa.int32()), pa.array([s.streams[u.pid] for u in s.units], pa.int32()), pa.array([u.pts for u in s.units], pa.int64()), pa.array([u.random_access for u in s.units], pa.bool_()), pa.array([u.data for u in s.units], pa.binary()), pa.array([s.counter_errors] * n, pa.int64())],
                [b.schema.names[0], "unit", "pid", "stream_type", "pts", "random_access", "data", "counter_errors"],
            )


def demux(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per elementary packet of each stream in a binary column: PID, stream type, time stamp, random access, data.

    Null, empty and unreadable streams give no rows; damage is counted in counter_errors.
    """
    x = media.select(F.col(id_col), F.col(media_col).alias("_mr_media"))
    return map_arrow(x, _units, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, unit long, pid int, stream_type int, pts long, random_access boolean, data binary, counter_errors long")
