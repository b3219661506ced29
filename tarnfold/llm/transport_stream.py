"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores bytes as private data in packetised elementary packets, each an access unit with a
timestamp and a random-access mark, with the program tables before it, so that a reader can begin
at any of them; ``parse`` reads any 188-byte stream: program tables,
continuity counters, elementary packets, timestamps and random-access points.

Defined results: a null text is empty; an empty text stores 64 zero bytes; equal bytes give equal
streams; a broken sync byte, section checksum or counter is counted in the report and never raised;
an empty table gives no rows and other columns of it are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnfold.llm.common import ship, stage

PACKET = 188
PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD
UNIT = 8192  # bytes of an access unit
HELD = 8 << 20  # bytes of streams that a task passes on at once
TICK = 3600  # 90 kHz clock, 25 units a second


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)
_TABLES_AT = [_TABLES[:3] + bytes([0x10 | c]) + _TABLES[4 : PACKET + 3] + bytes([0x10 | c]) + _TABLES[PACKET + 4 :] for c in range(16)]  # by continuity counter
_MIDDLE = [b"\x47" + DATA_PID.to_bytes(2, "big") + bytes([0x10 | c]) for c in range(16)]


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E]) + ((pts >> 14) & 0xFFFE | 1).to_bytes(2, "big") + ((pts << 1) & 0xFFFE | 1).to_bytes(2, "big")


def mux(data: bytes, unit: int = UNIT) -> bytes:
    """A single-program stream that holds ``data`` whole, an access unit for every ``unit`` bytes."""
    out, cc = [], 0
    for k, at in enumerate(range(0, len(data), unit)):
        pts = (k * TICK) & (2**33 - 1)
        piece = data[at : at + unit]
        out.append(_TABLES_AT[k & 15])
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(piece) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts) + piece
        pcr = (pts << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - 8
        stuff = max(0, room - len(pes))
        out.append(b"\x47" + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | cc, 7 + stuff, 0x50]) + pcr + b"\xff" * stuff + pes[:room])
        cc = (cc + 1) & 15
        end = room + (len(pes) - room) // 184 * 184 if len(pes) > room else room
        for i in range(room, end, 184):
            out.append(_MIDDLE[cc] + pes[i : i + 184])
            cc = (cc + 1) & 15
        if rest := pes[end:]:
            gap = 184 - len(rest) - 1
            fill = bytes([gap]) + (b"\x00" + b"\xff" * (gap - 1) if gap else b"")
            out.append(b"\x47" + DATA_PID.to_bytes(2, "big") + bytes([0x30 | cc]) + fill + rest)
            cc = (cc + 1) & 15
    return b"".join(out) or _TABLES


@dataclass
class Unit:
    pid: int
    pts: int | None
    dts: int | None
    random_access: bool
    offset: int  # of the unit's first packet in the stream
    data: bytes


@dataclass
class Parsed:
    programs: dict[int, int] = field(default_factory=dict)  # program number to PMT PID
    streams: dict[int, int] = field(default_factory=dict)  # elementary PID to stream type
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    lost: int = 0  # continuity errors
    damaged: int = 0  # packets without sync, sections with a wrong checksum, truncated units


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _unit(pid: int, parts: list[bytes], random_access: bool, offset: int, out: Parsed) -> None:
    pes = b"".join(parts)
    if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
        out.damaged += 1
        return
    size, flags, start = int.from_bytes(pes[4:6], "big"), pes[7] >> 6, 9 + pes[8]
    if len(pes) < start + 0 or (size and len(pes) < 6 + size):
        out.damaged += 1
        return
    pts = _stamp(pes[9:14]) if flags & 2 else None
    dts = _stamp(pes[14:19]) if flags == 3 else pts
    out.units.append(Unit(pid, pts, dts, random_access, offset, pes[start : 6 + size] if size else pes[start:]))


def _tables(pid: int, payload: bytes, out: Parsed) -> None:
    section = payload[1 + payload[0] :] if payload else b""
    size = 3 + ((section[1] & 0x0F) << 8 | section[2]) if len(section) >= 3 else 0
    if size < 12 or len(section) < size or section_crc(section[:size]):
        out.damaged += 1
        return
    if pid == 0 and section[0] == 0:
        for i in range(8, size - 4, 4):
            if number := int.from_bytes(section[i : i + 2], "big"):
                out.programs[number] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
    elif section[0] == 2:
        i = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
        while i + 5 <= size - 4:
            out.streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
            i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0x0FFF)


def parse(stream: bytes) -> Parsed:
    """Reads program tables, then the units of every elementary stream they name.

    Duplicate packets (same counter, same bytes) are dropped, a gap in the counter counts as lost and
    ends the unit it falls in, unless the discontinuity flag announces it.
    """
    out = Parsed()
    last: dict[int, tuple[int, bytes]] = {}
    open_units: dict[int, list] = {}  # PID to [parts, random access, offset]
    table_pids = {0}
    for at in range(0, len(stream) - PACKET + 1, PACKET):
        p = stream[at : at + PACKET]
        out.packets += 1
        if p[0] != 0x47 or p[1] & 0x80:
            out.damaged += 1
            continue
        pid, kind, cc = (p[1] & 0x1F) << 8 | p[2], p[3] >> 4 & 3, p[3] & 15
        if pid == 0x1FFF or not kind & 1:
            continue
        start, random_access, jump = 4, False, False
        if kind & 2:
            start = 5 + p[4]
            if p[4]:
                random_access, jump = bool(p[5] & 0x40), bool(p[5] & 0x80)
        if pid in last and not jump:
            before = last[pid]
            if cc == before[0] and p == before[1]:
                continue
            if cc != (before[0] + 1) & 15:
                out.lost += 1
                if open_units.pop(pid, None):
                    out.damaged += 1
        last[pid] = (cc, p)
        first, payload = p[1] & 0x40, p[start:]
        if pid in table_pids:
            if first:
                _tables(pid, payload, out)
                table_pids |= set(out.programs.values())
        elif pid in out.streams:
            if first:
                if pid in open_units:
                    _unit(pid, *open_units[pid], out)
                open_units[pid] = [[payload], random_access, at]
            elif pid in open_units:
                open_units[pid][0].append(payload)
    for pid, x in open_units.items():
        _unit(pid, *x, out)
    if len(stream) % PACKET:
        out.damaged += 1
    out.units.sort(key=lambda u: u.offset)
    return out


def feature(p: Parsed) -> str:
    raps = [u for u in p.units if u.random_access]
    stamps = [u.pts for u in p.units if u.pts is not None]
    streams = ",".join(f"{pid}/{kind}" for pid, kind in sorted(p.streams.items()))
    return f"programs={len(p.programs)};streams={streams};packets={p.packets};units={len(p.units)};rap={len(raps)};pts={min(stamps, default=-1)}-{max(stamps, default=-1)};lost={p.lost};damaged={p.damaged}"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stored streams (key, n_bytes, media)."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for media in batch.column(2):
            stream = media.as_py()
            read = parse(stream)
            back = b"".join(u.data for u in read.units)
            for col, v in zip(cols, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(read)), strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*batch.schema.names[:2], *names])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n_bytes, media; at most about ``HELD`` bytes of streams and one more stream at a time."""
    for batch in batches:
        first, size, got, held = 0, [], [], 0

        def passed(last: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(size, pa.int64()), pa.array(got, pa.binary())], names=[batch.schema.names[0], "n_bytes", "media"])  # noqa: B023

        for k, text in enumerate(batch.column(1)):
            payload, n = padded(text.as_py())
            got.append(mux(payload))
            size.append(n)
            held += len(got[-1])
            if held > HELD:
                yield passed(k + 1)
                first, size, got, held = k + 1, [], [], 0
        if got:
            yield passed(batch.num_rows)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            units = parse(media.as_py() or b"").units
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(units), batch.schema.types[0]), pa.array([u.pid for u in units], pa.int32()), pa.array([u.pts for u in units], pa.int64()), pa.array([u.random_access for u in units], pa.bool_()), pa.array([u.offset for u in units], pa.int64()), pa.array([u.data for u in units], pa.binary())],
                names=[batch.schema.names[0], "pid", "pts", "random_access", "offset", "data"],
            )


def to_streams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text), media: every text as a transport stream."""
    ship(docs.sparkSession)
    return docs.select(key, docs[text].cast("string")).mapInArrow(_streams, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def units(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, pid, pts, random_access, offset, data: the access units of each stored stream, in order of offset."""
    ship(media.sparkSession)
    return media.select(key, column).mapInArrow(_units, f"{key} {media.schema[key].dataType.simpleString()}, pid int, pts long, random_access boolean, offset long, data binary")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the streams of all texts, reads the stored bytes back and returns sizes, digests and features of what was read."""
    stored = stage(to_streams(docs, key, text), "media", compression="zstd")
    return stored.mapInArrow(_digests, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
