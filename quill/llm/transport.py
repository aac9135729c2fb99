"""MPEG transport streams as a media column: mux, demux and checks.

A stream holds a program association table, a program map table and one private elementary
stream of access units. ``mux`` and ``demux`` work on one stream each; ``stored`` and
``read_back`` apply them to DataFrame columns, batch by batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.shared import lean, written

PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID = 188, 0x47, 0, 0x1000, 0x0100
#: Bytes of an access unit, and 90 kHz ticks between two.
UNIT_BYTES, TICKS, FIRST_PTS = 32_000, 3_600, 90_000
#: The clock is so many ticks behind the stamp of the unit it comes with.
DELAY = 9_000
#: Every so many access units is a random-access point.
ACCESS_EVERY = 4
#: stream_type and stream_id of private data in PES packets.
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        table = np.where(table >> 31, (table << np.uint32(1)) ^ np.uint32(0x04C11DB7), table << np.uint32(1)).astype(np.uint32)
    return table


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def _clock(ticks: int) -> bytes:
    """A program clock reference: 33 bits of 90 kHz, six reserved ones, an extension of 0."""
    return (ticks << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """Payload cut into access units, each one PES packet with a timestamp, in 188-byte packets."""
    parts, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (min(len(payload) - at, UNIT_BYTES) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(FIRST_PTS + k * TICKS) + payload[at : at + UNIT_BYTES]
        # the first packet has an adaptation field, at access points with their flag and the clock; the last one is stuffed by one
        field_ = (b"\x50" + _clock(FIRST_PTS + k * TICKS - DELAY)) if k % ACCESS_EVERY == 0 else b"\x00"
        room = 184 - 1 - len(field_)
        n = 1 + max(0, -(-(len(pes) - room) // 184))
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        raw = np.frombuffer(pes, np.uint8)
        first = min(len(raw), room)
        if n == 1:
            out[0, 3] |= 0x20
            out[0, 4], out[0, 5 : 5 + len(field_)] = 184 - first - 1, np.frombuffer(field_, np.uint8)
            out[0, PACKET - first :] = raw
        else:
            out[0, 3] |= 0x20
            out[0, 4], out[0, 5 : 5 + len(field_)] = len(field_), np.frombuffer(field_, np.uint8)
            out[0, PACKET - room :] = raw[:room]
            full = raw[room : room + (n - 2) * 184]
            if n > 2:
                out[1:-1, 4:] = full.reshape(n - 2, 184)
            rest = raw[room + (n - 2) * 184 :]
            if len(rest) < 184:
                out[-1, 3] |= 0x20
                out[-1, 4] = 183 - len(rest)
                if len(rest) < 183:
                    out[-1, 5] = 0
            out[-1, PACKET - len(rest) :] = rest
        counter += n
        parts.append(out.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds: its programs, elementary payloads by PID, stamps and faults."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    units: dict[int, list[tuple[int | None, bool, bytes]]] = field(default_factory=dict)
    packets: int = 0
    lost_sync: int = 0
    gaps: int = 0
    bad_tables: int = 0
    orphans: int = 0
    clocks: list[int] = field(default_factory=list)


def _read_section(packet: np.ndarray) -> tuple[int, bytes] | None:
    body = packet[5 + int(packet[4]) if packet[3] & 0x20 else 4 :].tobytes()
    body = body[1 + body[0] :] if body else body
    if len(body) < 3:
        return None
    size = ((body[1] & 0x0F) << 8 | body[2]) + 3
    if size < 12 or size > len(body) or section_crc(body[:size]):
        return None
    return body[0], body[8 : size - 4]


def demux(media: bytes) -> Stream:
    """Parse tables, check continuity counters per PID and reassemble the PES packets.

    Packets without a sync byte are counted and skipped; a gap in a PID's counter is counted and
    its open unit kept as far as it came; packets before a PID's first unit are counted as orphans.
    Damaged tables, headers and lengths are counted or read as far as they go, never raised. Empty
    input gives an empty stream.
    """
    s = Stream()
    raw = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    s.packets = len(raw)
    good = raw[:, 0] == SYNC
    s.lost_sync = int((~good).sum()) + (len(media) % PACKET > 0)
    raw = raw[good]
    pids = (raw[:, 1].astype(np.int32) & 0x1F) << 8 | raw[:, 2]
    starts, control = raw[:, 1] & 0x40 > 0, raw[:, 3] >> 4 & 3
    maps: dict[int, int] = {}
    for p in raw[(pids == PAT_PID) & starts]:
        if not (got := _read_section(p)):
            s.bad_tables += 1
            continue
        for i in range(0, len(got[1]) - 3, 4):
            maps[(got[1][i + 2] & 0x1F) << 8 | got[1][i + 3]] = got[1][i] << 8 | got[1][i + 1]
    for pid, program in maps.items():
        for p in raw[(pids == pid) & starts]:
            if not (got := _read_section(p)):
                s.bad_tables += 1
                continue
            body = got[1]
            if len(body) < 4:
                s.bad_tables += 1
                continue
            at = 4 + ((body[2] & 0x0F) << 8 | body[3])
            while at + 5 <= len(body):
                s.programs.setdefault(program, {})[(body[at + 1] & 0x1F) << 8 | body[at + 2]] = body[at]
                at += 5 + ((body[at + 3] & 0x0F) << 8 | body[at + 4])
    for pid in {pid for streams in s.programs.values() for pid in streams}:
        own = (pids == pid) & (control & 1 > 0)
        packets, first = raw[own], starts[own]
        if not len(packets):
            continue
        counters = packets[:, 3] & 15
        same = np.r_[False, (counters[1:] == counters[:-1])]
        s.gaps += int((np.r_[False, (counters[1:] - counters[:-1]) & 15 != 1] & ~same).sum())
        packets, first = packets[~same], first[~same]
        adapted = packets[:, 3] & 0x20 > 0
        begin = np.where(adapted, 5 + packets[:, 4].astype(np.int64), 4)
        access = adapted & (packets[:, 4] > 0) & (packets[:, 5] & 0x40 > 0)
        clocked = adapted & (packets[:, 4] > 6) & (packets[:, 5] & 0x10 > 0)
        s.clocks += [int.from_bytes(p[6:12].tobytes(), "big") >> 15 for p in packets[clocked]]
        at = np.flatnonzero(first)
        s.orphans += int(at[0]) if len(at) else len(packets)
        for a, b in zip(at, np.append(at[1:], len(packets))[: len(at)], strict=True):
            block, begins = packets[a:b], begin[a:b]
            if len(block) > 2 and (begins[1:-1] == 4).all():
                pes = block[0, begins[0] :].tobytes() + block[1:-1, 4:].tobytes() + block[-1, begins[-1] :].tobytes()
            else:
                pes = b"".join(p[g:].tobytes() for p, g in zip(block, begins, strict=True))
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                s.bad_tables += 1
                continue
            pts = None
            if pes[7] & 0x80 and len(pes) >= 14:
                t = pes[9:14]
                pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
            body, declared = pes[9 + pes[8] :], int.from_bytes(pes[4:6], "big")
            s.units.setdefault(pid, []).append((pts, bool(access[a]), body[: max(0, declared - 3 - pes[8])] if declared else body))
    return s


def padded(raw: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def stored(df: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """``keep``, n_bytes, media: each text (null: empty) as a transport stream in a binary column."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.large_binary() if sum(map(len, raw)) > 1 << 30 else pa.binary())], ["key", "n_bytes", "media"])

    kind = df.schema[keep].dataType.simpleString()
    return df.select(F.col(keep).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lean(batches), f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", keep)


def read_back(df: DataFrame, keep: str = "doc_id") -> DataFrame:
    """Demultiplex ``media``: payload digests, program table, stamps, random-access points and faults."""
    kind = df.schema[keep].dataType.simpleString()
    out = f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_units bigint, first_pts bigint, last_pts bigint, access_points array<bigint>, n_gaps bigint, n_lost_sync bigint"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for key, n, media in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                media = media or b""
                s = demux(media)
                units = [u for pid in sorted(s.units) for u in s.units[pid]]
                payload = b"".join(u[2] for u in units)
                stamps, points = [u[0] for u in units if u[0] is not None], [u[0] for u in units if u[1] and u[0] is not None]
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) if payload else np.zeros(256, np.int64)
                mean, high = (float((counts * np.arange(256)).sum() / len(payload)), int(counts[128:].sum())) if payload else (0.0, 0)
                feature = f"programs={len(s.programs)};packets={s.packets};units={len(units)};pts={stamps[0] if stamps else '-'}..{stamps[-1] if stamps else '-'};access={len(points)};gaps={s.gaps};mean={mean:.4f};high={high}"
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(units), stamps[0] if stamps else None, stamps[-1] if stamps else None, points, s.gaps, s.lost_sync))
            types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], [f.split()[0] for f in out.split(", ")])

    return df.select(F.col(keep).alias("key"), "n_bytes", "media").mapInArrow(lean(batches), out).withColumnRenamed("key", keep)


def media_columns(df: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Store each text as a transport stream in a table of the shared folder, and read that back.

    Null and empty texts store 64 zero bytes; repeated rows give repeated results; other columns
    of ``df`` are not read, whatever their names; an empty table gives an empty one.
    """
    return read_back(written(stored(df, text, keep), "media")[0], keep)
