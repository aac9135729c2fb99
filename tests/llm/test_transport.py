"""Transport streams: exact round trips, damage that is counted and never raised, the stored table."""

import hashlib
import zlib

import numpy as np
import pytest
from quill.llm import transport as ts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 100, 160, 170, 176, 183, 184, 190, 360, 5000, 31999, 32000, 32001, 200000])
def test_round_trip(n):
    raw = ts.padded(np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes())
    media = ts.mux(raw)
    s = ts.demux(media)
    units = s.units[ts.DATA_PID]
    assert len(media) % ts.PACKET == 0 and b"".join(u[2] for u in units) == raw
    assert s.gaps == s.lost_sync == s.bad_tables == s.orphans == 0 and s.programs == {1: {ts.DATA_PID: ts.PRIVATE_TYPE}}
    assert [u[0] for u in units] == [ts.FIRST_PTS + k * ts.TICKS for k in range(len(units))]
    assert s.clocks == [u[0] - ts.DELAY for u in units if u[1]] and [u[1] for u in units] == [k % ts.ACCESS_EVERY == 0 for k in range(len(units))]


def test_a_lost_packet_is_a_gap():
    media = ts.mux(ts.padded(b"x" * 3000))
    s = ts.demux(media[: 5 * ts.PACKET] + media[6 * ts.PACKET :])
    assert s.gaps == 1 and len(s.units[ts.DATA_PID]) == 1


def test_damage_is_never_raised():
    rng = np.random.default_rng(1)
    for k in range(600):
        media = np.frombuffer(ts.mux(ts.padded(b"abc" * int(rng.integers(0, 3000)))), np.uint8).copy()
        at = rng.integers(0, len(media), int(rng.integers(1, 60)))
        media[at] = rng.integers(0, 256, len(at))
        if k % 3 == 0:
            media = media[: rng.integers(0, len(media))]
        ts.demux(media.tobytes())
    for _ in range(400):  # tables of sound checksums and random bodies
        body = rng.integers(0, 256, int(rng.integers(0, 30)), np.uint8).tobytes()
        ts.demux(ts._table_packet(ts.PAT_PID, ts._section(0, 1, body)) + ts._table_packet(ts.PMT_PID, ts._section(2, 1, body)))
        ts.demux(ts._TABLES[: ts.PACKET] + ts._table_packet(ts.PMT_PID, ts._section(2, 1, body)))


def test_stored_and_read_back(spark):
    rows = [(1, "tea"), (2, None), (3, ""), (4, "tea"), (None, "x" * 70000), (4, "tea")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id bigint, text string, media string, n_bytes int")
    got = ts.media_columns(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    for r in got:
        raw = ts.padded({"1": b"tea", "4": b"tea", "None": b"x" * 70000}.get(str(r["doc_id"]), b""))
        media = ts.mux(raw)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({str(tuple(r)[2:]) for r in got if r["doc_id"] in (1, 4)}) == 1
    assert ts.media_columns(docs.limit(0)).count() == 0
